"""Small inputs with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from sparquill.functions import text as tx
from sparquill.functions import vectors as vx
from sparquill.operators import changes, entities, evaluate, graph, memory, observe, search
from sparquill.plans import steps
from sparquill.streaming import events as stream


def test_search_ranks_the_shorter_match_first(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox jumps"), (2, "A quick brown dog sleeps in the long grass"), (3, "cats purr")], "doc_id long, text string")
    rows = search.bm25(docs, ["quick", "brown"], 2).collect()
    assert [r.id for r in rows] == [1, 2] and rows[0].score > rows[1].score


def test_fusion_prefers_what_both_lists_have(spark):
    a = spark.createDataFrame([(1, 0.9, 0), (2, 0.8, 1), (3, 0.7, 2)], "id long, score double, rank int")
    b = spark.createDataFrame([(2, 0.95, 0), (3, 0.85, 1), (4, 0.75, 2)], "id long, score double, rank int")
    rows = search.reciprocal_rank_fusion([a, b], 4).collect()
    assert rows[0].id == 2 and rows[0].score == 1.0


def test_stems_words_and_jaccard(spark):
    row = spark.range(1).select(
        tx.stem(F.lit("darkness")).alias("a"), tx.stem(F.lit("running")).alias("b"), tx.stem(F.lit("was")).alias("c"),
        tx.set_jaccard(tx.words(F.lit("the quick brown fox")), tx.words(F.lit("the quick brown dog"))).alias("j"), tx.set_jaccard(tx.words(F.lit("")), tx.words(F.lit(" "))).alias("none"),
    ).first()
    assert (row.a, row.b, row.c, row.j, row.none) == ("darknes", "runn", "was", 0.6, 0.0)


def test_chunks(spark):
    row = spark.createDataFrame([("abcdefghijklmnopqrstuvwxyz0123456789",)], "t string").select(tx.cut_fixed(F.col("t"), 10, 3).alias("c")).first()
    assert row.c[0] == "abcdefghij" and row.c[1].startswith("hij") and row.c[-1].endswith("789")
    text = "First sentence. Second sentence! Third sentence? Fourth sentence."
    row = spark.createDataFrame([(text,)], "t string").select(tx.cut_sentences(F.col("t"), 2, 1).alias("c")).first()
    assert row.c == ["First sentence. Second sentence.", "Second sentence. Third sentence.", "Third sentence. Fourth sentence."]


def test_vectors(spark):
    a, b, zero = (F.array(*map(F.lit, v)) for v in ([3.0, 4.0], [4.0, 3.0], [0.0, 0.0]))
    row = spark.range(1).select(vx.cosine(a, b).alias("c"), vx.euclidean(a, b).alias("e"), vx.manhattan(a, b).alias("m"), vx.cosine(a, zero).alias("z"), vx.unit(a).alias("u")).first()
    assert abs(row.c - 0.96) < 1e-12 and abs(row.e - 2**0.5) < 1e-12 and row.m == 2.0 and row.z == 0.0 and row.u == [0.6, 0.8]


def test_retrieval_metrics(spark):
    judged = spark.createDataFrame([("q", i, r) for i, r in enumerate([1, 0, 1, 0, 1])], "query_id string, rank int, relevant int")
    totals = spark.createDataFrame([("q", 3)], "query_id string, total_relevant long")
    row = evaluate.retrieval_metrics(judged, totals, 3).where("query_id = 'q'").first()
    assert (row.precision_at_k, row.recall_at_k, row.reciprocal_rank, row.hit) == (0.666667, 0.666667, 1.0, 1)


def test_changes_and_operations(spark):
    schema = "doc_id long, text string, source string"
    old = spark.createDataFrame([(1, "a", "s"), (2, "b", "s"), (3, "c", "s")], schema)
    new = spark.createDataFrame([(1, "a", "s"), (2, "bb", "t"), (4, "d", "s")], schema)
    assert {(r.doc_id, r.change) for r in changes.detect_changes(old, new).collect()} == {(1, "no_change"), (2, "multiple"), (3, "deleted"), (4, "added")}
    ops = spark.createDataFrame([(None, 1), (7, 2), (7, 1)], "doc_id long, at int")
    assert {(r.doc_id, r["at"]) for r in changes.first_operations(ops).collect()} == {(None, 1), (7, 1)}


def test_graph(spark):
    nodes = spark.createDataFrame([(x,) for x in "1234"], "id string")
    edges = spark.createDataFrame([("1", "2", 0.8), ("2", "3", 0.6), ("1", "4", 0.9), ("1", "9", 1.0)], "src string, dst string, weight double")
    good = graph.valid_edges(nodes, edges)
    assert good.count() == 3
    assert {(r.id, r.steps) for r in graph.reachable(good, "1", 5).collect()} == {("1", 0), ("2", 1), ("4", 1), ("3", 2)}
    assert graph.page_rank(nodes, good, 3).count() == 4


def test_memory_keeps_the_newest(spark):
    turns = spark.createDataFrame([(1, i, "user", "x" * 40) for i in range(6)], "conv_id long, turn long, role string, text string")
    assert sorted(r.turn for r in memory.token_buffer(turns, 50, 20).collect()) == [3, 4, 5]
    assert [r.n for r in memory.summaries(turns, 2).collect()] == [4]


def test_stream_agrees_with_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    counts = stream.windowed_counts(stream.read_events(spark, str(tmp_path / "in"), source.schema), late="400 days")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = source.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert {(str(r.start), r.event_type, r.n) for r in spark.table("counts").collect()} == {(str(r.start), r.event_type, r.n) for r in batch.select("w.start", "event_type", "n").collect()}
    tokens = stream.token_stream(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).collect()
    assert [(r.position, r.token) for r in tokens] == [(0, "a "), (1, "b "), (2, "")]


def test_places_of_a_large_group_are_exact(spark):
    """Hot, tied and null groups, cut into parts and not, against a sort."""
    rows = [("a", float(i * 37 % 1000 // 3)) for i in range(3000)] + [("a", 5.0)] * 900 + [("b", 1.5), ("c", None), (None, 2.0), (None, 4.0)]
    events = spark.createDataFrame(rows, "event_type string, value double")
    n = F.col("n")
    places = {"first": F.lit(0), "middle": F.floor(n / 2), "last": n - 1, "beyond": n}
    want = {}
    for k in {k for k, _ in rows}:
        v = sorted(x for g, x in rows if g == k and x is not None)
        want[k] = (v[0], v[len(v) // 2], v[-1], None) if v else (None,) * 4
    for few in (10, 1_000_000):
        got = observe.at_places(events, places, few=few, parts=7).collect()
        assert {r[0]: tuple(r)[1:] for r in got} == want


def test_entities_keep_the_fixed_patterns_and_long_runs_of_names(spark):
    assert len(entities.PATTERNS) == 15 and len({k for k, _ in entities.PATTERNS}) == 7 and len(entities.CITIES.split("|")) == 108
    text = "Dr. Ada Lovelace McCarthy met the  Big Red Foundation in Austin on 2024-05-06 and paid $1,200.50 for 5 percent of ACME SQL. Paris, TX."
    docs = spark.createDataFrame([(1, text), (2, "Aa " * 200_000), (3, None), (4, "AB " * 100_000), (5, "100," * 100_000)], "doc_id long, text string")
    found = {(r.kind, r.entity) for r in entities.mentions(docs.where("doc_id < 2 or doc_id = 3")).collect()}
    assert {("person", "Dr. Ada Lovelace"), ("organization", "Ada Lovelace McCarthy met the Big Red Foundation"), ("location", "Austin"), ("location", "Paris, TX"), ("datetime", "2024-05-06"), ("money", "$1,200.50"), ("percentage", "5 percent"), ("technical", "ACME SQL"), ("technical", "SQL")} <= found
    long = {(r.kind, r.rule, len(r.entity)): r.mentions for r in entities.mentions(docs.where("doc_id in (2, 4, 5)")).collect()}
    assert long[("person", 0, 5)] == 100_000 and long[("technical", 13, 299_999)] == 1


def test_steps_say_what_they_lack(spark):
    df = spark.createDataFrame([(1, "A  b")], "doc_id long, text string")
    bad = steps.Step("bad", lambda d: d.select("none"))
    out, log = steps.run_steps(df, [bad, steps.Step("needy", lambda d: d, ("other",)), *steps.ingestion(F.length)], go_on=True)
    assert [x[1] == "done" for x in log] == [False, False, True, True, True] and out.first()["chunk"] == "a b"
    with pytest.raises(ValueError):
        steps.run_steps(df, [steps.Step("needy", lambda d: d, ("other",))])
    calls = spark.createDataFrame([("add", 1.0, 2.0), ("divide", 1.0, 0.0), (None, 1.0, 1.0)], "tool string, a double, b double")
    assert [(r["result"], r["error"]) for r in steps.CALCULATOR.call(calls).collect()] == [(3.0, None), (None, "no result"), (None, "unknown tool")]
