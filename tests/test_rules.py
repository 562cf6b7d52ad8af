"""Rules of single metrics on texts that the tables hold none of."""

from sparquill.operators import evaluate, observe, understand


def test_diversity_and_fluency_of_bare_texts(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, " \n "), (4, "One one One two"), (5, "a a a a a a")], "doc_id long, text string")
    assert {r.doc_id: r.diversity for r in evaluate.repetition(docs).collect()} == {1: 0.0, 2: 0.0, 3: 0.5, 4: round((3 / 4 + 0.7) / 2, 6), 5: round(1 / 12, 6)}
    fluency = {r.doc_id: r.fluency for r in evaluate.writing(docs).collect()}
    assert fluency[1] == fluency[2] == 0.0 and fluency[3] == 0.46


def test_intents_fall_back(spark):
    texts = ["What is love", "define it", "how to bake", "one more step please", "apples vs pears", "hello there", "who created it and when did it start", "nothing broken"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: (r.intent, r.intent_score) for r in understand.classified(rows, ["id"]).collect()}
    assert [got[i][0] for i in range(6)] == ["definitional", "definitional", "procedural", "procedural", "comparative", "factual"]
    assert got[5] == ("factual", 0.0) and got[4] == ("comparative", 0.6) and got[6][0] == "factual" and got[6][1] > 0.3 and got[7] == ("troubleshooting", 0.1)


def test_kinds_of_bottlenecks(spark):
    names = {"DB_read": "database", "my_database": "database", "Cache": "cache", "NETWORK": "network", "http_get": "network", "IO": "io", "profile": "io", "else": "memory"}
    events = spark.createDataFrame([(n, 1.0, "2024-01-01") for n in names], "event_type string, value double, day string").selectExpr("event_type", "value", "cast(day as timestamp) as ts")
    assert {r.event_type: r.bottleneck for r in observe.operations(events).collect()} == names


def test_a_query_without_hits_keeps_its_row(spark):
    judged = spark.createDataFrame([(1, 0, 1), (1, 1, 0)], "query_id long, rank int, relevant int")
    totals = spark.createDataFrame([(1, 2), (2, 3), (3, 0)], "query_id long, total_relevant long")
    got = {r.query_id: r for r in evaluate.retrieval_metrics(judged, totals, 10).collect()}
    assert (got[1].precision_at_k, got[1].recall_at_k, got[1].hit) == (0.5, 0.5, 1)
    assert tuple(got[2])[1:] == (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0) and (got[3].recall_at_k, got[3].precision_at_k, got[3].hit) == (1.0, 0.0, 0)
