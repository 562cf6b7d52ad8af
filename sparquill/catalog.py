"""All queries of the engine but those of the llm subpackage, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .functions import vectors as vx
from .operators import caches, changes, entities, evaluate, graph, memory, observe, profile, rerank, search, understand
from .sources.files import html_text, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SEARCH_TERMS = ["with", "la", "thed", "ble"]  # stems, as terms() makes them; "with" is a stop word and never found
ASKED = "vec_id % 20 = 0"  # the query set of vector searches
ONE = "vec_id = 40"  # the query of the fused lists


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# SQL fragments for what the column functions do

# Fixed values, written out once more so that the twin doesn't share an error of the function.
_STOP = """'a','an','and','are','as','at','be','been','by','for','from','has','have','he','in','is','it','its','of','on','that','the','to','was','will','with','this','these','those','i','you',
'we','they','them','their','what','which','who','when','where','why','how','all','would','there','could'"""
_STEM = "CASE " + " ".join(f"WHEN suffix(w, '{s}') AND strlen(w) > {len(s) + 3} THEN left(w, length(w) - {len(s)})" for s in tx.SUFFIXES) + " ELSE w END"
_TERMS = f"""
raw AS (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM documents),
terms AS (SELECT id, {_STEM} AS term FROM raw WHERE strlen(w) BETWEEN 2 AND 50 AND w NOT IN ({_STOP}))"""
_WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')"
_SENTENCES = "list_filter(list_transform(regexp_split_to_array({0}, '[.!?]'), lambda x: trim(x)), lambda x: x <> '')"


def _jaccard_sql(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect(list_distinct({a}), list_distinct({b})))::DOUBLE / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"


# text preparation


@query("SELECT doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS hash, length(text) AS n_chars, trim(text) = '' AS blank FROM documents")
def text_normalize(spark, d):
    x = F.trim(F.regexp_replace(F.lower("text"), "\\s+", " "))
    return read_table(spark, d, "documents").select("doc_id", F.md5(x).alias("hash"), F.char_length("text").cast("long").alias("n_chars"), (F.trim("text") == "").alias("blank"))


@query("""SELECT doc_id, i AS chunk_index, md5(substr(text, i * 448 + 1, 512)) AS hash
FROM (SELECT doc_id, text, unnest(range(0, 1 + ceil(greatest(length(text) - 512, 0) / 448.0)::BIGINT)) AS i FROM documents)""")
def chunk_fixed(spark, d):
    x = read_table(spark, d, "documents").select("doc_id", F.posexplode(tx.cut_fixed(F.col("text"), 512, 64)).alias("chunk_index", "chunk"))
    return x.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("chunk").alias("hash"))


@query(f"""WITH s AS (SELECT doc_id, text, {_SENTENCES.format('text')} AS p FROM documents),
c AS (SELECT doc_id, text, p, unnest(range(0, CASE WHEN len(p) <= 5 THEN 1 ELSE 1 + ceil((len(p) - 5) / 4.0)::BIGINT END)) AS i FROM s)
SELECT doc_id, i AS chunk_index, md5(CASE WHEN len(p) <= 5 THEN text ELSE array_to_string(p[i * 4 + 1 : i * 4 + 5], '. ') || '.' END) AS hash FROM c""")
def chunk_sentences(spark, d):
    x = read_table(spark, d, "documents").select("doc_id", F.posexplode(tx.cut_sentences(F.col("text"), 5, 1)).alias("chunk_index", "chunk"))
    return x.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("chunk").alias("hash"))


@query("""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))) AS hash FROM pages""")
def pages_to_text(spark, d):
    return read_table(spark, d, "pages").select("page_id", F.md5(html_text(F.col("html"))).alias("hash"))


# search


@query(f"WITH {_TERMS} SELECT (SELECT count(*) FROM documents) AS total_docs, count(DISTINCT term) AS unique_terms, round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 6) AS avg_length FROM terms")
def index_statistics(spark, d):
    return search.term_statistics(read_table(spark, d, "documents"))


_BM25 = f"""{_TERMS},
lengths AS (SELECT doc_id AS id, count(term) AS len, {", ".join(f"count(*) FILTER (term = '{q}') AS n{i}" for i, q in enumerate(SEARCH_TERMS))} FROM documents LEFT JOIN terms ON id = doc_id GROUP BY doc_id),
totals AS (SELECT count(*) AS n, avg(len) AS avgdl, {", ".join(f"count(*) FILTER (n{i} > 0) AS df{i}" for i in range(len(SEARCH_TERMS)))} FROM lengths),
scored AS (SELECT id, round(({" + ".join(f"ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * (n{i}::DOUBLE / len) * 2.2 / (n{i}::DOUBLE / len + 1.2 * (1 - 0.75 + 0.75 * len / avgdl))" for i in range(len(SEARCH_TERMS)))}) / {len(SEARCH_TERMS)}, 6) AS score
  FROM lengths, totals WHERE {" OR ".join(f"n{i} > 0" for i in range(len(SEARCH_TERMS)))}),
keyword AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM scored QUALIFY rank < 20)"""


def _keyword(spark, d):
    return search.bm25(read_table(spark, d, "documents"), SEARCH_TERMS, 20)


@query(f"WITH {_BM25} SELECT * FROM keyword")
def bm25_search(spark, d):
    return _keyword(spark, d)


_VEC = "list_transform(embedding, lambda x: x::DOUBLE)"
_METRIC_SQL = {
    "cosine": "coalesce(list_sum(list_transform(list_zip(v, q), lambda z: z[1] * z[2])) / nullif(sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform(q, lambda x: x * x))), 0), 0)",
    "dot": "list_sum(list_transform(list_zip(v, q), lambda z: z[1] * z[2]))",
    "euclidean": "1 / (1 + sqrt(list_sum(list_transform(list_zip(v, q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))))",
    "manhattan": "1 / (1 + list_sum(list_transform(list_zip(v, q), lambda z: abs(z[1] - z[2]))))",
    "clamped": "least(greatest(list_sum(list_transform(list_zip(v, q), lambda z: z[1] * z[2])), 0), 1)",
}


def _knn_sql(metric: str, k: int = 10, asked: str = ASKED) -> str:
    return f"""vectors AS (SELECT vec_id, {_VEC} AS v FROM embeddings), asked AS (SELECT vec_id AS query_id, v AS q FROM vectors WHERE {asked}),
near AS (SELECT query_id, vec_id AS id, round({_METRIC_SQL[metric]}, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank
  FROM vectors JOIN asked ON vec_id <> query_id QUALIFY rank < {k})"""


def _knn(spark, d, metric, k=10, asked=ASKED):
    v = read_table(spark, d, "embeddings")
    return search.knn(v, v.where(asked), k, metric)


for _metric in _METRIC_SQL:
    QUERIES[f"knn_{_metric}"] = lambda spark, d, m=_metric: _knn(spark, d, m)
    ORACLE_SQL[f"knn_{_metric}"] = f"WITH {_knn_sql(_metric)} SELECT * FROM near"


@query(f"WITH vectors AS (SELECT vec_id, {_VEC} AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM vectors) SELECT vec_id, round(list_sum(list_transform(v, lambda x: abs(x / l))), 6) AS l1 FROM n")
def unit_vectors(spark, d):
    v = vx.unit(vx.doubles(F.col("embedding")))
    return read_table(spark, d, "embeddings").select("vec_id", F.round(tx.sum_of(F.transform(v, lambda x: F.abs(x))), 6).alias("l1"))


_LISTS = f"{_BM25}, {_knn_sql('cosine', 20, ONE)}, semantic AS (SELECT id, score, rank FROM near)"


def _semantic(spark, d):
    return _knn(spark, d, "cosine", 20, ONE).select("id", "score", "rank")


@query(f"""WITH {_LISTS}, sums AS (SELECT id, sum(1.0::DOUBLE / (60 + rank + 1)) AS raw FROM (SELECT id, rank FROM keyword UNION ALL SELECT id, rank FROM semantic) GROUP BY id),
fused AS (SELECT id, round(raw / (SELECT max(raw) FROM sums), 6) AS score FROM sums)
SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM fused QUALIFY rank < 10""")
def hybrid_rrf(spark, d):
    return search.reciprocal_rank_fusion([_keyword(spark, d), _semantic(spark, d)], 10)


def _weighted_sql(scaled: str) -> str:
    return f"""WITH {_LISTS}, parts AS (
SELECT id, 0.4::DOUBLE * {scaled} AS part FROM keyword, (SELECT min(score) lo, max(score) hi, avg(score) mean, stddev_pop(score) sd FROM keyword)
UNION ALL SELECT id, 0.6::DOUBLE * {scaled} FROM semantic, (SELECT min(score) lo, max(score) hi, avg(score) mean, stddev_pop(score) sd FROM semantic)),
fused AS (SELECT id, round(sum(part), 6) AS score FROM parts GROUP BY id)
SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM fused QUALIFY rank < 10"""


@query(_weighted_sql("CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE score END"))
def hybrid_min_max(spark, d):
    return search.weighted_fusion([_keyword(spark, d), _semantic(spark, d)], [0.4, 0.6], 10)


@query(_weighted_sql("CASE WHEN sd > 0 THEN (score - mean) / sd ELSE score END"))
def hybrid_z_score(spark, d):
    return search.weighted_fusion([_keyword(spark, d), _semantic(spark, d)], [0.4, 0.6], 10, "z_score")


# evaluation


@query(f"""WITH {_knn_sql('cosine')}, judged AS (SELECT query_id, rank, (a.label = b.label)::INT AS relevant FROM near JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = id),
totals AS (SELECT a.vec_id AS query_id, count(*) AS t FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.{ASKED} GROUP BY 1),
seen AS (SELECT *, sum(relevant) OVER (PARTITION BY query_id ORDER BY rank) AS s FROM judged),
g AS (SELECT query_id, count(*) AS n, sum(relevant) AS hits, sum(relevant * s::DOUBLE / (rank + 1)) AS ap, min(rank) FILTER (relevant = 1) AS first, sum(relevant / log2(rank + 2)) AS dcg FROM seen GROUP BY 1),
m AS (SELECT query_id, t, coalesce(hits, 0) AS hits, coalesce(ap, 0) AS ap, first, coalesce(dcg, 0) AS dcg, coalesce(hits::DOUBLE / least(n, 10), 0) AS p, coalesce(hits, 0)::DOUBLE / t AS r FROM g RIGHT JOIN totals USING (query_id))
SELECT query_id, round(p, 6) AS precision_at_k, round(r, 6) AS recall_at_k, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1_at_k, round(ap / t, 6) AS average_precision,
round(coalesce(1.0::DOUBLE / (first + 1), 0), 6) AS reciprocal_rank, round(dcg / list_sum(list_transform(range(1, least(t, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg_at_k, (hits > 0)::INT AS hit FROM m""")
def retrieval_evaluation(spark, d):
    e = read_table(spark, d, "embeddings").select("vec_id", "label")
    near = _knn(spark, d, "cosine")
    asked = e.where(ASKED).select(F.col("vec_id").alias("query_id"), F.col("label").alias("want"))
    judged = near.join(asked, "query_id").join(e.toDF("id", "label"), "id").select("query_id", "rank", (F.col("label") == F.col("want")).cast("int").alias("relevant"))
    sizes = e.groupBy(F.col("label").alias("want")).agg((F.count(F.lit(1)) - 1).alias("total_relevant"))  # all of the label but the query itself
    totals = asked.join(sizes, "want").select("query_id", "total_relevant")
    return evaluate.retrieval_metrics(judged, totals, 10)


_W = _WORDS.format("text")
_TOXIC = ", ".join(f"'{t}'" for t in evaluate.TOXIC_TERMS)


@query(f"""WITH x AS (SELECT doc_id, text, {_W} AS w, {_SENTENCES.format('text')} AS s, len(string_split(text, '.')) AS parts FROM documents),
r AS (SELECT *, list_sum(list_transform(w, lambda y: greatest(len(regexp_extract_all(lower(y), '[aeiouy]+')), 1)))::DOUBLE / nullif(len(w), 0) AS rate FROM x)
SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(0, least(100, 206.835::DOUBLE - 1.015::DOUBLE * len(w) / parts - 84.6::DOUBLE * rate)) END, 6) AS readability,
round(coalesce(len(list_distinct(w))::DOUBLE / nullif(len(w), 0), 0), 6) AS lexical_diversity,
round(CASE WHEN len(s) < 2 THEN 1 ELSE list_sum(list_transform(range(1, len(s)), lambda i: {_jaccard_sql(_WORDS.format('s[i]'), _WORDS.format('s[i + 1]'))})) / (len(s) - 1) END, 6) AS coherence,
round(coalesce(len(list_filter(w, lambda y: len(list_filter([{_TOXIC}], lambda t: contains(lower(y), t))) > 0))::DOUBLE / nullif(len(w), 0), 0), 6) AS toxicity FROM r""")
def text_quality(spark, d):
    return evaluate.text_quality(read_table(spark, d, "documents"))


@query(f"""WITH a AS (SELECT conv_id, turn, role, text, lag(text) OVER w AS query, lag(role) OVER w AS before, coalesce(lag(text, 2) OVER w, '') AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
x AS (SELECT conv_id, turn, list_distinct({_WORDS.format('lower(query)')}) AS q, list_distinct({_WORDS.format('lower(context)')}) AS c, list_distinct({_WORDS.format('lower(text)')}) AS a FROM a WHERE role = 'assistant' AND before = 'user')
SELECT conv_id, turn, round(coalesce(len(list_intersect(a, c))::DOUBLE / nullif(len(a), 0), 0), 6) AS faithfulness, round({_jaccard_sql('q', 'a')}, 6) AS answer_relevancy, round({_jaccard_sql('q', 'c')}, 6) AS context_relevancy,
round(0.6::DOUBLE * coalesce(len(list_intersect(q, a))::DOUBLE / nullif(len(q), 0), 0) + 0.4::DOUBLE * coalesce(len(list_intersect(c, a))::DOUBLE / nullif(len(c), 0), 0), 6) AS relevance FROM x""")
def answer_evaluation(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    x = read_table(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("answer"), F.lag("text").over(w).alias("query"), F.lag("role").over(w).alias("before"), F.coalesce(F.lag("text", 2).over(w), F.lit("")).alias("context"))
    return evaluate.answer_metrics(x.where((F.col("role") == "assistant") & (F.col("before") == "user")))


# operational events


def _events(spark, d):
    return read_table(spark, d, "events")


@query("SELECT event_type, " + ", ".join(f"sum((value <= {b})::INT)::BIGINT AS le_{b}" for b in (10, 50, 100, 500)) + ", count(value) AS le_inf, round(sum(value), 4) AS total FROM events GROUP BY 1")
def event_histogram(spark, d):
    return observe.histogram(_events(spark, d), (10, 50, 100, 500))


@query("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, min(value) AS low, max(value) AS high,
quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1""")
def event_profile(spark, d):
    return observe.profile(_events(spark, d))


@query("""SELECT event_type, round(avg(value), 6) AS mean, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value) / 1000 * log10(count(*)) * max(value) / avg(value), 6) AS impact FROM events GROUP BY 1 HAVING avg(value) > 10""")
def event_bottlenecks(spark, d):
    return observe.bottlenecks(_events(spark, d), 10)


@query("SELECT event_type, count(*) AS actions, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean_value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1")
def event_activity(spark, d):
    return observe.user_activity(_events(spark, d), "2024-01-10", "2024-01-20")


@query("""WITH x AS (SELECT ts::DATE AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1), y AS (SELECT *, lag(n) OVER (ORDER BY day) AS b FROM x)
SELECT day::VARCHAR AS day, n, total, round(CASE WHEN b > 0 THEN (n - b) * 100.0::DOUBLE / b END, 6) AS growth FROM y""")
def event_daily_trend(spark, d):
    return observe.daily_trend(_events(spark, d))


@query("""WITH f AS (SELECT event_type, quantile_disc(value, 0.25) AS q1, quantile_disc(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_id, event_type, value FROM events JOIN f USING (event_type) WHERE value < q1 - 1.5::DOUBLE * (q3 - q1) OR value > q3 + 1.5::DOUBLE * (q3 - q1)""")
def event_outliers(spark, d):
    return observe.outliers(_events(spark, d))


@query("""WITH x AS (SELECT time_bucket(INTERVAL 60 MINUTES, ts) AS s, count(*) AS n, sum((event_type = 'error')::INT)::BIGINT AS errors FROM events GROUP BY 1)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, n, errors FROM x WHERE errors > 0.3 * n""")
def event_rate_alerts(spark, d):
    return observe.rate_alerts(_events(spark, d), 60, 0.3)


@query("""SELECT event_type, CASE WHEN date_diff('day', ts::DATE, DATE '2024-01-31') > 21 THEN 'delete' WHEN date_diff('day', ts::DATE, DATE '2024-01-31') > 7 THEN 'archive' ELSE 'keep' END AS action, count(*) AS n FROM events GROUP BY 1, 2""")
def event_retention(spark, d):
    return observe.retention(_events(spark, d), "2024-01-31", 7, 21)


@query("""SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND value >= 20 AND json_extract(props, '$.k')::BIGINT >= 3 ORDER BY ts DESC, event_id LIMIT 25 OFFSET 5""")
def event_search(spark, d):
    return observe.search_events(_events(spark, d), "error", 20, "k", 3, 5, 25)


# changes and versions: the second snapshot is made from the first by a rule


def _snapshots(spark, d):
    old = read_table(spark, d, "documents").select("doc_id", "text", "source")
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" x"))).otherwise(F.col("text"))
    source = F.when(F.col("doc_id") % 11 == 0, F.lit("moved")).otherwise(F.col("source"))
    new = old.where(F.col("doc_id") % 13 != 0).select("doc_id", text.alias("text"), source.alias("source"))
    return old, new.union(old.where(F.col("doc_id") % 17 == 0).select(F.col("doc_id") + 10_000_000_000, "text", "source"))


_SNAPSHOTS = """old AS (SELECT doc_id, text, source FROM documents),
new AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || ' x' ELSE text END AS text, CASE WHEN doc_id % 11 = 0 THEN 'moved' ELSE source END AS source FROM old WHERE doc_id % 13 <> 0
  UNION ALL SELECT doc_id + 10000000000, text, source FROM old WHERE doc_id % 17 = 0)"""


@query(f"""WITH {_SNAPSHOTS} SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.text <> n.text AND o.source <> n.source THEN 'multiple'
WHEN o.text <> n.text THEN 'content_changed' WHEN o.source <> n.source THEN 'metadata_changed' ELSE 'no_change' END AS change, coalesce(strlen(n.text), 0) - coalesce(strlen(o.text), 0) AS size_delta
FROM old o FULL JOIN new n ON o.doc_id = n.doc_id""")
def change_detection(spark, d):
    return changes.detect_changes(*_snapshots(spark, d))


@query(f"""WITH {_SNAPSHOTS}, s AS (SELECT 1 AS snapshot, * FROM old UNION ALL SELECT 2, * FROM new), l AS (SELECT doc_id, snapshot, text, lag(text) OVER (PARTITION BY doc_id ORDER BY snapshot) AS b FROM s)
SELECT doc_id, snapshot, row_number() OVER (PARTITION BY doc_id ORDER BY snapshot) AS version FROM l WHERE b IS NULL OR b <> text""")
def version_history(spark, d):
    old, new = _snapshots(spark, d)
    return changes.number_versions(old.select(F.lit(1).alias("snapshot"), "*").union(new.select(F.lit(2).alias("snapshot"), "*")))


@query("""SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS hash, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS version FROM documents WHERE doc_id % 5 <> 0""")
def apply_updates(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    ops = docs.where("doc_id % 5 = 0").select("doc_id", F.lit("delete").alias("op"), F.lit(None).cast("string").alias("text"))
    ops = ops.union(docs.where("doc_id % 5 <> 0 AND doc_id % 3 = 0").select("doc_id", F.lit("update"), F.concat("text", F.lit("!"))))
    out = changes.apply_operations(docs.withColumn("version", F.lit(1).cast("long")), ops)
    return out.select("doc_id", F.md5("text").alias("hash"), "version")


# graph: customers, nations, regions, suppliers, and who supplied whom

_EDGES = """nodes AS (SELECT 'n' || n_nationkey AS id FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region UNION ALL SELECT 's' || s_suppkey FROM supplier),
edges AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 1.0::DOUBLE AS weight FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 0.5::DOUBLE FROM supplier
  UNION ALL SELECT 'r' || r_regionkey, 'n' || n_nationkey, 0.25::DOUBLE FROM region JOIN nation ON r_regionkey = n_regionkey)"""


def _graph(spark, d):
    n, r, s = (read_table(spark, d, k) for k in ("nation", "region", "supplier"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = n.select(key("n", "n_nationkey").alias("id")).union(r.select(key("r", "r_regionkey"))).union(s.select(key("s", "s_suppkey")))
    edges = n.select(key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst"), F.lit(1.0).alias("weight"))
    edges = edges.union(s.select(key("s", "s_suppkey"), key("n", "s_nationkey"), F.lit(0.5))).union(n.select(key("r", "n_regionkey"), key("n", "n_nationkey"), F.lit(0.25)))
    return nodes, edges


@query(f"""WITH {_EDGES}, o AS (SELECT src AS id, count(*) AS out_degree, round(sum(weight), 6) AS out_weight FROM edges GROUP BY 1), i AS (SELECT dst AS id, count(*) AS in_degree FROM edges GROUP BY 1)
SELECT id, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) AS in_degree, coalesce(out_weight, 0) AS out_weight FROM nodes LEFT JOIN o USING (id) LEFT JOIN i USING (id)""")
def graph_degrees(spark, d):
    return graph.degrees(*_graph(spark, d))


_ROUND = "s{1} AS MATERIALIZED (SELECT nodes.id, {2} / (SELECT count(*) FROM nodes) + (1 - {2}) * coalesce(g, 0) AS score FROM nodes LEFT JOIN (SELECT dst, sum(score * part) AS g FROM flows JOIN s{0} ON src = id GROUP BY 1) ON dst = nodes.id)"


def _rank_sql(rounds: int, base: str) -> str:
    steps = ", ".join(_ROUND.format(i, i + 1, base) for i in range(rounds))
    return f"""WITH {_EDGES}, flows AS MATERIALIZED (SELECT src, dst, weight / count(*) OVER (PARTITION BY src) AS part FROM edges), s0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS score FROM nodes),
{steps} SELECT id, round(score, 9) AS score FROM s{rounds}"""


@query(_rank_sql(20, "0.85::DOUBLE"))
def graph_page_rank(spark, d):
    return graph.page_rank(*_graph(spark, d), tolerance=1e-12)  # the base of 0.85 converges in a few rounds


@query(f"""WITH RECURSIVE {_EDGES}, walk AS (SELECT 's1' AS id, 0 AS steps UNION SELECT dst, steps + 1 FROM walk JOIN edges ON src = id WHERE steps < 4) SELECT id, min(steps) AS steps FROM walk GROUP BY 1""")
def graph_reachable(spark, d):
    return graph.reachable(_graph(spark, d)[1], "s1", 4)


@query(f"""WITH {_EDGES} SELECT dst AS id FROM edges WHERE src = 'n3' UNION SELECT src FROM edges WHERE dst = 'n3'""")
def graph_neighbours(spark, d):
    return graph.neighbours(_graph(spark, d)[1], "n3")


@query(f"""WITH {_EDGES}, o AS (SELECT id, count(dst) AS k FROM nodes LEFT JOIN edges ON src = id GROUP BY 1)
SELECT count(*) AS nodes, sum(k)::BIGINT AS edges, round(sum(k)::DOUBLE / (count(*) * (count(*) - 1)), 9) AS density, round(sum(k)::DOUBLE / count(*), 6) AS mean_degree, max(k) AS max_degree FROM o""")
def graph_metrics(spark, d):
    return graph.metrics(*_graph(spark, d))


# conversation memory


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def memory_last_turns(spark, d):
    return memory.last_turns(read_table(spark, d, "conversations"), 3)


@query("""WITH x AS (SELECT conv_id, turn, strlen(text) // 4 AS tokens, sum(strlen(text) // 4) OVER (PARTITION BY conv_id) AS total, sum(strlen(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS kept FROM conversations)
SELECT conv_id, turn, tokens FROM x WHERE total <= 400 OR kept <= 300""")
def memory_token_buffer(spark, d):
    return memory.token_buffer(read_table(spark, d, "conversations"), 400, 100)


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id, count(*) AS n, sum(strlen(text) // 4)::BIGINT AS tokens, min(turn) AS first, max(turn) AS last FROM x WHERE back > 2 GROUP BY 1""")
def memory_summaries(spark, d):
    return memory.summaries(read_table(spark, d, "conversations"), 2)


# re-ranking

_QUALITY = f"""((CASE WHEN strlen(text) > 100 AND strlen(text) < 5000 THEN 1 ELSE 0.5::DOUBLE END) + (CASE WHEN strlen(text) > 3 * greatest(len(w), 1) AND strlen(text) < 15 * greatest(len(w), 1) THEN 1 ELSE 0.7::DOUBLE END)
 + (CASE WHEN len(w) > 5 * len(string_split(text, '.')) AND len(w) < 30 * len(string_split(text, '.')) THEN 1 ELSE 0.8::DOUBLE END)) / 3"""
RERANK_QUERY = "the of and with la de"
_SIGNALS = f"""x AS (SELECT doc_id, text, {_W} AS w, {RERANK_QUERY.split()!r} AS q FROM documents),
s AS (SELECT doc_id, 'overlap' AS signal, {_jaccard_sql('w', 'q')} AS value FROM x UNION ALL SELECT doc_id, 'quality', {_QUALITY} FROM x UNION ALL SELECT doc_id, 'length', len(w)::DOUBLE FROM x)"""
_COMBINE = "SELECT doc_id, round(sum(value * CASE signal WHEN 'overlap' THEN 0.5::DOUBLE WHEN 'quality' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END), 6) AS score, round(1 - least(stddev_pop(value), 1), 6) AS confidence FROM z GROUP BY 1"


def _rerank(spark, d, how):
    values = rerank.scaled(rerank.signals(read_table(spark, d, "documents").select("doc_id", "text"), RERANK_QUERY), how)
    return rerank.combined(values, {"overlap": 0.5, "quality": 0.3, "length": 0.2})


@query(f"WITH {_SIGNALS}, z AS (SELECT doc_id, signal, CASE WHEN max(value) OVER p > min(value) OVER p THEN (value - min(value) OVER p) / (max(value) OVER p - min(value) OVER p) ELSE value END AS value FROM s WINDOW p AS (PARTITION BY signal)) {_COMBINE}")
def rerank_min_max(spark, d):
    return _rerank(spark, d, "min_max")


@query(f"WITH {_SIGNALS}, z AS (SELECT doc_id, signal, 1 / (1 + exp(-CASE WHEN stddev_pop(value) OVER p > 0 THEN (value - avg(value) OVER p) / stddev_pop(value) OVER p ELSE 0 END)) AS value FROM s WINDOW p AS (PARTITION BY signal)) {_COMBINE}")
def rerank_z_score(spark, d):
    return _rerank(spark, d, "z_score")


# query understanding, over the users' turns

_LOW = _WORDS.format("lower(text)")


@query(f"""WITH x AS (SELECT conv_id, turn, text, {_W} AS w, {_LOW} AS l FROM conversations WHERE role = 'user'),
r AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(CASE WHEN regexp_matches(text, '\\bteh\\b') THEN regexp_replace(text, '\\bteh\\b', 'the', 'g') WHEN regexp_matches(text, '\\badn\\b') THEN regexp_replace(text, '\\badn\\b', 'and', 'g') ELSE regexp_replace(text, '\\bwat\\b', 'what', 'g') END,
 'ML', 'machine learning'), 'AI', 'artificial intelligence'), 'NLP', 'natural language processing'), 'API', 'application programming interface'), 'UI', 'user interface'), 'UX', 'user experience'), '!+', '!', 'g'), '\\?+', '?', 'g'), ' +', ' ', 'g')) AS t FROM x)
SELECT conv_id, turn, CASE WHEN contains(text, '?') THEN 'question' WHEN len(w) <= 3 THEN 'keyword' WHEN len(w) > 10 THEN 'phrase' ELSE 'statement' END AS kind,
round(least(1, 0.3::DOUBLE * least(len(l) / 20.0::DOUBLE, 1) + least(0.1::DOUBLE * len(list_filter(l, lambda y: y IN ('what', 'how', 'why', 'when', 'where', 'who', 'which'))), 0.3::DOUBLE)
 + least(0.15::DOUBLE * len(list_filter(l, lambda y: y IN ('and', 'or', 'but', 'also'))), 0.3::DOUBLE) + CASE WHEN length(text) - length(replace(text, '?', '')) > 1 THEN 0.2::DOUBLE ELSE 0 END), 6) AS complexity,
md5(upper(left(t, 1)) || substr(t, 2)) AS rewritten, md5(regexp_replace(regexp_replace(text, '\\b[0-9]+\\b', '{{NUM}}', 'g'), '"[^"]*"', '{{STR}}', 'g')) AS template FROM r""")
def query_understanding(spark, d):
    return understand.understand(read_table(spark, d, "conversations").where("role = 'user'"), ["conv_id", "turn"])


@query("""WITH x AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(lower(text), ' and | or | but | also '), lambda x: trim(x)), lambda x: x <> '')[1:5] AS p FROM conversations WHERE role = 'user'),
y AS (SELECT conv_id, turn, p, unnest(range(0, len(p))) AS part FROM x) SELECT conv_id, turn, part, md5(p[part + 1]) AS sub_query FROM y""")
def query_parts(spark, d):
    return understand.parts(read_table(spark, d, "conversations").where("role = 'user'"), ["conv_id", "turn"])


# profiles

_PROFILED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_nulls, count(DISTINCT {c}) AS n_distinct, min({c}::VARCHAR) AS low, max({c}::VARCHAR) AS high FROM orders" for c in _PROFILED))
def table_profile(spark, d):
    return profile.columns(read_table(spark, d, "orders"), _PROFILED)


@query("""WITH v AS (SELECT unnest([event_type, ts::VARCHAR, value::VARCHAR, 'true', '']) AS x FROM events)
SELECT CASE WHEN trim(x) = '' THEN 'string' WHEN regexp_full_match(trim(x), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN 'number' WHEN regexp_matches(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date'
WHEN lower(trim(x)) IN ('true', 'false', 'yes', 'no') THEN 'boolean' ELSE 'string' END AS kind, count(*) AS n FROM v GROUP BY 1""")
def value_types(spark, d):
    x = read_table(spark, d, "events").select(F.explode(F.array("event_type", F.col("ts").cast("string"), F.col("value").cast("string"), F.lit("true"), F.lit(""))).alias("x"))
    return x.groupBy(profile.column_type(F.col("x")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# DuckDB's levenshtein counts bytes, so the twin puts a control sign for each letter beyond ASCII that the table has
_LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_SIGNS = " || ".join(f"chr({n})" for n in [*range(1, 9), *range(14, 27)])


@query(f"""WITH c AS (SELECT conv_id, turn, strlen(text) AS n, translate(text, '{_LETTERS}', {_SIGNS}) AS text FROM conversations), p AS (SELECT conv_id, turn, text AS a, n, lag(text) OVER w AS b, lag(n) OVER w AS m FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), x AS (SELECT *, {_WORDS.format('a')} AS wa, {_WORDS.format('b')} AS wb FROM p WHERE b IS NOT NULL)
SELECT conv_id, turn, round({_jaccard_sql('wa', 'wb')}, 6) AS jaccard, round(levenshtein(a, b)::DOUBLE / greatest(n, m), 6) AS edit, round(coalesce(len(list_filter(wa, lambda t: list_contains(wb, t)))::DOUBLE / nullif(len(wa), 0), 0), 6) AS bleu_1 FROM x""")
def text_pairs(spark, d):
    from pyspark.sql import Window

    b = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    x = read_table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("a"), b.alias("b")).where("b IS NOT NULL")
    return profile.pair_likeness(x, ["conv_id", "turn"])


# RE2 takes letters beyond ASCII for ends of words, so they become a sign that words hold
@query("WITH t AS (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F\\p{Z}\\p{P}\\p{S}\\p{C}]', '_', 'g') AS text FROM documents), e AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {i} AS rule, unnest(regexp_extract_all(text, '{p}')) AS entity FROM t" for i, (k, p) in enumerate(entities.PATTERNS))
       + ") SELECT kind, rule, regexp_replace(entity, '\\s+', ' ', 'g') AS entity, count(*) AS mentions, count(DISTINCT doc_id) AS documents FROM e GROUP BY ALL")
def entity_mentions(spark, d):
    return entities.mentions(read_table(spark, d, "documents"))


@query(f"""WITH v AS (SELECT vec_id, {_VEC} AS v FROM embeddings), s AS (SELECT *, list_min(v) AS lo, (list_max(v) - list_min(v)) / 255 AS sc FROM v),
b AS (SELECT vec_id, list_transform(v, lambda e: abs(e - (CASE WHEN sc > 0 THEN round((e - lo) / sc) ELSE 0 END * sc + lo))) AS e FROM s) SELECT vec_id, round(list_max(e), 6) AS max_error, round(list_sum(e) / len(e), 6) AS mean_error FROM b""")
def vector_quantisation(spark, d):
    return profile.quantised(read_table(spark, d, "embeddings"))


@query("""WITH f AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS place FROM embeddings), m AS (SELECT label, place, avg(x) AS m, count(*) AS n FROM f GROUP BY 1, 2)
SELECT label, max(n) AS size, round(sqrt(sum(m * m)), 6) AS norm FROM m GROUP BY 1""")
def vector_centroids(spark, d):
    return profile.centroids(read_table(spark, d, "embeddings"))


# caches and sessions

_AS_OF = "2024-01-31 00:00:00"
_ENTRIES = f"""c AS (SELECT user_id, event_type, count(*) AS accesses, avg(value) AS size, epoch(TIMESTAMP '{_AS_OF}')::BIGINT - floor(epoch(max(ts)))::BIGINT AS idle, epoch(TIMESTAMP '{_AS_OF}')::BIGINT - floor(epoch(min(ts)))::BIGINT AS age FROM events GROUP BY 1, 2)"""


def _register_evictions():
    keys = {"lru": "-idle::DOUBLE", "lfu": "accesses::DOUBLE", "gdsf": "(log2(accesses) + 1) / greatest(size, 1) / (age + 1) * 1000000"}
    for policy, key in keys.items():
        QUERIES[f"cache_{policy}"] = lambda spark, d, p=policy: caches.eviction_order(caches.entries(_events(spark, d), _AS_OF), p, 30)
        then = "idle, " if policy == "lfu" else ""
        ORACLE_SQL[f"cache_{policy}"] = f"WITH {_ENTRIES} SELECT user_id, event_type, round({key}, 6) AS priority FROM c ORDER BY priority, {then}user_id, event_type LIMIT 30"


_register_evictions()


@query(f"WITH {_ENTRIES} SELECT event_type, count(*) AS entries, count(*) FILTER (idle > 86400) AS expired, sum(accesses)::BIGINT AS accesses FROM c GROUP BY 1")
def cache_expired(spark, d):
    return caches.expired(caches.entries(_events(spark, d), _AS_OF), 86400)


@query("SELECT user_id, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20")
def popular_users(spark, d):
    return caches.popular(_events(spark, d), 20)


@query("""WITH x AS (SELECT *, CASE WHEN floor(epoch(ts))::BIGINT - floor(epoch(lag(ts) OVER w))::BIGINT <= 3600 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM x) SELECT user_id, session, count(*) AS n, round(sum(value), 4) AS total FROM y GROUP BY 1, 2""")
def event_sessions(spark, d):
    return caches.sessions(_events(spark, d), 60)


@query("""WITH x AS (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM events)
SELECT event_id, previous FROM x WHERE event_type = 'purchase'""")
def event_as_of(spark, d):
    return caches.state_before(_events(spark, d), "purchase", "click")


# more of events, graphs and vectors


@query("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(avg(value) - 1.96::DOUBLE * stddev_pop(value) / sqrt(count(value)), 6) AS low,
round(avg(value) + 1.96::DOUBLE * stddev_pop(value) / sqrt(count(value)), 6) AS high FROM events GROUP BY 1""")
def event_summary(spark, d):
    return observe.summary(_events(spark, d))


@query("""WITH g AS (SELECT event_type, date_diff('day', DATE '2024-01-01', ts::DATE) AS x, count(*) AS y FROM events GROUP BY 1, 2),
l AS (SELECT event_type, regr_slope(y, x) AS s, regr_intercept(y, x) AS b, regr_r2(y, x) AS r, max(x) AS m FROM g GROUP BY 1)
SELECT event_type, step::INT AS step, round(b + s * (m + step), 6) AS expected, round(r, 6) AS strength FROM l, range(1, 6) t(step)""")
def event_forecast(spark, d):
    return observe.forecast(_events(spark, d), 5)


@query("""WITH g AS (SELECT user_id, arg_max(value, (ts, event_id)) AS last, avg(value) AS mean, stddev_pop(value) AS sd, count(value) AS n FROM events GROUP BY 1)
SELECT user_id, round(last, 6) AS last, n >= 10 AND sd > 0 AND abs(last - mean) > 1.5::DOUBLE * sd AS anomaly FROM g""")
def event_anomalies(spark, d):
    return observe.anomalies(_events(spark, d), 1.5)


@query(f"""WITH RECURSIVE {_EDGES}, walk AS (SELECT 's1' AS id, 0.0::DOUBLE AS total, 0 AS k, 's1' AS way UNION SELECT dst, total + 1 / greatest(weight, 0.001), k + 1, way || '>' || dst FROM walk JOIN edges ON src = id WHERE k < 4), b AS (SELECT id, min(struct_pack(t := total, w := string_split(way, '>'))) AS b FROM walk GROUP BY 1)
SELECT id, round(b.t, 6) AS cost, len(b.w)::INT - 1 AS hops, array_to_string(b.w, '>') AS way FROM b""")
def graph_cheapest(spark, d):
    return graph.cheapest(_graph(spark, d)[1], "s1", 4)


@query("""WITH a AS (SELECT 'n' || n_nationkey AS id, n_name AS label FROM nation), b AS (SELECT 'n' || s_nationkey AS id, min(s_name) AS label FROM supplier GROUP BY 1 UNION ALL SELECT 'r' || r_regionkey, r_name FROM region)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)""")
def graph_merge(spark, d):
    n, r, s = (read_table(spark, d, k) for k in ("nation", "region", "supplier"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("id")
    other = s.groupBy(key("n", "s_nationkey")).agg(F.min("s_name").alias("label")).union(r.select(key("r", "r_regionkey"), "r_name"))
    return graph.merge_nodes(n.select(key("n", "n_nationkey"), F.col("n_name").alias("label")), other)


@query(f"WITH {_knn_sql('cosine')} SELECT * FROM near WHERE score >= 0.3")
def semantic_cache_hits(spark, d):
    v = read_table(spark, d, "embeddings")
    return search.knn(v, v.where(ASKED), 10, "cosine", 0.3)


FLAGSHIP = bm25_search

from . import catalog_alerts, catalog_entities, catalog_lookup, catalog_more, catalog_texts  # noqa: E402, F401  they register their queries
