"""More queries, with their SQL twins: storage, tables in text, text and answer metrics, re-ranking, query understanding, graphs, changes, alerts, caches, vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import _AS_OF, _BM25, _EDGES, _ENTRIES, _SNAPSHOTS, _VEC, ASKED, ONE, _events, _graph, _jaccard_sql, _keyword, _knn_sql, _snapshots, _WORDS, _semantic, query  # noqa: PLC2701
from .functions import text as tx
from .functions import vectors as vx
from .operators import caches, changes, evaluate, graph, observe, profile, rerank, search, storage, understand
from .sources import tables
from .sources.files import read_table

# text preparation


@query("""WITH p AS (SELECT doc_id, replace(text, '. ', chr(10) || chr(10)) AS t FROM documents), s AS (SELECT doc_id, t, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM p),
c AS (SELECT doc_id, t, p, unnest(range(0, CASE WHEN len(p) <= 4 THEN 1 ELSE ceil(len(p) / 4.0)::BIGINT END)) AS i FROM s)
SELECT doc_id, i AS chunk_index, md5(CASE WHEN len(p) <= 4 THEN t ELSE array_to_string(p[i * 4 + 1 : i * 4 + 4], chr(10) || chr(10)) END) AS hash FROM c""")
def chunk_paragraphs(spark, d):
    t = F.replace(F.col("text"), F.lit(". "), F.lit("\n\n"))  # the documents have no blank lines of their own
    x = read_table(spark, d, "documents").select("doc_id", F.posexplode(tx.cut_paragraphs(t, 4)).alias("chunk_index", "chunk"))
    return x.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("chunk").alias("hash"))


@query("""WITH c AS (SELECT doc_id, text, unnest(range(0, 1 + ceil(greatest(length(text) - 512, 0) / 448.0)::BIGINT)) AS i FROM documents), x AS (SELECT doc_id, i, substr(text, i * 448 + 1, 512) AS t FROM c)
SELECT doc_id, i AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS chunk_total, (sum(strlen(t)) OVER (PARTITION BY doc_id ORDER BY i) - strlen(t))::BIGINT AS start, doc_id || '_' || i AS id FROM x""")
def chunk_positions(spark, d):
    x = read_table(spark, d, "documents").select("doc_id", F.posexplode(tx.cut_fixed(F.col("text"), 512, 64)).alias("chunk_index", "chunk"))
    w = Window.partitionBy("doc_id")
    n = F.octet_length("chunk")
    x = x.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.count(F.lit(1)).over(w).alias("chunk_total"), (F.sum(n).over(w.orderBy("chunk_index")) - n).cast("long").alias("start"))
    return storage.chunk_keys(x)


@query("""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g'))) AS plain, md5(replace(substr(text, 3, 40), 'the', 'a')) AS shaped FROM documents""")
def text_prepared(spark, d):
    t = F.col("text")
    return read_table(spark, d, "documents").select("doc_id", F.md5(tx.prepared(t, ("lower", "plain", "spaces"))).alias("plain"), F.md5(tx.prepared(F.substring(t, 3, 40), (("the", "a"),))).alias("shaped"))


@query("""WITH g AS (SELECT doc_id, substr(text, i, 3) AS g FROM (SELECT doc_id, text, unnest(range(1, greatest(length(text) - 3 + 2, 1))) AS i FROM documents WHERE length(text) >= 3)) SELECT doc_id, count(*) AS n, count(DISTINCT g) AS kinds FROM g WHERE trim(g, ' ') <> '' GROUP BY 1""")
def char_grams(spark, d):
    return profile.gram_counts(read_table(spark, d, "documents"), 3)


@query("SELECT page_id, md5(string_split(html, '<')[1] || coalesce(array_to_string(list_transform(string_split(html, '<')[2:], lambda p: CASE WHEN contains(p, '>') THEN substr(p, instr(p, '>') + 1) ELSE '' END), ''), '')) AS hash FROM pages")
def pages_without_tags(spark, d):
    return read_table(spark, d, "pages").select("page_id", F.md5(tables.without_tags(F.col("html"))).alias("hash"))


# storage: documents and pages under keys

_STORE = """store AS (SELECT 'document' AS entry_type, coalesce(source, '') AS namespace, 'd' || doc_id AS id, md5(text) AS content FROM documents UNION ALL SELECT 'page', '', 'p' || page_id, md5(html) FROM pages)"""


def _store(spark, d):
    docs, pages = read_table(spark, d, "documents"), read_table(spark, d, "pages")
    x = docs.select(F.lit("document").alias("entry_type"), F.col("source").alias("namespace"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.md5("text").alias("content"))
    return x.union(pages.select(F.lit("page"), F.lit(None).cast("string"), F.concat(F.lit("p"), F.col("page_id").cast("string")), F.md5("html")))


@query(f"WITH {_STORE} SELECT entry_type, namespace, id FROM store WHERE entry_type = 'document' AND starts_with(id, 'd1') ORDER BY ALL LIMIT 40 OFFSET 5")
def storage_keys(spark, d):
    return storage.list_keys(_store(spark, d), "document", None, "d1", 5, 40)


@query(f"WITH {_STORE} SELECT doc_id AS place, 'document' AS entry_type, coalesce(source, '') AS namespace, 'd' || (doc_id * 3) AS id, s.content FROM documents LEFT JOIN store s ON s.entry_type = 'document' AND s.namespace = coalesce(source, '') AND s.id = 'd' || (doc_id * 3)")
def storage_lookup(spark, d):
    wanted = read_table(spark, d, "documents").select(F.col("doc_id").alias("place"), F.lit("document").alias("entry_type"), F.col("source").alias("namespace"), F.concat(F.lit("d"), (F.col("doc_id") * 3).cast("string")).alias("id"))
    return storage.get_many(_store(spark, d), wanted)


def _batch(spark, d):
    docs = read_table(spark, d, "documents").where("doc_id % 4 = 0")
    rows = docs.select(F.lit("document").alias("entry_type"), F.col("source").alias("namespace"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.lit(1).alias("place"), F.lit("first").alias("content"))
    return rows.union(rows.withColumn("place", F.lit(2)).withColumn("content", F.lit("last"))).union(rows.withColumn("id", F.concat("id", F.lit("new"))))


@query(f"""WITH {_STORE}, b AS (SELECT 'document' AS entry_type, coalesce(source, '') AS namespace, 'd' || doc_id AS id FROM documents WHERE doc_id % 4 = 0)
SELECT s.* FROM store s ANTI JOIN b USING (entry_type, namespace, id) UNION ALL SELECT *, 'last' FROM b UNION ALL SELECT entry_type, namespace, id || 'new', 'first' FROM b""")
def storage_put(spark, d):
    return storage.put_many(_store(spark, d), _batch(spark, d))


@query(f"WITH {_STORE}, k AS (SELECT s.* FROM store s ANTI JOIN (SELECT 'document' AS entry_type, coalesce(source, '') AS namespace, 'd' || doc_id AS id FROM documents WHERE doc_id % 4 = 0) b USING (entry_type, namespace, id)) SELECT entry_type, count(*) AS n, count(*) * 1024 AS bytes FROM k GROUP BY 1")
def storage_stats(spark, d):
    return storage.stats(storage.delete_many(_store(spark, d), _batch(spark, d)))


@query("SELECT count(*) AS removed FROM documents WHERE doc_id % 4 = 0")
def storage_removed(spark, d):
    return storage.removed(_store(spark, d), _batch(spark, d))


@query("""WITH c AS (SELECT doc_id, unnest(range(0, 1 + ceil(greatest(length(text) - 512, 0) / 448.0)::BIGINT)) AS i FROM documents WHERE doc_id % 6 <> 0)
SELECT (SELECT count(*) FROM documents WHERE doc_id % 6 <> 0) AS documents, count(*) AS chunks FROM c""")
def index_removal(spark, d):
    docs = read_table(spark, d, "documents")
    chunks = docs.select("doc_id", F.explode(tx.cut_fixed(F.col("text"), 512, 64)).alias("chunk"))
    left, parts = storage.remove_documents(docs, chunks, docs.where("doc_id % 6 = 0"))
    return left.agg(F.count(F.lit(1)).alias("documents")).join(parts.agg(F.count(F.lit(1)).alias("chunks")))  # one row each


@query("SELECT count(*) AS items, max(len(embedding)) AS dimensions, count(*) * max(len(embedding)) * 4 AS bytes FROM embeddings")
def index_size(spark, d):
    return storage.index_stats(read_table(spark, d, "embeddings"))


@query("""WITH b AS (SELECT a.doc_id, a.text, e.embedding FROM documents a JOIN embeddings e ON a.doc_id = e.vec_id WHERE a.lang = 'en' AND a.source IS NOT NULL)
SELECT doc_id, strlen(text) AS size, len(embedding) AS dimensions FROM b""")
def index_load(spark, d):
    meta = read_table(spark, d, "documents").select("doc_id", "text", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("meta"))
    kept = search.matching(meta, {"lang": "en"}).where(F.col("meta")["source"].isNotNull())
    x = kept.join(read_table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")
    return x.select("doc_id", F.octet_length("text").cast("long").alias("size"), F.size("embedding").cast("long").alias("dimensions"))


# tables in text: rows of customers spelled as delimited text and as pipe tables


def _csv_rows(spark, d):
    c = read_table(spark, d, "customer")
    line = F.concat_ws(";", F.col("c_custkey").cast("string"), F.concat(F.lit('"'), "c_name", F.lit('"')), F.when(F.col("c_custkey") % 5 == 0, F.lit("a;b")).otherwise(F.col("c_mktsegment")))
    return c.select(F.col("c_custkey").alias("k"), F.concat(F.lit("key;name;segment\n"), line, F.lit("\n\n")).alias("t"))


@query("""SELECT c_custkey AS id, 0 AS row, i::INT AS "column", ['key', 'name', 'segment'][i + 1] AS header, [c_custkey::VARCHAR, c_name, c_mktsegment][i + 1] AS value FROM customer, range(3) r(i) WHERE c_custkey % 5 <> 0""")
def table_delimited(spark, d):
    return tables.delimited_cells(_csv_rows(spark, d), "k", "t")


@query("""SELECT c_custkey AS id, 3 AS line, i::INT AS "column", ['Key', 'Name'][i + 1] AS header, [c_custkey::VARCHAR, c_name][i + 1] AS value FROM customer, range(2) r(i) WHERE c_custkey % 3 <> 0""")
def table_pipes(spark, d):
    c = read_table(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 3 == 0, F.lit(" ")).otherwise(F.col("c_name"))  # a blank cell loses its row
    t = F.concat(F.lit("Intro\n| Key | Name |\n|-----|:----:|\n| "), F.col("c_custkey").cast("string"), F.lit(" | "), name, F.lit(" |\n\nend"))
    return tables.pipe_cells(c.select(F.col("c_custkey").alias("k"), t.alias("t")), "k", "t").withColumn("line", F.col("line"))


@query("""WITH t AS (SELECT 'csv' AS format, ';' AS delimiter, count(*) AS n FROM customer UNION ALL SELECT 'html', NULL, count(*) FROM customer UNION ALL SELECT 'unknown', ',', count(*) FROM customer) SELECT format, n FROM t""")
def table_formats(spark, d):
    rows = _csv_rows(spark, d).select("t").union(read_table(spark, d, "customer").select(F.concat(F.lit("<table><tr>"), "c_name"))).union(read_table(spark, d, "customer").select(F.lit("plain")))
    return rows.groupBy(tables.table_format(F.col("t")).alias("format")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE regexp_extract(url || (['.pdf', '.DOCX', '.htm', '.md', '.zip'])[(page_id % 5 + 1)::INT], '\\.([^./]+)$', 1) WHEN 'pdf' THEN 'pdf' WHEN 'DOCX' THEN 'word' WHEN 'htm' THEN 'html' WHEN 'md' THEN 'markdown' ELSE 'mixed' END AS kind, count(*) AS n FROM pages GROUP BY 1""")
def file_kinds(spark, d):
    end = F.get(F.array(*map(F.lit, (".pdf", ".DOCX", ".htm", ".md", ".zip"))), (F.col("page_id") % 5).cast("int"))
    return read_table(spark, d, "pages").groupBy(tables.file_kind(F.concat("url", end)).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# text and answer metrics

_PAIRS = f"p AS (SELECT conv_id, turn, {_WORDS.format('text')} AS a, {_WORDS.format('lag(text) OVER (PARTITION BY conv_id ORDER BY turn)')} AS b FROM conversations QUALIFY lag(text) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL)"
_CNT = "len(list_filter({0}, lambda y: y = x))::DOUBLE"


def _turn_pairs(spark, d):
    b = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return read_table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("a"), b.alias("b")).where("b IS NOT NULL")


@query(f"""WITH {_PAIRS}, g AS (SELECT conv_id, turn, a, b, list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]) AS ga, list_transform(range(1, len(b)), lambda i: b[i] || ' ' || b[i + 1]) AS gb FROM p)
SELECT conv_id, turn, round(coalesce(list_sum(list_transform(list_intersect(a, b), lambda x: {_CNT.format('a')} * {_CNT.format('b')})) / (sqrt(list_sum(list_transform(list_distinct(a), lambda x: {_CNT.format('a')} * {_CNT.format('a')}))) * sqrt(list_sum(list_transform(list_distinct(b), lambda x: {_CNT.format('b')} * {_CNT.format('b')})))), 0), 6) AS cosine,
round(coalesce(len(list_filter(ga, lambda x: list_contains(gb, x)))::DOUBLE / nullif(len(ga), 0), 0), 6) AS bleu_2,
round(exp(-list_sum(list_transform(list_distinct(a), lambda x: {_CNT.format('a')} / len(a) * ln({_CNT.format('a')} / len(a)))) / len(list_distinct(a))), 6) AS entropy_rate FROM g""")
def text_pair_metrics(spark, d):
    return evaluate.pair_metrics(_turn_pairs(spark, d), ["conv_id", "turn"]).select("conv_id", "turn", "cosine", "bleu_2", "entropy_rate")


@query()
def text_common_words(spark, d):
    return evaluate.pair_metrics(_turn_pairs(spark, d), ["conv_id", "turn"]).select("conv_id", "turn", "common", "rouge_l")


_TRUTH = "t AS (SELECT conv_id, turn, text AS answer, lag(text) OVER w AS query, coalesce(lag(text, 2) OVER w, '') AS context, coalesce(lead(text) OVER w, '') AS truth, role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"
_D = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda x: x <> ''))"


def _inter(a, b):
    return f"len(list_intersect({a}, {b}))::DOUBLE"


@query(f"""WITH {_TRUTH}, x AS (SELECT conv_id, turn, {_D.format('query')} AS q, {_D.format('context')} AS c, {_D.format('truth')} AS t, {_D.format('answer')} AS a, list_transform(string_split(truth, '.'), lambda s: {_WORDS.format('lower(s)')}) AS parts FROM t WHERE role = 'assistant' AND query IS NOT NULL)
SELECT conv_id, turn, round(len(list_filter(parts, lambda w: len(w) > 0 AND len(list_filter(w, lambda z: list_contains(c, z)))::DOUBLE / len(w) >= 0.7))::DOUBLE / len(parts), 6) AS context_recall,
round(coalesce({_inter('q', 'c')} / nullif(len(q), 0), 0), 6) AS query_cover, (coalesce({_inter('q', 'c')} / nullif(len(q), 0), 0) >= 0.5)::INT AS context_precision, round({_jaccard_sql('a', 't')}, 6) AS similarity,
round(least(0.75::DOUBLE * coalesce({_inter('a', 't')} / nullif(len(t), 0), 0) + 0.25::DOUBLE * {_jaccard_sql('a', 't')}, 1), 6) AS correctness, round(coalesce({_inter('a', 'c')} / nullif(len(a), 0), 0), 6) AS factual FROM x""")
def answer_quality(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = read_table(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("answer"), F.lag("text").over(w).alias("query"), F.coalesce(F.lag("text", 2).over(w), F.lit("")).alias("context"), F.coalesce(F.lead("text").over(w), F.lit("")).alias("truth"))
    return evaluate.answer_quality(x.where("role = 'assistant' AND query IS NOT NULL"), ["conv_id", "turn"])


@query(f"""WITH x AS (SELECT doc_id, text, {_WORDS.format('text')} AS w, len(string_split(text, '.')) AS s FROM documents)
SELECT doc_id, round(CASE WHEN text = '' OR text IS NULL THEN 0 ELSE 0.4::DOUBLE * CASE WHEN len(w)::DOUBLE / s BETWEEN 5 AND 25 THEN 1 ELSE 0.7::DOUBLE END + 0.3::DOUBLE * CASE WHEN regexp_matches(text, '[.!?]') AND regexp_matches(text, '\\p{{Lu}}') THEN 1 ELSE 0.6::DOUBLE END + 0.3::DOUBLE * coalesce(len(list_distinct(w))::DOUBLE / nullif(len(w), 0), 0) END, 6) AS fluency,
round(coalesce(len(list_distinct(w))::DOUBLE / nullif(len(w), 0), 0), 6) AS variety,
round(coalesce(len(list_filter(w, lambda y: regexp_matches(lower(y), 'always|never|all|none|everyone|nobody|obviously|clearly|definitely|certainly')))::DOUBLE / nullif(len(w), 0), 0), 6) AS bias FROM x""")
def text_writing(spark, d):
    return evaluate.writing(read_table(spark, d, "documents"))


@query(f"""WITH x AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS w FROM documents), g AS (SELECT doc_id, w, count(*) AS n FROM x GROUP BY 1, 2), s AS (SELECT doc_id, count(*)::DOUBLE / sum(n) AS kinds, max(n) AS most FROM g GROUP BY 1)
SELECT doc_id, round(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE (coalesce(kinds, 0) + greatest(0, 1 - 0.3::DOUBLE * (coalesce(most, 1) - 1))) / 2 END, 6) AS diversity FROM documents LEFT JOIN s USING (doc_id)""")
def text_repetition(spark, d):
    return evaluate.repetition(read_table(spark, d, "documents"))


@query("""WITH g AS (SELECT event_type AS kind, count(*) AS n, avg(value) AS m, stddev_pop(value) AS sd, sum(value) AS t, avg((json_extract(props, '$.k')::INT = 0)::INT) AS f FROM events GROUP BY 1), r AS (SELECT *, n * 1000.0::DOUBLE / t AS rate, 100 * f AS e FROM g)
SELECT kind, n, round(m, 6) AS mean_ms, round(rate, 6) AS rate, round(e, 6) AS errors, round(greatest(0, 1 - sd / m), 6) AS consistency, round(CASE WHEN m <= 20 THEN 1 - 0.2::DOUBLE * m / 20 ELSE greatest(0, 0.8::DOUBLE - 0.5::DOUBLE * (m - 20) / 20) END, 6) AS latency_score,
round(CASE WHEN rate >= 10 THEN least(rate / 10, 2) / 2 ELSE rate / 10 END, 6) AS rate_score, round(CASE WHEN e <= 5 THEN 1 - e / 1000 ELSE greatest(0, 0.9::DOUBLE - 2 * (e - 5) / 100) END, 6) AS error_score FROM r""")
def system_evaluation(spark, d):
    runs = _events(spark, d).select(F.col("event_type").alias("kind"), F.col("value").alias("ms"), (F.get_json_object("props", "$.k").cast("int") == 0).cast("int").alias("failed"))
    return evaluate.system_metrics(runs, most_ms=20.0)


# re-ranking

_LIKE = "CASE WHEN x = y THEN 1 WHEN contains(x, y) OR contains(y, x) THEN 0.7::DOUBLE ELSE 0.5::DOUBLE * len(list_intersect(list_distinct(string_split(x, '')), list_distinct(string_split(y, ''))))::DOUBLE / len(list_distinct(list_concat(string_split(x, ''), string_split(y, '')))) END"


@query(f"""WITH t AS (SELECT conv_id, turn, role, text AS d, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations), w AS (SELECT conv_id, turn, d, q, {_WORDS.format('q')} AS qw, {_WORDS.format('d')} AS dw FROM t WHERE role = 'assistant' AND q IS NOT NULL),
e AS (SELECT conv_id, turn, lower(unnest(qw)) AS x, dw FROM w), e2 AS (SELECT conv_id, turn, x, lower(unnest(dw)) AS y FROM e), s AS (SELECT conv_id, turn, {_LIKE} AS s FROM e2),
g AS (SELECT conv_id, turn, sum(s) FILTER (s > 0.3::DOUBLE) AS hit, count(*) FILTER (s > 0.3::DOUBLE) AS n, sum(s * s * s) AS s3, sum(s * s) AS s2 FROM s GROUP BY 1, 2),
b AS (SELECT conv_id, turn, d, q, least(greatest(coalesce(hit, 0) / len(qw) / (1 + len(dw) / 100.0::DOUBLE) + CASE WHEN n::DOUBLE / len(qw) > 0.5 THEN 0.2::DOUBLE ELSE 0 END, 0), 1) AS base, 1 / (1 + exp(-4 * coalesce(s3 / nullif(s2, 0), 0))) AS neural FROM w JOIN g USING (conv_id, turn))
SELECT conv_id, turn, round(base, 6) AS plain, round(least(base + 0.05::DOUBLE * abs(sin(log10(strlen(d)::DOUBLE))), 1), 6) AS wave, round(greatest(0, base - 0.02::DOUBLE * (strlen(q) % 7) / 7), 6) AS small, round(neural, 6) AS neural, round(least(1.05::DOUBLE * neural, 1), 6) AS neural_wide FROM b""")
def rerank_cross_encoder(spark, d):
    q = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    x = read_table(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("document"), q.alias("query")).where("role = 'assistant' AND query IS NOT NULL")
    return rerank.cross_scores(x, ["conv_id", "turn"])


_TREE_W = "[" + ", ".join(f"(SELECT 0.01::DOUBLE * sum(sin(0.1::DOUBLE + 0.01::DOUBLE * (t + {i}))) FROM range(100) r(t))" for i in range(4)) + "]"


@query(f"""WITH x AS (SELECT doc_id, {_WORDS.format('lower(text)')} AS w FROM documents), c AS (SELECT doc_id, len(w) AS n, list_has_any(w, ['de'])::INT + list_has_any(w, ['of'])::INT + list_has_any(w, ['the'])::INT AS c, len(list_filter(w, lambda v: v IN ('of', 'the', 'de'))) AS h FROM x),
f AS (SELECT doc_id, n, n / (SELECT avg(n) FROM c) AS rel, coalesce(h::DOUBLE / nullif(n, 0), 0) AS tf, c / 3.0::DOUBLE AS cov FROM c), v AS (SELECT *, [n::DOUBLE, rel, tf, cov] AS v FROM f),
s AS (SELECT *, CASE WHEN list_max(v) > list_min(v) THEN list_transform(v, lambda e: (e - list_min(v)) / (list_max(v) - list_min(v))) ELSE v END AS u FROM v), k AS (SELECT {_TREE_W} AS k)
SELECT doc_id, n, round(rel, 6) AS relative, round(tf, 6) AS tf, round(cov, 6) AS coverage, round(1 / (1 + exp(-list_sum(list_transform(list_zip(u, k), lambda z: z[1] * z[2])) / 4)), 6) AS trees, round(1 / (1 + exp(-list_sum(u) / 4)), 6) AS mean_model FROM s, k""")
def rerank_learned(spark, d):
    return rerank.learning_features(read_table(spark, d, "documents"), "the of de")


@query("SELECT event_id, round(least(exp(-floor((epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(ts))) / 3600.0::DOUBLE) / 168.0::DOUBLE), 1), 6) AS freshness FROM events")
def rerank_freshness(spark, d):
    return _events(spark, d).select("event_id", F.round(rerank.freshness(F.col("ts"), _AS_OF), 6).alias("freshness"))


@query(f"WITH {_BM25} SELECT id, score FROM keyword WHERE score >= (SELECT avg(score) - 0.5::DOUBLE * stddev_pop(score) FROM keyword)")
def rerank_candidates(spark, d):
    return rerank.candidates(_keyword(spark, d).select("id", "score"), "adaptive")


_LISTS = f"{_BM25}, {_knn_sql('cosine', 20, ONE)}, semantic AS (SELECT id, score, rank FROM near)"


@query(f"WITH {_LISTS}, f AS (SELECT id, round(0.7::DOUBLE * coalesce(s.score, 0) + (1 - 0.7::DOUBLE) * coalesce(k.score, 0), 6) AS score FROM semantic s FULL JOIN keyword k USING (id)) SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM f QUALIFY rank < 10")
def hybrid_combined(spark, d):
    return search.combined(_semantic(spark, d), _keyword(spark, d), 10)


@query(f"""WITH {_LISTS}, f AS (SELECT id, coalesce(1.0::DOUBLE / (k.rank + 1), 0) AS r0, coalesce(k.score, 0) AS s0, coalesce(((SELECT count(*) FROM keyword) - k.rank)::DOUBLE / (SELECT count(*) FROM keyword), 0) AS p0, coalesce(1.0::DOUBLE / (s.rank + 1), 0) AS r1, coalesce(s.score, 0) AS s1,
coalesce(((SELECT count(*) FROM semantic) - s.rank)::DOUBLE / (SELECT count(*) FROM semantic), 0) AS p1 FROM keyword k FULL JOIN semantic s USING (id)),
g AS (SELECT id, round(0.3::DOUBLE * r0 + 0.2::DOUBLE * s0 + 0.1::DOUBLE * p0 + 0.3::DOUBLE * r1 + 0.2::DOUBLE * s1 + 0.1::DOUBLE * p1 + 0.05::DOUBLE * s0 * s1 - 0.05::DOUBLE * abs(s0 - s1) + 0.1::DOUBLE * greatest(s0, s1), 6) AS score FROM f)
SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM g QUALIFY rank < 10""")
def hybrid_learned(spark, d):
    return search.learned_fusion([_keyword(spark, d), _semantic(spark, d)], [0.3, 0.2, 0.1, 0.3, 0.2, 0.1, 0.05, -0.05, 0.1], 10)


@query(f"""WITH {_BM25} SELECT k.id, round(least(k.score * 0.7::DOUBLE + 0.1::DOUBLE * 0.5::DOUBLE + exp(-(k.id % 90)::INT / 30.0::DOUBLE) * 0.2::DOUBLE + CASE WHEN strlen(text) > 100 AND strlen(text) < 2000 THEN 0.05::DOUBLE * 0.4::DOUBLE ELSE 0 END, 1), 6) AS score FROM keyword k JOIN documents ON doc_id = k.id""")
def search_boosted(spark, d):
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.create_map(F.lit("lang"), F.col("lang")).alias("meta"), F.date_sub(F.lit("2024-01-31").cast("date"), (F.col("doc_id") % 90).cast("int")).cast("timestamp").alias("created_at"))
    return search.boosted(docs.join(_keyword(spark, d).select("id", "score"), "id"), _AS_OF, 0.7, 0.5, 0.2, 0.4)


@query(f"""WITH {_BM25.split(",\nlengths AS")[0].removeprefix("WITH ")}, t AS (SELECT id, term, count(*) AS n FROM terms GROUP BY 1, 2), l AS (SELECT id, sum(n) AS len FROM t GROUP BY 1), d AS (SELECT term, count(*) AS df FROM t GROUP BY 1)
SELECT term, count(*) AS df, round(sum(n::DOUBLE / len), 4) AS weight FROM t JOIN l USING (id) JOIN d USING (term) GROUP BY 1""")
def index_postings(spark, d):
    return search.term_shares(read_table(spark, d, "documents")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.round(F.sum("tf"), 4).alias("weight"))


# query understanding

_USER = "u AS (SELECT conv_id, turn, text, lower(text) AS low, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS l, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM conversations WHERE role = 'user')"


def _has(keys):
    return " + ".join(f"(len(list_filter(l, lambda t: contains(t, '{k}'))) > 0)::INT" for k in keys)


_INTENT_SQL = ", ".join(
    f"struct_pack(score := ({_has(k)} + " + " + ".join(f"2 * contains(low, '{p}')::INT" for p in ph) + f")::DOUBLE / {len(k) + len(ph)} * {c}::DOUBLE, place := {-i}, name := '{n}')" for i, (n, k, ph, c) in enumerate(understand.INTENTS)
)
_DOMAIN_SQL = "CASE " + " ".join(f"WHEN ({_has(k)}) >= 2 OR (({_has(k)}) = 1 AND len(l) <= 5) THEN '{n}'" for n, k in understand.DOMAINS) + " END"


@query(f"""WITH {_USER}, i AS (SELECT *, list_max([{_INTENT_SQL}]) AS b, {_DOMAIN_SQL} AS domain FROM u)
SELECT conv_id, turn, CASE WHEN b.score >= 0.3::DOUBLE THEN b.name WHEN regexp_matches(low, '^(what is|define)') THEN 'definitional' WHEN regexp_matches(low, '^how to|step') THEN 'procedural' WHEN regexp_matches(low, 'compare|vs|difference') THEN 'comparative' WHEN b.score > 0 THEN b.name ELSE 'factual' END AS intent,
round(CASE WHEN b.score < 0.3::DOUBLE AND regexp_matches(low, '^(what is|define|how to)|step|compare|vs|difference') THEN 0.6::DOUBLE ELSE greatest(b.score, 0) END, 6) AS intent_score, domain, coalesce(array_to_string(list_filter(l, lambda t: t IN ('api', 'sql', 'json', 'html', 'css', 'javascript', 'python', 'rust', 'docker')), ' '), '') AS entities,
len(list_intersect(l, ['this', 'that', 'it', 'they', 'them', 'previous', 'above', 'following', 'these', 'those'])) > 0 OR len(l) <= 2 AS needs_context,
regexp_matches(low, '^(what|how|why|when|where)\\s+is\\s+\\w+\\?*$') OR regexp_matches(low, '^(tell me about|about|info on)\\s+\\w+\\?*$') OR regexp_matches(low, '^\\w{{1,3}}\\?*$') AS vague,
md5(CASE WHEN starts_with(low, 'what is') THEN regexp_replace(text, '\\?+$', '') || ' and how does it work?' WHEN starts_with(low, 'how') THEN regexp_replace(text, '\\?+$', '') || ' step by step' WHEN starts_with(low, 'tell me about') THEN replace(low, 'tell me about', 'explain the concept of') END) AS clarified FROM i""")
def query_classes(spark, d):
    return understand.classified(read_table(spark, d, "conversations").where("role = 'user'"), ["conv_id", "turn"])


@query(f"""WITH {_USER}, x AS (SELECT conv_id, turn, len(w)::INT AS n, contains(text, '?') OR regexp_matches(text, '^(what|how|why|when|where|who)') AS question, len(list_filter(w, lambda t: regexp_matches(t, '^\\p{{Lu}}'))) > 0 AS names, len(list_filter(l, lambda t: t IN ('algorithm', 'function', 'method', 'system', 'protocol', 'framework'))) > 0 AS technical FROM u)
SELECT *, round(least(n / 10.0::DOUBLE, 1), 6) AS complexity, round(least(greatest(0.6::DOUBLE + CASE WHEN question THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN names THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN technical THEN 0.05::DOUBLE ELSE 0 END + 0.1::DOUBLE * least(n / 10.0::DOUBLE, 1), 0), 1), 6) AS weight FROM x""")
def query_characteristics(spark, d):
    return understand.characteristics(read_table(spark, d, "conversations").where("role = 'user'"), ["conv_id", "turn"])


_SYN_SQL = ", ".join(f"('{t}', {i}, '{a}')" for t, more in understand.SYNONYMS for i, a in enumerate(more))


@query(f"""WITH s(term, place, added) AS (VALUES {_SYN_SQL}), x AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(text || ' fast method use quick'), '\\s+'), lambda t: regexp_replace(t, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')), lambda t: strlen(t) > 2) AS t FROM documents)
SELECT doc_id, s.term, s.added FROM (SELECT doc_id, t, unnest(list_distinct(t)) AS term FROM x) e JOIN s USING (term) WHERE NOT list_contains(t, s.added)""")
def query_expansion(spark, d):
    rows = [(t, i, a) for t, more in understand.SYNONYMS for i, a in enumerate(more)]
    docs = read_table(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" fast method use quick")).alias("text"))
    return understand.expanded(docs, spark.createDataFrame(rows, "term string, place int, added string"), ["doc_id"])


@query(f"""WITH x AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), t AS (SELECT doc_id, list_sort(list_distinct(list_filter(w[:len(w) - 1], lambda t: regexp_matches(t, '^\\p{{Lu}}') AND strlen(t) > 2))) AS t FROM x)
SELECT doc_id, i AS place, 'What is ' || t[i + 1] || '?' AS question FROM (SELECT doc_id, t, unnest(range(0, len(t))) AS i FROM t WHERE len(t) > 1)""")
def query_topics(spark, d):
    return understand.topics(read_table(spark, d, "documents"), ["doc_id"])  # documents serve as queries


# graphs


@query(f"""WITH RECURSIVE {_EDGES}, linked AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), walk AS (SELECT id, id AS r FROM nodes UNION SELECT linked.b, r FROM walk JOIN linked ON a = id) SELECT id, min(r) AS component FROM walk GROUP BY 1""")
def graph_components(spark, d):
    return graph.weak_components(*_graph(spark, d))


@query(f"""WITH RECURSIVE {_EDGES}, walk AS (SELECT id, id AS r FROM nodes UNION SELECT dst, r FROM walk JOIN edges ON src = id)
SELECT a.id, min(a.r) AS component FROM walk a JOIN walk b ON a.id = b.r AND a.r = b.id GROUP BY 1""")
def graph_strong_components(spark, d):
    return graph.strong_components(*_graph(spark, d))


@query(f"""WITH {_EDGES}, o AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), l AS (SELECT DISTINCT least(src, dst) AS x, greatest(src, dst) AS y FROM edges WHERE src <> dst),
k AS (SELECT src AS id, count(*) AS n FROM o GROUP BY 1), t AS (SELECT a.src AS id, count(*) AS c FROM o a JOIN o b ON a.src = b.src AND a.dst < b.dst JOIN l ON l.x = a.dst AND l.y = b.dst GROUP BY 1)
SELECT id, n AS neighbours, coalesce(c, 0) AS closed, round(CASE WHEN n > 1 THEN coalesce(c, 0) / (n * (n - 1) / 2.0::DOUBLE) ELSE 0 END, 6) AS coefficient FROM k LEFT JOIN t USING (id)""")
def graph_clustering(spark, d):
    return graph.clustering(_graph(spark, d)[1])


@query(f"""WITH {_EDGES}, gone AS (SELECT 'n' || i AS id FROM range(0, 25, 5) t(i)) SELECT (SELECT count(*) FROM nodes ANTI JOIN gone USING (id)) AS nodes, count(*) AS edges FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)""")
def graph_removal(spark, d):
    nodes, edges = _graph(spark, d)
    left, links = graph.remove_nodes(nodes, edges, spark.range(0, 25, 5).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id")))
    return left.agg(F.count(F.lit(1)).alias("nodes")).join(links.agg(F.count(F.lit(1)).alias("edges")))  # one row each


_KINDS = f"""{_EDGES}, named AS (SELECT 'n' || n_nationkey AS id, n_name AS label, 'nation' AS kind, 0.9::DOUBLE AS confidence FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, 'region', 0.8::DOUBLE FROM region UNION ALL SELECT 's' || s_suppkey, s_name, 'supplier', 0.5::DOUBLE FROM supplier),
kinds AS (SELECT *, CASE weight WHEN 1.0 THEN 'hierarchical' WHEN 0.5 THEN 'semantic' ELSE 'similar' END AS kind, weight AS confidence FROM edges)"""


def _named(spark, d):
    n, r, s = (read_table(spark, d, k) for k in ("nation", "region", "supplier"))
    row = lambda p, key, label, kind, c: (F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), F.col(label).alias("label"), F.lit(kind).alias("kind"), F.lit(c).alias("confidence"))
    nodes = n.select(*row("n", "n_nationkey", "n_name", "nation", 0.9)).union(r.select(*row("r", "r_regionkey", "r_name", "region", 0.8))).union(s.select(*row("s", "s_suppkey", "s_name", "supplier", 0.5)))
    edges = _graph(spark, d)[1].withColumn("kind", F.when(F.col("weight") == 1.0, "hierarchical").when(F.col("weight") == 0.5, "semantic").otherwise("similar")).withColumn("confidence", F.col("weight"))
    return nodes, edges


@query(f"WITH {_KINDS} SELECT id, label, kind, confidence FROM named WHERE kind IN ('nation', 'region') AND confidence >= 0.85 ORDER BY id LIMIT 15 OFFSET 3")
def graph_query_nodes(spark, d):
    return graph.query_nodes(_named(spark, d)[0], ["nation", "region"], 0.85, 3, 15)


@query(f"WITH {_KINDS} SELECT src, dst, weight, kind, confidence FROM kinds WHERE src IN ('n1', 'n2', 's1', 's2', 'r0') AND kind IN ('hierarchical', 'similar') AND weight BETWEEN 0.2 AND 1")
def graph_query_edges(spark, d):
    return graph.query_edges(_named(spark, d)[1], ["n1", "n2", "s1", "s2", "r0"], ["hierarchical", "similar"], 0.2, 1.0)


@query(f"""WITH {_KINDS}, b AS (SELECT src, dst, kind, confidence FROM kinds UNION ALL SELECT dst, src, kind, confidence FROM kinds),
x AS (SELECT lower(label) AS term, b.kind, b.confidence * CASE b.kind WHEN 'semantic' THEN 1.0::DOUBLE WHEN 'hierarchical' THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS s, src FROM b JOIN named ON named.id = dst WHERE src IN ('n1', 'n2', 'r1') AND dst NOT IN ('n1', 'n2', 'r1')),
y AS (SELECT term, kind, round(s * CASE WHEN src = 'n2' THEN 1.5::DOUBLE ELSE 1 END, 6) AS score FROM x WHERE s >= 0.1), z AS (SELECT term, max(struct_pack(score := score, kind := kind)) AS m FROM y GROUP BY 1)
SELECT term, m.kind AS kind, m.score AS score FROM z ORDER BY score DESC, term LIMIT 20""")
def graph_expansion(spark, d):
    return graph.expand(*_named(spark, d), ["n1", "n2", "r1"], {"semantic": 1.0, "hierarchical": 0.8, "similar": 0.6}, 0.1, 20, ["n2"])


@query(f"""WITH RECURSIVE {_KINDS}, steps AS (SELECT src, dst, confidence * weight AS g FROM kinds WHERE confidence * weight >= 0.05), walk AS (SELECT 'n1' AS id, 0.0::DOUBLE AS score, ['n1'] AS way UNION ALL SELECT dst, score + g, list_append(way, dst) FROM walk JOIN steps ON src = id WHERE NOT list_contains(way, dst) AND len(way) <= 4 AND id <> 'r1')
SELECT array_to_string(way, '>') AS way, round(score, 6) AS score, len(way)::INT AS nodes FROM walk WHERE id = 'r1' ORDER BY score DESC, way LIMIT 10""")
def graph_semantic_paths(spark, d):
    return graph.simple_paths(_named(spark, d)[1], "n1", "r1", 4, {"similar": 1.0}, 0.05)


@query(f"""WITH {_KINDS}, t AS (SELECT DISTINCT id, regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g') AS w FROM (SELECT id, unnest(regexp_split_to_array(lower(label), '\\s+')) AS w FROM named)), f AS (SELECT * FROM t WHERE w IN ('united', 'states', 'zzz'))
SELECT id FROM f GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT w) FROM f)""")
def graph_text_search(spark, d):
    return graph.text_search(_named(spark, d)[0], "UNITED States zzz")


# changes

_CUT = "unnest(range(0, 1 + ceil(greatest(length(text) - 512, 0) / 448.0)::BIGINT))"


@query(f"""WITH {_SNAPSHOTS}, a AS (SELECT doc_id, i, md5(substr(text, i * 448 + 1, 512)) AS h FROM (SELECT doc_id, text, {_CUT} AS i FROM old)), b AS (SELECT doc_id, i, md5(substr(text, i * 448 + 1, 512)) AS h FROM (SELECT doc_id, text, {_CUT} AS i FROM new))
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.i, b.i) AS chunk_index, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'deleted' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.i = b.i""")
def change_chunks(spark, d):
    cut = lambda x: x.select("doc_id", F.posexplode(tx.cut_fixed(F.col("text"), 512, 64)).alias("chunk_index", "chunk")).withColumn("chunk_index", F.col("chunk_index").cast("long"))
    old, new = _snapshots(spark, d)
    return changes.chunk_changes(cut(old), cut(new))


@query(f"""WITH {_SNAPSHOTS} SELECT doc_id, strlen(n.text) - strlen(o.text) AS delta, round(least(coalesce(abs(strlen(n.text) - strlen(o.text))::DOUBLE / nullif(strlen(o.text), 0), 1), 1), 6) AS share,
round(CASE WHEN o.text = n.text THEN 1 ELSE 0.7::DOUBLE + 0.3::DOUBLE * least(coalesce(abs(strlen(n.text) - strlen(o.text))::DOUBLE / nullif(strlen(o.text), 0), 1), 1) END, 6) AS confidence FROM old o JOIN new n USING (doc_id)""")
def change_deltas(spark, d):
    return changes.deltas(*_snapshots(spark, d))


_VERSIONS = "v AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, floor(o_totalprice)::BIGINT AS size FROM orders)"


def _versions(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return read_table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.row_number().over(w).alias("version"), F.floor("o_totalprice").cast("long").alias("size"))


@query(f"WITH {_VERSIONS}, l AS (SELECT *, size - coalesce(lag(size) OVER (PARTITION BY doc_id ORDER BY version), 0) AS d FROM v) SELECT doc_id, version, greatest(d, 0) AS additions, greatest(-d, 0) AS deletions FROM l")
def version_summaries(spark, d):
    return changes.version_summary(_versions(spark, d))


@query(f"WITH {_VERSIONS}, c AS (SELECT doc_id, max(version) AS found FROM v GROUP BY 1) SELECT doc_id, 3 AS expected, found, CASE WHEN doc_id % 2 = 0 THEN 'resolved' ELSE 'open' END AS status FROM c WHERE found <> 3")
def version_conflicts(spark, d):
    now = storage.current(_versions(spark, d), "doc_id", "version").select("doc_id", "version")
    rows = changes.conflicts(now, now.select("doc_id", F.lit(3).alias("version")))
    return changes.resolved(rows, now.where("doc_id % 2 = 0"))


@query("SELECT event_id AS op_id, json_extract(props, '$.k')::INT AS priority, row_number() OVER w - 1 AS place, (row_number() OVER w - 1) // 50 AS batch FROM events WHERE json_extract(props, '$.k')::INT <= 10 WINDOW w AS (PARTITION BY json_extract(props, '$.k')::INT ORDER BY ts, event_id)")
def operation_batches(spark, d):
    ops = _events(spark, d).select(F.col("event_id").alias("op_id"), F.get_json_object("props", "$.k").cast("int").alias("priority"), F.col("ts").alias("at"))
    return changes.ordered_batches(ops, 50)


@query("""WITH l AS (SELECT doc_id, 1 AS step, 'add' AS op, text FROM documents UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 10 = 0 THEN 'delete' ELSE 'update' END, text || '!' FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 3, 'delete', NULL FROM documents),
m AS (SELECT doc_id, arg_max(op, step) AS op, arg_max(text, step) AS text FROM l WHERE step <= 2 GROUP BY 1) SELECT doc_id, md5(text) AS hash FROM m WHERE op <> 'delete'""")
def rollback_state(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    log = docs.select("doc_id", F.lit(1).alias("step"), F.lit("add").alias("op"), "text")
    log = log.union(docs.where("doc_id % 5 = 0").select("doc_id", F.lit(2), F.when(F.col("doc_id") % 10 == 0, "delete").otherwise("update"), F.concat("text", F.lit("!")))).union(docs.select("doc_id", F.lit(3), F.lit("delete"), F.lit(None).cast("string")))
    return changes.as_of(log, 2).select("doc_id", F.md5("text").alias("hash"))


@query(f"WITH {_VERSIONS} SELECT (SELECT count(*) FROM documents WHERE doc_id % 9 = 0) AS wrong_hashes, (SELECT count(*) FROM documents WHERE doc_id % 4 = 0 AND doc_id NOT IN (SELECT doc_id + 1 FROM documents)) AS orphans, (SELECT count(*) FROM v WHERE version = 4)::BIGINT AS gaps, 'critical' AS health")
def integrity_report(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 9 == 0, "x").otherwise(F.sha2("text", 256)).alias("hash"))
    moved = docs.withColumn("doc_id", F.col("doc_id") + 1)
    return changes.integrity(moved.withColumn("text", F.col("text")), docs.where("doc_id % 4 = 0").select("doc_id"), _versions(spark, d).where("version <> 3"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'size' ELSE '' END AS added, CASE WHEN doc_id % 4 = 0 THEN 'source' ELSE '' END AS removed, CASE WHEN doc_id % 5 = 0 THEN 'lang' ELSE '' END AS changed FROM documents")
def change_metadata(spark, d):
    docs = read_table(spark, d, "documents")
    src = F.coalesce("source", F.lit("-"))
    old = docs.select("doc_id", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), src).alias("meta"))
    lang = F.when(F.col("doc_id") % 5 == 0, F.lit("xx")).otherwise(F.col("lang"))
    new = F.create_map(F.lit("lang"), lang, F.lit("source"), src, F.lit("size"), F.lit("1"))
    new = F.map_filter(new, lambda k, v: ((k != "source") | (F.col("doc_id") % 4 != 0)) & ((k != "size") | (F.col("doc_id") % 3 == 0)))
    return changes.metadata_changes(old, docs.select("doc_id", new.alias("meta")))


# events: alerts, gauges, trends, files


@query("""WITH x AS (SELECT event_id, event_type, min(value) OVER w AS lo FROM (SELECT *, floor(epoch(ts))::BIGINT AS s FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY s RANGE BETWEEN 10800 PRECEDING AND CURRENT ROW)) SELECT event_id, event_type, lo > 2 AS high FROM x""")
def event_threshold_alerts(spark, d):
    return observe.alerts(_events(spark, d), 180, 2.0, 0.5, 1.2).select("event_id", "event_type", "high")


@query("""WITH e AS (SELECT *, floor(epoch(ts))::BIGINT AS s FROM events), x AS (SELECT a.event_id, a.event_type, min(struct_pack(s := b.s, i := b.event_id, v := b.value)) AS f, max(struct_pack(s := b.s, i := b.event_id, v := b.value)) AS l, min(b.value) AS lo, avg(b.value) AS m, stddev_pop(b.value) AS sd, count(*) AS n
FROM e a JOIN e b ON a.event_type = b.event_type AND b.s BETWEEN a.s - 10800 AND a.s GROUP BY 1, 2),
y AS (SELECT event_id, event_type, lo > 2 AS high, coalesce(n >= 2 AND (l.s - f.s) // 60 > 0 AND (l.v - f.v) / nullif((l.s - f.s) // 60, 0) > 0.5, false) AS steep, coalesce(n >= 5 AND sd > 0 AND abs((l.v - m) / nullif(sd, 0)) > 1.2, false) AS odd FROM x)
SELECT *, high AND steep AND odd AS all_of, high OR steep OR odd AS any_of FROM y""")
def event_alerts(spark, d):
    return observe.alerts(_events(spark, d), 180, 2.0, 0.5, 1.2)


@query("SELECT event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def event_gauges(spark, d):
    return observe.latest_values(_events(spark, d))


_PLACES = "WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS p, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, "


@query(_PLACES + ", ".join(f"coalesce(max(value) FILTER (p = round({q}::DOUBLE * (n - 1))), 0) AS p{round(100 * q)}" for q in (0.25, 0.5, 0.75, 0.95)) + " FROM x GROUP BY 1")
def event_nearest_ranks(spark, d):
    return observe.ranked_percentiles(_events(spark, d), (0.25, 0.5, 0.75, 0.95), "round")


@query(_PLACES + ", ".join(f"coalesce(max(value) FILTER (p = least(floor(n * {q}::DOUBLE), n - 1)), 0) AS p{round(100 * q)}" for q in (0.5, 0.95, 0.99)) + " FROM x GROUP BY 1")
def event_floor_ranks(spark, d):
    return observe.ranked_percentiles(_events(spark, d), (0.5, 0.95, 0.99), "clipped")


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, round(stddev_pop(value), 6) AS sd, round(count(*)::DOUBLE / greatest(floor(epoch(max(ts))) - floor(epoch(min(ts))), 1), 6) AS rate,
CASE WHEN regexp_matches(lower(event_type), 'database|db') THEN 'database' WHEN contains(lower(event_type), 'cache') THEN 'cache' WHEN regexp_matches(lower(event_type), 'network|http') THEN 'network' WHEN regexp_matches(lower(event_type), 'io|file') THEN 'io' WHEN avg(value) > 1000 THEN 'algorithm' WHEN avg(value) > 500 THEN 'cpu' ELSE 'memory' END AS bottleneck FROM events GROUP BY 1""")
def event_operations(spark, d):
    return observe.operations(_events(spark, d))


@query("""WITH d AS (SELECT event_type, ts::DATE AS day, sum(value) AS y FROM events GROUP BY 1, 2), g AS (SELECT event_type, arg_max(y, day) - arg_min(y, day) AS c, stddev_pop(y) AS sd, count(*) AS n FROM d GROUP BY 1)
SELECT event_type, round(sd, 4) AS volatility, round(c, 4) AS change, CASE WHEN n < 2 OR abs(c) < 0.5 * sd THEN 'stable' WHEN sd > 2 * abs(c) THEN 'volatile' WHEN c > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM g""")
def event_direction(spark, d):
    return observe.direction(_events(spark, d))


@query("""WITH k AS (SELECT DISTINCT event_type FROM events), d AS (SELECT (DATE '2024-01-01' + i::INT) AS day FROM range(31) t(i)), c AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, day::VARCHAR AS day, coalesce(n, 0) AS n FROM k CROSS JOIN d LEFT JOIN c USING (event_type, day)""")
def event_daily_types(spark, d):
    return observe.daily_by(_events(spark, d), "event_type", "2024-01-01", 31)


@query("SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'error' AND ts >= TIMESTAMP '2024-01-30 00:00:00') AS recent_errors, strftime(min(ts), '%Y-%m-%d %H:%M') AS oldest, strftime(max(ts), '%Y-%m-%d %H:%M') AS newest FROM events")
def event_log_stats(spark, d):
    return observe.log_stats(_events(spark, d), _AS_OF)


@query("""SELECT 'events,counter,' || count(*) || ',"type=' || event_type || ';user=' || user_id || '"' AS line FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00' AND event_type IN ('click', 'error') GROUP BY event_type, user_id""")
def export_metric_lines(spark, d):
    return observe.metric_lines(_events(spark, d), "2024-01-05 00:00:00", "2024-01-20 00:00:00", ["click", "error"])


@query("""WITH g AS (SELECT event_type, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1) SELECT event_type, 'mean' AS metric, mean AS value FROM g UNION ALL SELECT event_type, 'low', low FROM g UNION ALL SELECT event_type, 'high', high FROM g""")
def export_long(spark, d):
    return observe.long_form(observe.operations(_events(spark, d)), "event_type", ["mean", "low", "high"])


# caches


@query(f"WITH {_ENTRIES} SELECT user_id, event_type, round((log2(accesses) + 1) * CASE WHEN user_id % 2 = 0 THEN 0.5::DOUBLE ELSE 1 END / (idle + 1) * 1000000, 6) AS score FROM c ORDER BY score, user_id, event_type LIMIT 30")
def cache_semantic(spark, d):
    c = caches.entries(_events(spark, d), _AS_OF).withColumn("cluster", F.when(F.col("user_id") % 2 == 0, F.lit(0.5)))
    return caches.semantic_order(c, 30)


@query(f"WITH {_ENTRIES} SELECT user_id, event_type, round(0.3::DOUBLE / (idle + 1) + 0.3::DOUBLE * log2(accesses) + 0.2::DOUBLE / (size + 1) + age * 0.000001::DOUBLE + (86400 - age) * 0.000002::DOUBLE, 6) AS score FROM c ORDER BY score, user_id, event_type LIMIT 30")
def cache_linear(spark, d):
    return caches.linear_order(caches.entries(_events(spark, d), _AS_OF), (0.3, 0.3, 0.2, 1e-6, 2e-6), 86400, 30)


@query("WITH f AS (SELECT user_id AS key, count(*) AS n FROM events GROUP BY 1) SELECT a.key, a.key + 1 AS victim, a.n > coalesce(b.n, 0) AS admit FROM f a LEFT JOIN f b ON b.key = a.key + 1")
def cache_admission(spark, d):
    f = _events(spark, d).groupBy(F.col("user_id").alias("key")).agg(F.count(F.lit(1)).alias("frequency"))
    return caches.admitted(f, f.select("key", (F.col("key") + 1).alias("victim")))


@query("SELECT event_type, count(*) AS requests, count(*) FILTER (value > 10) AS hits, round(avg((value > 10)::INT), 6) AS hit_share, round(avg(value), 6) AS mean_value, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def cache_insights(spark, d):
    return caches.insights(_events(spark, d), "value > 10")


@query("WITH g AS (SELECT text, count(*) AS n, max(strlen(text)) AS s FROM documents GROUP BY 1) SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_texts, sum((n - 1) * s)::BIGINT AS saved_bytes FROM g")
def cache_repeats(spark, d):
    return caches.repeated_texts(read_table(spark, d, "documents"))


@query("SELECT count(*) AS n, sum(4 * len(embedding))::BIGINT AS plain, sum(len(embedding) + 8)::BIGINT AS packed, round(sum(4 * len(embedding))::DOUBLE / sum(len(embedding) + 8), 6) AS ratio FROM embeddings")
def cache_compression(spark, d):
    return caches.compression(read_table(spark, d, "embeddings"))


# vectors of several kinds, made into one

_SHIFT = f"v AS (SELECT vec_id, {_VEC} AS a, list_transform(list_reverse({_VEC}), lambda x: x::DOUBLE) AS b FROM embeddings)"


def _two(spark, d):
    return read_table(spark, d, "embeddings").select("vec_id", vx.doubles(F.col("embedding")).alias("a"), F.reverse(vx.doubles(F.col("embedding"))).alias("b"))


@query(f"""WITH {_SHIFT}, f AS (SELECT vec_id, list_transform(list_zip(a, b), lambda z: (z[1] + z[2]) / 2) AS m, list_transform(list_zip(a, b), lambda z: 0.6::DOUBLE * z[1] + 0.4::DOUBLE * z[2]) AS w, list_concat(a, b)[:100] AS c,
 1 / (1 + exp(-list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])) / sqrt(len(a)))) AS g, a, b FROM v)
SELECT vec_id, round(list_sum(list_transform(m, lambda x: abs(x))), 6) AS mean_l1, round(list_sum(list_transform(w, lambda x: abs(x))) / sqrt(list_sum(list_transform(w, lambda x: x * x))), 6) AS weighted_l1, round(list_sum(list_transform(c, lambda x: abs(x))), 6) AS joined_l1,
round(list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] + g * z[2]))), 6) AS attended_l1 FROM f""")
def vector_fusion(spark, d):
    x = _two(spark, d)
    a, b = F.col("a"), F.col("b")
    l1 = lambda v: tx.sum_of(F.transform(v, lambda e: F.abs(e)))
    return x.select(
        "vec_id", F.round(l1(vx.mean_of([a, b])), 6).alias("mean_l1"), F.round(tx.let(vx.weighted([a, b], [0.6, 0.4]), lambda w: l1(w) / vx.norm(w)), 6).alias("weighted_l1"),
        F.round(l1(vx.joined([a, b], 100)), 6).alias("joined_l1"), F.round(l1(vx.attended(a, [b])), 6).alias("attended_l1"),
    )


@query("""WITH v AS (SELECT doc_id, list_transform(range(0, 8), lambda i: sin(strlen(text) + i) / (i + 1)) AS m, list_transform(range(0, 8), lambda i: ((strlen(text) * 31 + i * 17) % 1000) / 1000.0::DOUBLE) AS l FROM documents) SELECT doc_id, round(list_sum(m), 6) AS mock, round(list_sum(l), 6) AS plain FROM v""")
def vector_stand_ins(spark, d):
    t = F.col("text")
    return read_table(spark, d, "documents").select("doc_id", F.round(tx.sum_of(vx.mock_vector(t, 8)), 6).alias("mock"), F.round(tx.sum_of(vx.length_vector(t, 8)), 6).alias("plain"))


# tokens of streams


@query(f"""WITH x AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), i AS (SELECT doc_id, w, unnest(range(0, len(w) + 1)) AS i FROM x), t AS (SELECT doc_id, i AS position, CASE WHEN i < len(w) THEN w[i + 1] || ' ' ELSE '' END AS token FROM i)
SELECT doc_id, count(*) AS tokens, count(*) FILTER (token <> '') AS words, md5(string_agg(token, '' ORDER BY position)) AS message FROM t GROUP BY 1""")
def stream_messages(spark, d):
    from .streaming.events import collected, token_stream

    return collected(token_stream(read_table(spark, d, "documents")))
