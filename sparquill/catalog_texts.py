"""Queries over questions, reports, pipelines and tools, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import _EDGES, _VEC, _WORDS, _events, _graph, query  # noqa: PLC2701
from .functions import text as tx
from .functions import vectors as vx
from .operators import caches, graph, memory, report, understand
from .plans import steps
from .sources.files import read_table

# questions

_TAILS = ("", " when did it start, before or after Alpha", " Alpha Beta vs the Gamma one", " please compare Rust, and Python speeds")
_ASK = "CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TAILS)) + " END"
_BARE = "regexp_replace({0}, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')"
_NOUNS = "list_filter(" + _WORDS + ", lambda t: strlen(t) > 2 AND lower(t) NOT IN ('the', 'and', 'or', 'of', 'in', 'on', 'at'))"


@query(f"""WITH x AS (SELECT doc_id, text || {_ASK} AS q FROM documents), y AS (SELECT doc_id, q, lower(q) AS low, instr(lower(q), ' vs ') AS vs, {_WORDS.format('q')} AS w FROM x),
z AS (SELECT *, coalesce({_BARE.format("list_filter(w, lambda t: strlen(t) > 3 AND lower(t) NOT IN ('what', 'when', 'where', 'how', 'why', 'who', 'the', 'and'))[1]")}, 'this') AS s, coalesce(list_position(list_transform(w, lambda t: lower(t)), 'compare'), 0) AS p, trim(left(q, vs - 1)) AS a, trim(substr(q, vs + 4)) AS b FROM y),
c AS (SELECT *, CASE WHEN vs > 0 THEN [coalesce({_NOUNS.format('a')}[-1], a), coalesce({_NOUNS.format('b')}[1], b)] WHEN p > 0 THEN list_transform(list_filter(w[p + 1 :], lambda t: strlen(t) > 2 AND lower(t) NOT IN ('compare', 'and', 'with', 'to'))[1:2], lambda t: {_BARE.format('t')}) ELSE [] END AS items FROM z),
o AS (SELECT doc_id, 0 AS k, 'temporal' AS strategy, 'When did ' || s || ' happen?' AS question, 0.7 AS confidence, 0.8 AS priority FROM c WHERE contains(low, 'when') UNION ALL SELECT doc_id, 1, 'temporal', 'What happened before ' || s || '?', 0.7, 0.8 FROM c WHERE contains(low, 'before')
UNION ALL SELECT doc_id, 2, 'temporal', 'What happened after ' || s || '?', 0.7, 0.8 FROM c WHERE contains(low, 'after') UNION ALL SELECT doc_id, 2 + i, 'comparative', 'What are the features of ' || items[i] || '?', 0.75, 0.8 FROM c, range(1, 3) r(i) WHERE len(items) >= 2
UNION ALL SELECT doc_id, 5, 'comparative', 'Compare ' || items[1] || ' and ' || items[2], 0.9, 1.0 FROM c WHERE len(items) >= 2)
SELECT doc_id, strategy, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS place, question, confidence::DOUBLE AS confidence, priority::DOUBLE AS priority, CASE WHEN starts_with(lower(question), 'what is') OR starts_with(lower(question), 'define') THEN 'definitional' WHEN starts_with(lower(question), 'how') THEN 'procedural'
WHEN starts_with(lower(question), 'when') THEN 'temporal' WHEN starts_with(lower(question), 'where') THEN 'locational' WHEN starts_with(lower(question), 'why') THEN 'causal' WHEN contains(lower(question), 'compare') OR contains(lower(question), 'vs') THEN 'comparative' ELSE 'factual' END AS answer FROM o""")
def query_decomposition(spark, d):
    tail = F.element_at(F.array(*map(F.lit, _TAILS)), (F.col("doc_id") % 4 + 1).cast("int"))
    return understand.decomposed(read_table(spark, d, "documents").select("doc_id", F.concat("text", tail).alias("text")), ["doc_id"])  # documents serve as queries


_HEADS = ("What is ", "How to build ", "Compare the cost and the price of ", "")
_HEAD = "CASE turn % 4 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_HEADS)) + " END"
_NO_TERM = "('the', 'a', 'an', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for', 'of', 'with', 'by', 'is', 'are', 'was', 'were', 'be', 'been', 'have', 'has', 'had', 'do', 'does', 'did', 'will', 'would', 'could', 'should', 'may', 'might', 'can', 'what', 'how', 'why', 'when', 'where', 'who', 'which')"
_DOMAIN = "CASE " + " ".join(f"WHEN {n} >= 2 OR ({n} = 1 AND len({_WORDS.format('low')}) <= 5) THEN '{name}'" for name, keys in understand.ANSWER_DOMAINS for n in ["(" + " + ".join(f"contains(low, '{k}')::INT" for k in keys) + ")"]) + " END"


@query(f"""WITH x AS (SELECT conv_id, turn, {_HEAD} || text AS q, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations), y AS (SELECT *, lower(q) AS low, lower(a) AS la, list_filter(list_transform({_WORDS.format('q')}, lambda t: {_BARE.format('t')}), lambda t: strlen(t) > 2 AND lower(t) NOT IN {_NO_TERM}) AS t FROM x WHERE a IS NOT NULL),
z AS (SELECT *, CASE WHEN starts_with(low, 'what is') OR starts_with(low, 'define') THEN 'definitional' WHEN starts_with(low, 'how to') OR contains(low, 'step') THEN 'procedural' WHEN contains(low, 'compare') OR contains(low, 'vs') OR contains(low, 'difference') THEN 'comparative' WHEN starts_with(low, 'when') OR starts_with(low, 'where') OR starts_with(low, 'who') THEN 'factual'
WHEN starts_with(low, 'why') THEN 'causal' WHEN starts_with(low, 'list') OR contains(low, 'examples') THEN 'enumerative' ELSE 'general' END AS type FROM y)
SELECT conv_id, turn, type, {_DOMAIN} AS domain, coalesce(t[1], 'the topic') AS subject, len(t) AS n_terms, round(least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN strlen(a) BETWEEN 50 AND 500 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN len(t) > 0 THEN len(list_filter(t, lambda v: contains(la, lower(v))))::DOUBLE / len(t) ELSE 0 END * 0.3::DOUBLE
+ CASE WHEN (type = 'definitional' AND (contains(a, 'is') OR contains(a, 'refers to'))) OR (type = 'procedural' AND (contains(a, 'step') OR contains(a, 'process'))) OR (type = 'comparative' AND (contains(a, 'compare') OR contains(a, 'difference'))) THEN 0.1::DOUBLE ELSE 0 END), 6) AS confidence FROM z""")
def answer_profiles(spark, d):
    head = F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("turn") % 4 + 1).cast("int"))
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    x = read_table(spark, d, "conversations").select("conv_id", "turn", F.concat(head, "text").alias("query"), after.alias("answer"))  # turns stand in for what a model would make up
    return understand.answer_confidence(x.where("answer IS NOT NULL"), ["conv_id", "turn"])


@query("WITH x AS (SELECT conv_id, regexp_replace(regexp_replace(text, '\\b[0-9]+\\b', '{NUM}', 'g'), '\"[^\"]*\"', '{STR}', 'g') AS t FROM conversations WHERE role = 'user') SELECT md5(t) AS template, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM x GROUP BY 1")
def query_patterns(spark, d):
    x = read_table(spark, d, "conversations").where("role = 'user'").select("conv_id", F.md5(understand.template(F.col("text"))).alias("template"))
    return x.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conv_id").alias("conversations"))


# reports

_RESULTS = "r AS (SELECT event_type AS evaluator, unnest(['highest', 'lowest', 'share of users']) AS metric, unnest([max(value), min(value), count(DISTINCT user_id)::DOUBLE / count(*)]) AS value FROM events GROUP BY 1)"


def _results(spark, d):
    g = _events(spark, d).groupBy(F.col("event_type").alias("evaluator")).agg(F.max("value").alias("highest"), F.min("value").alias("lowest"), (F.countDistinct("user_id") / F.count(F.lit(1))).alias("share of users"))
    return g.unpivot(["evaluator"], ["highest", "lowest", "share of users"], "metric", "value")


def _report_sql(head: list[str], row: str, tail: list[str]) -> str:
    text = lambda xs: "[" + ", ".join("'" + x.replace("{}", "' || evaluator || '") + "'" for x in xs) + "]"
    return f"WITH {_RESULTS}, s AS (SELECT evaluator, list({row} ORDER BY metric) AS m FROM r GROUP BY 1), l AS (SELECT evaluator, list_concat({text(head)}, m, {text(tail)}) AS l FROM s) SELECT evaluator, unnest(range(0, len(l))) AS place, unnest(l) AS line FROM l"


@query(_report_sql(["## {} Evaluation", "", "### Overall Scores", "", "| Metric | Score |", "|--------|-------|"], "'| ' || metric || ' | ' || printf('%.4f', value) || ' |'", ["", "---", ""]))
def export_markdown(spark, d):
    return report.lines(_results(spark, d), "markdown")


@query(_report_sql(['<div class="evaluator">', "<h2>{} Evaluation</h2>", "<h3>Overall Scores</h3>", "<table>", "<tr><th>Metric</th><th>Score</th></tr>"], "'<tr><td>' || metric || '</td><td class=\"score\">' || printf('%.4f', value) || '</td></tr>'", ["</table>", "</div>"]))
def export_html(spark, d):
    return report.lines(_results(spark, d), "html")


# pipelines and tools


def _lengths(chunk):
    """A plain embedding: words by the rest of their bytes over 4."""
    return tx.let(tx.words(chunk), lambda w: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.size(F.filter(w, lambda t: F.octet_length(t) % 4 == i)).cast("double")))


@query(f"""WITH t AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents), c AS (SELECT doc_id, t, unnest(range(0, 1 + ceil(greatest(length(t) - 512, 0) / 448.0)::BIGINT)) AS i FROM t), x AS (SELECT doc_id, i, substr(t, i * 448 + 1, 512) AS c FROM c),
w AS (SELECT doc_id, i, c, {_WORDS.format('c')} AS w FROM x) SELECT doc_id, i AS chunk_index, md5(c) AS hash, {', '.join(f'len(list_filter(w, lambda t: strlen(t) % 4 = {k}))::DOUBLE AS e{k}' for k in range(4))} FROM w""")
def pipeline_ingestion(spark, d):
    out, _ = steps.run_steps(read_table(spark, d, "documents").select("doc_id", "text"), steps.ingestion(_lengths))
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("chunk").alias("hash"), *(F.col("embedding")[k].alias(f"e{k}") for k in range(4)))


_TOOLS = ("add", "subtract", "multiply", "divide", "power")


@query(f"""WITH x AS (SELECT event_id, [{', '.join(f"'{t}'" for t in _TOOLS)}][event_id % 5 + 1] AS tool, value AS a, (user_id % 3)::DOUBLE AS b FROM events) SELECT event_id, tool, round(CASE tool WHEN 'add' THEN a + b WHEN 'subtract' THEN a - b WHEN 'multiply' THEN a * b WHEN 'divide' THEN CASE WHEN b <> 0 THEN a / b END END, 6) AS result,
CASE WHEN tool = 'power' THEN 'unknown tool' WHEN tool = 'divide' AND b = 0 OR a IS NULL THEN 'no result' END AS error FROM x""")
def tool_calls(spark, d):
    x = _events(spark, d).select("event_id", F.element_at(F.array(*map(F.lit, _TOOLS)), (F.col("event_id") % 5 + 1).cast("int")).alias("tool"), F.col("value").alias("a"), (F.col("user_id") % 3).cast("double").alias("b"))
    return steps.CALCULATOR.call(x).select("event_id", "tool", F.round("result", 6).alias("result"), "error")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, props->>'$.none.such' AS missing FROM events")
def state_paths(spark, d):
    return _events(spark, d).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.none.such").alias("missing"))


# graphs, conversations, documents, vectors


@query(f"WITH {_EDGES} SELECT 'edge' AS item, substr(src, 1, 1) || substr(dst, 1, 1) AS kind, count(*) AS n, count(*) * 1000 AS bytes FROM edges GROUP BY 2 UNION ALL SELECT 'node', substr(id, 1, 1), count(*), count(*) * 1000 FROM nodes GROUP BY 2")
def graph_kinds(spark, d):
    nodes, edges = _graph(spark, d)
    first = lambda c: F.substring(c, 1, 1)
    return graph.kinds(nodes.select(first("id").alias("kind")), edges.select(F.concat(first("src"), first("dst")).alias("kind")))


@query("SELECT conv_id, count(*) AS messages, sum(strlen(text) // 4)::BIGINT AS tokens FROM conversations GROUP BY 1 HAVING count(*) > 6 OR sum(strlen(text) // 4) > 300")
def memory_overflow(spark, d):
    return memory.overflowing(read_table(spark, d, "conversations"), 6, 300)


@query("""WITH x AS (SELECT doc_id, text, list_transform(range(0, 1 + ceil(greatest(length(text) - 512, 0) / 448.0)::BIGINT), lambda i: md5(substr(text, i * 448 + 1, 512))) AS c, '{' || array_to_string(list_filter(['"lang":"' || lang || '"', '"source":"' || source || '"'], lambda v: v IS NOT NULL), ',') || '}' AS meta FROM documents)
SELECT doc_id, md5(text) AS content_hash, md5(meta) AS meta_hash, len(c) AS chunks, md5(array_to_string(c, '')) AS chunk_hash, strlen(text) AS bytes FROM x""")
def document_states(spark, d):
    x = read_table(spark, d, "documents").select("doc_id", "text", tx.cut_fixed(F.col("text"), 512, 64).alias("c"), F.to_json(F.struct("lang", "source")).alias("meta"))  # keys in order of their names
    hashes = F.transform("c", F.md5)
    return x.select("doc_id", F.md5("text").alias("content_hash"), F.md5("meta").alias("meta_hash"), F.size("c").cast("long").alias("chunks"), F.md5(F.array_join(hashes, "")).alias("chunk_hash"), F.octet_length("text").cast("long").alias("bytes"))


@query(f"""WITH v AS (SELECT vec_id, {_VEC} AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v), u AS (SELECT vec_id, CASE WHEN n > 0 THEN list_transform(v, lambda x: x / n) ELSE v END AS u FROM n)
SELECT vec_id, round(list_sum(list_transform(u[1:16], lambda x: x * x)), 6) AS kept, len(u[1:16]) AS short, greatest(len(u), 100) AS long FROM u""")
def vectors_resized(spark, d):
    v = vx.doubles(F.col("embedding"))
    x = read_table(spark, d, "embeddings").select("vec_id", vx.joined([vx.unit(v)], 16).alias("a"), vx.joined([vx.unit(v)], 100).alias("b"))
    return x.select("vec_id", F.round(vx.dot(F.col("a"), F.col("a")), 6).alias("kept"), F.size("a").cast("long").alias("short"), F.size("b").cast("long").alias("long"))


# caches


_CELL = "('0x' || substr(md5(user_id::VARCHAR || ':' || i), 1, 8))::BIGINT % 256"


@query(f"""WITH s AS (SELECT i, {_CELL} AS cell, count(*) AS n FROM events, range(4) r(i) WHERE user_id IS NOT NULL GROUP BY 1, 2), k AS (SELECT user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1)
SELECT user_id, min(s.n) AS estimate, any_value(k.n) AS n FROM (SELECT user_id, n, i, {_CELL} AS cell FROM k, range(4) r(i)) k JOIN s USING (i, cell) GROUP BY 1""")
def cache_sketch(spark, d):
    x = _events(spark, d)
    counts = x.where("user_id IS NOT NULL").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return caches.estimates(counts, "user_id", caches.frequency_sketch(x, "user_id")).join(counts, "user_id").select("user_id", "estimate", "n")
