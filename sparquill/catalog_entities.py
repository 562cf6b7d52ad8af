"""Queries over entities, relations and the graphs they make, and over stored versions, with their SQL twins."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from .catalog import _EDGES, _graph, query  # noqa: PLC2701
from .operators import entities, entity_graph, graph, relations
from .plans.rounds import shared_folder
from .sources.files import read_table
from .sources.snapshots import Snapshots

_LEAST = 0.4  # all kinds but money and percentages are at 0.45 and above

# RE2 takes letters beyond ASCII for ends of words, so they become a sign that words hold; places stay, as one letter is one sign
_SURE = {k: relations.confidence(k) for k, _ in entities.PATTERNS}
_RULES = " UNION ALL ".join(
    f"SELECT doc_id, text, {i} AS rule, '{k}' AS kind, {_SURE[k]}::DOUBLE AS confidence, regexp_extract_all(m, '{p}') AS f, regexp_split_to_array(m, '{p}') AS g FROM t" for i, (k, p) in enumerate(entities.PATTERNS) if _SURE[k] >= _LEAST
)
_STOP = ", ".join(f"'{w}'" for w in relations.STOP_WORDS)


def _spans_sql(documents: str = "documents") -> str:
    return f"""t AS (SELECT doc_id, text, regexp_replace(text, '[^\\x00-\\x7F\\p{{Z}}\\p{{P}}\\p{{S}}\\p{{C}}]', '_', 'g') AS m FROM {documents}), rules AS ({_RULES}),
hits AS (SELECT doc_id, text, rule, kind, confidence, f[k] AS hit, (list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:k - 1], lambda x: length(x))), 0))::BIGINT AS first FROM (SELECT *, unnest(range(1, len(f) + 1)) AS k FROM rules)),
placed AS (SELECT *, first + length(hit) AS last, substr(text, first + 1, length(hit)) AS own FROM hits),
named AS (SELECT *, regexp_replace(trim(own), '\\s+', ' ', 'g') AS entity FROM placed WHERE strlen(trim(own)) <= 100),
spans AS (SELECT doc_id, text, rule, kind, strlen(substr(text, 1, first)) AS start, strlen(substr(text, 1, last)) AS "end", first, last, entity, confidence FROM named
    WHERE len(list_filter(string_split(lower(entity), ' '), lambda w: w NOT IN ({_STOP}))) > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, first, last ORDER BY rule) = 1)"""


def _relations_sql(least: float) -> str:
    kinds = dict.fromkeys(k for k, _ in relations.LINKS)
    told = " UNION ALL ".join(f"SELECT *, '{kind}' AS kind, 0.7::DOUBLE AS confidence FROM pairs WHERE regexp_full_match(gap, '{'|'.join(p for k, p in relations.LINKS if k == kind)}')" for kind in kinds)
    return f"""pairs AS (SELECT a.doc_id, a.entity AS subject, b.entity AS object, a.start, greatest(a."end", b."end") AS "end", greatest(b.start - a."end", 0) AS distance, CASE WHEN b.first > a.last THEN substr(a.text, a.last + 1, b.first - a.last) ELSE '' END AS gap
    FROM spans a JOIN spans b ON a.doc_id = b.doc_id AND (a.start, a."end", a.rule) < (b.start, b."end", b.rule) AND b.start - a."end" <= 100),
said AS (SELECT *, 'mentioned_with' AS kind, round(0.3::DOUBLE * (1 - distance / 100.0::DOUBLE), 6) AS confidence FROM pairs UNION ALL {told}),
relations AS (SELECT doc_id, subject, kind, object, confidence, start, "end", distance FROM said WHERE confidence >= {least})"""


@query(f"""WITH {_spans_sql()} SELECT doc_id, rule, kind, start, "end", entity, confidence FROM spans""")
def entity_spans(spark, d):
    return relations.spans(read_table(spark, d, "documents"), least=_LEAST).select("doc_id", "rule", "kind", "start", "end", "entity", "confidence")


@query(f"WITH {_spans_sql()}, {_relations_sql(0.0)} SELECT * FROM relations")
def entity_relations(spark, d):
    return relations.relations(relations.spans(read_table(spark, d, "documents"), least=_LEAST), 0.0).drop("row")


# the graph of all documents, from which toxic ones go and good ones among them come back

_FOLD = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_LEFT = "docs AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND quality <> 1))"
_FACTS = f"""{_LEFT}, {_spans_sql('docs')}, {_relations_sql(0.0)}, keyed AS (SELECT *, {_FOLD.format('entity')} AS key FROM spans),
said_in AS (SELECT doc_id, key, min(entity) AS label, count(*) AS mentions, max(confidence) AS confidence FROM keyed GROUP BY 1, 2),
ties AS (SELECT doc_id, {_FOLD.format('subject')} AS src, kind, {_FOLD.format('object')} AS dst, confidence FROM relations),
tied_in AS (SELECT doc_id, src, kind, dst, count(*) AS mentions, max(confidence) AS confidence FROM ties WHERE src <> dst GROUP BY 1, 2, 3, 4)"""


def _kept_up(spark, d) -> entity_graph.EntityGraph:
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    toxic = labels.where("toxic = 1")
    back = docs.join(toxic.where("quality = 1"), "doc_id", "left_semi")
    read = lambda x: entity_graph.facts(x, least=_LEAST, least_relation=0.0)
    return entity_graph.EntityGraph.of(read(docs)).remove(toxic).add(read(back))


@query(f"""WITH {_FACTS} SELECT 'entity_' || key AS id, min(label) AS label, 'entity' AS kind, sum(mentions)::BIGINT AS mentions, count(*) AS documents, max(confidence) AS confidence FROM said_in GROUP BY key
UNION ALL SELECT 'doc_' || doc_id, 'doc_' || doc_id, 'document', 0, 1, 1.0::DOUBLE FROM docs""")
def entity_graph_nodes(spark, d):
    return _kept_up(spark, d).nodes


@query(f"""WITH {_FACTS} SELECT 'entity_' || src AS src, 'entity_' || dst AS dst, kind, sum(mentions)::BIGINT AS mentions, count(*) AS documents, max(confidence) AS weight FROM tied_in GROUP BY src, dst, kind
UNION ALL SELECT 'doc_' || doc_id, 'entity_' || key, 'contains', mentions, 1, 1.0::DOUBLE FROM said_in""")
def entity_graph_edges(spark, d):
    return _kept_up(spark, d).edges


@query(f"""WITH RECURSIVE {_spans_sql()}, keys AS (SELECT DISTINCT {_FOLD.format('entity')} AS key FROM spans), worded AS (SELECT key, list_distinct(string_split(key, ' ')) AS words FROM keys WHERE key <> ''),
longer AS (SELECT a.key, b.key AS parent, rank() OVER (PARTITION BY a.key ORDER BY len(b.words)) AS place FROM worded a JOIN worded b ON len(a.words) < len(b.words) AND list_has_all(b.words, a.words)),
links AS (SELECT key, min(parent) AS parent FROM longer WHERE place = 1 GROUP BY key HAVING count(*) = 1), both_ways AS (SELECT key AS a, parent AS b FROM links UNION SELECT parent, key FROM links),
walk AS (SELECT key, key AS seen FROM worded UNION SELECT walk.key, b FROM walk JOIN both_ways ON seen = a)
SELECT key, max(struct_pack(n := len(string_split(seen, ' ')), name := seen)).name AS entity FROM walk GROUP BY key""")
def entity_names(spark, d):
    found = relations.spans(read_table(spark, d, "documents"), least=_LEAST)
    return entity_graph.resolved(found.select(entity_graph.folded(F.col("entity")).alias("key")))


# shortest ways through the nations' graph, and versions of stored entries


@query(f"""WITH RECURSIVE {_EDGES}, e AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), w AS (SELECT id AS s, id AS v, 0 AS d FROM nodes UNION ALL SELECT s, dst, d + 1 FROM w JOIN e ON v = src WHERE d < 5),
l AS (SELECT s, v, d, count(*) AS ways FROM w GROUP BY s, v, d QUALIFY d = min(d) OVER (PARTITION BY s, v)),
b AS (SELECT a.v AS id, sum(a.ways * b.ways / c.ways::DOUBLE) AS x FROM l a JOIN l b ON a.v = b.s JOIN l c ON c.s = a.s AND c.v = b.v AND c.d = a.d + b.d WHERE a.s <> a.v AND b.v <> a.v AND a.s <> b.v GROUP BY 1)
SELECT id, round(coalesce(x, 0) / ((SELECT count(*) FROM nodes) - 1) / ((SELECT count(*) FROM nodes) - 2), 9) AS betweenness FROM nodes LEFT JOIN b USING (id)""")
def graph_betweenness(spark, d):
    return graph.betweenness(*_graph(spark, d))


@query("""WITH marked AS (SELECT d.doc_id, coalesce(source, '') AS source, text, l.toxic, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)),
v AS (SELECT 1 AS version, source, text FROM marked UNION ALL SELECT 2, source, CASE WHEN toxic = 1 THEN '' ELSE text END FROM marked
  UNION ALL SELECT v, source, CASE WHEN toxic = 1 THEN '' ELSE text END FROM marked, (VALUES (3), (4)) t(v) WHERE coalesce(quality, 1) <> 0)
SELECT version, source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM v GROUP BY ALL""")
def snapshot_versions(spark, d):
    """All documents stored; toxic ones emptied; poor ones deleted; all live ones written as one: each version as it reads at the end."""
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    entries = docs.select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", "text")
    store = Snapshots(spark, f"{shared_folder(spark)}/sparquill/snapshots-{uuid.uuid4().hex}", ("source", "doc_id"), ("source",))
    store.put(entries)
    store.put(entries.join(labels.where("toxic = 1"), "doc_id", "left_semi").withColumn("text", F.lit("")))
    store.delete(entries.join(labels.where("quality = 0"), "doc_id", "left_semi"))
    store.compact()
    versions = [store.read(v).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars")).withColumn("version", F.lit(v)) for v in (1, 2, 3, 4)]
    return reduce(lambda a, b: a.unionByName(b), versions)
