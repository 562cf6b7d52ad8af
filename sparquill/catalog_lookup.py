"""Queries over lookups: cached questions and vector indexes, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _METRIC_SQL, _VEC, ASKED, query  # noqa: PLC2701
from .operators import lookup, search
from .operators.vector_index import VectorIndex
from .sources.files import read_table

_ALIKE = "trim(regexp_replace(regexp_replace(lower(question), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_LEAST = 0.5


@query(f"""WITH titles AS (SELECT doc_id AS id, regexp_extract(text, '^[^.!?\\n]*') AS question FROM documents), said AS (SELECT id, question, {_ALIKE} AS alike, string_split({_ALIKE}, ' ') AS words FROM titles), asked AS (SELECT * FROM said WHERE id % 20 = 0),
pairs AS (SELECT a.id, b.id AS entry, a.question = b.question AS equal, a.alike = b.alike AS alike, len(list_filter(a.words, lambda w: list_contains(b.words, w))) AS shared, len(a.words) + len(b.words) AS n, a.alike <> '' AND b.alike <> '' AS words FROM asked a JOIN said b ON a.id <> b.id),
scored AS (SELECT *, shared::DOUBLE / greatest(n - shared, 1) AS likeness FROM pairs),
found AS (SELECT id, CASE WHEN equal THEN 1 WHEN alike THEN 2 ELSE 3 END AS tier, entry, CASE WHEN alike THEN 1.0::DOUBLE ELSE likeness END AS likeness FROM scored WHERE words AND (alike OR likeness >= {_LEAST})),
best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, likeness DESC, entry) = 1)
SELECT asked.id, CASE tier WHEN 1 THEN 'equal' WHEN 2 THEN 'alike' WHEN 3 THEN 'like' END AS tier, entry, round(likeness, 6) AS likeness FROM asked LEFT JOIN best USING (id)""")
def cached_questions(spark, d):
    """Titles, the first sentences of documents, asked of a cache of all titles."""
    titles = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.regexp_extract("text", "^[^.!?\\n]*", 0).alias("question"))
    return lookup.cached_answers(titles.where("id % 20 = 0"), titles, _LEAST)


# vectors in inverted lists


@query()
def vector_index_search(spark, d):
    """The ten nearest by the index, with each query's share of the exact ten that are among them."""
    v = read_table(spark, d, "embeddings")
    index, asked = VectorIndex.build(v).rebalanced(), v.where(ASKED)
    found = index.search(asked, 10)
    exact = search.knn(v, asked, 10).select("query_id", "id")
    recall = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").groupBy("query_id").agg(F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))
    return found.join(recall, "query_id").select("query_id", "id", "score", (F.col("place") - 1).alias("rank"), "recall")


@query(f"""WITH vectors AS (SELECT vec_id, CASE WHEN label = 3 THEN list_transform({_VEC}, lambda x: -x) ELSE {_VEC} END AS v FROM embeddings), asked AS (SELECT vec_id AS query_id, v AS q FROM vectors WHERE {ASKED})
SELECT query_id, vec_id AS id, round({_METRIC_SQL['cosine']}, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM vectors JOIN asked ON vec_id <> query_id QUALIFY rank < 10""")
def vector_index_updated(spark, d):
    """All vectors of a label replaced in the index; then the exact way over it."""
    v = read_table(spark, d, "embeddings")
    turned = v.where("label = 3").withColumn("embedding", F.transform("embedding", lambda x: -x))
    index = VectorIndex.build(v).add(turned)
    return index.exact(index.rows.where(ASKED), 10).select("query_id", "id", "score", (F.col("place") - 1).alias("rank"))
