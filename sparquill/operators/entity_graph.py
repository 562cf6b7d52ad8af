"""Entity graphs of documents: built, kept up to date as documents come and go, and resolved to one node an entity.

The facts of a graph are what each document says: its mentions of entities and
its relations, a row for each distinct one. Nodes and edges are sums over the
facts. Documents that come or go touch only nodes and edges that they speak of;
these are summed anew from the facts that are left, so the graph is always the
one that all documents at once would give.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rounds import settled
from . import graph, relations
from .entities import PATTERNS


def folded(name: Column) -> Column:
    """What names of one entity share: lower-case words without punctuation."""
    return F.trim(F.regexp_replace(F.lower(name), "[^\\p{L}\\p{N}]+", " "))


@dataclass(frozen=True)
class Facts:
    """mentions (doc_id, key, label, mentions, confidence), relations (doc_id, src, kind, dst, mentions, confidence) and documents (doc_id)."""

    mentions: DataFrame
    relations: DataFrame
    documents: DataFrame


def facts(docs: DataFrame, patterns: Sequence[tuple[str, str]] = PATTERNS, least: float = 0.5, least_relation: float = 0.5) -> Facts:
    """What documents say; rows without doc_id are left out.

    Facts are written: a graph reads them several times over as it changes.
    Rows that share a doc_id, such as chunks of a document, are texts of their
    own, in which places are counted apart, and speak for one document.
    """
    docs = docs.where(F.col("doc_id").isNotNull())
    found = settled(relations.spans(docs, patterns, least).withColumn("key", folded(F.col("entity"))))
    mentions = found.groupBy("doc_id", "key").agg(F.min("entity").alias("label"), F.count(F.lit(1)).alias("mentions"), F.max("confidence").alias("confidence"))
    tied = relations.relations(found, least_relation).select("doc_id", folded(F.col("subject")).alias("src"), "kind", folded(F.col("object")).alias("dst"), "confidence").where("src <> dst")
    said = tied.groupBy("doc_id", "src", "kind", "dst").agg(F.count(F.lit(1)).alias("mentions"), F.max("confidence").alias("confidence"))
    return Facts(settled(mentions), settled(said), settled(docs.select("doc_id").distinct()))


def _entity(key: str) -> Column:
    return F.concat(F.lit("entity_"), F.col(key))


def _document() -> Column:
    return F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))


def nodes(f: Facts) -> DataFrame:
    """(id, label, kind, mentions, documents, confidence): a node an entity, and one a document."""
    entity = f.mentions.groupBy("key").agg(F.min("label").alias("label"), F.sum("mentions").alias("mentions"), F.count(F.lit(1)).alias("documents"), F.max("confidence").alias("confidence"))
    document = f.documents.select(_document().alias("id"), _document().alias("label"), F.lit("document").alias("kind"), F.lit(0).cast("long").alias("mentions"), F.lit(1).cast("long").alias("documents"), F.lit(1.0).cast("double").alias("confidence"))
    return entity.select(_entity("key").alias("id"), "label", F.lit("entity").alias("kind"), "mentions", "documents", "confidence").unionByName(document)


def _tied(said: DataFrame) -> DataFrame:
    """Edges between entities, summed over what documents say."""
    rows = said.groupBy("src", "dst", "kind").agg(F.sum("mentions").alias("mentions"), F.count(F.lit(1)).alias("documents"), F.max("confidence").alias("weight"))
    return rows.select(_entity("src").alias("src"), _entity("dst").alias("dst"), "kind", "mentions", "documents", "weight")


def _held(mentions: DataFrame) -> DataFrame:
    """Edges from documents to the entities they mention."""
    return mentions.select(_document().alias("src"), _entity("key").alias("dst"), F.lit("contains").alias("kind"), "mentions", F.lit(1).cast("long").alias("documents"), F.lit(1.0).cast("double").alias("weight"))


def edges(f: Facts) -> DataFrame:
    """(src, dst, kind, mentions, documents, weight): relations between entities, and `contains` from a document to each of its entities.

    Relations join entities that the same document mentions; facts from
    elsewhere may name others, whose edges graph.valid_edges() drops.
    """
    return _tied(f.relations).unionByName(_held(f.mentions))


@dataclass(frozen=True)
class EntityGraph:
    """A graph with the facts it comes from. Tables are as the caller gives them; settle or write them where lineage grows."""

    facts: Facts
    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def of(cls, f: Facts) -> EntityGraph:
        return cls(f, nodes(f), edges(f))

    def _after(self, left: Facts, touched: Facts) -> EntityGraph:
        """The graph of the facts `left`, of which only what `touched` speaks of differs from this one."""
        keys, docs, said = touched.mentions.select("key").distinct(), touched.documents.select("doc_id").distinct(), touched.relations.select("src", "dst", "kind").distinct()
        documents = docs.select(_document().alias("id"))
        ids = keys.select(_entity("key").alias("id")).unionByName(documents)
        spoken = left.mentions.join(keys, "key", "left_semi")
        standing = left.documents.join(docs, "doc_id", "left_semi")
        new_nodes = self.nodes.join(ids, "id", "left_anti").unionByName(nodes(Facts(spoken, left.relations, standing)))
        named = said.select(_entity("src").alias("src"), _entity("dst").alias("dst"), "kind")
        kept = self.edges.join(named, ["src", "dst", "kind"], "left_anti").join(documents.toDF("src"), "src", "left_anti")
        summed = _tied(left.relations.join(said, ["src", "dst", "kind"], "left_semi"))
        return EntityGraph(left, new_nodes, kept.select(*self.edges.columns).unionByName(summed).unionByName(_held(left.mentions.join(docs, "doc_id", "left_semi"))))

    def remove(self, doc_ids: DataFrame) -> EntityGraph:
        """Without these documents (doc_id), and what only they spoke of."""
        ids = doc_ids.select("doc_id").distinct()
        f = self.facts
        left = Facts(*(settled(x.join(ids, "doc_id", "left_anti")) for x in (f.mentions, f.relations, f.documents)))
        gone = Facts(*(x.join(ids, "doc_id", "left_semi") for x in (f.mentions, f.relations, f.documents)))
        return self._after(left, gone)

    def add(self, new: Facts) -> EntityGraph:
        """With these documents, in place of such as have their doc_ids."""
        kept = self.remove(new.documents)
        f = kept.facts
        both = Facts(*(a.unionByName(b) for a, b in zip((f.mentions, f.relations, f.documents), (new.mentions, new.relations, new.documents), strict=True)))
        return kept._after(both, new)


def name_links(labels: DataFrame) -> DataFrame:
    """(key, parent): names (key) whose words all stand in one other name, the only shortest such.

    A name looks for longer ones by its rarest word alone, which must stand in
    them; words are counted over all names first, so that a word that very many
    names share is looked for only by names that have no rarer one.
    """
    named = labels.select("key").distinct().select("key", F.array_distinct(F.split("key", " ")).alias("words")).where(F.col("key") != "")
    words = named.select("key", "words", F.explode("words").alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rare = words.join(counts, "word").groupBy("key").agg(F.min(F.struct("n", "word")).alias("r"), F.first("words").alias("words")).select("key", "words", F.col("r.word").alias("word"))
    longer = words.select(F.col("key").alias("parent"), F.col("words").alias("all"), "word")
    within = rare.join(longer, "word").where((F.size("words") < F.size("all")) & (F.size(F.array_except("words", "all")) == 0))
    best = within.select("key", "parent", F.size("all").alias("size")).withColumn("rank", F.rank().over(Window.partitionBy("key").orderBy("size"))).where("rank = 1")
    return best.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("parent")).where("n = 1").select("key", "parent")


def resolved(labels: DataFrame) -> DataFrame:
    """(key, entity): each name with the name that stands for its entity, the longest of those that name_links() ties together; ties by the name."""
    names = labels.select(F.col("key").alias("id")).distinct().where(F.col("id") != "")
    part = graph.weak_components(names, name_links(labels).select(F.col("key").alias("src"), F.col("parent").alias("dst")))
    best = part.groupBy("component").agg(F.max_by("id", F.struct(F.size(F.split("id", " ")), "id")).alias("entity"))
    return part.join(best, "component").select(F.col("id").alias("key"), "entity")
