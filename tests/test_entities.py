"""Entities in their places, relations, graphs kept up to date and names resolved, against brute force."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from sparquill.operators import entities, entity_graph, relations

TOLD = "John Smith works for Acme Corp. Anna Lee is a member. Acme Corp is located in Boston, MA\nThe Acme Corp owns Fine Company; Émile Zola and Jose Diaz in New York, on January 5, 2020."


def brute_spans(text, least=0.5):
    found = {}
    for rule, (kind, pattern) in enumerate(entities.PATTERNS):
        sure = relations.SURE.get(kind, 0.7) * relations.COUNTS.get(kind, 0.5)
        for m in re.finditer(pattern, text) if round(sure, 6) >= least else ():
            words = m[0].lower().split()
            if len(m[0].strip().encode()) <= 100 and any(w not in relations.STOP_WORDS for w in words):
                found.setdefault(m.span(), (rule, " ".join(m[0].split()), round(sure, 6)))
    at = lambda i: len(text[:i].encode())
    return sorted((at(a), at(b), rule, a, b, entity, sure) for (a, b), (rule, entity, sure) in found.items())


def brute_relations(text, least, reach=100):
    found, out = brute_spans(text), collections.Counter()
    for i, x in enumerate(found):
        for y in found[i + 1 :]:
            distance = max(0, y[0] - x[1])
            if distance > reach:
                continue
            near = round(0.3 * (1 - distance / reach), 6)
            kinds = {kind for kind, p in relations.LINKS if re.fullmatch(p, text[x[4] : y[3]])} if y[3] > x[4] else set()
            for kind, sure in [("mentioned_with", near), *((k, 0.7) for k in kinds)]:
                if sure >= least:
                    out[x[5], kind, y[5], sure, x[0], max(x[1], y[1]), distance] += 1
    return out


def texts():
    rng = random.Random(7)
    parts = ["John Smith", "Acme Corp", "Boston, MA", "Dr. Ada Byron King", " works for ", " in ", " is a ", " owns ", "The The", " é, ", ". ", " and so on, at length, ", "New  York", "2020-01-02", "Émile Zola", " belongs to ", "the Trade Agency", "\n"]
    return [TOLD, "", None, "no names here", "John Smith " * 40, "x" * 300 + "John Smith" + "é" * 49 + "Anna Lee" + "." * 101 + "Carl Fox", *("".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(60))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 5) for i, t in enumerate(texts())] + [(None, TOLD, None, None), (3, TOLD, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, rule int").repartition(3).cache()


def test_spans_and_relations_equal_brute_force(docs):
    found = relations.spans(docs).cache()
    got = collections.defaultdict(list)
    for r in found.collect():
        got[r.row].append((r.start, r.end, r.rule, r["first"], r["last"], r.entity, r.confidence))
    want = [brute_spans(t) for t in [*texts(), TOLD, TOLD] if t]
    assert sorted(map(sorted, got.values())) == sorted(x for x in want if x)
    for least in (0.5, 0.0, 0.25):
        said = collections.Counter((r.subject, r.kind, r.object, r.confidence, r.start, r.end, r.distance) for r in relations.relations(found, least).collect())
        assert said == sum((brute_relations(t, least) for t in [*texts(), TOLD, TOLD] if t), collections.Counter())
    assert relations.spans(docs.limit(0)).count() == 0 and relations.relations(found.limit(0)).count() == 0


def test_told_relations(spark):
    """The cases that users of the engine know: a person who works for an organization, with kinds of one's own."""
    said = relations.relations(relations.spans(spark.createDataFrame([(1, TOLD)], "doc_id long, text string"))).collect()
    assert {(r.subject, r.kind, r.object) for r in said} >= {("John Smith", "works_for", "Acme Corp"), ("Acme Corp", "located_in", "Boston, MA"), ("Jose Diaz", "located_in", "New York")}
    assert all(r.confidence == 0.7 for r in said)
    own = (("person", r"\b(?:Alice)\b"), ("organization", r"\bGoogle\b"))
    text = "Alice is a software engineer. Alice works for Google."
    said = relations.relations(relations.spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), own)).collect()
    assert [(r.subject, r.kind, r.object, text.encode()[r.start : r.end].decode()) for r in said] == [("Alice", "works_for", "Google", "Alice works for Google")]


def test_names_match_mentions_but_for_ascii_case(spark, docs):
    found = relations.spans(docs.where("doc_id = 0"))
    row = found.first().row
    names = spark.createDataFrame([(row, "JOHN smith"), (row, "émile Zola"), (row, "acme corp"), (row, "Nobody"), (row + 1, "John Smith")], "row long, name string")
    got = {r.name: (r.entity, r.start) for r in relations.match_entities(names, found).collect()}
    assert got["JOHN smith"] == ("John Smith", 0) and got["acme corp"][0] == "Acme Corp" and got["émile Zola"] == got["Nobody"] == (None, None) == got["John Smith"]


def same(a, b):
    order = sorted(a.columns)
    rows = lambda x: sorted(map(repr, (tuple(r) for r in x.select(*order).collect())))
    assert sorted(b.columns) == order and rows(a) == rows(b)


def test_graph_after_changes_is_the_rebuilt_one(spark, docs):
    docs = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    read = lambda x: entity_graph.facts(x, least_relation=0.1)
    built = entity_graph.EntityGraph.of(read(docs))
    assert {r.kind for r in built.edges.select("kind").distinct().collect()} >= {"contains", "mentioned_with", "works_for"}
    gone = docs.where("doc_id % 3 = 0 or doc_id = 1000").select("doc_id")
    left = built.remove(gone)
    rebuilt = entity_graph.EntityGraph.of(read(docs.where("doc_id % 3 <> 0")))
    same(left.nodes, rebuilt.nodes)
    same(left.edges, rebuilt.edges)
    changed = docs.where("doc_id % 2 = 0").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" Carl Fox in Boston")))
    grown = left.add(read(changed))
    again = entity_graph.EntityGraph.of(read(docs.where("doc_id % 3 <> 0 and doc_id % 2 <> 0").unionByName(changed)))
    same(grown.nodes, again.nodes)
    same(grown.edges, again.edges)
    same(built.remove(docs.select("doc_id")).nodes, built.nodes.limit(0))


def test_chunks_are_texts_of_their_own(spark):
    chunks = spark.createDataFrame([(1, 0, "John Smith works for"), (1, 1, " Acme Corp"), (2, 0, "John Smith works for Acme Corp")], "doc_id long, chunk_index int, text string")
    graph = entity_graph.EntityGraph.of(entity_graph.facts(chunks, least_relation=0.0))
    assert [(r.src, r.dst, r.documents) for r in graph.edges.where("kind = 'works_for'").collect()] == [("entity_john smith", "entity_acme corp", 1)]
    assert {(r.id, r.mentions, r.documents) for r in graph.nodes.where("kind = 'entity'").collect()} == {("entity_john smith", 2, 2), ("entity_acme corp", 2, 2)}


def test_names_resolve_to_their_only_longer_form(spark):
    names = ["smith", "john smith", "john a smith", "lee", "anna lee", "bo lee", "acme", "acme corp", "acme corp of boston", "boston", "", "zola zola", "zola"]
    got = {r.key: r.entity for r in entity_graph.resolved(spark.createDataFrame([(n,) for n in names * 2], "key string")).collect()}
    sets = {n: set(n.split()) for n in names if n}
    parents = {}
    for n, words in sets.items():
        longer = sorted((len(w), m) for m, w in sets.items() if words < w)
        best = [m for size, m in longer if size == longer[0][0]]
        if len(best) == 1:
            parents[n] = best[0]
    assert {(r.key, r.parent) for r in entity_graph.name_links(spark.createDataFrame([(n,) for n in names], "key string")).collect()} == set(parents.items())
    assert got["smith"] == got["john smith"] == "john a smith" and got["lee"] == "lee" and got["boston"] == got["acme"] == "acme corp of boston" and set(got) == set(sets)


def test_narrowed_patterns_find_the_same(spark, docs, monkeypatch):
    """Lists of words are tried only where one can begin, and rules only on texts that hold what they need."""
    assert entities.BEGINS and entities.NEEDS
    more = ["the Trade Agency paid $1,000.50 and 5 cents, 10 USD, 7 dollars", "12.5%or 3 percent of AWS and C++ in St. Paul on May 3, 2020", "agency 100 Percent"]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(500 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    got = sorted(map(tuple, entities.mentions(table).collect()))
    monkeypatch.setattr(entities, "BEGINS", {})
    monkeypatch.setattr(entities, "NEEDS", {})
    assert got == sorted(map(tuple, entities.mentions(table).collect())) and {r[1] for r in got} >= {3, 9, 10, 11, 12, 14}
