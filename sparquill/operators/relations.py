"""Entities with their places in texts, and relations between them."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .entities import PASSED, PATTERNS, without_recursion

# Words of which alone no entity consists.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from up about into through during before after above below between among this that these those i me my myself we our ours ourselves you your yours yourself "
    "yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom whose am is are was were be been being have has had having do does did doing would should "
    "could can may might must shall will"
).split()
# How sure a kind's patterns are, and how much a kind counts.
SURE = {"datetime": 0.9, "money": 0.9, "percentage": 0.9, "technical": 0.8}
COUNTS = {"person": 0.9, "organization": 0.8, "location": 0.8, "datetime": 0.7, "technical": 0.6}
OTHER_SURE, OTHER_COUNTS = 0.7, 0.5
# What stands between the two ends of a relation of each kind.
LINKS = (
    ("is_a", r"\s+is\s+a\s+"),
    ("is_a", r"\s+(?:are|is)\s+(?:an?|the)\s+"),
    ("part_of", r"\s+(?:is|are)\s+part\s+of\s+"),
    ("part_of", r"\s+belongs\s+to\s+"),
    ("located_in", r"\s+(?:is|are)\s+located\s+in\s+"),
    ("located_in", r"\s+in\s+"),
    ("works_for", r"\s+works\s+(?:for|at)\s+"),
    ("works_for", r"\s+(?:is|was)\s+employed\s+(?:by|at)\s+"),
    ("owns", r"\s+owns\s+"),
    ("owns", r"\s+(?:has|possesses)\s+"),
)
LINKED, NEAR, REACH = 0.7, 0.3, 100  # confidence of a patterned relation and of nearness; bytes

# where one of the fixed patterns can begin: a capital or a digit ahead of which a word begins, a dollar sign, "the" before a capital
_STARTS = re.compile(r"[A-Z0-9$t](?:(?<=\b[A-Z0-9])|(?<=\$)(?=\d)|(?<=\bt)he(?=\s+[A-Z]))")

ROWS = 200  # texts whose entities a worker holds at a time
SPANS = "row long, doc_id long, rule int, start long, end long, first long, last long, entity string, behind string"


def confidence(kind: str, counts: Mapping[str, float] = COUNTS) -> float:
    return min(round(SURE.get(kind, OTHER_SURE) * counts.get(kind, OTHER_COUNTS), 6), 1.0)


def _hits(pattern: re.Pattern, text: str, starts: list[int] | None) -> Iterator[re.Match]:
    """Matches in order, none within another; only from the starts, if these are all that it can begin at."""
    if starts is None:
        yield from pattern.finditer(text)
        return
    end = 0
    for at in starts:
        if at >= end and (m := pattern.match(text, at)):
            end = m.end()
            yield m


def spans(docs: DataFrame, patterns: Sequence[tuple[str, str]] = PATTERNS, least: float = 0.5, longest: int = 100, counts: Mapping[str, float] = COUNTS) -> DataFrame:
    """(row, doc_id, rule, kind, start, end, entity, confidence, ...) of the entities in whole texts, a row a mention.

    start and end count UTF-8 bytes, first and last code points; entity has
    single spaces; behind is the text up to REACH bytes' worth of code points
    behind it. Kinds whose confidence is below `least`, entities longer than
    `longest` bytes and those of stop words only are left out; of rules that
    find the same place the first counts. `row` tells rows of docs apart, also
    such as share a doc_id or have none. Null and empty texts have none.
    """
    rules = [(i, p, PASSED.get(p)) for i, (kind, p) in enumerate(patterns) if confidence(kind, counts) >= least]
    stop = frozenset(STOP_WORDS)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(i, re.compile(f"({without_recursion(p)})" + (f"|{passed}" if passed else ""))) for i, p, passed in rules]
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            out: list[tuple] = []
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                places = {}
                starts = [m.start() for m in _STARTS.finditer(text)] if patterns is PATTERNS else None
                for rule, pattern in compiled:
                    for m in _hits(pattern, text, starts):
                        if m[1] and m.span() not in places:
                            entity = " ".join(m[0].split())
                            if len(m[0].strip().encode()) <= longest and not stop.issuperset(entity.lower().split()):
                                places[m.span()] = rule, entity
                at = byte = 0
                for (first, last), (rule, entity) in sorted(places.items()):
                    byte, at = byte + len(text[at:first].encode()), first
                    out.append((row, doc_id, rule, byte, byte + len(text[first:last].encode()), first, last, entity, text[last : last + REACH]))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["row", "doc_id", "rule", "start", "end", "first", "last", "entity", "behind"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text").where(F.col("text").isNotNull()).mapInArrow(found, SPANS)
    kinds = F.create_map(*(F.lit(x) for i, (kind, _) in enumerate(patterns) for x in (i, kind)))
    sure = F.create_map(*(F.lit(x) for i, (kind, _) in enumerate(patterns) for x in (i, float(confidence(kind, counts)))))
    return rows.select("*", kinds[F.col("rule")].alias("kind"), sure[F.col("rule")].alias("confidence"))


def _link(between: Column, links: Sequence[tuple[str, str]]) -> Column:
    """The kinds of relations that the text between two entities spells, each once."""
    kinds = dict.fromkeys(kind for kind, _ in links)
    return F.filter(F.array(*(F.when(between.rlike("^(?:" + "|".join(p for k, p in links if k == kind) + ")$"), kind) for kind in kinds)), lambda x: x.isNotNull())


def relations(found: DataFrame, least: float = 0.5, links: Sequence[tuple[str, str]] = LINKS, reach: int = REACH, longest: int = 100) -> DataFrame:
    """(row, doc_id, subject, kind, object, confidence, start, end, distance) between the entities of spans().

    Two entities of a text at most `reach` bytes apart are mentioned_with each
    other, the surer the nearer, in the order they begin; if what stands between
    them is one of the links, that relation holds, too. Relations below `least`
    are left out; at the default of 0.5 nearness alone is not enough.

    Partners come from a range of places behind each entity: no two entities
    further apart ever meet, however many a text holds.
    """
    ahead = Window.partitionBy("row").orderBy("start").rangeBetween(0, longest + reach)
    each = F.struct("start", "end", "rule", "first", "entity")
    pairs = found.withColumn("all", F.collect_list(each).over(ahead)).withColumn("b", F.explode("all")).drop("all")
    order = F.struct("start", "end", "rule") < F.struct("b.start", "b.end", "b.rule")
    distance = F.greatest(F.col("b.start") - F.col("end"), F.lit(0))
    pairs = pairs.withColumn("distance", distance).where(order & (F.col("distance") <= reach))
    between = F.when(F.col("b.first") > F.col("last"), F.expr("substring(behind, 1, cast(b.first - last as int))")).otherwise("")
    near = F.struct(F.lit("mentioned_with").alias("kind"), F.round(NEAR * (1 - F.col("distance") / reach), 6).alias("confidence"))
    told = F.transform(_link(between, links), lambda k: F.struct(k.alias("kind"), F.lit(LINKED).alias("confidence")))
    rows = pairs.select("row", "doc_id", F.col("entity").alias("subject"), F.col("b.entity").alias("object"), "start", F.greatest("end", "b.end").alias("end"), "distance", F.inline(F.concat(F.array(near), told)))
    return rows.where(F.col("confidence") >= least).select("row", "doc_id", "subject", "kind", "object", "confidence", "start", "end", "distance")


def match_entities(names: DataFrame, found: DataFrame) -> DataFrame:
    """names (row, name) with the entity and place of the first mention in the same text that equals the name but for the case of ASCII letters; null without one."""
    fold = lambda c: F.translate(F.col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    first = found.groupBy("row", fold("entity").alias("folded")).agg(F.min(F.struct("start", "end", "entity")).alias("m"))
    named = names.withColumn("folded", fold("name"))
    return named.join(first, ["row", "folded"], "left").select(*names.columns, F.col("m.entity").alias("entity"), F.col("m.start").alias("start"))
