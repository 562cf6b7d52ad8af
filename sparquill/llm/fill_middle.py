"""Fill-in-the-middle: documents cut at two places and put together anew, by SQL over Arrow batches.

Units are runs of ASCII letters and single other code points. Where a document
is cut, and in which form it comes out, follows from the SHA-256 of a seed and
its doc_id alone, so any task gives the same. Null texts are empty; a null
doc_id counts as an empty number; rows that repeat come out alike; an empty
table gives no rows. Extra columns are not read.

Each task has a DuckDB of its own, one thread, in memory, that sees some
megabytes of texts at a time: a batch is cut where that many are reached, so
only a longer single text exceeds it. Of a text, the list of its units takes
about sixteen bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARKERS = ("<P>", "<S>", "<M>")  # of prefix, suffix and middle
BATCH_BYTES = 4 << 20


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _group(number: int) -> str:
    """The number-th eight hex digits of the document's hash."""
    return f"('0x' || substr(h, {8 * number - 7}, 8))::UBIGINT"


def cut_sql(table: str, seed: str = "1", plain_from: int = 90, spm_below: int = 20, markers: tuple[str, str, str] = MARKERS, text: bool = True) -> str:
    """SQL over doc_id and text of `table`: the parts' sizes, output, and hashes of output and of the text restored from it."""
    p, s, m = (_quoted(x) for x in markers)
    after = lambda x, marker: f"substr({x}, strpos({x}, {marker}) + {len(marker) - 2})"
    before = lambda x, marker: f"substr({x}, 1, strpos({x}, {marker}) - 1)"
    head = lambda marker: f"substr(output, {len(marker) - 1})"
    part = lambda first, last: f"array_to_string(list_slice(units, {first}, {last}), '')"
    return f"""
    WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text, sha256({_quoted(seed + ":")} || coalesce(doc_id::VARCHAR, '')) AS h FROM {table}),
    cut AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, {_group(1)} AS h1, {_group(2)} AS h2, {_group(3)} AS h3, {_group(4)} AS h4 FROM hashed),
    placed AS (SELECT doc_id, text, units, len(units)::BIGINT AS n, h1 % (len(units) + 1)::UBIGINT AS c1, h2 % (len(units) + 1)::UBIGINT AS c2,
        CASE WHEN text = '' OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR h3 % 100 >= {plain_from} THEN 'plain' WHEN h4 % 100 < {spm_below} THEN 'spm' ELSE 'psm' END AS form FROM cut),
    parted AS (SELECT doc_id, text, n, form, {part("1", "least(c1, c2)::BIGINT")} AS prefix, {part("least(c1, c2)::BIGINT + 1", "greatest(c1, c2)::BIGINT")} AS middle, {part("greatest(c1, c2)::BIGINT + 1", "n")} AS suffix FROM placed),
    made AS (SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
        CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle ELSE {s} || suffix || {p} || prefix || {m} || middle END AS output FROM parted),
    opened AS (SELECT *, CASE form WHEN 'psm' THEN {head(p)} WHEN 'spm' THEN {head(s)} END AS body FROM made),
    halved AS (SELECT *, CASE form WHEN 'psm' THEN {before("body", s)} WHEN 'spm' THEN {before("body", p)} END AS one, CASE form WHEN 'psm' THEN {after("body", s)} WHEN 'spm' THEN {after("body", p)} END AS rest FROM opened),
    read AS (SELECT *, {before("rest", m)} AS two, {after("rest", m)} AS three FROM halved)
    SELECT doc_id, n, form, prefix_chars, middle_chars, {"output," if text else ""} sha256(output) AS output_sha256,
        sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN one || three || two ELSE two || three || one END) AS restored_sha256 FROM read"""


def _pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text, one row at least."""
    column = batch.column("text")
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]) if len(column) else np.zeros(0, np.int64)
    group = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def fill_in_middle(docs: DataFrame, seed: str = "1", plain_from: int = 90, spm_below: int = 20, markers: tuple[str, str, str] = MARKERS, text: bool = True, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output (if `text`), output_sha256, restored_sha256 of every document.

    Of a hundred documents by hash, those from plain_from on stay as they are,
    and of the others those below spm_below put the suffix first. Texts that are
    empty or hold a marker stay, too.
    """
    sql = cut_sql("batch", seed, plain_from, spm_below, markers, text)

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1})
        try:
            for whole in batches:
                for some in _pieces(whole, batch_bytes):
                    con.register("batch", pa.Table.from_batches([some]))
                    made = con.sql(sql).to_arrow_table()
                    con.unregister("batch")
                    yield from made.cast(pa.schema([(f.name, pa.string() if f.name in ("form", "output", "output_sha256", "restored_sha256") else pa.int64()) for f in made.schema])).to_batches()
        finally:
            con.close()

    columns = f"doc_id long, n long, form string, prefix_chars long, middle_chars long, {'output string, ' if text else ''}output_sha256 string, restored_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(transform, columns)
