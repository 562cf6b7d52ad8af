"""Tables and texts within text: sniffing, delimited and pipe tables, file types, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

# File endings and the kinds of documents they mean.
FILE_KINDS = (("pdf", "pdf"), ("doc", "word"), ("docx", "word"), ("ppt", "powerpoint"), ("pptx", "powerpoint"), ("html", "html"), ("htm", "html"), ("md", "markdown"), ("txt", "text"))


def _count(text: Column, part: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(part), F.lit("")))


def table_format(text: Column) -> Column:
    """html, markdown, csv, tsv or unknown, the first that fits."""
    commas, tabs, semicolons = (_count(text, c) for c in (",", "\t", ";"))
    piped = F.exists(F.split(text, "\n"), lambda l: F.char_length(l) - F.char_length(F.replace(l, F.lit("|"), F.lit(""))) >= 2)
    return (
        F.when(F.contains(text, F.lit("<table")) | F.contains(text, F.lit("<tr")), "html").when(piped, "markdown").when((commas > tabs) & (commas > semicolons), "csv")
        .when((tabs > commas) & (tabs > semicolons), "tsv").when(semicolons > 0, "csv").otherwise("unknown")
    )


def delimiter(text: Column) -> Column:
    """What the first line has most of: comma, semicolon, tab or pipe, the earlier of these if as often."""
    line = F.get(F.split(text, "\n"), F.lit(0))
    counts = [(d, _count(line, d)) for d in (",", ";", "\t", "|")]
    best = F.greatest(*(n for _, n in counts))
    out = F.when(F.lit(False), "")
    for d, n in counts:
        out = out.when(n == best, d)
    return out


def delimited_cells(raw: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, row, column, header, value) of delimited texts.

    Rows with another number of cells than the header are left out; quotes are
    only cut from the ends of cells, so a delimiter within them still parts.
    """
    x = raw.select(F.col(id_column).alias("id"), F.filter(F.split(text, "\n"), lambda l: F.trim(l) != "").alias("lines"), delimiter(F.col(text)).alias("d"))
    clean = lambda cells: F.transform(cells, lambda c: F.trim(F.regexp_replace(F.trim(c), '^"+|"+$', "")))
    cells = lambda line: clean(F.split(line, F.concat(F.lit("\\Q"), F.col("d"), F.lit("\\E"))))
    rows = x.select("id", cells(F.get("lines", F.lit(0))).alias("header"), "d", F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("row", "line"))
    rows = rows.select("id", "header", "row", cells(F.col("line")).alias("cells")).where(F.size("cells") == F.size("header"))
    return rows.select("id", "row", F.posexplode(F.arrays_zip("header", "cells")).alias("column", "z")).select("id", "row", "column", F.col("z.header").alias("header"), F.col("z.cells").alias("value"))


def pipe_cells(raw: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, line, column, header, value) of pipe tables.

    A table begins where the next line holds only pipes, dashes, colons and
    blanks, and ends at the first line without a pipe. Empty cells are dropped,
    and rows that then differ in number from the header are, too.
    """
    cells = lambda l: F.filter(F.transform(F.split(l, "\\|"), lambda c: F.trim(c)), lambda c: c != "")
    rule = lambda l: l.rlike("^[|:\\- \\t]+$") & F.contains(l, F.lit("-")) & F.contains(l, F.lit("|"))
    lines = raw.select(F.col(id_column).alias("id"), F.split(text, "\n").alias("lines"))

    def tables(ls: Column) -> Column:
        n = F.size(ls)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.coalesce(F.contains(F.get(ls, i), F.lit("|")) & ~rule(F.get(ls, i)) & rule(F.get(ls, i + 1)), F.lit(False)))
        breaks = F.concat(F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.contains(F.get(ls, i), F.lit("|"))), F.array(n))

        def body(s: Column) -> Column:
            end = F.array_min(F.filter(breaks, lambda b: b > s))
            return F.transform(F.slice(ls, s + 3, F.greatest(end - s - 2, F.lit(0))), lambda l: F.struct(cells(F.get(ls, s)).alias("header"), cells(l).alias("cells")))

        return F.transform(starts, lambda s: F.struct(s.alias("start"), body(s).alias("rows")))

    found = lines.select("id", F.inline(let(F.col("lines"), tables))).select("id", "start", F.posexplode("rows").alias("row", "r"))
    kept = found.where(F.size("r.cells") == F.size("r.header"))
    return kept.select("id", (F.col("start") + 2 + F.col("row")).alias("line"), F.posexplode(F.arrays_zip(F.col("r.header").alias("header"), F.col("r.cells").alias("value"))).alias("column", "z")).select("id", "line", "column", "z.header", "z.value")


def file_kind(path: Column) -> Column:
    """The kind of a document by its file's ending; mixed without a known one."""
    ending = F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))
    out = F.when(F.lit(False), "")
    for end, kind in FILE_KINDS:
        out = out.when(ending == end, kind)
    return out.otherwise("mixed")


def without_tags(html: Column) -> Column:
    """What stands outside of tags, joined as it is: bodies of scripts stay, entities too."""
    parts = F.split(html, "<")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).when(F.contains(p, F.lit(">")), F.substring(p, F.instr(p, ">") + 1, F.char_length(p))).otherwise("")), "")
