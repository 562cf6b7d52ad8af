"""Column functions over text: words, stems, set likeness, readability, chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words that rankings ignore, in the order they are defined; "the" stands there twice.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "by", "for", "from", "has", "have", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "will", "with", "the",
    "this", "these", "those", "i", "you", "we", "they", "them", "their", "what", "which", "who", "when", "where", "why", "how", "all", "would", "there", "could",
)
# Suffixes, the first that fits is cut.
SUFFIXES = ("ing", "ed", "es", "s", "ly", "er", "est", "ness", "ment")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Parts between white space, none of them empty."""
    return F.array_remove(F.split(text, "\\s+"), "")


def alphanumerics(text: Column) -> Column:
    """Lower-case runs of letters and digits of 2 to 50 bytes."""
    return F.filter(F.split(F.lower(text), "[^\\p{IsAlphabetic}\\p{N}]+"), lambda x: F.octet_length(x).between(2, 50))


def stem(word: Column) -> Column:
    """word without the first of SUFFIXES that it ends in, if more than three bytes remain."""
    out = F.when(F.lit(False), word)
    for s in SUFFIXES:
        out = out.when(F.endswith(word, F.lit(s)) & (F.octet_length(word) > len(s) + 3), F.substring(word, F.lit(1), F.char_length(word) - len(s)))
    return out.otherwise(word)


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two word lists as sets, 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def sentences(text: Column) -> Column:
    """Trimmed parts between full stops, exclamation and question marks, none empty."""
    return F.filter(F.transform(F.split(text, "[.!?]"), lambda x: F.trim(x)), lambda x: x != "")


def syllables(word: Column) -> Column:
    """Runs of vowels, one at least."""
    return F.greatest(F.size(F.regexp_extract_all(F.lower(word), F.lit("[aeiouy]+"), F.lit(0))), F.lit(1))


def sum_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def cut_fixed(text: Column, size: int, overlap: int) -> Column:
    """Windows of `size` characters that step by size - overlap; the last ends with the text."""
    step, n = size - overlap, F.char_length(text)
    starts = F.sequence(F.lit(0), F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int"))
    return F.transform(starts, lambda i: F.substring(text, i * step + 1, F.lit(size)))


def cut_sentences(text: Column, most: int, overlap: int) -> Column:
    """The text if it has at most `most` sentences, else windows of them joined by '. ' with a full stop."""

    def windows(parts: Column) -> Column:
        step = most - overlap
        starts = F.sequence(F.lit(0), F.ceil(F.greatest(F.size(parts) - most, F.lit(0)) / step).cast("int"))
        return F.when(F.size(parts) <= most, F.array(text)).otherwise(F.transform(starts, lambda i: F.concat(F.array_join(F.slice(parts, i * step + 1, F.lit(most)), ". "), F.lit("."))))

    return let(sentences(text), windows)


def cut_paragraphs(text: Column, most: int) -> Column:
    """The text if it has at most `most` paragraphs (parted by blank lines), else groups of them that don't overlap."""

    def groups(parts: Column) -> Column:
        starts = F.sequence(F.lit(0), F.ceil(F.size(parts) / most).cast("int") - 1)
        return F.when(F.size(parts) <= most, F.array(text)).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(parts, i * most + 1, F.lit(most)), "\n\n")))

    return let(F.filter(F.transform(F.split(text, "\n\n"), lambda x: F.trim(x)), lambda x: x != ""), groups)


def prepared(text: Column, steps: tuple) -> Column:
    """Steps in order: "lower", "spaces" (runs to one, ends cut), "plain" (letters, digits and white space only), or (what, by) for a literal replacement."""
    for step in steps:
        if step == "lower":
            text = F.lower(text)
        elif step == "spaces":
            text = F.trim(F.regexp_replace(text, "\\s+", " "))
        elif step == "plain":
            text = F.regexp_replace(text, "[^\\p{IsAlphabetic}\\p{N}\\s]", "")
        else:
            text = F.replace(text, F.lit(step[0]), F.lit(step[1]))
    return text


def char_grams(text: Column, n: int) -> Column:
    """Runs of n characters, none of them blank."""

    def runs(chars: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0)))
        return F.filter(F.transform(starts, lambda i: F.concat(*(F.get(chars, i + j) for j in range(n)))), lambda g: F.trim(g) != "")

    return F.when(F.char_length(text) < n, F.array().cast("array<string>")).otherwise(let(F.split(text, ""), runs))


def word_grams(w: Column, n: int) -> Column:
    """Runs of n words of a list, joined by a space."""
    return F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " ")))


def edge_trimmed(w: Column) -> Column:
    """Words without what is not a letter or digit at their ends, none empty."""
    return F.filter(F.transform(w, lambda x: F.regexp_replace(x, "^[^\\p{IsAlphabetic}\\p{N}]+|[^\\p{IsAlphabetic}\\p{N}]+$", "")), lambda x: x != "")


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two lists: one row of the table after the other, as an array."""
    zero = F.transform(F.concat(F.array(F.lit("")), b), lambda _: F.lit(0))

    def next_row(row: Column, x: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            left = F.element_at(done, -1)
            return F.concat(done, F.array(F.when(F.get(b, j - 1) == x, F.get(row, j - 1) + 1).otherwise(F.greatest(left, F.get(row, j)))))

        return F.when(F.size(b) == 0, row).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1))), F.array(F.lit(0)), cell))

    return F.element_at(F.aggregate(a, zero, next_row), -1)
