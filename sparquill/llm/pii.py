"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and
identifier cues; a parser for each kind of anchor looks to both sides of it,
finds where the item begins and ends and validates it. Work is linear in the
text, also in long runs of one kind of character: a digit within a number that
was parsed is passed over.

Base kinds (email, ip, card, phone) follow fixed patterns, leftmost and without
overlap, and matches that fail their validation are dropped. The parsers add
what these patterns lose or don't know: phones and cards whose digits run into
a neighbour's, URLs, accounts, secrets and street addresses. A secret reaches
from its cue, in any letter case, to white space or a quote; one in quotes to
the closing quote of its line.

Null texts count as empty: no spans. Rows keep their doc_id, null or repeated;
no rows give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "url", "account", "secret", "address")
EMAIL, IP, CARD, PHONE, URL, ACCOUNT, SECRET, ADDRESS = range(len(KINDS))
Span = tuple[int, int, int]  # start, kind, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_GROUP = re.compile(r"[0-9]+")
_URL_REST = re.compile(r"[^\s<>\"'`|\\^{}]+")
_ACCOUNT_REST = re.compile(r"(?:\s{1,3}(?:number|no\.?|nr\.?|id|code))?\s{0,3}[:=#]\s{0,3}[\"']?([A-Za-z0-9](?:[ -]?[A-Za-z0-9]){4,}+)")
_SECRET_SIGN = re.compile(r"[\"'`]?\s{0,3}(?:(?:=>|:=)(?=[\s\"'`])|[:=])\s{0,3}")
_SECRET_REST = re.compile(r"[^\s\"'`]{8,}+")
_QUOTES = frozenset("\"'`")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+-.")
_HOUSE_REACH = 7 + 3 * 32 + 31 + 1  # the longest match, and what it must not follow
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_ACCESS_KEY = re.compile(r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")
_HOUSE = re.compile(r"(?<![0-9])[0-9]{1,5}[A-Za-z]? (?:[A-Z][\w'.-]{0,30} ){0,3}[A-Z][\w'.-]{0,30}\Z")

# Fixed cue words, in natural order.
ACCOUNT_CUES = ("account", "acct", "iban", "ssn", "social security", "passport", "customer id", "member id", "user id", "tax id", "konto", "cuenta", "compte")
SECRET_CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "api-key", "access_key")
STREET_CUES = (" Street", " Avenue", " Road", " Lane", " Boulevard", " Drive")


_ASCII_LOWER = {x: x + 32 for x in range(65, 91)}


@cache
def _automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for cue, what in (("@", EMAIL), ("+", PHONE), ("://", URL), ("akia", -1), *((str(x), CARD) for x in range(10))):
        out.add_word(cue, (what, len(cue)))
    for cues, what in ((ACCOUNT_CUES, ACCOUNT), (SECRET_CUES, SECRET), (STREET_CUES, ADDRESS)):
        for cue in cues:
            out.add_word(cue.lower(), (what, len(cue)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        n = ord(x) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _email(text: str, at: int, floor: int) -> int:
    """Where the local part that ends at the at-sign begins; at if there is none."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    return start


def _phone_prefix(text: str, start: int, end: int) -> int:
    """End of the longest run of whole digit groups with 9 to 15 digits; 0 if none."""
    count, best = 0, 0
    for m in _GROUP.finditer(text, start, end):
        count += m.end() - m.start()
        if count > 15:
            break
        if count >= 9:
            best = m.end()
    return best


def _cards_within(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Groups of 13 to 19 digits, or four groups of four, that pass the check digit."""
    groups = [m.span() for m in _GROUP.finditer(text, start, end)]
    i = 0
    while i < len(groups):
        a, b = groups[i]
        if 13 <= b - a <= 19 and luhn(text[a:b]):
            yield a, b
        elif all(z - y == 4 for y, z in groups[i : i + 4]) and len(groups) >= i + 4 and luhn("".join(text[y:z] for y, z in groups[i : i + 4])):
            yield a, groups[i + 3][1]
            i += 3
        i += 1


def _iban_end(text: str, start: int, end: int) -> int:
    """End of the longest run of whole groups from start that is an IBAN; 0 if none."""
    best, value = 0, ""
    for m in re.finditer(r"[A-Za-z0-9]+", text[start : min(end, start + 70)]):
        value += m[0].upper()
        if len(value) > 34:
            break
        if re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", value) and int("".join(str(int(x, 36)) for x in value[4:] + value[:4])) % 97 == 1:
            best = start + m.end()
    return best


def _digits_end(text: str, start: int, end: int) -> int:
    """End of the groups of digits from start if these have five digits or more; 0 if not."""
    m = re.compile(r"[0-9]++(?:[ -][0-9]++)*+(?![A-Za-z0-9])").match(text, start, end)
    return m.end() if m and sum(x.isdigit() for x in m[0]) >= 5 else 0


def _lower(text: str) -> str:
    """text in lower case, a character for each: where a letter has no single lower one, only A to Z change."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_ASCII_LOWER)


def _secret(text: str, at: int, last_quote: dict[str, int]) -> tuple[int, int]:
    """The secret that begins behind a cue and its sign, at `at`: to the closing quote of its line, else to white space or a quote; (0, 0) if too short."""
    quote = text[at : at + 1]
    if quote in _QUOTES and quote:
        if quote not in last_quote:
            last_quote[quote] = text.rfind(quote)
        at += 1
        if last_quote[quote] >= at:  # else no search could find one
            end = text.find(quote, at)
            while end > at and text[end - 1] == "\\" and (end - len(text[at:end].rstrip("\\")) - at) % 2:
                end = text.find(quote, end + 1)
            if end >= at + 6 and "\n" not in text[at:end]:
                return at, end
    m = _SECRET_REST.match(text, at)
    return m.span() if m else (0, 0)


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start, then kind."""
    base: list[Span] = []
    more: list[Span] = []
    email_end = phone_end = number_end = digits_end = ip_end = url_end = secret_end = iban_end = 0
    last_quote: dict[str, int] = {}
    for last, (what, size) in _automaton().iter(_lower(text)):
        at = last + 1 - size
        if what == CARD:
            if at >= digits_end:  # the first digit of its run
                digits_end = _GROUP.match(text, at).end()
                if (m := _IP.match(text, at)) and at >= ip_end:
                    ip_end = m.end()
                    if all(len(x.lstrip("0")) <= 3 and int(x[-4:] or 0) <= 255 for x in m[0].split(".")):
                        base.append((at, IP, ip_end))
                start = at - 2
                if start >= iban_end and (start == 0 or not text[start - 1].isalnum()) and (m := _IBAN.match(text, start)) and (end := _iban_end(text, start, m.end())):
                    iban_end = end
                    more.append((start, ACCOUNT, end))
            if at >= number_end and (m := _CARD.match(text, at)):
                number_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "") if number_end - at >= 7 else ""
                if 12 <= len(digits) <= 19 and luhn(digits):
                    base.append((at, CARD, number_end))
                elif len(digits) > 12:
                    more += [(a, CARD, b) for a, b in _cards_within(text, at, number_end)]
        elif what == EMAIL:
            start = _email(text, at, email_end)
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                base.append((start, EMAIL, m.end()))
                email_end = m.end()
        elif what == PHONE:
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= sum(x.isdigit() for x in m[0]) <= 15:
                    base.append((at, PHONE, phone_end))
                elif end := _phone_prefix(text, at, phone_end):
                    more.append((at, PHONE, end))
        elif what == URL and at < url_end:
            continue  # within another
        elif what == URL:
            start = at
            while start > url_end and text[start - 1] in _SCHEME:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            m = _URL_REST.match(text, last + 1) if start <= at - 2 else None
            if m and (any(x in m[0] for x in ".@:/") or m[0].startswith("localhost")):
                url_end = last + 1 + len(m[0].rstrip(".,;:!?)]"))
                more.append((start, URL, url_end))
        elif what == ACCOUNT:
            if (at == 0 or not text[at - 1].isalnum()) and (m := _ACCOUNT_REST.match(text, last + 1)):
                token = m[1].split(" ", 1)[0]
                if end := _iban_end(text, m.start(1), m.end(1)) or _digits_end(text, m.start(1), m.end(1)):
                    more.append((m.start(1), ACCOUNT, end))
                elif sum(x.isdigit() for x in token) >= 4:
                    more.append((m.start(1), ACCOUNT, m.start(1) + len(token)))
        elif what == SECRET:
            if at >= secret_end and (at == 0 or not text[at - 1].isalnum()) and (m := _SECRET_SIGN.match(text, last + 1)):
                start, end = _secret(text, m.end(), last_quote)
                if end > start:
                    secret_end = end
                    more.append((start, SECRET, end))
        elif what == ADDRESS:
            if text[at + 1].isupper() and (last + 1 == len(text) or not text[last + 1].isalnum()):
                low = max(0, at - _HOUSE_REACH)
                if m := _HOUSE.search(text[low:at]):
                    more.append((low + m.start(), ADDRESS, last + 1))
        elif m := _ACCESS_KEY.match(text, at):
            if at == 0 or not text[at - 1].isalnum():
                more.append((at, SECRET, m.end()))
    return sorted(base), sorted({*base, *more})


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with [KIND] in place of each span; spans that overlap become one."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans, and how many these are, of every document."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in range(7)]
            for text in batch.column("text"):
                base, every = find_spans(text.as_py() or "")
                for column, kind in zip(columns, (EMAIL, IP, CARD, PHONE), strict=False):
                    column.append(sum(x[1] == kind for x in base))
                columns[4].append(hashlib.sha256(spelled(base).encode()).hexdigest())
                columns[5].append(spelled(every))
                columns[6].append(len(every))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(found, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs, all columns kept, with the spans of the text column masked; null stays null.

    n_chars, where there is such a column, counts the masked text.
    """

    @F.pandas_udf("string")
    def masked(texts):
        return texts.map(lambda x: x if x is None else redacted(x, find_spans(x)[1]))

    out = docs.withColumn(column, masked(F.col(column)))
    return out.withColumn("n_chars", F.char_length(column).cast("long")) if "n_chars" in docs.columns else out
