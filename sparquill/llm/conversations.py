"""Conversation repair: the cheapest edits after which roles alternate and no row is blank or said twice.

Rows of a conversation stand by turn, nulls first; rows of one turn by role,
then by a digest of their text, so copies are neighbours. A null text or role is
one space. A null conv_id is a conversation of its own. A conversation without
rows left has zeros, an empty audit and the hash of the empty string. Extra
columns are not read; an empty table gives no rows.

Each conversation passes a task twice, first as one byte a row, which is all the
edits depend on, then as text, which is hashed as it goes by. Of a conversation
of any length a task thus holds some forty bytes a row, and no text; its audit
and its hash are single values over all its rows in order, which no second task
could share.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_sizes, pieces_for

DELETE, INSERT, REROLE, MEND = 4, 3, 3, 3  # what edits cost; MEND comes on top for truncated rows that stay
BLANKS = " \t\n\x0b\f\r"
PACKS = 8  # of a partition, each solved at once

# a row's byte: its role's initial (other, s, u, a), plus one fault
FAULT_DELETE, FAULT_TRUNCATED, ABSENT, BLANK, REPEATED = 4, 8, 16, 32, 64
_PAD = 12
_NEVER = 1 << 20
# states: nothing yet, after system, after user, after assistant; where a user or assistant row leads from each
FORWARD = np.array([2, 2, 3, 2])
ROLES = ("", "system", "user", "assistant")
AT_END = np.array([0, 6, 3, 0], np.int8)  # inserts that still must follow
TAIL = (0, 2, 1, 0)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code: the cost of deletion, of keeping in each state, of another role, and the state that keeping leads to."""
    drop, keep, rerole = np.full(13, DELETE), np.full((13, 4), _NEVER), np.full(13, _NEVER)
    keep_to = np.zeros((13, 4), np.int64)
    for fault, more in ((0, 0), (FAULT_TRUNCATED, MEND)):
        rerole[fault : fault + 4] = REROLE + more
        keep[fault + 1, 0], keep_to[fault + 1, 0] = more, 1
        for state in (0, 1, 3):
            keep[fault + 2, state], keep_to[fault + 2, state] = more, 2
        keep[fault + 3, 2], keep_to[fault + 3, 2] = more, 3
    drop[_PAD] = 0
    return drop, keep, rerole, keep_to


_DROP, _KEEP, _REROLE, _KEEP_TO = _tables()


def costs_to_go(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of codes [turn, conversation]: least costs from each state before each turn to the end, less the least of the four, and by how much that least grows at each turn."""
    turns, n = codes.shape
    togo, grown = np.empty((turns + 1, n, 4), np.int8), np.empty((turns, n), np.int8)
    togo[turns] = AT_END
    each = np.arange(n)[:, None]
    for t in range(turns - 1, -1, -1):
        code, after = codes[t], togo[t + 1].astype(np.int32)
        best = np.minimum(after + _DROP[code][:, None], _KEEP[code] + after[each, _KEEP_TO[code]])
        np.minimum(best, _REROLE[code][:, None] + after[:, FORWARD], out=best)
        user, assistant = best[:, 2].copy(), best[:, 3].copy()
        np.minimum(user, assistant + INSERT, out=best[:, 2])
        np.minimum(assistant, user + INSERT, out=best[:, 3])
        np.minimum(best[:, :2], best[:, 2:3] + INSERT, out=best[:, :2])
        least = best.min(1)
        grown[t], togo[t] = least, best - least[:, None]
    return togo, grown


def trace(codes: np.ndarray, togo: np.ndarray, grown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edits [turn, conversation] of the cheapest ways with the least audit, and the states they end in.

    An edit holds the state before it (2 bits), inserts before the row (2 bits),
    and what becomes of the row: 0 deleted, 1 kept, 2 another role.
    """
    turns, n = codes.shape
    edits, state, each = np.empty((turns, n), np.uint8), np.zeros(n, np.int64), np.arange(n)
    for t in range(turns):
        code, after = codes[t], togo[t + 1].astype(np.int32)
        here = togo[t].astype(np.int32) + grown[t][:, None]
        edit, inserts = state.copy(), np.zeros(n, np.int64)
        for _ in range(2):  # three inserts on end would come back to where one has been
            more = (_DROP[code] + after[each, state] != here[each, state]) & (INSERT + here[each, FORWARD[state]] == here[each, state])
            inserts += more
            state = np.where(more, FORWARD[state], state)
        now = here[each, state]
        drop = _DROP[code] + after[each, state] == now
        to = _KEEP_TO[code, state]
        keep = ~drop & (_KEEP[code, state] + after[each, to] == now)
        edits[t] = edit | inserts << 2 | np.where(drop, 0, np.where(keep, 1, 2)) << 4
        state = np.where(drop, state, np.where(keep, to, FORWARD[state]))
    return edits, state


def cheapest_edits(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For conversations one behind the other: an edit a row, and the final state and cost of each conversation.

    Conversations meet in one tensor with those up to twice as long.
    """
    ends = np.cumsum(lengths)
    edits, finals, costs = np.empty(len(codes), np.uint8), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    sizes = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for size in np.unique(sizes[lengths > 0]):
        own = np.flatnonzero((sizes == size) & (lengths > 0))
        turns = np.arange(lengths[own].max())[:, None]
        there = turns < lengths[own]
        place = (ends - lengths)[own] + turns
        table = np.where(there, codes[np.where(there, place, 0)], _PAD).astype(np.uint8)
        togo, grown = costs_to_go(table)
        found, finals[own] = trace(table, togo, grown)
        costs[own] = grown.sum(0, dtype=np.int64) + togo[0, :, 0]
        edits[place[there]] = found[there]
    return edits, finals, costs


def _meaning(edit: int) -> tuple[str, list[str], str | None]:
    """Letters of an edit, roles of the rows it inserts, and the row's role after it: None where it goes, empty where it keeps its own."""
    state, inserts, what = edit & 3, edit >> 2 & 3, edit >> 4
    roles = []
    for _ in range(inserts):
        state = int(FORWARD[state])
        roles.append(ROLES[state])
    return "I" * inserts + "DKR?"[what], roles, (None, "", ROLES[FORWARD[state]], None)[what]


_MEANING = [_meaning(e) for e in range(64)]


def _differs(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value differs from the one before it; nulls are alike."""
    a, b = column.slice(1).combine_chunks(), column.slice(0, max(len(column) - 1, 0)).combine_chunks()
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return np.concatenate([[True], ~same.to_numpy(zero_copy_only=False)]) if len(column) else np.zeros(0, bool)


class _Pack:
    """Some whole conversations: edits from their bytes, then hashes from their texts."""

    def __init__(self, rows: pa.Table):
        code = rows["code"].to_numpy().astype(np.int64)
        first = _differs(rows["conv_id"])
        number = np.cumsum(first) - 1
        self.conv_id = rows["conv_id"].filter(pa.array(first))
        n = len(self.conv_id)
        there = code != ABSENT
        rows, code, self.owner = rows.filter(pa.array(there)), code[there], number[there]
        new_owner = np.diff(self.owner, prepend=-1) > 0
        new_turn = _differs(rows["turn"]) | new_owner
        copy = ~(new_turn | _differs(rows["key"]))
        fault = code & ~3
        blank, said = fault == BLANK, (fault != BLANK) & (copy | (fault >= REPEATED))
        cut = ~blank & ~said & ((fault & FAULT_TRUNCATED) > 0)
        initial = code & 3
        count = lambda x: np.bincount(self.owner[x], minlength=n).astype(np.int64)
        lawful = np.isin(initial[:-1] * 4 + initial[1:], (1 * 4 + 2, 2 * 4 + 3, 3 * 4 + 2))
        self.columns = {"gaps": self._gaps(rows["turn"], new_turn, n), "blank": count(blank), "duplicate": count(said), "truncated": count(cut), "illegal": count(np.concatenate([[False], ~lawful & ~new_owner[1:]]) if len(code) else np.zeros(0, bool))}
        lengths = np.bincount(self.owner, minlength=n)
        self.edits, self.finals, self.columns["cost"] = cheapest_edits(initial + np.where(blank | said, FAULT_DELETE, np.where(cut, FAULT_TRUNCATED, 0)), lengths)
        ends = np.cumsum(lengths).tolist()
        self.audits = ["".join([_MEANING[e][0] for e in self.edits[a:b].tolist()]) + "I" * TAIL[f] for a, b, f in zip([0, *ends[:-1]], ends, self.finals.tolist())]
        self.hashes, self.begun, self.at = [hashlib.sha256() for _ in range(n)], [False] * n, 0

    def _gaps(self, turn: pa.ChunkedArray, new: np.ndarray, n: int) -> list[int]:
        known = turn.is_valid().to_numpy()
        owner, value = self.owner[known], turn.drop_null().to_numpy()
        different = np.bincount(owner[new[known]], minlength=n)
        least, most = np.zeros(n, np.int64), np.zeros(n, np.int64)
        least[owner[::-1]], most[owner] = value[::-1], value  # turns ascend
        return [min(int(b) - int(a) + 1 - int(d), (1 << 63) - 1) if d else 0 for a, b, d in zip(least, most, different)]

    def _line(self, k: int, role: str, text: str) -> None:
        self.hashes[k].update(f"{chr(10) if self.begun[k] else ''}{role}:{text}".encode())
        self.begun[k] = True

    def read(self, rows: pa.RecordBatch) -> None:
        """Takes the next rows' texts."""
        span = slice(self.at, self.at + len(rows))
        for k, edit, role, text in zip(self.owner[span].tolist(), self.edits[span].tolist(), rows["role"].to_pylist(), rows["text"].to_pylist(), strict=True):
            _, inserted, new_role = _MEANING[edit]
            for r in inserted:
                self._line(k, r, "")
            if new_role is not None:
                self._line(k, new_role or role, text)
        self.at = span.stop

    def result(self) -> pa.RecordBatch:
        for k, final in enumerate(self.finals.tolist()):
            for _ in range(TAIL[final]):
                final = int(FORWARD[final])
                self._line(k, ROLES[final], "")
        names = {"conv_id": self.conv_id.combine_chunks(), **{k: pa.array(v, pa.int64()) for k, v in self.columns.items()}, "audit": pa.array(self.audits, pa.string()), "repaired_sha256": pa.array([h.hexdigest() for h in self.hashes], pa.string())}
        return pa.RecordBatch.from_pydict(names)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def runs() -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            step = batch["pack"].to_numpy() * 2 + batch["phase"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(step)]
            for a, b in itertools.pairwise(cuts):
                if b > a:
                    yield int(step[a]), batch.slice(a, b - a)

    pack = None
    for step, parts in itertools.groupby(runs(), key=lambda x: x[0]):
        if step % 2:
            for _, rows in parts:
                pack.read(rows)
            continue
        if pack:
            yield pack.result()
        pack = _Pack(pa.Table.from_batches([rows.select(["conv_id", "turn", "key", "code"]) for _, rows in parts]))
    if pack:
        yield pack.result()


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies: by the crc of conv_id:turn, of twenty rows one is dropped (copies 0), one emptied, one loses its ends of sentences, one comes twice, one is the user's."""
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spoken("conv_id"), F.lit(":"), spoken("turn"))) % 20
    rows = conversations.select("conv_id", "turn", spoken("role").alias("role"), spoken("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def repair(rows: DataFrame) -> DataFrame:
    """A row a conversation: gaps, faults, the cost and letters of the cheapest edits, and the hash of the repaired conversation.

    rows: conv_id, turn, role, text, copies (one without the column). A
    conversation of which only rows with 0 copies are left still has its row.
    """
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    spoken = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = rows.select("conv_id", "turn", spoken("role").alias("role"), spoken("text").alias("text"), copies.alias("copies"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"))))
    end = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    fault = F.when(end == "", BLANK).when(~end.isin(".", "!", "?"), FAULT_TRUNCATED).otherwise(0)
    each = rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.greatest("copies", F.lit(1)))))
    slim = each.select("conv_id", "turn", "role", "key", F.when(F.col("copies") == 0, ABSENT).otherwise(_initial(F.col("role")) + fault).alias("code"))
    # what is said in more than one turn: (conv_id, key) with the first turn; conv_id may be null
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    slim = slim.withColumn("said", F.struct(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "key")).withColumn("at", at)
    first = slim.where(F.col("code") != ABSENT).groupBy("said").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("first") < F.col("last"))
    slim = join_sizes(slim, first, ["said"], "n", "left")
    again = F.when((F.col("code") < ABSENT) & F.coalesce(F.col("at") > F.col("first"), F.lit(False)), REPEATED).otherwise(0)
    codes = slim.select("conv_id", F.lit(0).alias("phase"), "turn", "role", "key", (F.col("code") + again).alias("code"), F.lit(None).cast("string").alias("text"))
    texts = each.where(F.col("copies") > 0).select("conv_id", F.lit(1).alias("phase"), "turn", "role", "key", F.lit(0).alias("code"), "text")
    both = codes.unionByName(texts).withColumn("pack", F.pmod(F.xxhash64("conv_id", F.lit(7)), F.lit(PACKS)))
    dealt = both.repartition(pieces_for(rows, 8 << 20), "conv_id").sortWithinPartitions("pack", "phase", "conv_id", "turn", "role", "key")
    return dealt.mapInArrow(_solve, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
