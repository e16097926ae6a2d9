"""Repair of conversations: the cheapest edits that give turns of system, user and assistant in order.

The wanted roles are ``(s?(ua)+)?``, read by an automaton of four states. All conversations of a task are solved together:
they are bucketed by length, and per turn, from the last to the first, one NumPy step updates the costs of all states of
all conversations of the bucket. The stored costs are then followed from the first turn on, again for all at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.cluster import ship
from tessera.llm.common import read

#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. A conversation may end in the first or last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What follows each state when a turn is inserted or gets another role: user or assistant, whichever may stand there.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: The state that a kept turn leads to, by state and initial (s, u, a, other); -1: it may not stand there.
KEPT = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
_NEVER = 1 << 28
#: Turns of all conversations of one tensor; a single longer one makes a tensor of its own.
TENSOR_TURNS = 1 << 20
_SPACE = " \t\n\x0b\x0c\r"


def cheapest(initials: np.ndarray, faults: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Cost and edits (D, I, K, R; least in ASCII order among the cheapest) of each conversation.

    initials: 0 to 3 for s, u, a, other; faults: FINE to TRUNCATED; starts: where each conversation begins, and the end.
    """
    lengths = np.diff(starts)
    costs, audits = np.zeros(len(lengths), np.int64), [b""] * len(lengths)
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        shortest = int(lengths[order[at]])
        # a bucket holds lengths up to a quarter above its shortest, so that few of a tensor's turns are padding
        end = int(np.searchsorted(lengths[order], shortest + shortest // 4, side="right"))
        end = min(end, at + max(1, TENSOR_TURNS // max(1, shortest + shortest // 4)))
        bucket = order[at:end]
        at = end
        if shortest == 0 and not lengths[bucket].any():
            continue
        costs[bucket], found = _bucket(initials, faults, starts[bucket], lengths[bucket])
        for i, audit in zip(bucket.tolist(), found, strict=True):
            audits[i] = audit
    return costs, audits


def _bucket(initials: np.ndarray, faults: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    turns, n = int(lengths.max()), len(lengths)
    # right-aligned: every conversation ends at the last turn, and those shorter begin later
    places = first + np.arange(turns)[:, None] - (turns - lengths)
    real = np.arange(turns)[:, None] >= turns - lengths
    places = np.where(real, places, 0)
    initial, fault = np.where(real, initials[places], 3), np.where(real, faults[places], FINE)

    def inserted(cost: np.ndarray) -> np.ndarray:
        """Costs when turns may be inserted first; two inserts in a row at most are of use."""
        user, assistant = np.minimum(cost[USER], INSERT + cost[ASSISTANT]), np.minimum(cost[ASSISTANT], INSERT + cost[USER])
        return np.stack([np.minimum(cost[START], INSERT + user), np.minimum(cost[SYSTEM], INSERT + user), user, assistant])

    back = np.empty((turns + 1, 4, n), np.int32)
    back[turns] = inserted(np.repeat(np.array([0, _NEVER, _NEVER, 0], np.int32)[:, None], n, axis=1))
    for t in range(turns - 1, -1, -1):
        after = back[t + 1]
        padded = np.concatenate([after, np.full((1, n), _NEVER, np.int32)])
        stay = np.where((fault[t] == BLANK) | (fault[t] == DUPLICATE), _NEVER, np.where(fault[t] == TRUNCATED, CUT_OFF, 0)).astype(np.int32)
        keep = np.take_along_axis(padded, KEPT[:, initial[t]], axis=0) + stay
        step = np.minimum(np.minimum(keep, REROLE + stay + after[NEXT]), DELETE + after)
        back[t] = np.where(real[t], inserted(np.minimum(step, _NEVER)), after)
    begin, every = turns - lengths, np.arange(n)
    costs = back[begin, START, every].astype(np.int64)

    # two inserts at most before each turn and at the end
    letters = np.zeros((n, 3 * turns + 2), np.uint8)
    at, state, written = begin.copy(), np.zeros(n, np.int64), np.zeros(n, np.int64)
    active = every
    while len(active):
        t, q = at[active], state[active]
        now, last = back[t, q, active], t == turns
        row = np.minimum(t, turns - 1)
        kind, bad = initial[row, active], fault[row, active]
        stay = np.where((bad == BLANK) | (bad == DUPLICATE), _NEVER, np.where(bad == TRUNCATED, CUT_OFF, 0))
        over = np.minimum(t + 1, turns)
        done = last & (now == 0)
        delete = ~last & (DELETE + back[over, q, active] == now)
        insert = ~done & ~delete & (INSERT + back[t, NEXT[q], active] == now)
        target = KEPT[q, kind]
        keep = ~done & ~delete & ~insert & (target >= 0) & (stay + back[over, target, active] == now)
        letter = np.select([delete, insert, keep], [ord("D"), ord("I"), ord("K")], ord("R"))
        goes = ~done
        letters[active[goes], written[active[goes]]] = letter[goes]
        written[active[goes]] += 1
        state[active] = np.where(done | delete, q, np.where(keep, target, NEXT[q]))
        at[active] = np.where(insert | done, t, over)
        active = active[goes]
    return costs, [letters[i, : written[i]].tobytes() for i in range(n)]


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone): nulls are one space; by the CRC-32 of 'conv:turn' modulo 20, 0 drops a row (gone), 1 empties
    its text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20
    base = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), kind.alias("kind"))
    body = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return base.select("conv", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), body.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def _fault() -> Column:
    """BLANK, TRUNCATED or FINE; the space characters are the six of ASCII."""
    rest = F.rtrim(F.col("text"), F.lit(_SPACE))
    return F.when(rest == "", F.lit(BLANK)).when(F.substring(rest, -1, 1).isin(".", "!", "?"), F.lit(FINE)).otherwise(F.lit(TRUNCATED))


def repair(rows: DataFrame, conv: str = "conv", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """One row a conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns are in order of turn (nulls first); equal turns by role, then by the SHA-256 of the text, so that the order does
    not depend on partitions. Null roles and texts are one space. Rows marked by the column gone only name their
    conversation. A null conv is a conversation of its own. Other columns are not read; an empty table gives no rows.

    A task gets two rows a turn, all of the first kind before those of the second: marks of a few bytes, from which all of its
    conversations are solved, then the texts, which are hashed as they stream by. So the memory follows the
    number of turns (about 100 bytes each), not the texts, also where one conversation holds a third of all rows; its hash needs its
    texts in one sequence and so in one task.
    """
    ship(rows.sparkSession)
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    base = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), (F.col(gone) if gone else F.lit(False)).alias("gone"))
    marked = base.select("*", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), _fault().cast("byte").alias("fault"))
    both = marked.select("*", F.explode(F.when(F.col("gone"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("part"))
    both = both.select("conv", "turn", "role", F.when(F.col("part") == 1, F.col("text")).alias("text"), "gone", "digest", "fault", "part")
    dealt = both.repartition("conv").sortWithinPartitions("part", F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest")
    kind = rows.schema[conv].dataType.simpleString()
    columns = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    narrow = dealt.select("conv", "turn", "role", F.when(F.col("part") == 0, F.col("digest")).alias("digest"), "gone", "fault", "part", "text")
    return narrow.mapInArrow(_solve, f"conv {kind}, {columns}")


def _codes(values: pa.Array) -> np.ndarray:
    """Numbers that are equal where the values are; null is a value."""
    return pc.fill_null(pc.dictionary_encode(values, null_encoding="encode").indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _merged(chunks: list[pa.Array]) -> pa.Array:
    return pa.concat_arrays(chunks) if len(chunks) > 1 else chunks[0]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marks: list[pa.RecordBatch] = []
    solved = None
    for batch in batches:
        part = batch.column(6).to_numpy(zero_copy_only=False)
        split = int(np.searchsorted(part, 1))
        if split:
            marks.append(batch.slice(0, split).select([0, 1, 2, 3, 4, 5]))
        if split < batch.num_rows:
            if solved is None:
                solved, marks = _Solved(marks), []
            solved.hash_texts(batch.column(2).slice(split), batch.column(7).slice(split))
    if solved is None and marks:
        solved = _Solved(marks)
    if solved is not None:
        yield from solved.rows()


class _Solved:
    """All conversations of a task: their measures, edits and hashes."""

    def __init__(self, marks: list[pa.RecordBatch]):
        conv, turn, role, digest, gone, fault = (_merged([b.column(i) for b in marks]) for i in range(6))
        code = _codes(conv)
        new = np.concatenate([[True], code[1:] != code[:-1]])
        self.conv = conv.filter(pa.array(new))
        there = ~gone.to_numpy(zero_copy_only=False)
        number = (np.cumsum(new) - 1)[there]
        self.starts = np.searchsorted(number, np.arange(len(self.conv) + 1))
        kept = pa.array(there)
        turn, role, digest = turn.filter(kept), role.filter(kept), digest.filter(kept)
        fault = fault.filter(kept).to_numpy(zero_copy_only=False).astype(np.int64)
        self.fault = np.where((fault != BLANK) & self._again(number, _codes(role), _codes(digest)), DUPLICATE, fault)
        first = pc.utf8_slice_codeunits(role, 0, 1)
        self.initials = pc.fill_null(pc.index_in(first, value_set=pa.array(["s", "u", "a"])), 3).to_numpy(zero_copy_only=False).astype(np.int64)
        self.gaps = self._gaps(turn)
        self.cost, self.audits = cheapest(self.initials, self.fault, self.starts)
        self.at, self.row, self.hash, self.hashes, self.fed = -1, 0, None, [], False
        self.edits, self.read, self.state = b"", 0, START

    @staticmethod
    def _again(number: np.ndarray, role: np.ndarray, digest: np.ndarray) -> np.ndarray:
        """Whether role and text stood earlier in the conversation; blank rows count as seen."""
        order = np.lexsort((digest, role, number))
        same = np.zeros(len(order), bool)
        a, b = order[1:], order[:-1]
        same[order[1:]] = (number[a] == number[b]) & (role[a] == role[b]) & (digest[a] == digest[b])
        return same

    def _gaps(self, turn: pa.Array) -> np.ndarray:
        null, value = turn.is_null().to_numpy(zero_copy_only=False), pc.fill_null(turn, 0).to_numpy(zero_copy_only=False)
        out = np.zeros(len(self.starts) - 1, np.int64)
        nulls = np.concatenate([[0], np.cumsum(null)])
        first, end = self.starts[:-1] + nulls[self.starts[1:]] - nulls[self.starts[:-1]], self.starts[1:]
        some = first < end
        step = np.concatenate([[0], np.cumsum((value[1:] != value[:-1]) & ~null[:-1])]) if len(value) else np.zeros(1, np.int64)
        a, b = first[some], end[some] - 1
        out[some] = value[b] - value[a] + 1 - (step[b] - step[a] + 1)
        return out

    def hash_texts(self, roles: pa.Array, texts: pa.Array) -> None:
        """Feeds the next texts, in the order of the marks."""
        for role, text in zip(roles, texts, strict=True):
            while self.at < 0 or self.row == self.starts[self.at + 1]:
                self._next()
            self._inserted()
            edit = self.edits[self.read]
            self.read += 1
            if edit == ord("K"):
                self.state = int(KEPT[self.state, self.initials[self.row]])
                self._line(role.as_py(), text.as_py())
            elif edit == ord("R"):
                self.state = int(NEXT[self.state])
                self._line(self._role(), text.as_py())
            self.row += 1

    def _role(self) -> str:
        return "user" if self.state == USER else "assistant"

    def _inserted(self) -> None:
        while self.read < len(self.edits) and self.edits[self.read] == ord("I"):
            self.read += 1
            self.state = int(NEXT[self.state])
            self._line(self._role(), "")

    def _line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.fed else ''}{role}:{text}".encode())
        self.fed = True

    def _next(self) -> None:
        """Ends the conversation at hand and begins the next one."""
        if self.at >= 0:
            self._inserted()
            self.hashes.append(self.hash.hexdigest())
        self.at += 1
        self.hash, self.fed, self.state = hashlib.sha256(), False, START
        self.edits, self.read = self.audits[self.at] if self.at < len(self.audits) else b"", 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        while self.at < len(self.conv):
            self._next()
        where = np.repeat(np.arange(len(self.conv)), np.diff(self.starts))
        counts = [np.bincount(where[self.fault == f], minlength=len(self.conv)) for f in (BLANK, DUPLICATE, TRUNCATED)]
        pair = self.initials[:-1] * 4 + self.initials[1:]
        # s to u, u to a, a to u
        wrong = ~np.isin(pair, [1, 6, 9]) & (where[1:] == where[:-1])
        illegal = np.bincount(where[1:][wrong], minlength=len(self.conv))
        columns = [self.gaps, *counts, illegal, self.cost]
        names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        for i in range(0, len(self.conv), 10_000):
            cut = slice(i, i + 10_000)
            arrays = [self.conv[cut], *(pa.array(c[cut].astype(np.int64)) for c in columns), pa.array([a.decode() for a in self.audits[cut]], pa.string()), pa.array(self.hashes[cut], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(read(spark, sf_dir, "conversations")), gone="gone").withColumnRenamed("conv", "conv_id")
