"""Cursors and byte budgets of bounded answers: what a driver does with the few rows that an operator returned."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Callable
from dataclasses import dataclass

from tessera.limits import LIMITS, RequestError

VERSION = "1"


@dataclass(frozen=True)
class Cursor:
    """Where the next page begins: after a sort key, of one operation and query, in one generation of one repository."""

    operation: str
    repository_id: str
    generation_id: str
    fingerprint: str
    sort: tuple[str, ...]


def fingerprint(*parts: object) -> str:
    """A hash of what makes a query; pages of one query share it."""
    return hashlib.sha256("".join(f"{'' if p is None else p}\0" for p in parts).encode()).hexdigest()


def encode(cursor: Cursor) -> str:
    fields = (VERSION, cursor.operation, cursor.repository_id, cursor.generation_id, cursor.fingerprint, *cursor.sort)
    return ".".join(f.encode().hex() for f in fields)


def decode(text: str) -> Cursor:
    if not text or len(text) > LIMITS.cursor_bytes:
        raise RequestError("INVALID_CURSOR")
    try:
        fields = [bytes.fromhex(f).decode() for f in text.split(".")]
    except ValueError:
        raise RequestError("INVALID_CURSOR") from None
    if len(fields) < 6 or fields[0] != VERSION or encode(found := Cursor(*fields[1:5], tuple(fields[5:]))) != text:
        raise RequestError("INVALID_CURSOR")
    return found


def checked(text: str, operation: str, repository_id: str, generation_id: str, query: str) -> Cursor:
    """The cursor, if it belongs to this operation, repository, generation and query."""
    cursor = decode(text)
    if cursor.operation != operation or cursor.fingerprint != query and cursor.generation_id == generation_id:
        raise RequestError("INVALID_CURSOR", "another query")
    if cursor.repository_id != repository_id:
        raise RequestError("CROSS_REPOSITORY_ID")
    if cursor.generation_id != generation_id:
        raise RequestError("STALE_CURSOR")
    return cursor


def score_text(score: float) -> str:
    """The bits of a double, so that a key survives the text without loss."""
    return str(struct.unpack("<Q", struct.pack("<d", score))[0])


def score_of(text: str) -> float:
    try:
        score = struct.unpack("<d", struct.pack("<Q", int(text)))[0]
    except (ValueError, struct.error):
        raise RequestError("INVALID_CURSOR") from None
    if score != score or score in (float("inf"), float("-inf")):
        raise RequestError("INVALID_CURSOR")
    return score


def page(rows: list, limit: int) -> tuple[list, bool]:
    """The first `limit` rows, and whether more follow; rows holds limit + 1 of them if so."""
    return rows[:limit], len(rows) > limit


def compact(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def wire_bytes(value: object) -> int:
    """Bytes of an answer on the wire: the value, and its text once more, escaped."""
    text = compact(value)
    return len(compact({"structuredContent": value, "content": [{"type": "text", "text": text}]}).encode())


#: Bytes by which the number of an estimate, written twice, may shrink.
ESTIMATE_BYTES = 16


def fit(value: dict, most: int, shrink: Callable[[dict], int], settle: Callable[[dict], object] | None = None) -> dict:
    """The value, made smaller by shrink() until it fits.

    shrink tells how many bytes it has dropped at most, 0 if nothing was left. Only once so many are dropped as are too many is the
    whole looked at again, so that a long answer is written out a few times, not once for each item, and keeps all that fits.
    settle: renews an estimate that is part of the value, before each look.
    """
    if not 512 <= most <= LIMITS.response_bytes:
        raise RequestError("INVALID_ARGUMENT", "max_bytes")
    while (over := wire_bytes(value) - most) > 0:
        while over > 0:
            dropped = shrink(value)
            if not dropped:
                raise RequestError("RESPONSE_TOO_LARGE")
            over -= dropped + (ESTIMATE_BYTES if settle else 0)
        if settle:
            settle(value)
    return value


def drop_last(*names: str) -> Callable[[dict], int]:
    """A shrink() that drops the last item of the first list of these names that has any, and marks the cut."""

    def shrink(value: dict) -> int:
        for name in names:
            if value[name]:
                text = compact(value[name].pop())
                value["truncated"] = True
                return len(text.encode()) + len(compact(text).encode()) + 2  # with a comma in both, and true for false
        return 0

    return shrink


def with_token_estimate(value: dict, name: str = "approximate_tokens") -> dict:
    """A quarter of the answer's bytes, rounded up; the number is part of what it measures, so it is sought as a fixed point."""
    value[name] = 0
    for _ in range(8):
        estimate = -(-len(compact(value).encode()) // 4)
        if estimate == value[name]:
            return value
        value[name] = estimate
    raise RequestError("SERIALIZATION_FAILED", "the estimate does not settle")
