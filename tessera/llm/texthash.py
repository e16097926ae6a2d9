"""Vectorised word and n-gram hashes over Arrow text columns.

Everything here works on whole texts, in slices of bounded size: a slice holds the words of
many short texts or a piece of one long text, so memory does not follow the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once.
SLICE_BYTES = 1 << 20
_R = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 8)
        inverse = pow(_R, -1, 1 << 64)
        for name, base in (("up", _R), ("down", inverse)):
            out = np.empty(size, np.uint64)
            out[0] = 1
            filled = 1
            while filled < size:
                step = min(filled, size - filled)
                out[filled : filled + step] = out[:step] * np.uint64(pow(base, filled, 1 << 64))
                filled += step
            _POWERS[name] = out
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that sums of powers spread over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def whitespace_words() -> np.ndarray:
    """Lookup for words without the white space characters 0x20 and 0x09 to 0x0D."""
    inside = np.ones(256, bool)
    inside[[0x20, *range(0x09, 0x0E)]] = False
    return inside


def alnum_words() -> np.ndarray:
    """Lookup for words of ASCII letters and digits and all characters past ASCII."""
    inside = np.zeros(256, bool)
    inside[0x30:0x3A] = inside[0x41:0x5B] = inside[0x61:0x7B] = inside[0x80:] = True
    return inside


_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += 32


def hash_words(data: np.ndarray, inside: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start offset and hash of each word of UTF-8 bytes, A-Z lowered. No word crosses a cut."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    word = inside[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    first = word & ~before
    last = np.empty(n, bool)
    last[-1] = word[-1]
    last[:-1] = word[:-1] & ~word[1:]
    if cuts is not None and len(cuts):
        at = cuts[(cuts > 0) & (cuts < n)]
        first[at] |= word[at]
        last[at - 1] |= word[at - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((_LOWER[data] + np.uint64(1)) * up[:n], out=total[1:])
    hashes = (total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    return starts, mix(hashes)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(_R) + words[i : i + len(out)]
    return mix(out)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def word_slices(column: pa.Array, inside: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word counts of consecutive rows, their word hashes), a slice at a time.

    A text longer than a slice is hashed in pieces that end between words, then comes alone.
    """
    data, offsets = _buffers(column)
    rows, row = len(offsets) - 1, 0
    while row < rows:
        start = offsets[row]
        if offsets[row + 1] - start > SLICE_BYTES:
            words = _long_words(data[start : offsets[row + 1]], inside)
            yield row, np.array([len(words)]), words
            row += 1
            continue
        end = int(np.searchsorted(offsets, start + SLICE_BYTES, side="right")) - 1
        end = min(max(end, row + 1), rows)
        cuts = offsets[row : end + 1] - start
        starts, hashes = hash_words(data[start : offsets[end]], inside, cuts[1:-1])
        yield row, np.diff(np.searchsorted(starts, cuts)), hashes
        row = end


def _long_words(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    found, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + SLICE_BYTES)
        if end < n and inside[data[end - 1]] and inside[data[end]]:
            gaps = np.flatnonzero(~inside[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word fills the slice: go on to its end
                more = np.flatnonzero(~inside[data[end:]])
                end = end + int(more[0]) if len(more) else n
        found.append(hash_words(data[at:end], inside)[1])
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)
