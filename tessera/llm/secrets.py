"""Secrets in texts and in the layers that are encoded in them.

A worklist holds layers: the text, and whatever its URL, Unicode, JSON, UTF-16, base64 and compressed parts decode to, bytes
that are no UTF-8 replaced. Each layer is
scanned and searched for further encoded parts until none is left; a layer that was met before at the same place closes a
cycle, and one of the same content is not searched again. The worklist is a stack of searches that go on when the layers below
are done, so that only the layers around one part are held at once, however many parts a text has.
Each layer knows the span of the text that it came from, so a secret is reported where it stands in the text.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read, sha256, spans_digest, text_or_empty
from tessera.llm.pii import joined_spans

BASE = ("assign", "access", "hex")
#: Secrets of decoded layers are reported as the kind and the encodings around them, outermost first.
KINDS = {k: i for i, k in enumerate(BASE)}

#: Bytes that a compressed part may grow to; a part that grows further is not opened, as one row could fill an executor.
INFLATED = 64 << 20
#: Characters of a layer, and of all layers, whose own layers are kept for the next place of the same content.
KEPT, KEPT_ALL = 1 << 16, 1 << 24

_NAMES = ("passw", "secret", "token", "api_key", "apikey")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_PERCENT = re.compile(r"((?:%[0-9A-Fa-f]{2})+)")
_UNICODE = re.compile(r"((?:\\u[0-9A-Fa-f]{4})+)")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?!=)")
#: Characters of base64 that also part it from what stands before, as in a path or after an identifier.
_PARTING = re.compile(r"[-_+/]")
#: What a part that does not begin a run must hold to be read: no secret is shorter, in one byte a character or two.
_READABLE = re.compile(rb"[\x20-\x7e]{12}|(?:[\x20-\x7e]\0){12}")
#: Escapes of JSON and of program texts.
_ESCAPE = re.compile(r"""(\\[nrt/"'])""")
_ESCAPED = {"\\n": "\n", "\\r": "\r", "\\t": "\t", "\\/": "/", '\\"': '"', "\\'": "'"}
#: Base64 in lines: the first of 16 characters or more, the last one at the end of its line or padded.
_LINES = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)+(?:={1,2}(?![A-Za-z0-9+/_=-])|(?![A-Za-z0-9+/_=-])(?![ \t]+\S))")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: ASCII in UTF-16 of either order, read as UTF-8.
_WIDE = re.compile(r"(\0(?:[\x01-\x7f]\0)+[\x01-\x7f]|(?:[\x01-\x7f]\0){2,})")


def scan(text: str) -> list[tuple[str, int, int]]:
    """Secrets of one layer: leftmost non-overlapping matches of each kind that pass its length."""
    spans = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    spans += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return spans


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def _inflate(data: bytes) -> tuple[str, bytes, bytes, bool] | None:
    """The name and content of a compressed part, in the formats that begin with a mark of their own, what follows it, and whether it is cut off.

    Members of one format that follow each other are one content.
    """
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return _zstd(data)
    if _mark(data) in ("bzip2", "xz"):
        return _streams(data)
    if not _mark(data):
        return _deflated(data)
    name = "gzip" if data[:2] == b"\x1f\x8b" else "zlib"
    out: list[bytes] = []
    left, cut = INFLATED, False
    while left > 0 and (data[:2] == b"\x1f\x8b" if name == "gzip" else len(data) > 2 and data[0] == 0x78 and (data[0] << 8 | data[1]) % 31 == 0):
        machine = zlib.decompressobj(31 if name == "gzip" else 15)
        try:
            content = machine.decompress(data, left)
        except zlib.error:
            content = _readable(data, 31 if name == "gzip" else 15, left)
            if not content:
                break
            cut = True
        if not cut and not machine.eof:
            if machine.unconsumed_tail or len(content) >= left:  # past the bound
                break
            cut = True
        if cut and not content:
            break
        out.append(content)
        left, data = left - len(content), b"" if cut else machine.unused_data
    return (name, b"".join(out), data, cut) if out else None


def _mark(data: bytes) -> str:
    """The format that these bytes begin, or nothing."""
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd"
    if data[:3] == b"BZh" and data[3:4].isdigit():
        return "bzip2"
    if data[:6] == b"\xfd7zXZ\0":
        return "xz"
    return "zlib" if len(data) > 2 and data[0] == 0x78 and (data[0] << 8 | data[1]) % 31 == 0 else ""


def _streams(data: bytes) -> tuple[str, bytes, bytes, bool] | None:
    """As _inflate, for bzip2 and xz; what a broken stream holds before its fault counts as cut off."""
    name, out, left, cut = _mark(data), [], INFLATED, False
    while left > 0 and not cut and _mark(data) == name:
        machine = bz2.BZ2Decompressor() if name == "bzip2" else lzma.LZMADecompressor(memlimit=1 << 28)
        content, at = [], 0
        try:
            while not machine.eof and left > 0 and (at < len(data) or not machine.needs_input):
                step = data[at : at + 4096] if machine.needs_input else b""
                at += len(step)
                content.append(machine.decompress(step, left))
                left -= len(content[-1])
        except (OSError, EOFError, lzma.LZMAError):
            cut = True
        cut = cut or not machine.eof
        if left <= 0 and cut:  # past the bound
            break
        out += content
        data = b"" if cut else machine.unused_data + data[at:]
    found = b"".join(out)
    return (name, found, data, cut) if found else None


def _deflated(data: bytes) -> tuple[str, bytes, bytes, bool] | None:
    """As _inflate, for deflated data without a mark: it must be whole, end with the bytes and be readable."""
    machine = zlib.decompressobj(-15)
    try:
        content = machine.decompress(data[:64], 4096)
        if machine.eof and len(data) > 64:
            return None
        content += machine.decompress(machine.unconsumed_tail + data[64:], INFLATED) if not machine.eof else b""
    except zlib.error:
        return None
    if not machine.eof or machine.unused_data or not _READABLE.search(content):
        return None
    return "deflate", content, b"", False


def _readable(data: bytes, window: int, most: int) -> bytes:
    """What a broken stream holds before its fault."""
    machine, out, size = zlib.decompressobj(window), [], 0
    for i in range(0, len(data), 64):
        try:
            out.append(machine.decompress(data[i : i + 64], most - size))
        except zlib.error:
            break
        size += len(out[-1])
        if size >= most:
            break
    return b"".join(out)


def _zstd(data: bytes) -> tuple[str, bytes, bytes, bool] | None:
    """As _inflate, for zstandard frames one after the other."""
    import zstandard

    out, left, cut = [], INFLATED, False
    while left > 0 and data[:4] == b"\x28\xb5\x2f\xfd":
        try:
            size = zstandard.frame_content_size(data)
            if size > left:
                break
            machine = zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj(read_across_frames=False)
            content, at = [], 0
            while at < len(data) and not machine.eof and left > 0:  # small steps, as their content has no bound of its own
                content.append(machine.decompress(data[at : at + 1024]))
                left, at = left - len(content[-1]), at + 1024
        except zstandard.ZstdError:
            break
        if left < 0:
            break
        cut = not machine.eof
        out += content
        data = b"" if cut else machine.unused_data + data[at:]
    found = b"".join(out)
    return ("zstd", found, data, cut) if found else None


def _bytes(raw: str) -> bytes:
    """What base64 characters decode to; one that is left over by itself holds no byte."""
    raw = raw.rstrip("=").replace("-", "+").replace("_", "/")
    raw = raw[:-1] if len(raw) % 4 == 1 else raw
    return base64.b64decode(raw + "=" * (-len(raw) % 4))


def _opened(data: bytes) -> Iterator[tuple[str, bytes]]:
    """The encodings and content of decoded base64: what its compressed parts hold, and what stands behind them."""
    work, seen = [("base64", data)], set()
    while work:
        names, data = work.pop()
        key = hashlib.blake2b(data, digest_size=16).digest()
        opened = None if key in seen else _inflate(data)
        seen.add(key)
        if opened is None or opened[3]:  # a stream that is cut off may be none
            if data:
                yield names, data
        if opened is not None:
            work += [(names, opened[2]), (f"{names}.{opened[0]}", opened[1])]


def _wrapped(text: str) -> Iterator[list[re.Match]]:
    """Lines of base64 that belong together: lines of one length, then one that is shorter."""
    for m in _LINES.finditer(text):
        lines, i = list(_LINE.finditer(text, m.start(), m.end())), 0
        while i < len(lines):
            size, j = len(lines[i][0]), i + 1
            while j < len(lines) and len(lines[j][0]) == size:
                j += 1
            end = j + 1 if j < len(lines) and len(lines[j][0]) < size else j
            if end > i + 1 and size >= 16:
                yield lines[i:end]
            i = j


class Cut:
    """A layer in terms of the one around it: pieces of text, where each stands there, and whether it is the same text there."""

    __slots__ = ("bodies", "a", "b", "same")

    def __init__(self, bodies: list[str], a: np.ndarray, b: np.ndarray, same: np.ndarray):
        self.bodies, self.a, self.b, self.same = bodies, a, b, same

    @classmethod
    def decoded(cls, pieces: list[tuple[str, int, int]]) -> Cut:
        a, b = (np.array([p[i] for p in pieces], np.int64) for i in (1, 2))
        return cls([p[0] for p in pieces], a, b, np.zeros(len(pieces), bool))

    def size(self) -> int:
        return sum(map(len, self.bodies))


def _replaced(text: str, pattern: re.Pattern, decode: Callable[[str], str | None]) -> Cut | None:
    """The text with each match decoded; None if there is none. Equal matches are decoded once, and stay where that gives None."""
    parts = pattern.split(text)  # texts and matches by turns
    if len(parts) == 1:
        return None
    meaning = {m: decode(m) for m in set(parts[1::2])}
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    same = np.ones(len(parts), bool)
    same[1::2] = [meaning[m] is None for m in parts[1::2]]
    if same.all():
        return None
    begins = np.concatenate([[0], ends[:-1]])
    parts[1::2] = [m if meaning[m] is None else meaning[m] for m in parts[1::2]]
    return Cut(parts, begins, ends, same)


def _utf16(escapes: str) -> str | None:
    try:
        return bytes.fromhex(escapes.replace("\\u", "")).decode("utf-16-be")
    except UnicodeDecodeError:
        return None


def _by_line(data: bytes, lines: list[re.Match]) -> Cut:
    """The text of bytes in pieces, each with the place of the line that it begins in."""
    pieces, at, count = [], 0, 0
    for line in lines:
        count += len(line[0])
        end = max(at, min(len(data), count * 3 // 4)) if line is not lines[-1] else len(data)
        while end < len(data) and 0x80 <= data[end] < 0xC0:
            end += 1
        pieces.append((_text(data[at:end]), line.start(), line.end()))
        at = end
    return Cut.decoded(pieces)


def _whole(text: str) -> Iterator[tuple[str, Cut]]:
    """(encoding, cut) of each layer that is this one with its escapes decoded.

    Escapes decode to one layer with all that surrounds them, as a secret may be escaped in part.
    """
    for name, mark, pattern, decode in (
        ("url", "%", _PERCENT, lambda m: _text(bytes.fromhex(m.replace("%", "")))),
        ("unicode", "\\u", _UNICODE, _utf16),
        ("escape", "\\", _ESCAPE, _ESCAPED.__getitem__),
        ("utf16", "\0", _WIDE, lambda m: m.replace("\0", "")),
    ):
        if mark in text and (cut := _replaced(text, pattern, decode)) is not None:
            yield name, cut


def _aligned(run: str) -> Iterator[tuple[int, str, bytes]]:
    """(place, encodings, content) of base64 that begins inside of a run, behind one of its parting characters.

    Only three other alignments than that of the run can be: each is decoded once, from its first place on, and read if it holds
    anything readable. Compressed content must begin at its own first byte, so the bytes at every place are looked at.
    """
    ends = [m.end() for m in _PARTING.finditer(run)]
    for turn in range(4):
        places = [p for p in ends if p % 4 == turn and len(run) - p >= 16]
        if not places:
            continue
        data = _bytes(run[places[0] :])
        if turn and _READABLE.search(data):
            yield places[0], "base64", data
        for p in places:
            at = (p - places[0]) // 4 * 3
            if _mark(data[at : at + 6]) and _inflate(data[at : at + 256]) is not None:
                yield from ((p, names, content) for names, content in _opened(data[at:]) if names != "base64")


def _parts(text: str, known: Kept) -> Iterator[tuple[str, Cut]]:
    """(encodings, cut) of each base64 part, by line or not, and of what is compressed in it.

    Parts that were decoded before are taken from known.
    """
    for m in _BASE64.finditer(text):
        if m[0] in known:
            yield from ((names, Cut.decoded([(body, m.start() + at, m.end())])) for at, names, body in known[m[0]])
            continue
        kept: list[tuple[int, str, str]] | None = []
        for at, names, data in chain(((0, *opened) for opened in _opened(_bytes(m[0]))), _aligned(m[0])):
            body = _text(data)
            if kept is not None:
                kept = [*kept, (at, names, body)] if sum(len(b) for _, _, b in kept) + len(body) + len(m[0]) < KEPT else None
            yield names, Cut.decoded([(body, m.start() + at, m.end())])
        if kept is not None:
            known.keep(m[0], kept, len(m[0]) + sum(len(body) for _, _, body in kept))
    for lines in _wrapped(text):
        data = _bytes("".join(line[0] for line in lines))
        for names, content in _opened(data):
            if content is data or content == data:
                yield names, _by_line(data, lines)
            else:
                yield names, Cut.decoded([(_text(content), lines[0].start(), lines[-1].end())])


class Kept(dict):
    """What was found for contents that were met before, KEPT_ALL characters at most."""

    size = 0

    def keep(self, key: str, value: object, size: int) -> None:
        if self.size + size > KEPT_ALL:
            self.clear()
            self.size = 0
        self.size += size
        self[key] = value


class Layer:
    """A layer: its text, in pieces that each come from one place. A piece of the length of its origin maps by character, any other as a
    whole; neighbours that map by character are one piece, however the layer was cut."""

    def __init__(self, name: str, body: str, length: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.name, self.body, self.length, self.a, self.b = name, body, length, a, b
        self.starts, self.exact = np.cumsum(length) - length, length == b - a

    @classmethod
    def of(cls, text: str) -> Layer:
        return cls("", text, np.array([len(text)]), np.array([0]), np.array([len(text)]))

    def key(self) -> bytes:
        """The content and where its characters come from."""
        own = hashlib.blake2b(self.body.encode("utf-8", "surrogatepass"), digest_size=16)
        for numbers in (self.length, self.a, self.b):
            own.update(numbers.astype("<i8").tobytes())
        return own.digest()

    def _pieces(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1

    def begin(self, at: np.ndarray) -> np.ndarray:
        """Where these characters of the layer begin in the text."""
        k = self._pieces(at)
        return np.where(self.exact[k], self.a[k] + at - self.starts[k], self.a[k])

    def end(self, at: np.ndarray) -> np.ndarray:
        """Where the characters before these end in the text."""
        k = self._pieces(at - 1)
        return np.where(self.exact[k], self.a[k] + at - self.starts[k], self.b[k])

    def decoded(self, a: int, b: int) -> bool:
        """Whether any of the characters from a to b was."""
        first, last = self._pieces(np.array([a, b - 1])).tolist()
        return not self.exact[first : last + 1].all()

    def inner(self, name: str, cut: Cut) -> Layer:
        """The layer of a cut of this one, with its places in the text."""
        lengths, a, b, same = np.fromiter(map(len, cut.bodies), np.int64, len(cut.bodies)), cut.a, cut.b, cut.same
        some = (lengths > 0) & (a < b)
        lengths, a, b, same = lengths[some], a[some], b[some], same[some]
        body = "".join(cut.bodies) if some.all() else "".join(compress(cut.bodies, some.tolist()))
        if not len(lengths):
            return Layer(name, "", lengths, a, b)
        # what is the same keeps the places of each piece around it, what is decoded gets those of its whole origin
        first, last = self._pieces(a), self._pieces(b - 1)
        counts = np.where(same, last - first + 1, 1)
        i = np.repeat(np.arange(len(a)), counts)
        k = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
        low, high = np.maximum(a[i], self.starts[k]), np.minimum(b[i], self.starts[k] + self.length[k])
        kept, exact = same[i], self.exact[k]
        begin = np.where(kept, np.where(exact, self.a[k] + low - self.starts[k], self.a[k]), self.begin(a)[i])
        end = np.where(kept, np.where(exact, self.a[k] + high - self.starts[k], self.b[k]), self.end(b)[i])
        length = np.where(kept, high - low, lengths[i])
        exact = length == end - begin
        new = np.flatnonzero(np.concatenate([[True], ~(exact[1:] & exact[:-1] & (end[:-1] == begin[1:]))]))
        stop = np.concatenate([new[1:], [len(length)]]) - 1
        return Layer(name, body, np.add.reduceat(length, new), begin[new], end[stop])

    def inside(self, layers: Iterable[tuple[str, Cut]]) -> Iterator[Layer]:
        for name, cut in layers:
            yield self.inner(f"{self.name}.{name}".lstrip("."), cut)


def nested(text: str) -> list[tuple[str, int, int]]:
    """Secrets of the layers below the text, where those stand in it: kind.encodings, start, end; once each.

    The same layer may stand in many places and is placed in each; a layer that was at its place before closes a cycle. A layer
    is searched with its escapes as they are, then decoded; each of its base64 parts is done before the next is decoded.
    """
    found: set[tuple[str, int, int]] = set()
    seen: set[bytes] = set()
    known, searched = Kept(), Kept()

    def below(root: Layer) -> Iterator[Layer]:
        """Adds the secrets of a layer, and gives the layers of its parts."""
        queue = deque([root])
        while queue:
            layer = queue.popleft()
            body = layer.body
            if layer.name:
                if body == text or (key := layer.key()) in seen:
                    continue
                seen.add(key)
            if body in searched:
                secrets, whole, parts = searched[body]
            else:
                secrets, whole = scan(body) if layer.name else [], list(_whole(body))
                parts = _remembered(body, secrets, whole, known, searched) if layer.name else _parts(body, known)
            for kind, a, b in secrets:
                if layer.decoded(a, b):
                    found.add((f"{kind}.{layer.name}", int(layer.begin(np.array([a]))[0]), int(layer.end(np.array([b]))[0])))
            queue += layer.inside(whole)
            del whole
            yield from layer.inside(parts)

    work = [below(Layer.of(text))]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
        else:
            work.append(below(layer))
    return sorted(found, key=lambda s: (s[1], s[0], s[2]))


def _remembered(body: str, secrets: list, whole: list, known: Kept, searched: Kept) -> Iterator[tuple[str, Cut]]:
    """The parts of a layer, which are kept with its secrets if all of it is small."""
    kept: list = []
    size = len(body) * (1 + len(whole))
    for name, cut in _parts(body, known):
        size += cut.size()
        if size < KEPT:
            kept.append((name, cut))
        else:
            kept.clear()
        yield name, cut
    if size < KEPT:
        searched.keep(body, (secrets, whole, kept), size)


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) in order, in code points, end exclusive."""
    base = scan(text)
    rest = nested(text)
    return base, sorted(base + rest, key=lambda s: (s[1], KINDS[s[0].split(".")[0]], s[0], s[2]))


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, the number of base spans of each kind, base_sha256, and found, all spans with kind, start, end.

    Base spans are those of the text itself: assigned passwords and keys, access keys, long hexadecimal strings. Spans of
    decoded layers have the kind and the encodings, as in assign.base64.gzip, and the place of the encoded part. A null
    text is empty and has no spans; base_sha256 is then that of no text. Repeated rows and null keys stay; other columns
    are not read; an empty table gives no rows. A compressed part past INFLATED bytes is not opened.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, digests, found = [[] for _ in BASE], [], []
            for i in range(0, batch.num_rows, 256):
                for body in batch.column(1).slice(i, 256).to_pylist():
                    base, rows = find(body)
                    for kind, out in zip(BASE, numbers, strict=True):
                        out.append(sum(s[0] == kind for s in base))
                    digests.append(sha256(spans_digest(base, KINDS)))
                    found.append([{"kind": k, "start": a, "end": b} for k, a, b in rows])
            arrays = [batch.column(0), *(pa.array(n, pa.int64()) for n in numbers), pa.array(digests, pa.string()), pa.array(found, _FOUND)]
            yield pa.RecordBatch.from_arrays(arrays, ["k", *(f"n_{k}" for k in BASE), "base_sha256", "found"])

    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
    counts = ", ".join(f"n_{k} long" for k in BASE)
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, {counts}, base_sha256 string, found array<struct<kind:string,start:long,end:long>>").withColumnRenamed("k", key)


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def op8_secret_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(read(spark, sf_dir, "documents"))
    return found.withColumn("spans", joined_spans()).withColumn("n_nested", (F.size("found") - F.col("n_assign") - F.col("n_access") - F.col("n_hex")).cast("long")).drop("found")
