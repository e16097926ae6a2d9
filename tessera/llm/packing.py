"""Packing of token sequences by the shortest pack first, over the histogram of lengths."""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.cluster import ship
from tessera.llm.common import read, stored, text_or_empty
from tessera.llm.tokens import load

#: Tokens of a sequence, and the id that ends a document.
SIZE, END = 4096, 2
#: Characters of text that are tokenized at once; a longer text comes in pieces of about so many.
SLICE = 1 << 21
#: Runs without white space that a task remembers with their ids, and the ids; past either only those met most are kept.
RUNS, IDS = 1 << 19, 1 << 23
#: Where a long text may be cut without a change of its tokens: before ASCII white space, or between a mark that is
#: part of no special string and an ASCII letter, where a word begins whatever stands around it.
_CUT = re.compile(r"[ \t\n\x0b\x0c\r]|(?<=[.,;:!?/_=-])(?=[A-Za-z])")


class Encoder:
    """Ids of whole texts, as the tokenizer gives them, with each distinct run of other characters than white space encoded once.

    The vocabulary must drop white space, ignore the case of ASCII letters and let no word, normalisation or special string reach over
    white space, nor over the place between an ASCII letter or digit and one of ``.,;:!?``; ``word_bpe_49k.json`` does. Then the ids of
    a text are those of its runs, one after the other.
    """

    def __init__(self, vocabulary: str, end: int):
        self.tokenizer = load(vocabulary)
        suffix = self.tokenizer.model.end_of_word_suffix
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        # run 0 is the end of a document
        self.runs, self.known = [""], {}
        self.starts, self.lengths, self.hits = np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1, np.int64)
        self.ids = np.array([end], np.uint32)

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with its end, and where each text begins (and the last ends)."""
        runs = pc.ascii_split_whitespace(pc.replace_substring_regex(column, "([A-Za-z0-9])([.,;:!?])", r"\1 \2"))
        flat = pc.dictionary_encode(runs.flatten())
        place = self._places(flat.dictionary.to_pylist())[flat.indices.to_numpy(zero_copy_only=False)]
        self.hits += np.bincount(place, minlength=len(self.hits))
        counts = pc.list_value_length(runs).to_numpy(zero_copy_only=False)
        codes = np.insert(place, np.cumsum(counts), 0)
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths)
        ids = self.ids[np.repeat(self.starts[codes] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends[np.cumsum(counts + 1) - 1]]).astype(np.int64)

    def long(self, text: str) -> np.ndarray:
        """Ids of a text of any length, with its end."""
        parts, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + SLICE)
            stop = cut.start() if cut else len(text)
            parts.append(self.texts(pa.array([text[at:stop]], pa.large_string()))[0][:-1])
            at = stop
        return np.concatenate([*parts, self.ids[:1]])

    def _places(self, runs: list[str]) -> np.ndarray:
        if len(self.runs) > RUNS or len(self.ids) > IDS:
            self._forget()
        # special strings are found before letters are lowered
        runs = [r.lower() if r.isascii() and "<" not in r else r for r in runs]
        new = list(dict.fromkeys(r for r in runs if r not in self.known))
        self._learn(new)
        return np.fromiter(map(self.known.__getitem__, runs), np.int64, len(runs))

    def _learn(self, new: list[str]) -> None:
        """Runs of letters are words, encoded in one text and told apart by the tokens that end words; all others one by one."""
        words = [r for r in new if r.isalpha()]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32) if words else np.empty(0, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):  # the library knows other letters: no run of letters has no end, so one has two
            words, ids, ends = [], ids[:0], ends[:0]
        plain = set(words)
        others = [r for r in new if r not in plain]
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        lengths = np.concatenate([np.diff(ends, prepend=0), np.array([len(f) for f in found], np.int64)]).astype(np.int64)
        self.known.update(zip([*words, *others], range(len(self.runs), len(self.runs) + len(new)), strict=True))
        self.runs += [*words, *others]
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths, self.hits = np.concatenate([self.lengths, lengths]), np.concatenate([self.hits, np.zeros(len(new), np.int64)])
        self.ids = np.concatenate([self.ids, ids, *found])

    def _forget(self) -> None:
        """Keeps the runs met most, a quarter of what may be kept."""
        order = 1 + np.argsort(-self.hits[1:], kind="stable")[: RUNS // 4]
        order = np.concatenate([[0], order[np.cumsum(self.lengths[order]) <= IDS // 4]])
        lengths = self.lengths[order]
        ends = np.cumsum(lengths)
        self.ids = self.ids[np.repeat(self.starts[order] - ends + lengths, lengths) + np.arange(ends[-1])]
        self.starts, self.lengths, self.hits = ends - lengths, lengths, self.hits[order] // 2
        self.runs = [self.runs[i] for i in order.tolist()]
        self.known = {r: i for i, r in enumerate(self.runs) if i}


@functools.lru_cache(maxsize=1)
def encoder_of(vocabulary: str, end: int) -> Encoder:
    """One for all tasks of a Python worker, so that its runs are learnt once."""
    return Encoder(vocabulary, end)


def width(vocabulary: str) -> int:
    """Bytes of an id while documents are ranked: 2, or 4 if there are more than 65,536 ids."""
    return 2 if load(vocabulary).get_vocab_size() <= 1 << 16 else 4


def widened(ids: pa.Array, wide: int) -> pa.Array:
    """The same numbers with 32 bits each."""
    ids = ids.cast(pa.large_binary())
    _, offsets, data = ids.buffers()
    begins = np.frombuffer(offsets, np.int64)[ids.offset : ids.offset + len(ids) + 1]
    numbers = np.frombuffer(data or b"", np.uint8)[int(begins[0]) : int(begins[-1])].view(f"<u{wide}").astype("<u4")
    out = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer((begins - begins[0]) // wide * 4), pa.py_buffer(numbers)])
    return out.cast(pa.binary())


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE characters; a longer text is alone."""
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(sizes):
        end, total = at + 1, int(sizes[at])
        while end < len(sizes) and total + sizes[end] <= SLICE:
            total += int(sizes[end])
            end += 1
        yield at, end
        at = end


def tokenized(docs: DataFrame, vocabulary: str, key: str, text: str, size: int = SIZE, end: int = END) -> DataFrame:
    """The ids of every text, cut at multiples of the size: (part, nth, key, start, length, ids, doc_tokens).

    ids: little-endian unsigned numbers of the vocabulary's width (see width()). A part is a task; nth counts the rows of one length of a part from 0. So the rows of a
    length can be ranked from counts alone, without moving them.
    """
    ship(docs.sparkSession)
    wide = width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = encoder_of(vocabulary, end), np.zeros(size + 1, np.int64)
        for batch in batches:
            texts = batch.column(2).cast(pa.large_string())
            for a, b in _slices(texts):
                own = texts.slice(a, b - a)
                if b - a == 1 and len(one := own[0].as_py()) > SLICE:
                    ids = encoder.long(one)
                    begins = np.array([0, len(ids)], np.int64)
                else:
                    ids, begins = encoder.texts(own)
                tokens = np.diff(begins)
                pieces = -(-tokens // size)
                row = np.repeat(np.arange(b - a), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * size
                length = np.minimum(size, tokens[row] - start)
                order = np.argsort(length, kind="stable")
                groups, counts = np.unique(length, return_counts=True)
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen[groups], counts)
                seen[groups] += counts
                # pieces follow each other as their ids do
                offsets = np.concatenate([[0], np.cumsum(length)]) * wide
                data = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.astype(f"<u{wide}"))])
                where = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(where), pa.array(nth), batch.column(1).take(where), pa.array(start), pa.array(length), data.cast(pa.binary()), pa.array(tokens[row])], ["part", "nth", "key", "start", "length", "ids", "doc_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.spark_partition_id().cast("long").alias("part"), F.col(key).alias("key"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, f"part long, nth long, key {kind}, start long, length long, ids binary, doc_tokens long")


class Plan:
    """Which pack every rank of every length goes to.

    Lengths are placed longest first, all rows of a length at once: each goes to the shortest pack that has room, and a pack is opened only
    if none has. As many packs are opened as the tokens need at least; once all are open, what fits nowhere is cut: one part
    fills the shortest pack, the rest is placed when its own length comes. So less than one pack is padding.

    Packs of one pattern are a range of numbers, and so are the rows that go there: the plan has a row for each, a number that depends on the
    size (at most about 90 * size by the water level of the lengths) and not on the documents.
    """

    FIELDS = ("length", "start", "lo", "per", "piece", "pack", "offset")

    def __init__(self, histogram: dict[int, int], size: int = SIZE):
        self.size = size
        total = sum(n * c for n, c in histogram.items())
        self.packs, self.opened = -(-total // size), 0
        self.rows: list[tuple[int, ...]] = []
        self.fill, self.first, self.count = (np.empty(0, np.int64) for _ in range(3))
        queue = [(-n, n, 0, 0, c) for n, c in histogram.items() if c]
        heapq.heapify(queue)
        while queue:
            piece, length, start, lo, count = heapq.heappop(queue)
            self._place(-piece, length, start, lo, count, queue)
        found = np.array(sorted(self.rows, key=lambda r: r[:3]), np.int64).reshape(-1, len(self.FIELDS))
        self.columns = {name: found[:, i].copy() for i, name in enumerate(self.FIELDS)}
        self.shift = 63 - int(size * (size + 1) + size).bit_length()
        self.keys = ((self.columns["length"] * (size + 1) + self.columns["start"]) << self.shift) + self.columns["lo"]

    def _place(self, piece: int, length: int, start: int, lo: int, count: int, queue: list) -> None:
        def put(per: int, pack: int, offset: int, packs: int) -> None:
            nonlocal lo, count
            self.rows.append((length, start, lo, per, piece, pack, offset))
            lo, count = lo + per * packs, count - per * packs

        room = (self.size - self.fill) // piece
        if room.any():
            # the highest water level that the rows can fill all shorter packs to, each by whole pieces
            each = lambda level: np.clip(-((self.fill - level) // piece), 0, room)
            low, high = 0, self.size
            while low < high:
                level = (low + high + 1) // 2
                low, high = (level, high) if int((each(level) * self.count).sum()) <= count else (low, level - 1)
            per = each(low)
            more = np.flatnonzero(each(low + 1) > per) if low < self.size else np.empty(0, np.int64)
            for i in np.flatnonzero(per).tolist():
                put(int(per[i]), int(self.first[i]), int(self.fill[i]), int(self.count[i]))
            self.fill += per * piece
            for i in more.tolist():
                if not count:
                    break
                packs = min(count, int(self.count[i]))
                put(1, int(self.first[i]), int(self.fill[i]), packs)
                self._split(i, packs, piece)
            self._drop_full()
        if count and self.opened < self.packs:
            most = self.size // piece
            whole = min(self.packs - self.opened, count // most)
            if whole:
                self._open(whole, most * piece)
                put(most, self.opened - whole, 0, whole)
            if count and self.opened < self.packs:
                self._open(1, count * piece)
                put(count, self.opened - 1, 0, 1)
            self._drop_full()
        while count:
            i = int(np.lexsort((self.first, self.fill))[0])
            filled, packs = self.size - int(self.fill[i]), min(count, int(self.count[i]))
            self.rows.append((length, start, lo, 1, filled, int(self.first[i]), int(self.fill[i])))
            heapq.heappush(queue, (filled - piece, length, start + filled, lo, packs))
            lo, count = lo + packs, count - packs
            self._split(i, packs, filled)
            self._drop_full()

    def _open(self, packs: int, fill: int) -> None:
        self.fill, self.first, self.count = (np.append(a, x) for a, x in ((self.fill, fill), (self.first, self.opened), (self.count, packs)))
        self.opened += packs

    def _split(self, i: int, packs: int, piece: int) -> None:
        """The first packs of a pattern get one piece more; the others stay a pattern of their own."""
        if packs < self.count[i]:
            rest = (self.fill[i], self.first[i] + packs, self.count[i] - packs)
            self.fill, self.first, self.count = (np.append(a, x) for a, x in zip((self.fill, self.first, self.count), rest, strict=True))
        self.count[i] = packs
        self.fill[i] += piece

    def _drop_full(self) -> None:
        open_ = self.fill < self.size
        self.fill, self.first, self.count = self.fill[open_], self.first[open_], self.count[open_]

    def pieces(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, start, piece, pack, offset) of every piece of the rows of these lengths and ranks."""
        out: list[tuple[np.ndarray, ...]] = []
        row, start = np.arange(len(length)), np.zeros(len(length), np.int64)
        while len(row):
            e = np.searchsorted(self.keys, ((length[row] * (self.size + 1) + start) << self.shift) + rank[row], side="right") - 1
            i, c = rank[row] - self.columns["lo"][e], self.columns
            out.append((row, start, c["piece"][e], c["pack"][e] + i // c["per"][e], c["offset"][e] + i % c["per"][e] * c["piece"][e]))
            start = start + c["piece"][e]
            more = start < length[row]
            row, start = row[more], start[more]
        return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 5


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", key: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """One row a piece: key, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document's ids are cut at multiples of the size: whole sequences, and a rest that is packed with others. Only counts by length are
    shuffled to rank the rests, and at most ``size`` of them reach the driver, which plans the packs from them; the rests then
    meet the counts before their own task, and with their rank the plan tells where they go. A null text is empty: its one
    token is the end. Repeated rows and null keys are documents of their own, in the order of the table. Columns other than key and
    text are not read. An empty table gives no rows.
    """
    rows = stored(tokenized(docs, vocabulary, key, text, size, end))
    counts = rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.filter(F.col("length") < size).groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, wide = Plan(histogram, size), width(vocabulary)
    # counts of one length: a row a task
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("part", "length", before.alias("before"))
    columns = ["key", "start", "length", "ids", "doc_tokens"]
    ranked = rows.join(bases.hint("shuffle_hash"), ["part", "length"]).select(*columns, (F.col("before") + F.col("nth")).alias("rank"))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 5))
            whole = length == size
            rest = np.flatnonzero(~whole)
            row, at, piece, sequence, offset = plan.pieces(length[rest], rank[rest])
            own = np.concatenate([np.flatnonzero(whole), rest[row]])
            zeros = np.zeros(int(whole.sum()), np.int64)
            at, piece = np.concatenate([zeros, at]), np.concatenate([zeros + size, piece])
            sequence, offset = np.concatenate([plan.packs + rank[whole], sequence]), np.concatenate([zeros, offset])
            taken = batch.select([0, 3, 4]).take(pa.array(own))
            arrays = [taken.column(0), pa.array(start[own] + at), pa.array(piece), pa.array(at), widened(taken.column(1), wide), taken.column(2), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "start", "length", "at", "ids", "doc_tokens", "sequence_id", "offset"])

    kind = docs.schema[key].dataType.simpleString()
    out = ranked.mapInArrow(dealt, f"key {kind}, start long, length long, at long, ids binary, doc_tokens long, sequence_id long, offset long")
    ids = F.expr("substring(ids, cast(at * 4 + 1 as int), cast(length * 4 as int))")
    return out.select(F.col("key").alias(key), "start", "length", ids.alias("ids"), "doc_tokens", "sequence_id", "offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves, without padding; each holds a few pieces of bounded size."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p")).select("sequence_id", "length", F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))


def op11_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(read(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
