"""Exact Jaccard join of word n-gram sets by token-combination prefixes, and the classes of its links.

Shingles are ordered by class (in one set only, rare, frequent), then by hash. Two sets whose Jaccard similarity is
0.8 or more share a shingle among the first n - ceil(0.8 n) + 1 of each. If the first shingle that they share is rare,
they meet there: the rare shingles of that prefix are indexed alone. If it is frequent, all that they share is frequent.
Then frequent shingles are indexed in combinations: the range of hashes is cut into more parts than two linked sets can
differ in shingles, and the shingles of a part are one combination. At most D parts differ, so one of the first D + 1
combinations of each set is the same in both: the prefix is extended to them. The number of parts goes by bands of the
size of a set, each a quarter wider than the last; linked sets are in one band or in neighbouring ones, so a set is indexed
in its own band and in the next. A set of n shingles thus has about n / 2 entries at most, whatever the classes.
Shingles of one set only come first, link nothing and are not indexed.

Sets are first compared with one leader each, the least set of most of its least entries; what links is contracted. An
entry whose sets are all in one component then can't give a new link and goes. The sets of the others meet in
clusters that are verified in blocks of bounded size: all pairs but those within the largest component of a
large cluster. So no entry is expanded into its pairs, and no link between different components is lost.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fresh, read, stored, text_or_empty
from tessera.llm.components import components
from tessera.llm.texthash import mix, ngrams, whitespace_words, word_slices

#: Words of a shingle, and the least similarity in percent.
SHINGLE, PERCENT = 5, 80
#: Sets in which a shingle must be to count as frequent.
FREQUENT = 16
#: Bits of the largest maps of repeated and of frequent shingles. A full map costs speed, not links.
REPEATED_BITS, FREQUENT_BITS = 27, 24
#: Bytes and sets of a block of a cluster; a task compares two blocks at most.
BLOCK_BYTES, BLOCK_SETS = 8 << 20, 1024
#: Shingles that a task sorts at once while it counts.
SORTED = 1 << 21
#: Least entries of a set by which it finds its leader.
FIRST = 8
#: The most repeated sets, of which only one row is counted and indexed; of any other a task remembers the last ones.
COPIED, REMEMBERED = 1 << 17, 1 << 16
#: Bytes of shingles in an Arrow batch.
BATCH = 4 << 20


_LONG = (1 << 64) - 1


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes): the whole sequence if it is shorter, nothing without words."""
    for row, counts, hashes in word_slices(column, whitespace_words()):
        grams, ends = ngrams(hashes, size), np.cumsum(counts)
        for i, (n, end) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
            if n >= size:
                yield row + i, np.unique(grams[end - n : end - size + 1])
            else:
                yield row + i, ngrams(hashes[end - n : end], n) if n else np.empty(0, np.uint64)


def set_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "big", signed=True)


def bands(percent: int = PERCENT) -> list[int]:
    """The least size of a set of each band: sets that link are in one band or in neighbouring ones."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(-(-100 * starts[-1] // percent))
        starts[-1] = max(starts[-1], starts[-2] + 1)
    return starts


_BANDS = {PERCENT: bands()}


class Classes:
    """Whether shingles are in more than one set, and in many: bits by the first bits of their hash."""

    def __init__(self, repeated: bytes | bytearray, frequent: bytes | bytearray):
        self.repeated, self.frequent = np.frombuffer(repeated, np.uint8), np.frombuffer(frequent, np.uint8)

    @staticmethod
    def _bits(table: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        at = tokens >> np.uint64(64 - int(math.log2(len(table) * 8)))
        return (table[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1) != 0

    def index_keys(self, tokens: np.ndarray, percent: int = PERCENT) -> np.ndarray:
        """The index entries of a set, in order: its rare prefix shingles, and combinations of its frequent ones."""
        n = len(tokens)
        prefix = n - (percent * n + 99) // 100 + 1
        repeated = tokens[self._bits(self.repeated, tokens)]
        left = prefix - (n - len(repeated))
        if left <= 0:
            return np.empty(0, np.uint64)
        often = self._bits(self.frequent, repeated)
        rare, common = repeated[~often], repeated[often]
        keys = [rare[:left]]
        if len(rare) < left:
            starts = _BANDS.get(percent) or bands(percent)
            own = bisect_right(starts, n) - 1
            for band in (own, own + 1):
                keys.append(self._combinations(common, n, n - len(common), band, starts, percent))
        return np.unique(np.concatenate(keys))

    @staticmethod
    def _combinations(common: np.ndarray, n: int, other: int, band: int, starts: list[int], percent: int) -> np.ndarray:
        """Entries of one band. A set that links to this one by frequent shingles alone differs in `differ` of them at most."""
        largest, apart, whole = starts[band + 1] - 1, 100 - percent, 100 + percent
        differ = min(apart * (n + largest) // whole, apart * (n + 100 * n // percent) // whole) - other
        if differ < 0 or apart * 2 * largest < whole:
            return np.empty(0, np.uint64)
        parts = 3 * (apart * 2 * largest // whole) // 2 + 2
        part = ((common >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(common) else np.empty(0, np.int64)
        place = mix(np.uint64(band * 0x9E3779B97F4A7C15 & _LONG) + part[first] + np.uint64(1))
        keys = mix(place + np.add.reduceat(mix(common ^ np.uint64(0xA24BAED4963EE407)), first)) if len(first) else place
        if len(first) > differ:
            return keys[: differ + 1]
        # so few parts hold shingles that all of them may differ: the empty ones are entries, too
        empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[first], assume_unique=True)
        return np.concatenate([keys, mix(np.uint64(band * 0x9E3779B97F4A7C15 & _LONG) + empty + np.uint64(1))])


class Copies:
    """Tells the rows of a set that is there already: for the most repeated sets all rows but those of its least key, else those that a task met."""

    def __init__(self, least: dict[int, int]):
        self.least, self.met = least, set()

    def again(self, own: int, key: int) -> bool:
        if self.least.get(own, key) != key or own in self.met:
            return True
        if len(self.met) >= REMEMBERED:
            self.met.clear()
        self.met.add(own)
        return False


def repeated_sets(info: DataFrame) -> dict[int, int]:
    """Hash of the least key of each of the COPIED most repeated sets."""
    sets = info.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.min("k").alias("least")).filter("rows > 1")
    found = sets.orderBy(F.desc("rows"), "id").limit(COPIED).select("id", F.xxhash64("least").alias("h")).toArrow()
    return dict(zip(found.column("id").to_pylist(), found.column("h").to_pylist(), strict=True))


def count_classes(docs: DataFrame, key: str, rows: int, least: Broadcast, text: str = "text", frequent: int = FREQUENT) -> Classes:
    """Counts every shingle over all documents, and keeps two bit maps of fixed largest size.

    Hashes travel sorted and packed, four bytes a shingle, to the task that counts their range. A set is counted once, so
    that copies don't make rare shingles frequent, however many tasks they are in.
    """
    rows = max(1, rows)
    spread = min(17, max(4, math.ceil(math.log2(rows / 4096 + 1))))  # bits of the range
    inner = max(0, 16 - spread)  # bits between the range and the last 32
    wide = [min(most, max(spread + 3, math.ceil(math.log2(rows * 2048)) - less)) for most, less in ((REPEATED_BITS, 0), (FREQUENT_BITS, 4))]

    def pack(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.sort(np.concatenate(held)) >> np.uint64(32 - spread - inner)
        ranges = (tokens >> np.uint64(inner + 32)).astype(np.int64)
        low, middle = tokens.astype(np.uint32), ((tokens >> np.uint64(32)) & np.uint64((1 << inner) - 1)).astype(np.int64)
        found, starts = np.unique(ranges, return_index=True)
        ends = [*starts[1:].tolist(), len(tokens)]
        heads = [np.bincount(middle[a:b], minlength=1 << inner).astype(np.uint32).tobytes() for a, b in zip(starts.tolist(), ends, strict=True)]
        lows = [low[a:b].tobytes() for a, b in zip(starts.tolist(), ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(heads, pa.binary()), pa.array(lows, pa.binary())], ["r", "heads", "lows"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies, held, size = Copies(least.value), [], 0
        for batch in batches:
            hashes = batch.column(1).to_pylist()
            for i, tokens in shingle_sets(batch.column(0)):
                if not len(tokens) or copies.again(set_id(tokens), hashes[i]):
                    continue
                held.append(tokens)
                size += len(tokens)
                if size >= SORTED:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    def bits(keys: np.ndarray, width: int) -> bytes:
        out = np.zeros(1 << (width - spread), np.uint8)
        out[(keys >> np.uint64(inner + 32 - (width - spread))).astype(np.int64)] = 1
        return np.packbits(out).tobytes()

    def count(r: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(parts))
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        times = np.diff(np.append(starts, len(keys)))
        keys = keys[starts]
        maps = [bits(keys[times >= 2], wide[0]), bits(keys[times >= frequent], wide[1])]
        return pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), *[pa.array([m], pa.binary()) for m in maps]], ["r", "repeated", "frequent"])

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for r, heads, lows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if r != now and parts:
                    yield count(now, parts)
                    parts = []
                now = r
                middle = np.repeat(np.arange(1 << inner, dtype=np.uint64), np.frombuffer(heads, np.uint32))
                parts.append((middle << np.uint64(32)) | np.frombuffer(lows, np.uint32).astype(np.uint64))
        if parts:
            yield count(now, parts)

    packed = docs.select(text_or_empty(text).alias("t"), F.xxhash64(key).alias("h")).mapInArrow(gather, "r int, heads binary, lows binary")
    maps = packed.repartition("r").sortWithinPartitions("r").mapInArrow(classify, "r int, repeated binary, frequent binary")
    tables = [bytearray(1 << (w - 3)) for w in wide]
    for row in maps.toLocalIterator():  # of fixed size together: the two maps
        for table, part in zip(tables, (row["repeated"], row["frequent"]), strict=True):
            table[row["r"] * len(part) : (row["r"] + 1) * len(part)] = part
    return Classes(*tables)


def _info(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, n_shingles, id) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids = [], []
            for _, tokens in shingle_sets(batch.column(1)):
                sizes.append(len(tokens))
                ids.append(set_id(tokens) if len(tokens) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64())], ["k", "n_shingles", "id"])

    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
    return rows.mapInArrow(run, f"k {docs.schema[key].dataType.simpleString()}, n_shingles long, id long")


def _index(docs: DataFrame, key: str, text: str, classes: Broadcast, least: Broadcast) -> DataFrame:
    """(id, size, keys, tokens) of each set that has index entries; once, but for rows that repeat key and text."""

    def batch_of(held: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys = pa.array([k.astype(np.int64) for _, k, _ in held], pa.list_(pa.int64()))
        columns = [pa.array([i for i, _, _ in held], pa.int64()), pa.array([len(t) for *_, t in held], pa.int64()), keys, pa.array([t.tobytes() for *_, t in held], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["id", "size", "keys", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, copies, held, size = classes.value, Copies(least.value), [], 0
        for batch in batches:
            hashes = batch.column(1).to_pylist()
            for i, tokens in shingle_sets(batch.column(0)):
                if not len(tokens) or copies.again(number := set_id(tokens), hashes[i]):
                    continue
                keys = own.index_keys(tokens)
                if len(keys):
                    held.append((number, keys, tokens))
                    size += tokens.nbytes + keys.nbytes
                if size >= BATCH:
                    yield batch_of(held)
                    held, size = [], 0
        yield batch_of(held)

    rows = docs.select(text_or_empty(text).alias("t"), F.xxhash64(key).alias("h"))
    return rows.mapInArrow(run, "id long, size long, keys array<bigint>, tokens binary")


def linked(sets: list[np.ndarray], sides: np.ndarray | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between sets; with sides, of links from side 0 to side 1 only."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if (100 + percent) * both >= percent * sizes.sum() else []
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, inverse, times = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = times >= 2
    column = np.cumsum(shared) - 1
    kept = shared[inverse]
    column, owner = column[inverse[kept]], owner[kept]
    order = np.argsort(column, kind="stable")
    column, owner, both = column[order], owner[order], np.zeros((n, n), np.float32)
    for start in range(0, int(shared.sum()), 2048):
        a, b = np.searchsorted(column, [start, start + 2048])
        part = np.zeros((n, 2048), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        both += part @ part.T
    near = (100 + percent) * both.astype(np.float64) >= percent * (sizes[:, None] + sizes[None, :])
    if sides is not None:
        near &= sides[:, None] != sides[None, :]
    np.fill_diagonal(near, False)
    edges, free = [], np.ones(n, bool)
    for i in range(n):
        if not free[i]:
            continue
        free[i] = False
        todo = [i]
        while todo:
            at = todo.pop()
            new = np.flatnonzero(near[at] & free)
            free[new] = False
            edges += [(at, int(j)) for j in new]
            todo += new.tolist()
    return edges


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each (leader, i, j) group; its rows follow one another, sorted. Memory holds two blocks."""
    now, held = None, {}

    def finish() -> list[tuple[int, int]]:
        ids = list(held)
        if len(ids) < 2:
            return []
        sides = None if now[1] == now[2] else np.array([held[i][0] == now[1] for i in ids])
        return [(ids[i], ids[j]) for i, j in linked([held[x][1] for x in ids], sides)]

    for batch in batches:
        edges = []
        columns = [batch.column(c).to_pylist() for c in range(6)]
        for leader, i, j, block, own, tokens in zip(*columns, strict=True):
            if (leader, i, j) != now:
                edges += finish()
                now = (leader, i, j)
                held.clear()
            held[own] = (block, np.frombuffer(tokens, np.uint64))
        yield _edges(edges)
    yield _edges(finish())


def _edges(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])


def _near_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of sets to their leader, which comes first of its group. Memory holds one set beside a batch."""
    leader, head = None, None
    for batch in batches:
        edges = []
        for group, own, tokens in zip(*(batch.column(c).to_pylist() for c in (0, 2, 4)), strict=True):
            tokens = np.frombuffer(tokens, np.uint64)
            if own == group:
                leader, head = own, tokens
            elif group == leader and PERCENT * max(len(tokens), len(head)) <= 100 * min(len(tokens), len(head)):
                both = int((head[np.minimum(np.searchsorted(head, tokens), len(head) - 1)] == tokens).sum())
                if (100 + PERCENT) * both >= PERCENT * (len(tokens) + len(head)):
                    edges.append((group, own))
        yield _edges(edges)


def _blocks(count: str, size: str) -> Column:
    """Blocks of a group of sets by its number of sets and of shingles."""
    return F.greatest(F.ceil(F.col(size) * 8 / BLOCK_BYTES), F.ceil(F.col(count) / BLOCK_SETS)).cast("int")


def _stars(index: DataFrame) -> DataFrame:
    """Edges (a, b) from leaders to sets that link to them, a set with one leader: the least set of most of its least entries."""
    firsts = index.select("id", F.explode(F.slice("keys", 1, FIRST)).alias("entry"))
    heads = firsts.groupBy("entry").agg(F.min("id").alias("leader"), F.max("id").alias("last")).filter("leader < last").select("leader", F.col("entry").alias("e"))
    met = firsts.join(heads, F.col("entry") == F.col("e")).groupBy("id", "leader").agg(F.count(F.lit(1)).alias("n"))
    best = met.groupBy("id").agg(F.max_by("leader", F.struct("n", F.bitwise_not("leader"))).alias("leader")).filter("id <> leader")
    best = stored(best.select(F.col("id").alias("i"), "leader"))
    members = index.join(best, F.col("id") == F.col("i")).select("leader", "id", "size", "tokens")
    sizes = index.select("id", "size").join(best, F.col("id") == F.col("i")).groupBy("leader").agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("sizes"))
    sizes = stored(sizes.select(F.col("leader").alias("l"), _blocks("sets", "sizes").alias("blocks")))  # so that Spark can split the rows of a large leader
    dealt = members.join(sizes, F.col("leader") == F.col("l")).select("leader", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", F.lit(1).alias("turn"), "tokens")
    first = index.join(sizes, F.col("id") == F.col("l")).select(F.col("id").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", F.lit(0).alias("turn"), "tokens")
    groups = dealt.union(first).repartition("leader", "block").sortWithinPartitions("leader", "block", "turn")
    return groups.mapInArrow(_near_leader, "a long, b long")


def _links(index: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges (a, b) between sets of different components: a spanning forest of the links in each cluster."""
    named = index.select("id", "size", "keys").join(roots.select(F.col("node").alias("n"), "root"), F.col("id") == F.col("n"), "left")
    entries = named.select("id", "size", F.coalesce("root", "id").alias("root"), F.explode("keys").alias("entry"))
    mixed = entries.groupBy("entry").agg(F.min("root").alias("leader"), F.max("root").alias("last")).filter("leader < last").select("leader", F.col("entry").alias("e"))
    met = stored(entries.join(mixed, F.col("entry") == F.col("e")).groupBy("leader", "id", "root").agg(F.max("size").alias("size")))
    parts = met.groupBy("leader", "root").agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("sizes"))
    most = F.max(F.struct("sizes", "sets", F.col("root").alias("main"))).alias("most")
    plan = parts.groupBy("leader").agg(F.sum("sets").alias("sets"), F.sum("sizes").alias("sizes"), most)
    plan = plan.select(F.col("leader").alias("l"), "sets", "sizes", "most.main", F.col("most.sets").alias("in_main"), F.col("most.sizes").alias("of_main"))
    plan = plan.withColumns({"rest": F.col("sets") - F.col("in_main"), "of_rest": F.col("sizes") - F.col("of_main")})
    whole = _blocks("sets", "sizes") <= 1
    plan = plan.select("l", "main", F.when(whole, 0).otherwise(_blocks("in_main", "of_main")).alias("main_blocks"), F.when(whole, 1).otherwise(_blocks("rest", "of_rest")).alias("rest_blocks"))
    plan = stored(plan)
    # blocks of the rest come first; the largest component is compared with them, not with itself
    placed = met.join(plan, F.col("leader") == F.col("l"))
    inside = (F.col("root") == F.col("main")) & (F.col("main_blocks") > 0)
    block = F.when(inside, F.col("rest_blocks") + F.pmod(F.xxhash64("id"), F.greatest("main_blocks", F.lit(1)))).otherwise(F.pmod(F.xxhash64("id"), F.col("rest_blocks")))
    last = F.when(inside, F.col("rest_blocks")).otherwise(F.col("rest_blocks") + F.col("main_blocks")) - 1
    placed = placed.select("leader", F.col("id").alias("i"), block.cast("int").alias("block"), last.cast("int").alias("last"))
    pairs = index.select("id", "tokens").join(placed, F.col("id") == F.col("i")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    groups = pairs.select("leader", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "tokens")
    return groups.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j").mapInArrow(_verify, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_shingles, component_id (the least key that links reach, its own included).

    Documents link when the Jaccard similarity of their sets of distinct 5-word shingles is 0.8 or more; a text with fewer
    words is one shingle. A-Z are lowered, words end at white space. Texts that are null or hold no words have
    n_shingles 0 and link with nothing. Sets are told apart by 64-bit hashes. Rows with a null key link like others;
    component_id is the least key that is not null, null if there is none. Repeated rows stay. Other columns are not read.
    """
    return _rooted(docs, key, text).select(F.col("k").alias(key), "n_shingles", "component_id")


def _rooted(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, n_shingles, id, root, component_id) of every document: its set and the set that stands for its component, null without words."""
    context = docs.sparkSession.sparkContext
    info = stored(_info(docs, key, text))
    least = context.broadcast(repeated_sets(info))
    classes = context.broadcast(count_classes(docs, key, info.count(), least, text))
    index = stored(_index(docs, key, text, classes, least))
    near = components(_stars(index))
    edges = near.select(F.col("root").alias("a"), F.col("node").alias("b")).union(_links(index, near))
    roots = components(edges).withColumnRenamed("node", "n")
    own = info.filter("id IS NOT NULL").groupBy("id").agg(F.min("k").alias("least"))
    own = own.join(roots, F.col("id") == F.col("n"), "left").select("id", "least", F.coalesce("root", "id").alias("root"))
    least = own.groupBy("root").agg(F.min("least").alias("component")).withColumnRenamed("root", "r")
    of_set = own.join(least, F.col("root") == F.col("r")).select(F.col("id").alias("s"), "root", "component")
    whole = info.select("k", "n_shingles", "id").join(of_set, F.col("id") == F.col("s"), "left")
    return whole.select("k", "n_shingles", "id", "root", F.when(F.col("id").isNull(), F.col("k")).otherwise(F.col("component")).alias("component_id"))


def _with_set(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Documents with the id of their set, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [set_id(tokens) if len(tokens) else None for _, tokens in shingle_sets(batch.column(0))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(ids, pa.int64())], [*batch.schema.names[1:], name])

    rows = docs.select(text_or_empty(text).alias(name), *[F.col(f"`{c}`") for c in docs.columns])
    return rows.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that of its least key. Of its rows that repeat this key, one with the longest, then least text stays.

    Rows of one key that are in different components are told apart by their sets. Rows without words stay, one of each
    key, and rows of null key all stay. Columns pass, whatever their names.
    """
    found = stored(_rooted(docs, key, text))
    first, rows, own, at, root, turn = fresh(docs, "__first", "__rows", "__set", "__key", "__root", "__turn")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    leads = F.col("k").isNull() | F.col("k").eqNullSafe(F.col("component_id"))
    heads = found.groupBy("k").agg(F.count(F.lit(1)).alias(rows), F.max(leads).alias("leads")).filter("leads").select(F.col("k").alias(first), rows)
    kept = docs.join(heads, F.col(key).eqNullSafe(F.col(first)))
    single = kept.filter(F.col(first).isNull() | (F.col(rows) == 1)).select(*columns)
    sets = found.filter("k IS NOT NULL AND k = component_id").select(F.col("k").alias(at), F.col("id").alias("own_id"), F.col("root").alias(root)).distinct()
    repeated = _with_set(kept.filter(F.col(first).isNotNull() & (F.col(rows) > 1)).select(*columns), text, own)
    sets = sets.withColumnRenamed("own_id", turn)
    again = repeated.join(sets, (F.col(key) == F.col(at)) & F.col(own).eqNullSafe(F.col(turn))).drop(turn)
    spare = Window.partitionBy(at, root).orderBy(F.length(text).desc_nulls_last(), F.col(text))
    again = again.withColumn(turn, F.row_number().over(spare)).filter(F.col(turn) == 1)
    return single.union(again.select(*columns))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE worded AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
grams AS (SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM worded WHERE len(w) > 0) t),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS meet FROM grams a JOIN grams b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
links AS (SELECT x, y FROM shared JOIN sizes s ON s.r = x JOIN sizes t ON t.r = y WHERE 100 * meet >= 80 * (s.n + t.n - meet)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT r, r FROM worded UNION SELECT reach.x, b.y FROM reach JOIN both_ways b ON reach.y = b.x)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(c.component_id AS BIGINT) AS component_id
FROM worded w LEFT JOIN sizes USING (r) JOIN (SELECT reach.x AS r, min(d.doc_id) AS component_id FROM reach JOIN worded d ON reach.y = d.r GROUP BY reach.x) c USING (r)
"""
