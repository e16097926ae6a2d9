"""Benchmark decontamination by winnowed fingerprints that are extended to whole shared spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.cluster import ship
from tessera.llm.common import fresh, read, stored, text_or_empty
from tessera.llm.texthash import _R, alnum_words, mix, ngrams, word_slices

#: Words of a window; a shared span of this many words is always found.
WINDOW = 13
#: Words of a fingerprint. One of every WINDOW - GRAM + 1 consecutive ones is kept at least.
GRAM = 6
#: Bytes of benchmark text up to which its index is broadcast.
BLOCK_BYTES = 8 << 20


def winnow(grams: np.ndarray, span: int) -> np.ndarray:
    """Positions of the last smallest hash in each run of span hashes, in order, once each.

    Equal runs keep the same relative position, so two texts that share WINDOW words share a fingerprint there.
    """
    n = len(grams) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, span):
        other = grams[j : j + n]
        lower = other <= best
        best[lower] = other[lower]
        at[lower] = j
    return np.unique(at + np.arange(n))


def _window_hashes(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """ngrams() at some positions only."""
    out = np.zeros(len(starts), np.uint64)
    for i in range(size):
        out = out * np.uint64(_R) + words[starts + i]
    return mix(out)


class Known:
    """Items by the hash of a window, once each."""

    def __init__(self, hashes: list[np.ndarray], items: list[np.ndarray]):
        both = np.unique(np.rec.fromarrays([np.concatenate([np.empty(0, np.uint64), *hashes]), np.concatenate([np.empty(0, np.int64), *items])], names="h,i"))
        self.hashes, self.first = np.unique(both["h"], return_index=True)
        self.items, self.first = both["i"].copy(), np.append(self.first, len(both))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the hashes that are known, and their places among the known ones."""
        at = np.searchsorted(self.hashes, hashes)
        met = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes) if len(self.hashes) else np.empty(0, np.int64)
        return met, at[met]


class Index:
    """The windows of items, and the fingerprints of those of full length."""

    def __init__(self, ids: list[str], texts: list[str], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram, self.ids = window, gram, ids
        prints, windows = [np.empty(0, np.uint64)], {}
        for row, counts, hashes in word_slices(pa.array(texts, pa.string()), alnum_words()):
            for i, own in enumerate(np.split(hashes, np.cumsum(counts)[:-1]), row):
                if len(own) >= window:
                    grams = ngrams(own, gram)
                    prints.append(np.unique(grams[winnow(grams, window - gram + 1)]))
                if len(own):
                    found = np.unique(ngrams(own, min(window, len(own))))
                    for part, value in zip(windows.setdefault(min(window, len(own)), ([], [])), (found, np.full(len(found), i)), strict=True):
                        part.append(value)
        self.prints = np.unique(np.concatenate(prints))
        self.windows = {n: Known(*both) for n, both in windows.items()}
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.prints >> np.uint64(44)] = True

    def hits(self, counts: np.ndarray, hashes: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
        """By document of a slice: spans of hit words, end exclusive, and the items that occur.

        A fingerprint that both have is extended to the windows around it; these are looked up as a whole, once each, so
        that words that repeat don't multiply the work.
        """
        doc = np.repeat(np.arange(len(counts)), counts)
        first = np.cumsum(counts) - counts
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[int]] = {}
        for n, known in self.windows.items():
            starts = self._starts(hashes, n)
            starts = starts[doc[starts] == doc[starts + n - 1]] if len(starts) else starts
            met, places = known.find(_window_hashes(hashes, starts, n))
            starts = starts[met]
            if not len(starts):
                continue
            own = doc[starts]
            breaks = np.flatnonzero((own[1:] != own[:-1]) | (starts[1:] > starts[:-1] + n)) + 1
            for a, b in zip([0, *breaks.tolist()], [*breaks.tolist(), len(starts)], strict=True):
                d = int(own[a])
                spans.setdefault(d, []).append((int(starts[a] - first[d]), int(starts[b - 1] + n - first[d])))
            for d, place in np.unique(np.stack([own, places], 1), axis=0).tolist():
                items.setdefault(d, set()).update(known.items[known.first[place] : known.first[place + 1]].tolist())
        return {d: (spans[d], items[d]) for d in spans}

    def _starts(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """Where windows of n words can begin, in order: all places for short items, those around a shared fingerprint else."""
        if n < self.window or len(hashes) < n:
            return np.arange(max(0, len(hashes) - n + 1))
        grams = ngrams(hashes, self.gram)
        kept = winnow(grams, self.window - self.gram + 1)
        kept = kept[self.seen[grams[kept] >> np.uint64(44)]]
        kept = kept[np.isin(grams[kept], self.prints)]
        can = np.zeros(len(hashes), bool)
        for back in range(self.window - self.gram + 1):
            can[np.maximum(kept - back, 0)] = True
        return np.flatnonzero(can[: len(hashes) - n + 1])


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Disjoint spans in order, as one flat list of starts and ends."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def bytes_of(benchmark: DataFrame, text: str = "text") -> int:
    return benchmark.agg(F.sum(F.octet_length(text_or_empty(text)))).first()[0] or 0


def _items(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("item"), text_or_empty(text).alias("t"))


def _added(found: DataFrame) -> list[str]:
    """The names that find() gave to its three columns: they are the last."""
    return found.columns[-3:]


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with the words of whole texts, the spans of words that windows of items cover, and those items' ids.

    A window is `window` consecutive words of an item, or all words of one with fewer; items without words have none.
    Words are runs of ASCII letters, A-Z lowered, digits and characters past ASCII. Adds three columns for evidence() after
    those of the input, named __bench_words, __bench_spans and __bench_items, with underscores after them where the input has
    such a column. Null texts have no words, repeated rows and items stay, an empty benchmark hits nothing, an empty table
    gives no rows.

    A benchmark of up to block_bytes is indexed once and broadcast, and the documents are read in one pass. A larger one is never
    held by a process: see joined(). Both give the same rows.
    """
    spark = docs.sparkSession
    ship(spark)
    names = fresh(docs, "__bench_words", "__bench_spans", "__bench_items")
    if bytes_of(benchmark, item_text) > block_bytes:
        return joined(docs, _items(benchmark, item_key, item_text), text, window, gram, names)
    rows = _items(benchmark, item_key, item_text).collect()
    index = spark.sparkContext.broadcast(Index([r["item"] for r in rows], [r["t"] for r in rows], window, gram))
    schema = T.StructType([*docs.schema, *(T.StructField(n, k) for n, k in zip(names, (T.LongType(), T.ArrayType(T.LongType()), T.ArrayType(T.StringType())), strict=True))])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            n_words, spans, items = np.zeros(batch.num_rows, np.int64), [[]] * batch.num_rows, [[]] * batch.num_rows
            for row, counts, hashes in word_slices(batch.column(text), alnum_words()):
                n_words[row : row + len(counts)] = counts
                for d, (hit, which) in own.hits(counts, hashes).items():
                    spans[row + d], items[row + d] = merged(hit), sorted({own.ids[i] for i in which})
            found = (pa.array(n_words), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [f.name for f in schema])

    return docs.mapInArrow(look_up, schema)


#: Bits of the map of fingerprints that is broadcast, as a power of two: 16 MB, whatever the benchmark's size.
MAP_BITS = 27


class Marks:
    """A bit map of hashes, from the words of it that are not zero."""

    def __init__(self, at: np.ndarray, words: np.ndarray):
        self.bits = np.zeros(1 << (MAP_BITS - 6), np.int64)
        self.bits[at] = words

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the hashes that may be known."""
        bit = hashes >> np.uint64(64 - MAP_BITS)
        return np.flatnonzero((self.bits[bit >> np.uint64(6)] >> (bit & np.uint64(63)).astype(np.int64)) & 1)


def _marks(hashes: DataFrame) -> Marks:
    """The bit map of a column h, made by one aggregate; at most 2^(MAP_BITS - 6) words reach the driver."""
    bit = F.shiftrightunsigned("h", 64 - MAP_BITS)
    words = hashes.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - MAP_BITS}) & 63 AS int))")).alias("w")).toArrow()
    return Marks(words["at"].to_numpy(), words["w"].to_numpy())


def _batch(columns: list, schema: T.StructType) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "integer": pa.int32(), "string": pa.string()}
    arrays = [pa.array(c.view(np.int64) if isinstance(c, np.ndarray) and c.dtype == np.uint64 else c, kinds.get(f.dataType.typeName(), pa.list_(pa.int32()))) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema.names)


def _slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(batch, row, its word hashes), one text at a time."""
    for batch in batches:
        for row, counts, hashes in word_slices(batch.column(text), alnum_words()):
            for d, own in enumerate(np.split(hashes, np.cumsum(counts)[:-1])):
                yield batch, row + d, own


_PRINTS = T.StructType().add("id", "long").add("h", "long")
_WINDOWS = T.StructType().add("n", "integer").add("h", "long").add("item", "string")
_PLACES = T.StructType().add("id", "long").add("n", "integer").add("h", "long").add("starts", T.ArrayType(T.IntegerType()))


def joined(docs: DataFrame, items: DataFrame, text: str, window: int, gram: int, names: list[str]) -> DataFrame:
    """find() for a benchmark of any size (columns item and t), by joins on fingerprints and then on the windows around them.

    Fingerprints and windows of items are tables of distinct hashes. A bit map of the fingerprints, of fixed size, keeps most document
    fingerprints from being shuffled; once full it keeps all, and results are the same. Document fingerprints that are in the
    benchmark come back to their document, whose words around them are hashed as whole windows, once each with
    their places; these are joined with the windows of items. All documents that the map can't clear are written once with an id,
    so that lost executors change none. The benchmark's sides hold each key a few times only and are written tables, so a key
    that many documents have is split by Spark's skew join, as nothing but a shuffle stands below the join.
    """
    spark = docs.sparkSession

    def print_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, own in _slices(batches, "t"):
            if len(own) >= window:
                grams = ngrams(own, gram)
                kept = np.unique(grams[winnow(grams, window - gram + 1)])
                yield _batch([np.zeros(len(kept), np.int64), kept], _PRINTS)

    def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, own in _slices(batches, "t"):
            if len(own):
                n = min(window, len(own))
                found = np.unique(ngrams(own, n))
                yield _batch([np.full(len(found), n), found, [batch.column("item")[row].as_py()] * len(found)], _WINDOWS)

    prints = stored(items.mapInArrow(print_rows, _PRINTS).select("h").distinct())
    windows = stored(items.mapInArrow(window_rows, _WINDOWS).distinct())
    known = stored(windows.select("n", "h").distinct())
    short = sorted(r["n"] for r in known.filter(F.col("n") < window).select("n").distinct().collect())  # below window in number
    marks = spark.sparkContext.broadcast(_marks(prints.union(known.filter(F.col("n") < window).select("h"))))

    def kept_prints(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of a text's fingerprints that the map can't clear."""
        if len(own) < window:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        grams = ngrams(own, gram)
        kept = winnow(grams, window - gram + 1)
        kept = kept[marks.value.places(grams[kept])]
        return kept, grams[kept]

    n_words, spans, which = names
    ident, mark = fresh(docs, "__bench_id", "__bench_mark")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, open_ = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            for _, row, own in _slices(iter([batch]), text):
                sizes[row] = len(own)
                open_[row] = len(kept_prints(own)[0]) > 0 or any(len(marks.value.places(ngrams(own, n))) for n in short)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), pa.array(open_)], [*batch.schema.names, n_words, mark])

    counted = docs.mapInArrow(count, T.StructType([*docs.schema, T.StructField(n_words, T.LongType()), T.StructField(mark, T.BooleanType())]))
    own_columns = [F.col(f"`{c}`") for c in docs.columns]
    clear = counted.filter(~F.col(mark)).select(*own_columns, n_words, F.array().cast("array<bigint>").alias(spans), F.array().cast("array<string>").alias(which))
    rest = stored(counted.filter(mark).drop(mark).withColumn(ident, F.monotonically_increasing_id()))

    def document_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, own in _slices(batches, "t"):
            hashes = np.unique(kept_prints(own)[1])
            if len(hashes):
                yield _batch([np.full(len(hashes), batch.column("id")[row].as_py()), hashes], _PRINTS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows that may be an item's, by document: around a fingerprint that was met, and short ones that the map can't clear."""
        for batch, row, own in _slices(batches, "t"):
            met = batch.column("met")[row].values
            found = {n: np.arange(max(0, len(own) - n + 1)) for n in short}
            if met is not None:
                at, hashes = kept_prints(own)
                at = at[np.isin(hashes.view(np.int64), met.to_numpy(zero_copy_only=False))]
                can = np.zeros(len(own), bool)
                for back in range(window - gram + 1):
                    can[np.maximum(at - back, 0)] = True
                found[window] = np.flatnonzero(can[: len(own) - window + 1])
            for n, starts in found.items():
                hashes = _window_hashes(own, starts, n) if len(starts) else np.empty(0, np.uint64)
                if n < window:
                    kept = marks.value.places(hashes)
                    starts, hashes = starts[kept], hashes[kept]
                if not len(starts):
                    continue
                order = np.argsort(hashes, kind="stable")
                once, first = np.unique(hashes[order], return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(starts[order], pa.int32()))
                ids = np.full(len(once), batch.column("id")[row].as_py())
                yield _batch([ids, np.full(len(once), n), once, lists], _PLACES)

    texts = rest.select(F.col(ident).alias("id"), F.col(f"`{text}`").alias("t"))
    met = texts.mapInArrow(document_prints, _PRINTS).join(prints, "h", "left_semi").groupBy("id").agg(F.collect_list("h").alias("met"))
    around = stored(texts.join(met, "id", "left" if short else "inner").mapInArrow(places, _PLACES))
    found = around.join(known, ["n", "h"], "left_semi").groupBy("id").agg(F.collect_list(F.struct("n", "starts")).alias("found"))
    by_item = around.select("id", "n", "h").join(windows, ["n", "h"]).select("id", "item").distinct().groupBy("id").agg(F.sort_array(F.collect_list("item")).alias("items"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for hits in batch.column("found").to_pylist():
                starts = np.concatenate([h["starts"] for h in hits])
                ends = np.concatenate([np.asarray(h["starts"]) + h["n"] for h in hits])
                order = np.argsort(starts, kind="stable")
                starts, reach = starts[order], np.maximum.accumulate(ends[order])
                breaks = np.flatnonzero(starts[1:] > reach[:-1]) + 1
                out.append(np.stack([starts[np.r_[0, breaks]], reach[np.r_[breaks - 1, len(reach) - 1]]], 1).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.list_(pa.int64())), batch.column("items")], ["id", "spans", "items"])

    hit = found.join(by_item, "id").mapInArrow(spread, "id long, spans array<bigint>, items array<string>")
    hit = hit.select(F.col("id").alias(ident), F.col("spans").alias(spans), F.col("items").alias(which))
    looked_up = rest.join(hit, ident, "left").select(
        *own_columns, n_words, F.coalesce(spans, F.array().cast("array<bigint>")).alias(spans), F.coalesce(which, F.array().cast("array<string>")).alias(which)
    )
    return clear.union(looked_up)


def _hit_words(spans: str) -> Column:
    """The number of words in the spans of a row."""
    sums = F.aggregate(F.sequence(F.lit(0), F.size(spans) - 2, F.lit(2)), F.lit(0).cast("long"), lambda a, i: a + F.element_at(spans, i + 2) - F.element_at(spans, i + 1))
    return F.when(F.size(spans) > 0, sums).otherwise(F.lit(0).cast("long"))


def evidence(found: DataFrame) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated (n_hit > 0 and 20 * n_hit >= n_words) beside the other columns of find().

    Input columns of these five names are replaced. A text without words has n_words 0 and is clean; item ids are sorted as
    strings, a null one counts as 'null', repeated ones once. An empty table gives no rows.
    """
    n_words, spans, items = _added(found)
    n_hit = _hit_words(spans)
    return found.withColumns({
        "n_words": F.col(n_words),
        "n_hit": n_hit,
        "n_items": F.size(items).cast("long"),
        "items_sha256": F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256),
        "contaminated": (n_hit > 0) & (20 * n_hit >= F.col(n_words)),
    }).drop(n_words, spans, items)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, with their own columns only, whatever their names.

    Null and empty texts are clean and stay, null itself; repeated rows stay or go together. Without benchmark items all rows stay.
    """
    found = find(docs, benchmark, text, block_bytes=block_bytes)
    n_words, spans, _ = _added(found)
    clean = (F.size(spans) == 0) | (20 * _hit_words(spans) < F.col(n_words))
    return found.filter(clean).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return evidence(find(docs, read(spark, sf_dir, "benchmark"))).drop("text")


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS_SQL} AS w FROM benchmark),
lengths AS (SELECT DISTINCT least(len(w), 13) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM items WHERE len(w) > 0) t),
places AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, n, w, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM docs, lengths WHERE len(w) >= n) t),
found AS (SELECT p.r, p.i, p.n, x.item FROM places p JOIN windows x ON p.g = x.g AND p.n = x.n),
hits AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM found) u) t GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found) t GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""
