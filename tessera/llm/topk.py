"""Exact top-k search by distributed histogram selection.

Every candidate is scored against a block of queries. Histograms of the scores, one a query, are added up over all
tasks; each round splits the bin that holds the kth score, until the kth score itself is known. A last pass keeps the
rows above it and, of the rows that tie with it, those of the least ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.cluster import shared_folder
from tessera.llm.common import read, stored

#: Queries of a block, that each executor holds at once, and bins of a query's histogram.
QUERIES, BINS = 2048, 1024
#: Candidates that are scored at once.
TILE = 256
_SIGN = np.uint64(1 << 63)
_RESULT = "query_id long, rank int, vec_id long, score long"


def quantized(embedding: Column) -> Column:
    """floor(256 * x) of each component, as long."""
    return F.transform(embedding, lambda x: F.floor(F.lit(256.0) * x.cast("double")))


def whole(embedding: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


class Block:
    """Queries of one dimension, by ascending id, with the interval that holds each one's kth score."""

    def __init__(self, ids: list[int], vectors: list[list[int]], k: int, bound: int):
        self.ids, self.bound = np.array(ids, np.int64), bound
        self.exact = bound < 1 << 53
        self.vectors = np.array(vectors, np.float64 if self.exact else object).reshape(len(ids), -1)
        self.low = np.full(len(ids), _key(-bound), np.uint64)
        self.span = 2 * bound + 1
        self.width = -(-self.span // BINS)
        self.need = np.full(len(ids), k, np.int64)
        self.all = np.zeros(len(ids), bool)

    def keys(self, ids: np.ndarray, vectors: list) -> tuple[np.ndarray, np.ndarray]:
        """Scores as unsigned numbers of the same order, and whether a row is a candidate of the query."""
        if self.exact:
            scores = (np.array(vectors, np.float64).reshape(len(ids), -1) @ self.vectors.T).astype(np.int64)
        else:
            found = np.array(vectors, object).reshape(len(ids), -1) @ self.vectors.T
            scores = np.array([max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in found.ravel()], np.int64).reshape(found.shape)
        mine = np.ones(scores.shape, bool)
        first, last = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        for i in np.flatnonzero(last > first):
            mine[i, first[i] : last[i]] = False
        return scores.view(np.uint64) ^ _SIGN, mine

    def tiles(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for i in range(0, batch.num_rows, TILE):
                ids = batch.column(0).slice(i, TILE).to_numpy(zero_copy_only=False).astype(np.int64)
                column = batch.column(1).slice(i, TILE)
                vectors = column.flatten().to_numpy(zero_copy_only=False) if self.exact else column.to_pylist()
                yield ids, *self.keys(ids, vectors)

    def histograms(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(q, bin, n) from the highest bin down, until a task's own rows fill the need: the kth score is no lower."""
        counts = np.zeros(len(self.ids) * BINS, np.int64)
        for _, keys, mine in self.tiles(batches):
            mine &= keys >= self.low
            row, q = np.nonzero(mine)
            past = keys[row, q] - self.low[q]
            at, inside = past // np.uint64(self.width), past < np.uint64(self.span)
            counts += np.bincount(q[inside] * BINS + at[inside].astype(np.int64), minlength=len(counts))
        counts = counts.reshape(len(self.ids), BINS)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, at = np.nonzero((counts > 0) & (above < self.need[:, None]) & ~self.all[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(self.need[q], pa.int64()), pa.array(at, pa.int32()), pa.array(counts[q, at], pa.int64())], ["q", "need", "bin", "n"])

    def narrow(self, rows: list) -> None:
        """Takes the bin that holds each query's kth score, and the rows above it."""
        met = np.zeros(len(self.ids), bool)
        for r in rows:
            met[r["q"]] = True
            self.low[r["q"]] += np.uint64(r["bin"] * self.width)
            self.need[r["q"]] -= r["above"]
        self.all |= ~met  # fewer candidates than asked for: all are taken
        self.done = self.width == 1
        self.span, self.width = self.width, -(-self.width // BINS)

    def chosen(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(query_id, q, vec_id, score): all rows above the kth score, and a task's ties of the least ids."""
        ties: dict[int, list[int]] = {}
        for ids, keys, mine in self.tiles(batches):
            row, q = np.nonzero(mine & (self.all | (keys > self.low)))
            yield self._rows(q, ids[row], (keys[row, q] ^ _SIGN).view(np.int64))
            row, q = np.nonzero(mine & ~self.all & (keys == self.low))
            order = np.argsort(q, kind="stable")
            for one, own in zip(*_grouped(q[order], ids[row][order]), strict=True):
                ties[one] = sorted([*ties.get(one, []), *np.sort(own)[: self.need[one]].tolist()])[: self.need[one]]
        q = np.array([one for one, own in ties.items() for _ in own], np.int64)
        yield self._rows(q, np.array([i for own in ties.values() for i in own], np.int64), (self.low[q] ^ _SIGN).view(np.int64))

    def _rows(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q], pa.int64()), pa.array(q, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["query_id", "q", "vec_id", "score"])


def _key(score: int) -> int:
    return score + (1 << 63)


def _grouped(q: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    if not len(q):
        return [], []
    starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    return q[starts].tolist(), np.split(values, starts[1:])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of the highest integer inner product, ties to the least id.

    Components count as floor(256 * x). A row of a query's own id is not its candidate. Vectors that are null or hold
    null or non-finite components, and rows of null id, take no part; vectors of another length are no candidates.
    Rows that repeat are candidates each, and queries each. Scores past a long are held at its ends. A query with fewer
    candidates gets all; empty tables give no rows. Other columns are not read.

    Queries come to the executors in blocks of about `block`; for each block the candidates are read once a round, and its
    rows are appended to one table in the shared folder: the plan of the result is one scan, however many blocks there are.
    """
    spark = candidates.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        return df.filter(F.col(key).isNotNull() & whole(F.col(vector))).select(F.col(key).cast("long").alias("id"), quantized(F.col(vector)).alias("v"))

    asked = stored(clean(queries).groupBy("id", "v").agg(F.count(F.lit(1)).alias("times")))
    all_rows = clean(candidates)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sizes = asked.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("rows"), F.max(norm).alias("n")).orderBy("d").collect()
    longest = {r["d"]: r["n"] for r in all_rows.groupBy(F.size("v").alias("d")).agg(F.max(norm).alias("n")).collect()} if sizes else {}
    results = f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    spark.createDataFrame([], _RESULT).write.parquet(results)
    for r in sizes:
        d, bound = r["d"], min((1 << 62) - 1, int(np.sqrt(r["n"]) * np.sqrt(longest.get(r["d"], 0.0)) * 1.000001) + 1)
        rows, parts = all_rows.filter(F.size("v") == d), -(-r["rows"] // block)
        of_block = stored(asked.filter(F.size("v") == d).withColumn("part", F.pmod(F.xxhash64("id", "v"), F.lit(parts))).repartition("part").sortWithinPartitions("part"))
        for part in range(parts):
            own = of_block.filter(F.col("part") == part).collect()
            own.sort(key=lambda q: (q["id"], q["v"]))
            if own:
                _search(rows, Block([q["id"] for q in own], [q["v"] for q in own], k, bound), [q["times"] for q in own], k).write.mode("append").parquet(results)
    return spark.read.schema(_RESULT).parquet(results)


def _search(rows: DataFrame, block: Block, times: list[int], k: int) -> DataFrame:
    context = rows.sparkSession.sparkContext
    block.done = False
    while not block.done:
        shared = context.broadcast(block)
        bins = rows.mapInArrow(lambda batches, shared=shared: shared.value.histograms(batches), "q int, need long, bin int, n long")
        bins = bins.groupBy("q", "need", "bin").agg(F.sum("n").alias("n"))
        bins = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))).filter("upto >= need")
        block.narrow(bins.groupBy("q").agg(F.max_by(F.struct("bin", (F.col("upto") - F.col("n")).alias("above")), "bin").alias("b")).select("q", "b.*").collect())
    shared = context.broadcast(block)
    found = rows.mapInArrow(lambda batches: shared.value.chosen(batches), "query_id long, q int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    if max(times) > 1:
        copies = F.element_at(F.array(*map(F.lit, times)), F.col("q") + 1)
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_histogram_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
