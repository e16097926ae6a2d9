"""Indexes of a generation on a file system: symbols by name, edges by their ends. Written once, read in part.

Both are sorted over all files, so what belongs together stands in one file or a few that follow each other, however often a key occurs. The
number of files follows the number of rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.cluster import swept
from tessera.functions.text import ascii_lower

#: Rows of one file of names, and of one task that writes edges.
NAMES, EDGES = 200_000, 1_000_000
#: Edges of one partition, about, and the most partitions.
PARTITION, PARTITIONS = 100_000, 4096
#: Columns that edges are found by.
ENDS = ("source_symbol_id", "target_symbol_id", "target_path")
#: Column of the bytes of an edge's id; what is kept of a path's symbols.
_BYTES, _PAIR = "__edge_id", T.StructType([T.StructField("target_path", T.StringType()), T.StructField("target_symbol_id", T.StringType())])


def write_names(symbols: DataFrame, folder: str) -> None:
    """Writes symbols sorted by their folded names, and the first and last name of each file."""
    rows = symbols.withColumn("folded", ascii_lower(F.col("spelling")))
    files = max(1, -(-symbols.count() // NAMES))
    order = ("folded", "spelling", "relative_path", "symbol_id")  # a frequent name is shared out
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{folder}/rows")
    written = symbols.sparkSession.read.parquet(f"{folder}/rows")
    ranges = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("folded").alias("low"), F.max("folded").alias("high"))
    ranges.coalesce(1).write.mode("overwrite").parquet(f"{folder}/ranges")


class Names:
    """The symbols of a generation by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def find(self, prefix: str, *names: str) -> DataFrame:
        """Symbols whose folded name begins with the folded prefix, or is one of the folded names; only files that can hold them are opened."""
        wanted = F.col("folded").startswith(prefix)
        # a range touches a prefix if it ends at or after it and does not begin past it
        overlap = (F.col("high") >= prefix) & ((F.col("low") <= prefix) | F.col("low").startswith(prefix))
        for name in names:
            wanted, overlap = wanted | (F.col("folded") == name), overlap | ((F.col("low") <= name) & (F.col("high") >= name))
        ranges = self.spark.read.parquet(f"{self.folder}/ranges")
        files = sorted(r["file"] for r in ranges.filter(overlap).collect())
        whole = self.spark.read.parquet(f"{self.folder}/rows")
        rows = self.spark.read.schema(whole.schema).parquet(*[f"{self.folder}/rows/{f}" for f in files]) if files else whole.limit(0)
        return rows.filter(wanted).drop("folded")


def _partition(key: Column, partitions: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")


def _packed(edges: DataFrame) -> DataFrame:
    """Edges whose ids, if they are hexadecimal digits, are bytes: ids are hashes, most of what an edge takes."""
    digits = F.col("edge_id").rlike(r"\A[0-9a-f]+\z") & (F.length("edge_id") % 2 == 0)
    return edges.withColumns({_BYTES: F.when(digits, F.unhex("edge_id")), "edge_id": F.when(~digits, F.col("edge_id"))})


def write_edges(edges: DataFrame, folder: str, ends: tuple[str, ...] = ENDS, most: int | None = None, by_symbol: bool = False, named: Callable[[DataFrame], DataFrame] | None = None, keys: dict[str, tuple[Column, str]] | None = None) -> None:
    """Writes the edges once for each of the ends: by a hash of the end, sorted by it, in partitions whose number follows that of the edges.

    most: how many edges there are at most, where it is known; else they are counted. by_symbol: by target_path are written the edges without
    a target symbol alone, and beside them the symbols that the edges into a path have: the others are found by these. named: what makes edges
    of short rows, after they are exchanged; keys then hold the text of each end, and the column that it stands for.
    """
    if by_symbol and "target_symbol_id" not in ends:
        raise ValueError(ends)
    spark = edges.sparkSession
    rows = (edges if named is None else named(edges)).count() if most is None else most
    partitions = min(PARTITIONS, 1 << max(4, (rows // PARTITION).bit_length()))
    tasks = max(1, -(-rows // EDGES))
    text = lambda end: F.col(end) if keys is None else keys[end][0]
    packed = _packed(edges if named is None else named(edges))
    for end in ends:
        part, order = _partition(F.col(end), partitions), ("part", end, _BYTES, "edge_id")  # by range: an end with very many edges is shared out among tasks
        placed = edges.filter(text(end).isNotNull())
        if by_symbol and end == "target_path":
            placed = placed.filter(text("target_symbol_id").isNull())
        if named is None:
            placed = _packed(placed).withColumn("part", part).repartitionByRange(tasks, *order)
        else:
            near = (keys[end][1], *(c for c in edges.columns if c != keys[end][1]))  # equal rows meet, so that they can be told apart without another exchange
            placed = _packed(named(placed.withColumn("part", _partition(text(end), partitions)).repartitionByRange(tasks, "part", *near))).withColumn("part", part)
        with swept(spark):
            placed.sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(f"{folder}/{end}")
    # the kind of the rows is kept beside them: an end that no edge has leaves no file that says it
    kind = T.StructType([*packed.schema.fields, T.StructField("part", T.IntegerType())])
    if by_symbol:
        pairs = spark.read.schema(kind).parquet(f"{folder}/target_symbol_id").select(*_PAIR.names).filter("target_path IS NOT NULL").distinct()
        with swept(spark):
            pairs.repartitionByRange(tasks, *_PAIR.names).sortWithinPartitions(*_PAIR.names).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/symbols")
    spark.createDataFrame([(partitions, rows, kind.json(), by_symbol)], "partitions int, rows long, kind string, by_symbol boolean").coalesce(1).write.mode("overwrite").parquet(f"{folder}/numbers")


class Adjacency:
    """The edges of a generation by their ends."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._numbers = None

    def of(self, end: str, keys: list[str]) -> DataFrame:
        """Edges with one of the keys at that end: only the keys' partitions are read, and in these the row groups that can hold them."""
        if end not in ENDS:
            raise ValueError(end)
        if self._numbers is None:
            self._numbers = self.spark.read.parquet(f"{self.folder}/numbers").first()
        wanted = list(dict.fromkeys(keys))
        if not wanted:
            return self._rows(end, F.lit(False))
        # a local relation: the numbers of the partitions come without a job
        hashed = self.spark.createDataFrame(pa.table({"k": pa.array(wanted, pa.string())})).select(_partition(F.col("k"), self._numbers["partitions"]))
        own = self._rows(end, F.col("part").isin(sorted({r[0] for r in hashed.collect()})) & F.col(end).isin(wanted))
        if end != "target_path" or not getattr(self._numbers, "by_symbol", False):
            return own
        pairs = self.spark.read.schema(_PAIR).parquet(f"{self.folder}/symbols").filter(F.col(end).isin(wanted))
        parts = sorted(r[0] for r in pairs.select(_partition(F.col("target_symbol_id"), self._numbers["partitions"])).distinct().collect())  # PARTITIONS at most
        return own.unionByName(self._rows("target_symbol_id", F.col("part").isin(parts) & F.col(end).isin(wanted))) if parts else own

    def _rows(self, end: str, wanted: Column) -> DataFrame:
        """Edges of the files of an end, as they were before they were written."""
        kind = T.StructType.fromJson(json.loads(self._numbers["kind"]))
        rows = self.spark.read.schema(kind).parquet(f"{self.folder}/{end}").filter(wanted).drop("part")
        if _BYTES not in kind.names:
            return rows
        return rows.withColumn("edge_id", F.coalesce(F.lower(F.hex(_BYTES)), "edge_id")).drop(_BYTES)
