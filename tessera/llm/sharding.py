"""Weighted rendezvous hashing of stable record keys, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import read, stored, text_or_empty, uniform_bits

#: Distinct rows of one range of slots, about: the largest sort that a task has to do.
BUCKET_ROWS = 100_000
#: Equal rows that one row stands for until slots are given out.
CHUNK = 1 << 16
_SPAN = 1 << 52


def shard_column(key: Column, weights: list[float], seed: str = "shard") -> Column:
    """The shard with the highest score -w / ln(u(key, shard)); ties go to the smaller shard.

    A key's score for a shard depends on that key and shard alone. So one more shard, or a larger
    weight, moves only the rows that it wins; no row moves between two other shards.
    """
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights: one positive number a shard")

    def score(i: int, w: float) -> Column:
        u = (uniform_bits(F.lit(seed), F.lit(i), key) + F.lit(0.5)) / F.lit(float(_SPAN))
        return F.struct((F.lit(-float(w)) / F.log(u)).alias("score"), F.lit(-i).alias("order"))

    scores = [score(i, w) for i, w in enumerate(weights)]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["order"]).cast("int")


def shard(docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its shard and a gapless slot from 0 inside it.

    Slots follow the order (hash of the key, key, text_crc32, size). Rows that are equal in all of it are counted first and
    get neighbouring slots; the distinct ones are cut into ranges of this order, so that no task holds a shard, nor a key that
    has many texts. Slots are numbered in two steps, as rows before the range plus rows before in the range.
    Rows with equal keys, null included, share a shard; a null text has size 1 and CRC 0. An empty table gives no rows. Other
    columns are not read.
    Returns key, size, text_crc32, law, shard, slot, grown_shard (the shard if there were one more, of mean weight).
    """
    size, body = F.octet_length(text_or_empty(text)).cast("long") + 1, F.crc32(text_or_empty(text).cast("binary"))
    grown = [*weights, sum(weights) / len(weights)]
    rows = docs.select(F.col(key).alias("k"), size.alias("size"), body.alias("text_crc32")).groupBy("k", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("*", shard_column(F.col("k"), weights).alias("shard"), shard_column(F.col("k"), grown).alias("grown_shard"), uniform_bits(F.lit("slot"), F.col("k")).alias("h"))
    rows = stored(rows)
    sums = rows.agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("most")).first()
    order = ("h", "k", "text_crc32", "size")
    ranges = max(1, -(-sums["rows"] // BUCKET_ROWS))
    cut = stored(rows.repartitionByRange(ranges, "shard", *order).withColumn("range", F.spark_partition_id())) if ranges > 1 else rows.withColumn("range", F.lit(0))
    counts = cut.groupBy("shard", "range").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("shard").alias("s"), F.col("range").alias("r"), before.alias("before"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("shard", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = cut.withColumn("own", own).join(starts, (F.col("shard") == F.col("s")) & (F.col("range") == F.col("r"))).withColumn("slot", F.col("before") + F.col("own"))
    if (sums["most"] or 0) > CHUNK:
        dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK)))).repartition("k", "chunk")
        dealt = dealt.withColumn("slot", F.col("slot") + F.col("chunk") * CHUNK).withColumn("n", F.least(F.col("n") - F.col("chunk") * CHUNK, F.lit(CHUNK)))
    dealt = dealt.withColumn("slot", F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("n") - 1)))
    return dealt.select(F.col("k").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: list[float], key: str = "doc_id") -> None:
    """Writes the rows under path/shard=N; files of a shard are written by many tasks.

    All columns are written but one named shard, which is replaced. Rows with a null key share a shard; null texts, ties and
    repeated rows are written as they are. An empty table makes an empty folder. The path must not be there.
    """
    docs.withColumn("shard", shard_column(F.col(key), weights)).write.partitionBy("shard").parquet(path)


SHARDS = [1.0] * 8


def op9_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"), SHARDS)


_SCORES = ", ".join(f"md5('shard|{i}|' || k) AS m{i}" for i in range(9))


def _winner(n: int) -> str:
    top = f"greatest({', '.join(f'substr(m{i}, 1, 13)' for i in range(n))})"
    return "CASE " + " ".join(f"WHEN substr(m{i}, 1, 13) = {top} THEN {i}" for i in range(n)) + " END"


#: With equal weights the highest score is the highest hash, so the weights need no logarithm here.
#: DuckDB has no CRC-32: the table of 256 remainders and the loop over bytes are the definition of the checksum.
OP9_SQL = f"""
WITH RECURSIVE bits(byte, step, crc) AS (
  SELECT b, 0, b FROM range(256) t(b)
  UNION ALL SELECT byte, step + 1, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END FROM bits WHERE step < 8
), remainders AS (SELECT list(crc ORDER BY byte) AS r FROM bits WHERE step = 8),
texts AS (SELECT DISTINCT coalesce(text, '') AS body FROM documents),
sums AS (SELECT body, CASE WHEN body = '' THEN 0 ELSE xor(list_reduce(
  list_prepend(4294967295, list_transform(range(octet_length(encode(body))), lambda i: CAST('0x' || substr(hex(encode(body)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, r[xor(c & 255, b) + 1])), 4294967295) END AS crc FROM texts, remainders),
keys AS (SELECT doc_id, coalesce(text, '') AS body, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k FROM documents),
hashed AS (SELECT *, {_SCORES} FROM keys),
dealt AS (SELECT doc_id, strlen(h.body) + 1 AS size, crc AS text_crc32, {_winner(8)} AS shard, {_winner(9)} AS grown_shard, substr(md5('slot|' || k), 1, 13) AS h
  FROM hashed h JOIN sums s ON h.body = s.body)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM dealt
"""
