"""Importance resampling towards a target distribution, over hashed words and word pairs, in DataFrame operations only."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, read, stored, text_or_empty

BUCKETS = 10_000
#: Share drawn, in hundredths, of the documents with at least MIN_WORDS words.
PERCENT, MIN_WORDS = 25, 20
#: A gain of 1 in log odds is as many points.
SCALE = 1000
#: Equal rows that one row stands for until ranks are given out.
CHUNK = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of ASCII letters, digits and characters past ASCII, with A-Z lowered and nothing else."""
    lowered = lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER))
    return F.transform(F.filter(F.split(text, _GAPS), lambda w: w != ""), lowered)


def bucketed(docs: DataFrame, key: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """(key, n_words, buckets): for every word and pair of neighbours the CRC-32 modulo the number of buckets, repeats included."""
    split = docs.select(F.col(key).alias("key"), words(text_or_empty(text)).alias("w"))
    bucket = lambda s: (F.crc32(s.cast("binary")) % buckets).cast("int")
    # the last word has no neighbour: concat gives null there
    pairs = F.filter(F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))), lambda a, b: bucket(F.concat(a, F.lit(" "), b))), lambda p: p.isNotNull())
    return split.select("key", F.size("w").cast("long").alias("n_words"), F.concat(F.transform("w", bucket), pairs).alias("buckets"))


def totals(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of each bucket. Counted before the shuffle, so a task sends one row a bucket at most; as many reach the driver."""
    counts = np.zeros(buckets, np.int64)
    for b, n in rows.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[b] = n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """Points of a bucket: the log of its share of the target over its share of the source, both with one more feature a bucket."""
    up, down = float(source.sum() + len(source)), float(target.sum() + len(target))
    return [math.floor(SCALE * math.log((t + 1) * up / ((s + 1) * down))) for s, t in zip(source.tolist(), target.tolist(), strict=True)]


def gumbel(key: Column, seed: int) -> Column:
    """Points of Gumbel noise that depend on the key and the seed alone; a null key counts as the text null."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def importance(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """One row a document: key, n_words, n_features, weight (floored mean gain of its features), score (weight and noise).

    The bucket arrays of all documents are written once; their totals are all that is shuffled, then one map adds up the
    gains over the arrays. A null text has no words; documents without features have weight 0. Rows of equal key share their
    noise. Columns other than key and text are not read. Empty tables give no rows, an empty target equal shares.
    """
    rows = stored(bucketed(docs, key, text, buckets))
    gain = gains(totals(rows, buckets), totals(bucketed(target, text, text, buckets), buckets))
    # one literal: the optimizer folds the split text to an array
    points = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<int>")
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(points, b + 1))
    n = F.size("buckets").cast("long")
    measured = rows.select("key", "n_words", n.alias("n_features"), total.alias("points"))
    # floored division of integers: pmod is never negative
    weight = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(points - pmod(points, n_features)) div n_features"))
    weighed = measured.select("key", "n_words", "n_features", weight.alias("weight"))
    return weighed.select(F.col("key").alias(key), "n_words", "n_features", "weight", (F.col("weight") + gumbel(F.col("key"), seed)).alias("score"))


def draw(scored: DataFrame, key: str = "doc_id", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows of importance() with their rank among the drawn ones, from 1; null for those that are not drawn.

    Drawn are the highest scores of the rows with enough words, floor(percent * N / 100) of them; ties go to the smaller key
    (null first), then to fewer features, then to the smaller weight; equal rows take neighbouring ranks. A histogram of scores, which are whole
    points and so a bounded number, gives the threshold and the rank before each score; ranks inside a score are counted
    over distinct rows, so that no task holds more than the distinct keys of one score.
    """
    able = F.col("n_words") >= min_words
    order = sorted(((r["score"], r["n"]) for r in scored.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    count = np.array([n for _, n in order], np.int64)
    most, before = percent * int(count.sum()) // 100, np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64) if len(count) else count
    reached = int((before < most).sum())
    undrawn = F.lit(None).cast("long")
    columns = [key, "n_words", "n_features", "weight", "score"]
    if not reached:
        return scored.select(*columns, undrawn.alias("rank"))
    least = order[reached - 1][0]
    starts = scored.sparkSession.createDataFrame(pa.table({"s": pa.array([s for s, _ in order[:reached]], pa.int64()), "before": pa.array(before[:reached], pa.int64())}))
    above = able & (F.col("score") >= least)
    groups = scored.filter(above).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("score").orderBy(key, "n_features", "weight", "n_words").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = groups.withColumn("own", own).join(F.broadcast(starts), F.col("score") == F.col("s")).withColumn("first", F.col("before") + F.col("own") + 1)
    chunks = ranked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK))))
    chunks = chunks.withColumn("first", F.col("first") + F.col("chunk") * CHUNK).withColumn("n", F.least(F.col("n") - F.col("chunk") * CHUNK, F.lit(CHUNK)))
    each = chunks.withColumn("rank", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    drawn = each.select(*columns, F.when(F.col("rank") <= most, F.col("rank")).alias("rank"))
    return scored.filter(~above | above.isNull()).select(*columns, undrawn.alias("rank")).unionByName(drawn)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = 7) -> DataFrame:
    """The drawn rows of docs with all of their columns; of a repeated key, all rows that any of its ranks drew."""
    (own,) = fresh(docs, "drawn")
    drawn = draw(stored(importance(docs, target, key, text, seed)), key, percent, min_words).filter("rank IS NOT NULL").select(F.col(key).alias(own)).distinct()
    return docs.join(drawn, F.col(key).eqNullSafe(F.col(own)), "left_semi")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = stored(importance(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))
    return draw(scored).select("doc_id", "n_features", "weight", "score", "rank")


#: DuckDB has no CRC-32: the table of 256 remainders and the loop over bytes are the definition of the checksum.
OP13_SQL = r"""
WITH RECURSIVE bits(byte, step, crc) AS (
  SELECT b, 0, b FROM range(256) t(b)
  UNION ALL SELECT byte, step + 1, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END FROM bits WHERE step < 8
), remainders AS (SELECT list(crc ORDER BY byte) AS r FROM bits WHERE step = 8),
texts AS (SELECT 's' AS side, doc_id AS id, row_number() OVER () AS row, coalesce(text, '') AS body FROM documents
  UNION ALL SELECT 't', item_id, row_number() OVER (), coalesce(text, '') FROM benchmark),
worded AS (SELECT side, id, row, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (SELECT side, row, unnest(w) AS f FROM worded
  UNION ALL SELECT side, row, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM worded),
counted AS (SELECT side, row, f, count(*) AS n FROM features GROUP BY ALL),
names AS (SELECT DISTINCT f FROM counted),
hashed AS (SELECT f, xor(list_reduce(
  list_prepend(4294967295, list_transform(range(octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, r[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM names, remainders),
bucketed AS (SELECT side, row, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
sides AS (SELECT coalesce(sum(n) FILTER (side = 's'), 0) AS all_s, coalesce(sum(n) FILTER (side = 't'), 0) AS all_t FROM bucketed),
gain AS (SELECT bucket, floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (all_s + 10000) / (CAST(s + 1 AS DOUBLE) * (all_t + 10000)))) AS g
  FROM (SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM bucketed GROUP BY bucket), sides),
sums AS (SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * g) / sum(n)) AS BIGINT) AS weight FROM bucketed JOIN gain USING (bucket) WHERE side = 's' GROUP BY row),
scored AS (SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  CAST('0x' || substr(sha256('7:' || coalesce(CAST(id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS h FROM worded LEFT JOIN sums USING (row) WHERE side = 's'),
noisy AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS r, count(*) FILTER (n_words >= 20) OVER () AS able FROM noisy)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 25 * able // 100 THEN r END AS rank FROM ranked
"""
