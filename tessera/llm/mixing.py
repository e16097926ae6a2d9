"""Mixing of sources to target weights by Poisson replication, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, read, text_or_empty, uniform_bits

#: Exponent of the default target: a source's weight is its size to this power.
TEMPERATURE = 0.5
#: A source's rate is dealt to this many draws at most a unit, so that the table of one draw stays short.
DRAW_MEAN = 16.0
#: Sources up to which their table, of 1 KB a row at most, is broadcast; past it, the join is Spark's choice.
BROADCAST_SOURCES = 10_000
_SPAN = float(1 << 52)


def poisson_table(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable, far past the last value that a 52-bit draw can reach."""
    last = F.ceil(mean + F.lit(12.0) * F.sqrt(mean) + F.lit(24.0)).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["all"]


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", text: str = "text", total: float | None = None) -> DataFrame:
    """One row a source: bytes of text, target weight, mean repetitions of a row, and the table of one draw.

    weights: by source; a source not named gets none. Without weights, a source's weight is its size to the power TEMPERATURE.
    total: bytes of the mix; those of the input if not given.
    """
    sizes = docs.groupBy(F.col(source).alias("mix_source")).agg(F.sum(F.octet_length(text_or_empty(text)).cast("long")).alias("n_bytes"))
    if weights is None:
        raw = F.pow(F.col("n_bytes").cast("double"), F.lit(TEMPERATURE))
    else:
        named = [F.when(F.col("mix_source") == F.lit(k), F.lit(float(w))) for k, w in weights.items()]
        raw = F.coalesce(*named, F.lit(0.0))
    sizes = sizes.withColumn("raw", F.when(F.col("n_bytes") > 0, raw).otherwise(F.lit(0.0)))
    sums = sizes.agg(F.sum("raw").alias("raw"), F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n")).first()
    whole, size = float(sums["raw"] or 0.0), float(total if total is not None else sums["n_bytes"] or 0)
    rate = F.when(F.col("n_bytes") > 0, F.col("raw") / F.lit(whole or 1.0) * F.lit(size) / F.col("n_bytes")).otherwise(F.lit(0.0))
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(DRAW_MEAN))).cast("int")
    rates = (
        sizes.withColumn("rate", rate)
        .withColumn("draws", draws)
        .select("mix_source", "n_bytes", (F.col("raw") / F.lit(whole or 1.0)).alias("weight"), "rate", "draws", poisson_table(F.col("rate") / F.col("draws")).alias("table"))
    )
    return F.broadcast(rates) if sums["n"] <= BROADCAST_SOURCES else rates


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: str = "mix", key: str = "doc_id", source: str = "source", text: str = "text", total: float | None = None) -> DataFrame:
    """Repeats every row a Poisson number of times, with its source's rate as mean, and shuffles the copies.

    A row's number depends on its key, its source's rate and the seed: rows equal in these, null included, share it. Rows of null source are a source of their own. Sources that hold only empty
    texts have rate 0 and vanish, as no number of copies reaches their weight. An empty table gives no rows.
    The copies are dealt to partitions by the hash of mix_key, a random order, and sorted by it there: a global shuffle
    that needs no sampling of ranges. A key with very many rows, null included, is split by adaptive execution. Adds mix_rate, mix_copies, mix_copy (from 0) and mix_key; other columns pass.
    Columns of these names in the input are replaced.
    """
    rates = source_rates(docs, weights, source, text, total)
    base = docs.drop("mix_rate", "mix_copies", "mix_copy", "mix_key")
    own, draws, table = fresh(base, "__source", "__draws", "__table")
    drawn = F.transform(
        F.sequence(F.lit(1), F.col(draws)),
        lambda i: F.size(F.filter(F.col(table), lambda p: p <= uniform_bits(F.lit(seed), i, F.col(key)) / F.lit(_SPAN))),
    )
    rates = rates.select(F.col("mix_source").alias(own), F.col("rate").alias("mix_rate"), F.col("draws").alias(draws), F.col("table").alias(table))
    counted = base.join(rates, F.col(source).eqNullSafe(F.col(own))).withColumn("mix_copies", F.aggregate(drawn, F.lit(0), lambda a, b: a + b)).filter("mix_copies > 0")
    copies = counted.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
    order = uniform_bits(F.lit(f"{seed}-order"), F.col("mix_copy"), F.col(key))
    # rows of one key share a hash: as a rebalance, a partition that they fill is split among tasks at run time
    return copies.withColumn("mix_key", order).drop(own, draws, table).hint("rebalance", F.col("mix_key")).sortWithinPartitions("mix_key")


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "text", F.round("mix_rate", 9).alias("mix_rate"), F.col("mix_copies").cast("int").alias("mix_copies"), F.col("mix_copy").cast("int").alias("mix_copy"), "mix_key")


OP4_SQL = """
WITH RECURSIVE sizes AS (SELECT source, sum(CAST(strlen(coalesce(text, '')) AS BIGINT)) AS n_bytes FROM documents GROUP BY source),
raws AS (SELECT source, CAST(n_bytes AS DOUBLE) AS n_bytes, CASE WHEN n_bytes > 0 THEN sqrt(CAST(n_bytes AS DOUBLE)) ELSE 0 END AS raw FROM sizes),
sums AS (SELECT sum(raw) AS whole, sum(n_bytes) AS size FROM raws),
rates AS (SELECT source, CASE WHEN n_bytes > 0 THEN raw / whole * size / n_bytes ELSE 0.0 END AS rate FROM raws, sums),
means AS (SELECT source, rate, CAST(greatest(1, ceil(rate / 16.0)) AS BIGINT) AS draws, rate / greatest(1, ceil(rate / 16.0)) AS mean FROM rates),
steps(source, k, p, total) AS (
  SELECT source, 0, exp(-mean), exp(-mean) FROM means
  UNION ALL SELECT s.source, k + 1, p * mean / (k + 1), total + p * mean / (k + 1) FROM steps s JOIN means m ON s.source IS NOT DISTINCT FROM m.source WHERE k < ceil(mean + 12.0 * sqrt(mean) + 24.0)
), tables AS (SELECT source, list(total ORDER BY k) AS cdf FROM steps GROUP BY source),
keyed AS (SELECT d.*, rate, draws, cdf, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key
  FROM documents d JOIN means m ON d.source IS NOT DISTINCT FROM m.source JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
counted AS (SELECT *, CAST(list_sum(list_transform(range(1, draws + 1), lambda i: len(list_filter(cdf, lambda p: p <= CAST('0x' || substr(md5('mix|' || CAST(i AS VARCHAR) || '|' || key), 1, 13) AS BIGINT) / 4503599627370496.0)))) AS BIGINT) AS mix_copies FROM keyed),
copies AS (SELECT *, unnest(range(mix_copies)) AS mix_copy FROM counted)
SELECT doc_id, source, lang, text, round(rate, 9) AS mix_rate, CAST(mix_copies AS INTEGER) AS mix_copies, CAST(mix_copy AS INTEGER) AS mix_copy,
  CAST('0x' || substr(md5('mix-order|' || CAST(mix_copy AS VARCHAR) || '|' || key), 1, 13) AS BIGINT) AS mix_key
FROM copies
"""
