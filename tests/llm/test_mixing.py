from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.llm.mixing import mix, poisson_table, source_rates


def test_table_is_the_poisson_distribution(spark):
    for mean in (0.0, 0.3, 5.0, 16.0):
        table = spark.range(1).select(poisson_table(F.lit(mean)).alias("t")).first()["t"]
        want = [sum(math.exp(-mean) * mean**j / math.factorial(j) for j in range(k + 1)) for k in range(len(table))]
        assert all(abs(a - b) < 1e-12 for a, b in zip(table, want, strict=True)) and table[-1] > 1 - 1e-12


def test_shares_meet_weights(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("source"), F.lit("x" * 50).alias("text"))
    got = {r["source"]: r["n"] for r in mix(docs, {"a": 3.0, "b": 1.0}).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(got["a"] / (got["a"] + got["b"]) - 0.75) < 0.02
    assert abs(sum(got.values()) - 20000) < 1000


def test_large_rates_and_unnamed_sources(spark):
    docs = spark.createDataFrame([(i, "a" if i < 20 else "b", "text") for i in range(2000)], "doc_id long, source string, text string")
    rows = mix(docs, {"a": 1.0}).collect()
    assert {r["source"] for r in rows} == {"a"} and abs(len(rows) - 2000) < 250


def test_equal_rows_null_sources_empty_texts_and_names(spark):
    docs = spark.createDataFrame([(1, None, "t", 1), (1, None, "t", 2), (2, "s", "", 3), (3, "s", None, 4), (None, "u", "v", 5)], "doc_id long, source string, text string, mix_copy int")
    rows = mix(docs, seed="3").collect()
    assert all(r["source"] != "s" for r in rows)
    assert len([r for r in rows if r["doc_id"] == 1]) % 2 == 0
    assert all(0 <= r["mix_copy"] < r["mix_copies"] for r in rows)
    assert mix(docs.limit(0)).count() == 0 and mix(docs.limit(0)).columns[:4] != []
    assert source_rates(docs).count() == 3


def test_only_native_plans(spark, folder):
    plan = mix(spark.read.parquet(f"{folder}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_clashing_names(spark):
    docs = spark.createDataFrame([(i, "s", "t", 1, 2, 3) for i in range(50)], "doc_id long, source string, text string, __source int, __draws int, __TABLE int")
    got = mix(docs)
    assert got.columns[:6] == docs.columns and got.count() == mix(docs.select("doc_id", "source", "text")).count()


def test_rows_of_one_key_are_split(spark):
    names = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        docs = spark.range(0, 40_000, 1, 16).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit("x" * 100)).alias("text"), F.lit("s").alias("source"))
        mixed = next(m for m in (mix(docs, seed=str(i)) for i in range(20)) if m.limit(1).count())
        # the texts are shuffled as well, else the partitions would be too small to be split
        sizes = [r["n"] for r in mixed.groupBy(F.spark_partition_id()).agg(F.count("text").alias("n"), F.max("text")).collect()]
        assert sum(sizes) == 40_000 * mixed.select("mix_copies").first()[0] and max(sizes) < sum(sizes) / 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
