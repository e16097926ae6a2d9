from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import sharding
from tessera.llm.sharding import shard, shard_column


def test_one_more_shard_takes_rows_only_into_itself(spark):
    rows = shard(spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), [1.0] * 8).collect()
    moved = [r for r in rows if r["shard"] != r["grown_shard"]]
    assert all(r["grown_shard"] == 8 for r in moved) and 350 < len(moved) < 750


def test_weights(spark):
    rows = spark.range(20000).select(shard_column(F.col("id"), [1.0, 3.0]).alias("s")).groupBy("s").count().collect()
    assert abs({r["s"]: r["count"] for r in rows}[1] / 20000 - 0.75) < 0.02
    with pytest.raises(ValueError, match="weights"):
        shard_column(F.lit(1), [1.0, 0.0])


def test_slots_have_no_gaps_whatever_the_buckets(spark, monkeypatch):
    rows = [(i % 40 if i % 7 else None, ["é" * (i % 5), None, ""][i % 3], i) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(5)
    results = []
    for size in (100_000, 5):
        monkeypatch.setattr(sharding, "BUCKET_ROWS", size)
        got = shard(df, [1.0] * 4).collect()
        for s in range(4):
            own = sorted(r["slot"] for r in got if r["shard"] == s)
            assert own == list(range(len(own)))
        results.append(sorted(map(str, got)))
    assert results[0] == results[1] and len(got) == 500
    assert {(r["size"], r["text_crc32"]) for r in got} == {(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in rows}
    assert shard(df.limit(0), [1.0]).count() == 0


def test_written_shards(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    sharding.write_shards(df, str(tmp_path / "out"), [1.0] * 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.select("shard").distinct().count() == 3
    plan = shard(df, [1.0] * 3)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_many_equal_rows_and_one_key_of_many_texts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 16)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 20)
    rows = [(7, "same")] * 300 + [(8, f"text {i}") for i in range(300)] + [(i, "x") for i in range(100)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), [1.0] * 3).collect()
    assert len(got) == len(rows)
    for s in range(3):
        own = sorted((r["slot"], r["doc_id"], r["text_crc32"], r["size"]) for r in got if r["shard"] == s)
        assert [o[0] for o in own] == list(range(len(own)))
        eights = [o[2:] for o in own if o[1] == 8]
        assert eights == sorted(eights)
        assert not len({o[0] - i for i, o in enumerate(o for o in own if o[1] == 7)}) > 1
