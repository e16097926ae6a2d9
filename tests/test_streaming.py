"""The stream of hints gives the bursts of the batch; bursts equal a plain loop."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from tessera.streaming import hints

START = datetime(2024, 1, 1, tzinfo=UTC)


def rows(seed=4, n=300):
    rng, at = random.Random(seed), 0
    out = []
    for i in range(n):
        at += rng.choice([0, 1, 5, 30, 400])
        out.append((START + timedelta(seconds=at), f"src/f{rng.randint(0, 5)}.rs", "modify", i))
    return out


def loop(data, gap):
    out = {}
    for ts, path, *_ in sorted(data):
        us = int(ts.timestamp() * 1_000_000)
        own = out.setdefault(path, [])
        if not own or us >= own[-1][0] + gap:
            own.append([us, 0])
        own[-1][1] += 1
    return sorted((p, s, n) for p, b in out.items() for s, n in b)


def test_bursts_begin_with_their_first_hint(spark):
    data = rows()
    df = spark.createDataFrame(data, "ts timestamp, path string, kind string, n int").repartition(3)
    for gap in (1, 60_000_000, 10**12):
        assert sorted(tuple(r) for r in hints.bursts(df, gap).collect()) == loop(data, gap)
    assert hints.bursts(df.limit(0), 5).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    data = rows()
    schema = "ts timestamp, path string, kind string"
    for i in range(0, len(data), 60):
        spark.createDataFrame([d[:3] for d in data[i : i + 60]], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = data[-1][0] + timedelta(days=2)
    spark.createDataFrame([(end, "src/end.rs", "modify")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        got = hints.open_bursts(spark, stream, 60_000_000, str(tmp_path / "checkpoint"), "bursts_out").collect()
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = loop([d for d in data], 60_000_000)
    assert sorted(tuple(r) for r in got if r["path"] != "src/end.rs") == want


def test_reconciliation_modes(spark):
    data = [(START + timedelta(minutes=m), p, "modify") for m, p in [(0, "a.rs"), (1, "a.rs"), (2, "b.go"), (61, "c.rs"), (62, "c.txt"), (125, "../x.rs"), *[(181, f"d{i}.rs") for i in range(5)]]]
    df = spark.createDataFrame(data, "ts timestamp, path string, kind string")
    got = [(r["trigger"], r["mode"], r["path_count"], r["overflow"]) for r in hints.reconciliations(df, "1 hour", 4).orderBy("start").collect()]
    assert got == [("event", "targeted", 2, 0), ("event", "full", 2, 0), ("event", "full", 1, 0), ("overflow", "full", 5, 1)]
    total = hints.counters(hints.reconciliations(df, "1 hour", 4)).first()
    assert (total["hints"], total["overflow"], total["mode_full"]) == (11, 1, 3)
    assert hints.counters(hints.reconciliations(df.filter(F.lit(False)), "1 hour")).first()["hints"] == 0
