"""Tables that cut a plan off, and a resolution of some relationships: what they leave on disk."""

from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

from tessera.cluster import cut
from tessera.operators import extraction, resolution
from tessera.sources import modules


def shuffles(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_a_cut_table_is_small_and_its_shuffles_go(spark):
    before = shuffles(spark)
    held = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    df = spark.range(50_000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.concat(F.lit("src/a/rather/long/path/file"), F.col("id") % 100).alias("path"))
    rows = cut(df.repartition("path").dropDuplicates(["id"]))
    size = sum(os.path.getsize(p.removeprefix("file://")) for p in rows.inputFiles())
    assert 0 < size < 50_000 * 48  # a row in memory takes over 128 bytes
    until = time.monotonic() + 20
    while shuffles(spark) - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not shuffles(spark) - before
    assert rows.count() == 50_000 and rows.join(df, ["id", "path"]).count() == 50_000 and cut(rows) is rows
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == held


def test_some_relationships_are_those_of_the_whole(spark, folder):
    sources = modules.sources(spark, folder).filter(r"relative_path rlike '^(ts|java)/.1/'")
    found, files = cut(extraction.observations(extraction.parsed(sources))), sources.select("relative_path", "language")
    whole, externals, told = resolution.resolve(found, files, modules.manifests(spark))
    for r in ("imports", "calls"):
        edges, outside, said = resolution.resolve(found, files, modules.manifests(spark), (r,))
        want = whole.filter(F.col("relationship") == r)
        assert sorted(map(tuple, edges.select("edge_id", F.xxhash64(*edges.columns)).collect())) == sorted(map(tuple, want.select("edge_id", F.xxhash64(*edges.columns)).collect())) and not edges.isEmpty(), r
        assert sorted(map(tuple, outside.collect())) == (sorted(map(tuple, externals.collect())) if r == "imports" else [])
        assert said.exceptAll(told).isEmpty()
    assert whole.count() == whole.select("edge_id").distinct().count()


def test_an_observation_that_comes_twice_gives_its_edges_once(spark, folder):
    sources = modules.sources(spark, folder).filter(r"relative_path rlike '^ts/.1/'")
    found, files = extraction.observations(extraction.parsed(sources)), sources.select("relative_path", "language")
    edges = resolution.resolve(found.unionByName(found), files, modules.manifests(spark))[0]
    assert edges.count() == edges.select("edge_id").distinct().count() > 0
