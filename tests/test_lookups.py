"""Names and edges by index: the rows of a scan, from the files that can hold them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, lookups, search
from tessera.sources import corpus


@pytest.fixture(scope="module")
def symbols(spark, folder):
    return corpus.symbols(spark, folder).persist()


@pytest.fixture(scope="module")
def edges(spark, folder):
    return corpus.edges(spark, folder).persist()


def test_names_are_those_of_a_scan_from_few_files(spark, symbols, tmp_path, monkeypatch):
    monkeypatch.setattr(lookups, "NAMES", 20)
    odd = symbols.limit(3).withColumn("spelling", F.lit("ÉclairX")).withColumn("symbol_id", F.concat(F.lit("odd"), "symbol_id"))
    hot = symbols.limit(1).crossJoin(spark.range(70)).withColumn("symbol_id", F.concat(F.lit("hot"), "id")).withColumn("spelling", F.lit("redHot")).drop("id")
    every = symbols.unionByName(odd).unionByName(hot)
    lookups.write_names(every, f"file://{tmp_path}/names")
    names = lookups.Names(spark, f"file://{tmp_path}/names")
    files = spark.read.parquet(f"file://{tmp_path}/names/ranges").count()
    assert files > 5
    for query in ("redring", "red", "RedHot", "r", "zzz", "Brand17.RedWidget", "Brand4::old", "ÉclairX", "éc", "old", "~", "", "A"):
        if query:
            got, want = (search.search_symbols(every, query, limit=200, tokens=False, names=n).select("tier", "symbol_id").collect() for n in (names, None))
            assert got == want, query
    assert len(names.find("redring").inputFiles()) <= 2 and len(names.find("zzz").inputFiles()) <= 1
    assert 3 <= len(names.find("redhot").inputFiles()) < files  # a frequent name fills some files, not one
    lookups.write_names(symbols.limit(0), f"file://{tmp_path}/none")
    assert lookups.Names(spark, f"file://{tmp_path}/none").find("a", "b").count() == 0


def test_walks_by_index_are_those_of_a_scan(spark, symbols, edges, tmp_path, monkeypatch):
    monkeypatch.setattr(lookups, "EDGES", 500)
    lookups.write_edges(edges, f"file://{tmp_path}/edges")
    index = lookups.Adjacency(spark, f"file://{tmp_path}/edges")
    for end in lookups.ENDS:
        assert spark.read.parquet(f"file://{tmp_path}/edges/{end}").count() == edges.filter(F.col(end).isNotNull()).count()
    rng = random.Random(3)
    for _ in range(4):
        roots = [f"sym-{rng.randrange(200)}" for _ in range(2)]
        options = {"direction": rng.choice(["outgoing", "incoming"]), "relationship": rng.choice(["any", "calls"]), "depth": 3, "max_edges": rng.choice([50, 2000])}
        a, b = graph.walk(edges, roots, **options), graph.walk(edges, roots, index=index, **options)
        assert (a[0], [r["edge_id"] for r in a[1]], a[2]) == (b[0], [r["edge_id"] for r in b[1]], b[2])
    path = edges.first()["target_path"]
    a, b = (graph.analyze_impact(edges, symbols, ["sym-7"], [path], depth=2, index=i) for i in (None, index))
    assert (a[0], a[2], a[3]) == (b[0], b[2], b[3]) and a[1].collect() == b[1].select(*a[1].columns).collect()
    assert index.of("target_path", []).count() == 0
    with pytest.raises(ValueError):
        index.of("line", ["1"])


def test_a_level_reads_the_partitions_of_its_frontier(spark, edges, tmp_path):
    lookups.write_edges(edges, f"file://{tmp_path}/edges")
    rows = lookups.Adjacency(spark, f"file://{tmp_path}/edges").of("source_symbol_id", ["sym-7"])
    plan = rows._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "PartitionFilters: [isnotnull(part" in text and "EqualTo(source_symbol_id,sym-7)" in text
    read = {r["f"] for r in rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"(part=\d+)/", 1).alias("f")).collect()}
    assert len(read) == 1


def test_an_end_with_most_edges_is_shared_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lookups, "EDGES", 300)
    rows = spark.range(3000).select(F.col("id").cast("string").alias("edge_id"), F.when(F.col("id") % 3 != 0, "hub").otherwise(F.concat(F.lit("s"), "id")).alias("source_symbol_id"), F.lit("t").alias("target_symbol_id"), F.lit(None).cast("string").alias("target_path"))
    lookups.write_edges(rows, f"file://{tmp_path}/edges")
    index = lookups.Adjacency(spark, f"file://{tmp_path}/edges")
    hub = index.of("source_symbol_id", ["hub"])
    counts = [r["count"] for r in hub.groupBy(F.col("_metadata.file_name")).count().collect()]
    assert sum(counts) == 2000 and max(counts) < 700
    assert index.of("target_path", ["x"]).count() == 0
