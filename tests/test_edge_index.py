"""Indexes of edges that are dealt as short rows, and paths that are found through their symbols."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import lookups
from tessera.plans import graphs
from tessera.sources import corpus


def shuffled(spark) -> int:
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def rows(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=str)


def test_paths_are_found_through_symbols(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lookups, "EDGES", 40)
    odd = ["0af3", "0AF3", "abc", "", "ab\n", "cd\ncd", "é0", "00" * 32, None]
    made = [(odd[i % 9] if i < 9 else f"{i:064x}", f"s{i % 7}", None if i % 5 == 0 else f"t{i % 11}", None if i % 13 == 0 else f"p{i % 11 // 4}" if i % 3 else f"q{i % 4}") for i in range(200)]
    edges = spark.createDataFrame(made, "edge_id string, source_symbol_id string, target_symbol_id string, target_path string")
    lookups.write_edges(edges, f"file://{tmp_path}/edges", ("target_symbol_id", "target_path"), 1_000, by_symbol=True)
    index = lookups.Adjacency(spark, f"file://{tmp_path}/edges")
    for paths in (["p0"], ["q1", "p2", "gone"], ["gone"], [f"q{i}" for i in range(4)], []):
        assert rows(index.of("target_path", paths)) == rows(edges.filter(F.col("target_path").isin(paths)))
    assert rows(index.of("target_symbol_id", ["t3", "t4"])) == rows(edges.filter("target_symbol_id IN ('t3', 't4')"))
    assert spark.read.schema("edge_id string").parquet(f"file://{tmp_path}/edges/target_path").count() == edges.filter("target_symbol_id IS NULL AND target_path IS NOT NULL").count()
    with pytest.raises(ValueError):
        lookups.write_edges(edges, f"file://{tmp_path}/none", ("target_path",), by_symbol=True)


def test_lines_that_repeat_are_one_edge_of_an_index(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(lookups, "EDGES", 700)
    lines, edges = corpus.lines(spark, folder), corpus.edges(spark, folder)
    keys = {end: of() for end, of in corpus.LINE_ENDS.items()}
    lookups.write_edges(lines.unionByName(lines), f"file://{tmp_path}/edges", named=corpus.named, keys=keys)
    index = lookups.Adjacency(spark, f"file://{tmp_path}/edges")
    for end in lookups.ENDS:
        some = [r[0] for r in edges.select(end).distinct().orderBy(end).limit(5).collect()]
        assert rows(index.of(end, some)) == rows(edges.filter(F.col(end).isin(some)))


def test_an_index_exchanges_numbers(spark, folder):
    lines, before = corpus.lines(spark, folder).count(), shuffled(spark)
    graphs._adjacency(spark, f"{folder}/.", "target_symbol_id", "target_path")
    assert shuffled(spark) - before < 60 * lines  # an edge with its names takes over 300
