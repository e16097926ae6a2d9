"""Steps that must hold at size: what is broadcast, how rows are dealt, what bounds a task."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from tessera.cluster import cut
from tessera.functions import text as T
from tessera.operators import extraction, notes, postings, resolution, search
from tessera.sources import corpus, modules, scan
from tessera.sources.store import Store


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_was_cut_is_joined_by_keys(spark):
    few = spark.range(4).select(F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("k"), F.col("id").alias("v"))  # guessed as 4 rows
    left, right = cut(few), cut(few.withColumnRenamed("v", "w"))
    joined = left.join(right.filter("w > 1").groupBy("k").agg(F.max("w").alias("w")), "k")
    assert "BroadcastHashJoin" not in plan(joined) and "SortMergeJoin" in plan(joined)
    assert joined.count() == 4000 and cut(left) is left


def test_imports_are_parsed_once(spark, folder):
    from tessera.plans.modules import _found

    assert "MapInArrow" not in plan(resolution.destinations(*_found(spark, folder)))


def test_trees_are_dealt_before_they_grow(spark, folder):
    rows = modules.sources(spark, folder)
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows.select("relative_path").distinct().count() == rows.count()


def test_lines_are_counted_in_one_pass(spark):
    rows = spark.range(40).select(F.repeat(F.lit("é\n"), 200_000).alias("x"), F.lit(599_999).alias("at"))
    begun = time.monotonic()
    assert {r[0] for r in rows.select(T.line_of(F.col("x"), F.col("at"))).collect()} == {200_000}
    assert time.monotonic() - begun < 10
    odd = spark.createDataFrame([("\n\né", 1), ("\n\né", 3), ("", 5), (None, 1), ("\n0A\n", -4)], "x string, at int")
    assert [r[0] for r in odd.select(T.line_of(F.col("x"), F.col("at"))).collect()] == [2, 3, 1, None, 1]


def test_bounds_of_very_many_notes(spark, monkeypatch):
    monkeypatch.setattr(notes, "NOTES", 2)
    have = spark.createDataFrame([(k, "x" * 20000 if k == "c" else "y") for k in "abcd"], "id string, body string")
    evidence = spark.createDataFrame([("d", f"p{i}", "h", None) for i in range(33)], "memory_id string, relative_path string, content_hash string, symbol_id string")
    assert {(r["id"], r["fault"]) for r in notes.bound_faults(have, evidence).collect()} == {("c", "body"), ("d", "evidence")}


def test_a_scan_of_very_many_files_is_complete(spark, monkeypatch):
    files = spark.createDataFrame([(f"d{i}/{n}.rs", 1) for i in range(3) for n in "ab"], "relative_path string, byte_length long")
    monkeypatch.setattr(scan, "FILES", 5)
    row = scan.scan_status(files).first()
    assert (row["found"], row["complete"]) == (6, True) and not scan.whole(row)
    monkeypatch.setattr(scan, "FILES", 6)
    assert scan.whole(row)


def test_notes_of_a_common_word_come_by_date(spark):
    have = spark.createDataFrame([(f"n{i}", "the" + " x" * i, i) for i in range(1, 9)], "id string, body string, updated_at long")  # shorter ones are better by less than a millionth
    status = spark.createDataFrame([], "memory_id string, evidence_status string")
    found = [(r["id"], r["score"]) for r in search.search_notes(have, status, "the", limit=8).collect()]
    assert [n for n, _ in found] == sorted((n for n, _ in found), key=lambda n: (dict(found)[n], -int(n[1:]))) and len({s for _, s in found}) < 4


def test_a_task_holds_observations_of_few_files(spark, monkeypatch):
    sources = spark.createDataFrame([(f"f{i}.go", "go", bytearray(b"package p\nfunc A() { B() }\n" * 40)) for i in range(300)], "relative_path string, language string, content binary")
    ran, own = [], type(sources).mapInArrow
    monkeypatch.setattr(type(sources), "mapInArrow", lambda df, run, schema: (ran.append(run), own(df, run, schema))[1])
    found = extraction.parsed(sources)
    batch = sources.selectExpr("relative_path", "language", "content", "CAST(0 AS LONG) AS byte_length", "'' AS content_hash").toArrow().combine_chunks().to_batches()
    parts = [(b.num_rows, len(b.column(5).flatten())) for b in ran[0](iter(batch))]
    assert sum(n for n, _ in parts) == 300 and len(parts) > 3 and max(r for _, r in parts) < 2 * extraction.HELD
    assert found.select("relative_path").distinct().count() == 300


def test_an_index_for_one_query_holds_the_ends_that_it_looks_up(spark, folder):
    from pathlib import Path

    from tessera.plans import graphs

    index = graphs._adjacency(spark, folder, "target_symbol_id")
    assert {p.name for p in Path(index.folder.removeprefix("file:")).iterdir()} == {"target_symbol_id", "numbers"}


def test_a_symbols_words_are_made_once_in_all_tasks(spark, folder):
    symbols = corpus.symbols(spark, folder).coalesce(1)
    docs = search.search_documents(symbols)
    assert docs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    found = plan(search.bm25(docs, ["spelling", "relative_path", "content"], ["cold", "anvil"], phrase=True))
    assert found.count("translate(") == 3


def test_terms_are_counted_in_the_task_of_their_key(spark, folder):
    docs = spark.createDataFrame([("a", "x y x"), ("a", "x z"), ("a", "y x x"), ("b", None), ("c", "x")], "id string, text string")
    got = search.postings(docs.coalesce(1), "id", "text")
    found = plan(got)
    assert found.count("Exchange") == 1 and found.index("Generate") < found.index("Exchange")
    assert sorted(map(tuple, got.collect())) == [("x", "a", 1, 2), ("x", "a", 4, 3), ("x", "c", 1, 1), ("y", "a", 2, 3), ("z", "a", 1, 2)]


def test_an_index_of_words_is_made_in_all_tasks_and_counts_every_word(spark, folder, tmp_path):
    symbols = corpus.symbols(spark, folder).limit(60).coalesce(1)
    assert postings.posted(symbols).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    for name, rows in (("some", symbols), ("none", symbols.limit(0))):
        postings.write(rows, f"file://{tmp_path}/{name}")
        words = [r for r in search.search_documents(rows).select(*(F.size(search.index_tokens(F.col(c))).alias(c) for c in postings.FIELDS)).collect()]
        numbers = spark.read.parquet(f"file://{tmp_path}/{name}/numbers").first()
        assert (numbers["rows"], numbers["length"]) == (len(words), sum(map(sum, words)))


def test_edges_are_told_apart_by_numbers_and_named_after_that(spark, folder):
    found = plan(corpus.edges(spark, folder))
    assert "lexically_resolved" not in found[found.index("Exchange hashpartitioning") :]


def test_a_store_writes_ids_in_half_their_bytes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    rows = spark.range(20000).select(F.sha2(F.col("id").cast("string"), 256).alias("edge_id")).coalesce(1)
    store.write("edges", rows, "g1")
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 20000 * 45
    assert store.read("edges", "g1").select("edge_id").exceptAll(rows).count() == 0
