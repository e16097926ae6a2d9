from __future__ import annotations

from collections import Counter

import corpus_pipeline
from tessera.llm.decontamination import evidence, find
from tessera.llm.mixing import mix
from tessera.llm.neardup import near_duplicates
from tessera.llm.quality import fit, score


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    good = stages["quality"](spark, docs, folder).cache()
    scores = score(docs, fit(docs, spark.read.parquet(f"{folder}/labels.parquet")), column="s").collect()
    assert good.columns == names and {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in scores if r["s"] >= 0.5}
    one = stages["near_duplicates"](spark, good, folder).cache()
    assert one.columns == names and sorted(r["doc_id"] for r in one.collect()) == sorted({r["component_id"] for r in near_duplicates(good).collect()})
    clean = stages["decontamination"](spark, one, folder).cache()
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert clean.columns == names and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in evidence(find(one, bench)).collect() if not r["contaminated"]}
    mixed = stages["mixing"](spark, clean, folder).cache()
    copies = {r["doc_id"]: r["mix_copies"] for r in mix(clean).collect()}
    assert mixed.columns == names and Counter(r["doc_id"] for r in mixed.collect()) == copies
    shards = stages["sharding"](spark, mixed, folder).collect()
    assert Counter(r["doc_id"] for r in shards) == copies and len({(r["shard"], r["slot"]) for r in shards}) == len(shards)
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, shards))


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0


def test_nulls_and_repeated_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, None, None, "s", 0), (-1, None, None, "s", 0), (-2, "", "en", "s", 0), (None, "a text of null key and more words", "en", "s", 3)], docs.schema)
    now = docs.union(odd).union(docs.limit(20))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder).cache()
        assert now.columns == docs.columns, name
    shards = corpus_pipeline.STAGES[-1][1](spark, now, folder)
    assert shards.count() == now.count() > 0
