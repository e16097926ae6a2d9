from __future__ import annotations

import zlib

import numpy as np

from tessera.llm.quality import Model, fit, keep_good, op3_quality_votes, score, term_counts

import pyarrow as pa


def test_held_out_accuracy(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    got = op3_quality_votes(spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert (held.predicted == held.quality).mean() > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.itertuples())
    assert ((got.score >= 0) & (got.score <= 1)).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_votes_equal_brute_force():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcde "), 80)) for _ in range(40)] + ["".join(rng.choice(list("VWXYZ!"), 80)) for _ in range(40)]
    raw = np.array(list(term_counts(pa.array(texts))), np.float32)
    model = Model(raw, [1] * 40 + [0] * 40, dimensions=8, neighbours=5)
    for row, got in zip(raw[::9], model.scores(raw[::9]), strict=True):
        vector = model.weigh(row[None]) @ model.basis
        vector = vector[0] / np.linalg.norm(vector)
        cosines = model.vectors @ vector
        top = np.argsort(-cosines)[:5]
        weights = np.maximum(cosines[top], 0).astype(float) ** 8 * model.weights[top]
        assert abs(got - (weights * model.labels[top]).sum() / weights.sum()) < 1e-4


def test_whole_texts_count():
    long = "good words here " * 200_000
    a, b = list(term_counts(pa.array([long, long + "@#$" * 10])))
    assert (b >= 0).all() and (a[: 1 << 13].sum() == len(long) - 2) and not np.array_equal(a, b)


def test_nulls_no_labels_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", None), (None, "some text", 1.0), (2, "", None)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (77, 1)], "doc_id long, quality int")
    model = fit(docs, labels)
    got = score(docs, model).collect()
    assert len(got) == 4 and all(r["score"] == model.prior for r in got)
    assert keep_good(docs, labels).columns == docs.columns
    assert score(docs.limit(0), model).count() == 0


def test_keep_good_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "some text", "x"), (1, "some text", "x"), (None, None, None)], "doc_id long, text string, __quality string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert keep_good(docs, labels).columns == docs.columns and keep_good(docs, labels).count() == 3
    assert keep_good(docs.limit(0), labels).count() == 0
