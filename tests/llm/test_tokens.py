from __future__ import annotations

import random

import pytest

from tessera.llm.tokens import count_long, load, token_counts

TOKENIZER = load("byte_bpe_50k.json")


def whole(text):
    return len(TOKENIZER.encode(text, add_special_tokens=False))


@pytest.mark.parametrize("chunk", [40, 97, 256, 1000])
def test_spliced_counts_equal_whole(chunk):
    rng = random.Random(chunk)
    parts = ["ab ", "don't ", "we're", "  \n\n ", "x" * 300, "é" * 50, "<|endoftext|>", "12345", " \t", "!!!", "日本語", " ", "\n"]
    for _ in range(60):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 120)))
        assert count_long(TOKENIZER, text, chunk, 8) == whole(text)


def test_no_boundary_at_all():
    text = "a" * 5000
    assert count_long(TOKENIZER, text, 64, 8) == whole(text)


def test_rows(spark, folder):
    rows = [(1, "The cat", "a"), (2, "", "b"), (3, None, None), (None, "x y", "c"), (1, "The cat", "a"), (4, "word " * 30000, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((tuple(r) for r in token_counts(df, chunk=500).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), whole(t or ""), whole(t or "") > 1024) for i, t, _ in rows), key=str)
    assert got == want
    assert token_counts(df.limit(0)).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["n_tokens"] == whole(texts[r["doc_id"]]) for r in token_counts(docs).collect())
