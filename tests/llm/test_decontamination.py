from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm.decontamination import Index, decontaminate, evidence, find, merged, winnow
from tessera.llm.texthash import alnum_words, word_slices


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items):
    out = []
    for k, text in docs:
        own, hit, ids = words(text), set(), set()
        for i, t in items:
            item = words(t)
            n = min(13, len(item))
            windows = {tuple(item[j : j + n]) for j in range(len(item) - n + 1)} if n else set()
            for p in range(len(own) - n + 1) if n else ():
                if tuple(own[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    ids.add(str(i))
        out.append((k, len(own), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(own)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 12, 13, 14, 40])))) for i in range(25)] + [(90, None), (91, ""), (92, "!!"), (3, "É ñ É")]
    docs = []
    for k in range(60):
        text = [rng.choice(["A-", "b "]) + rng.choice(vocabulary + [f"z{rng.randint(0, 99)}"] * 30) for _ in range(rng.randint(0, 60))]
        if k % 2:
            item = words(rng.choice(items)[1])
            text[len(text) // 2 : 0] = item[rng.randint(0, 3) :]
        docs.append((k, ", ".join(text)))
    return [*docs, (100, None), (101, ""), (None, "É! ñ? É."), (5, docs[5][1])], items


@pytest.mark.parametrize(("seed", "block"), [(1, 8 << 20), (2, 8 << 20), (2, 0), (3, 400)])
def test_equals_brute_force(spark, seed, block):
    docs, items = corpus(seed)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n_words string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = evidence(find(df.select("doc_id", "text"), bench, block_bytes=block)).drop("text")
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs, items)
    clean = decontaminate(df, bench, block_bytes=block)
    assert clean.columns == df.columns
    assert clean.count() == sum(not r[-1] for r in brute(docs, items))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    row = evidence(find(docs, none)).first()
    assert (row["n_words"], row["n_hit"], row["contaminated"]) == (2, 0, False)
    assert evidence(find(docs.limit(0), none)).count() == 0
    one = spark.createDataFrame([(1, "so few")], "item_id long, text string")
    for texts in (docs, docs.limit(0)):
        rows = evidence(find(texts, one, block_bytes=0)).collect()
        assert [(r["n_words"], r["n_hit"]) for r in rows] == [(2, 0)] * texts.count()


def test_winnowing_keeps_one_in_every_window():
    rng = np.random.default_rng(3)
    grams = rng.integers(0, 6, 500).astype(np.uint64)
    kept = set(winnow(grams, 8).tolist())
    for i in range(493):
        least = grams[i : i + 8].min()
        assert max(j for j in range(i, i + 8) if grams[j] == least) in kept


def test_repeated_words_and_long_texts_end():
    def run(items, docs):
        index, began, out = Index([str(i) for i in range(len(items))], items), time.time(), {}
        for row, counts, hashes in word_slices(pa.array(docs, pa.string()), alnum_words()):
            out |= {row + d: (merged(spans), items) for d, (spans, items) in index.hits(counts, hashes).items()}
        assert time.time() - began < 5
        return out

    assert run(["ab " * 30_000], ["ab " * 300_000, "ab " * 12, "x " + "ab " * 13]) == {0: ([0, 300_000], {0}), 2: ([1, 14], {0})}
    item = " ".join(f"w{i}" for i in range(20))
    text = " ".join(f"x{i % 997}y{i % 1009}" for i in range(1_500_000)) + " " + item
    assert run([item, "ab cd"], [text, "ab cd " * 100_000]) == {0: ([1_500_000, 1_500_020], {0}), 1: ([0, 200_000], {1})}


def test_joins_of_long_and_repeated_texts(spark):
    shared = [" ".join(f"s{i}x{j}" for j in range(15)) for i in range(3)]
    items = [(i, f"{shared[i % 3]} only{i} " + " ".join(f"i{i}y{j}" for j in range(30))) for i in range(40)] + [(99, "ab " * 20_000)]
    long = " ".join(f"d{j % 997}e{j % 1009}" for j in range(60_000))
    docs = [(0, f"{long} {shared[0]} {long}"), (1, "ab " * 50_000), *((k, f"k{k} {shared[1]}") for k in range(2, 400))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"]
    one, two = (sorted(map(tuple, evidence(find(df, bench, block_bytes=b)).select(columns).collect())) for b in (8 << 20, 0))
    assert one == two
    assert [r[1:4] for r in two[:3]] == [(120_015, 15, 14), (50_000, 50_000, 1), (16, 15, 13)]


def test_a_large_benchmark_stays_off_the_driver(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("the driver built an index")

    monkeypatch.setattr("tessera.llm.decontamination.Index", refuse)
    docs, items = corpus(4)
    found = find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=0)
    assert found.count() == len(docs)


def test_own_columns_come_back(spark):
    docs = spark.createDataFrame([(1, "a c", [7], 5), (2, "a b", [8], 6)], "doc_id long, text string, __bench_spans array<long>, __bench_id long")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for block in (8 << 20, 0):
        assert [tuple(r) for r in decontaminate(docs, bench, block_bytes=block).collect()] == [(1, "a c", [7], 5)]


@pytest.mark.parametrize("block", [8 << 20, 0])
def test_clashing_names(spark, block):
    docs = spark.createDataFrame([(1, "a b", "own", [1]), (None, None, None, None)], "doc_id long, text string, n_words string, __bench_spans array<long>")
    bench = spark.createDataFrame([(None, "a b", 1)], "item_id long, text string, n_items int")
    rows = sorted(evidence(find(docs, bench, block_bytes=block)).collect(), key=lambda r: -r["n_words"])
    assert [(r["n_words"], r["n_hit"], r["n_items"]) for r in rows] == [(2, 2, 1), (0, 0, 0)]
    assert [r["doc_id"] for r in decontaminate(docs, bench, block_bytes=block).collect()] == [None]
