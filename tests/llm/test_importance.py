from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import importance as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]]


def brute(docs, target, percent=25):
    """The contract, row by row; ties as draw() breaks them."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    ss, tt = sum(s.values()), sum(t.values())
    out = []
    for key, text in docs:
        n, f = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + 10000) / ((s[b] + 1) * (tt + 10000)))) for b in f]
        weight = math.floor(sum(gain) / len(f)) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((key, n, len(f), weight, score))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    drawn = able[: percent * len(able) // 100]
    ranks = [(*r, i + 1) for i, r in enumerate(drawn)]
    rest = Counter(out) - Counter(drawn)
    return sorted([*ranks, *((*r, None) for r in rest.elements())], key=str)


def rows(seed, n=300):
    rng = random.Random(seed)
    some = ["Der", "die", "ÉTÉ", "été", "ISO9", "don't", "x", "ſ", "İ", "日本", "a-b", "\x00", "..", "K"]
    texts = [" ".join(rng.choice(some) for _ in range(rng.choice([0, 1, 2, 19, 20, 21, 60]))) for _ in range(40)]
    return [(rng.choice([None, *range(30)]), rng.choice([None, "", *texts])) for _ in range(n)], [rng.choice(texts) for _ in range(5)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_on_ties_and_repeats(spark, seed, monkeypatch):
    monkeypatch.setattr(op, "CHUNK", 3)  # large groups of equal rows come in parts
    docs, target = rows(seed)
    docs += [(5, "w " * 25)] * 40
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, score string, rank int").repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = op.draw(op.importance(df, bench))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, target)
    half = op.draw(op.importance(df, bench), percent=50)
    assert sorted((tuple(r) for r in half.collect()), key=str) == brute(docs, target, 50)


def test_empty_and_very_long(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([("a b c",)], "text string")
    assert op.draw(op.importance(empty, bench)).count() == 0
    long = [(1, "Word " * 400_000), (2, None), (3, "z" * 1_000_000), (4, "a b " * 30), (5, "b a " * 30), (6, "c " * 20), (7, "")]
    df = spark.createDataFrame(long, "doc_id long, text string")
    for target in (bench, bench.limit(0)):
        got = op.draw(op.importance(df, target), percent=100).collect()
        assert sorted(map(tuple, got), key=str) == brute(long, [r["text"] for r in target.collect()], 100)


def test_resample_keeps_columns(spark):
    docs, target = rows(3, 120)
    df = spark.createDataFrame([(i, t, f"r{i}") for i, (_, t) in enumerate(docs)], "doc_id long, text string, drawn string")
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    want = {r[0] for r in brute([(i, t) for i, (_, t) in enumerate(docs)], target) if r[5]}
    got = op.resample(df, bench).collect()
    assert want and {r["doc_id"] for r in got} == want and len(got) == len(want) and all(r["drawn"] == f"r{r['doc_id']}" for r in got)


def test_plan_has_no_python_and_one_literal(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = op.importance(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "split(" not in plan and "Exchange" not in plan
