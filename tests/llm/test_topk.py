from __future__ import annotations

import random

from tessera.llm.topk import BINS, Block, top_k

SCHEMA = "vec_id long, embedding array<double>, rank string"


def brute(rows, k):
    vectors = [(i, [int(256 * x // 1) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and x == x and abs(x) != float("inf") for x in v)]
    out = []
    for q, a in vectors:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in vectors if i != q and len(b) == len(a))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def search(spark, rows, k=3, block=4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in top_k(df.filter("vec_id % 50 = 0"), df, k, block=block).collect())


def test_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)], "x") for i in range(0, 700)]
    assert search(spark, rows) == brute(rows, 3)


def test_ties_go_to_the_least_id(spark):
    rows = [(i, [1.0, 0.5] if i % 3 else [0.0, 1.0], "x") for i in range(300)]
    assert search(spark, rows, 5) == brute(rows, 5)


def test_nulls_other_lengths_few_rows_and_repeats(spark):
    rows = [(0, [1.0, 2.0], None), (1, None, None), (2, [None, 1.0], None), (3, [float("nan"), 1.0], None), (4, [float("inf"), 1.0], None), (None, [9.0, 9.0], None), (5, [1.0], None), (6, [0.5, -2.0], None), (50, [1.0], None), (100, [], None)]
    assert search(spark, rows) == brute(rows, 3)
    repeated = [(0, [1.0], None), (0, [1.0], None), (1, [2.0], None), (1, [2.0], None)]
    assert search(spark, repeated, 5) == sorted([(0, 1, 1, 131072), (0, 2, 1, 131072)] * 2)


def test_large_numbers_stay_whole(spark):
    rows = [(0, [1e7, 1.0], None), (1, [1e7, 1.0], None), (2, [1e7, 1.0078125], None), (3, [-1e7, 5.0], None)]
    assert search(spark, rows) == brute(rows, 3)


def test_empty(spark):
    assert search(spark, [], 3) == []


def test_interval_narrows_to_one_score():
    block = Block([0], [[1]], 5, BINS * 10)
    rounds = 0
    block.done = False
    while not block.done:
        block.narrow([{"q": 0, "bin": 0, "above": 0}])
        rounds += 1
    assert rounds == 2
