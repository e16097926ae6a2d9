from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import neardup
from tessera.llm.components import components
from tessera.llm.neardup import keep_one, linked, near_duplicates


def brute(rows):
    def grams(text):
        words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])

    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(s), least.get(find(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    shared = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(30)]
    bases = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 90))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 9)}"
        if rng.random() < 0.3:
            words[rng.randrange(len(words)) : 0] = shared
        rows.append((i, " ".join(words)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "ONE two"), (n + 4, "one\ttwo"), (None, "one two"), (3, rows[3][1])]


@pytest.mark.parametrize(("frequent", "sets", "size"), [(256, 1024, 8 << 20), (3, 1024, 8 << 20), (2, 3, 8 << 20), (4, 1024, 2000)])
def test_equals_brute_force(spark, monkeypatch, frequent, sets, size):
    monkeypatch.setattr(neardup, "BLOCK_SETS", sets)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", size)
    monkeypatch.setattr(neardup.count_classes, "__defaults__", ("text", frequent))
    rows = corpus(frequent)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int").repartition(4)
    got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_full_maps_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "REPEATED_BITS", 7)
    monkeypatch.setattr(neardup, "FREQUENT_BITS", 7)
    rows = corpus(11, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in near_duplicates(df).collect()), key=str) == brute(rows)


def test_keep_one(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "a"), (2, text, "b"), (2, text, "c"), (3, "other words of another text here", "d"), (4, None, "e"), (4, "", "f"), (None, text, "g"), (1, text, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rows string")
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "None"]
    assert keep_one(df.limit(0)).count() == 0


def test_keep_one_tells_rows_of_one_key_apart(spark):
    text, other, third = "one two three four five six seven", "other words of another much longer text here", "third text that is quite unlike those two"
    rows = [(1, text, "a"), (2, text, "b"), (2, other, "c"), (3, third, "d"), (3, other + " x", "e"), (5, third, "f"), (5, "fifth text stands for itself alone", "g"), (5, None, "h")]
    rows += [(7, "seventh " + text, "i"), (7, "so does this one of the same key", "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rows string")
    assert sorted(r["rows"] for r in keep_one(df).collect()) == ["a", "c", "d", "g", "h", "i", "j"]
    assert sorted(r["rows"] for r in keep_one(df.filter("rows <> 'c'")).collect()) == ["a", "d", "e", "g", "h", "i", "j"]


def test_forest_spans_the_links():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 60, 100).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, 95, replace=False), rng.integers(0, 1 << 60, k).astype(np.uint64)])) for k in (0, 1, 2, 20, 60)]
    edges = linked(sets)
    near = [(i, j) for i in range(5) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]

    def classes(pairs):
        root = list(range(5))
        for a, b in pairs:
            root = [root[a] if r == root[b] else r for r in root]
        return [root.index(r) for r in root]

    assert classes(edges) == classes(near) and len(edges) <= 4


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(200, i) for i in range(201, 260)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {i: i for e in edges for i in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert all(got.get(n, n) == r for n, r in root.items())


def test_linked_sets_share_an_entry():
    """Random classes, sizes and overlaps at the least similarity: by the index alone no link is lost, and entries stay few."""
    rng = np.random.default_rng(8)
    for turn in range(4000):
        n = int(rng.integers(2, 400))
        base = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        gone, new = sorted(rng.integers(0, max(2, n // 4), 2))
        other = np.unique(np.concatenate([rng.choice(base, max(1, len(base) - int(gone)), replace=False), rng.integers(0, 1 << 64, int(new - gone), dtype=np.uint64)]))
        both = len(np.intersect1d(base, other))
        if 180 * both < 80 * (len(base) + len(other)):
            continue
        whole = np.union1d(base, other)
        shared, odd = np.isin(whole, np.intersect1d(base, other)), rng.random(len(whole))
        repeated, frequent = np.zeros(1 << 17, np.uint8), np.zeros(1 << 14, np.uint8)
        at = whole[shared | (odd < 0.5)] >> np.uint64(44)
        np.bitwise_or.at(repeated, at >> np.uint64(3), np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8))
        at = whole[rng.random(len(whole)) < rng.choice([0, 0.3, 0.9, 1])] >> np.uint64(47)
        np.bitwise_or.at(frequent, at >> np.uint64(3), np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8))
        classes = neardup.Classes(repeated.tobytes(), frequent.tobytes())
        a, b = classes.index_keys(base), classes.index_keys(other)
        assert len(np.intersect1d(a, b)), turn
        assert max(len(a), len(b)) <= max(len(base), len(other)) + 8


def test_entries_of_a_long_text_stay_few():
    rng = np.random.default_rng(3)
    classes = neardup.Classes(bytes([255]) * (1 << 10), bytes([255]) * (1 << 10))
    for n in (1_000, 30_000, 1_000_000):
        assert len(classes.index_keys(np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)))) <= n // 2 + 8


def test_copies_are_counted_once(spark):
    """A long text copied into more tasks than FREQUENT: its shingles are in one set and need no entry."""
    text = " ".join(f"w{i % 7919}x{i % 104729}" for i in range(100_000))
    df = spark.range(60).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    for parts in (10, 60):
        docs = df.repartition(parts)
        info = neardup._info(docs, "doc_id", "text")
        least = spark.sparkContext.broadcast(neardup.repeated_sets(info))
        classes = spark.sparkContext.broadcast(neardup.count_classes(docs, "doc_id", 60, least))
        assert neardup._index(docs, "doc_id", "text", classes, least).count() == 0
    got = near_duplicates(df.repartition(60)).groupBy("component_id", "n_shingles").count().collect()
    assert [(r["component_id"], r["count"]) for r in got] == [(0, 60)]


def test_large_cluster_is_verified_through_its_leader(spark, monkeypatch):
    """20,000 near copies of one text, and a chain of texts that link to the next one only."""
    monkeypatch.setattr(neardup, "BLOCK_SETS", 64)
    base = [f"w{i}" for i in range(150)]
    one = [(i, " ".join([*base[: i % 140], f"x{i}", *base[i % 140 + 1 :]])) for i in range(20_000)]
    chain = [(100_000 + i, " ".join(f"c{j}" for j in range(4 * i, 4 * i + 120))) for i in range(300)]
    got = near_duplicates(spark.createDataFrame(one + chain, "doc_id long, text string").repartition(8)).groupBy("component_id").count().collect()
    assert sorted((r["component_id"], r["count"]) for r in got) == [(0, 20_000), (100_000, 300)]


def test_keep_one_with_clashing_names(spark):
    text = "one two three four five six seven"
    rows = [(1, text, 1, 2, 3, 4), (2, text, 1, 2, 3, 4), (1, text, 5, 2, 3, 4), (None, None, 1, None, 3, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __first int, __rows int, __set int, __key int")
    kept = keep_one(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "None"]
