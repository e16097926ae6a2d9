from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import packing as op
from tessera.llm.tokens import load

NAME = "word_bpe_49k.json"
TOKENIZER = load(NAME)
PARTS = ["ab ", "Don't ", "we're", "  \n\n ", "x" * 300, "é" * 20, "é", "<|endoftext|>", "<|startoftext|> ", "12345", " \t", "!!!", "日本語", "\x0b", "\x1c", "\x85", " ", "ΣΑΣ", "İ", "'s", "a.b", ",'LL", "<|end", "oftext|>", "̈", "\r", "\x00", "ǅ", "각"]


def whole(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def random_text(rng):
    return "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60)))


@pytest.mark.parametrize("runs", [5, op.RUNS])
def test_ids_equal_the_library(monkeypatch, runs):
    monkeypatch.setattr(op, "RUNS", runs)
    monkeypatch.setattr(op, "SLICE", 50)
    encoder, rng = op.Encoder(NAME, 2), random.Random(runs)
    for _ in range(60):
        texts = [random_text(rng) for _ in range(rng.randint(1, 6))]
        ids, begins = encoder.texts(pa.array(texts, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == [whole(t) for t in texts]
        assert all(encoder.long(t).tolist() == whole(t) for t in texts)


@pytest.mark.parametrize("wide", [2, 4])
def test_widened_ids(wide):
    rows = [[1, 65535], [], [7], [2, 3, 4]]
    column = pa.array([np.array(r, f"<u{wide}").tobytes() for r in rows], pa.binary())
    for part in (column, column.slice(1), column.slice(2, 1), column.slice(4)):
        assert [np.frombuffer(x, "<u4").tolist() for x in op.widened(part, wide).to_pylist()] == [np.frombuffer(x, f"<u{wide}").tolist() for x in part.to_pylist()]


def one_by_one(histogram, size):
    """Shortest pack first, a row at a time, with as few packs as the tokens need; fills of the packs and the cuts that were made."""
    most = -(-sum(n * c for n, c in histogram.items()) // size)
    waiting, fills, cuts = Counter(histogram), [], 0
    while +waiting:
        n = max(+waiting)
        waiting[n] -= 1
        least = min(fills, default=size)
        if least + n <= size:
            fills[fills.index(least)] += n
        elif len(fills) < most:
            fills.append(n)
        else:
            fills[fills.index(least)] = size
            waiting[n - (size - least)] += 1
            cuts += 1
    return sorted(fills), cuts


def checked(histogram, size):
    plan = op.Plan(histogram, size)
    rows = [(n, r) for n, c in histogram.items() for r in range(c)]
    length, rank = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    row, start, piece, pack, offset = plan.pieces(length, rank)
    packs, documents = defaultdict(list), defaultdict(list)
    for r, s, p, k, o in zip(row.tolist(), start.tolist(), piece.tolist(), pack.tolist(), offset.tolist(), strict=True):
        packs[k].append((o, p))
        documents[r].append((s, p))
    for found, ends in ((packs, None), (documents, length)):
        for k, parts in found.items():
            at = 0
            for a, n in sorted(parts):
                assert a == at and n > 0
                at += n
            assert at <= size and (ends is None or at == ends[k])
    assert len(documents) == len(rows) and sorted(packs) == list(range(plan.packs))
    return sorted(sum(n for _, n in p) for p in packs.values()), len(row) - len(rows)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_shortest_pack_first(seed):
    rng, size = random.Random(seed), [16, 64, 100][seed % 3]
    histogram = {n: rng.choice([1, 2, 7, 40]) for n in rng.sample(range(1, size), rng.randint(1, size - 1))}
    fills, _ = checked(histogram, size)
    assert sum(size - f for f in fills) < size
    # packs have no names: the fills are those of placing a row at a time
    assert fills == one_by_one(histogram, size)[0]


def test_plan_of_many_documents():
    plan = op.Plan({n: 10**9 + n for n in range(1, 4096)})
    assert len(plan.rows) < 90 * 4096 and plan.opened == plan.packs
    assert op.Plan({1: 10**11}).packs == -(-(10**11) // 4096) and op.Plan({}).packs == 0
    fills, cuts = checked({3000: 50, 1: 3}, 4096)
    assert len(fills) == 37 and sum(fills) == 150_003 and cuts


def brute(docs, got, size):
    """Every id in one piece, sequences without gaps, CRCs of the library's ids."""
    ids = {k: whole(t) for k, t in docs.items()}
    spans, filled = defaultdict(list), defaultdict(list)
    for r in got:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        spans[r["doc_id"]].append((r["start"], r["length"]))
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts, end in [*((spans[k], len(ids[k])) for k in ids), *((p, None) for p in filled.values())]:
        at = 0
        for a, n in sorted(parts):
            assert a == at and n > 0
            at += n
        assert at == end if end is not None else at <= size
    return sum(size - sum(n for _, n in p) for p in filled.values())


def test_given_documents(spark, folder):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    assert brute(docs, op.op11_shortest_pack_first(spark, folder).collect(), 4096) < 4096


def test_rows_of_all_kinds(spark):
    rng = random.Random(9)
    docs = dict(enumerate([None, "", " ", "word " * 50_000, "x" * 30_000, *(random_text(rng) for _ in range(80)), *[None] * 40, *["a b c"] * 40]))
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in docs.items()], "doc_id long, text string, part int, ids int").repartition(7)
    packed = op.pack(df, size=64)
    got = packed.selectExpr("doc_id", "start", "length", "crc32(ids) AS ids_crc32", "doc_tokens", "sequence_id", "offset").collect()
    assert brute(docs, got, 64) < 64
    made = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in op.sequences(packed).collect()}
    ids = {k: whole(t) for k, t in docs.items()}
    for r in got:
        assert made[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
    assert op.pack(df.limit(0)).count() == 0
    repeated = op.pack(spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in repeated) == [(0, 3), (1, 3), (1, 3)] and len({(r["sequence_id"], r["offset"]) for r in repeated}) == 3
