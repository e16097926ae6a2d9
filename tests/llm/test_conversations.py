from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
import sys
import zlib

import numpy as np
import pytest

from tessera.llm import conversations as op

ORDER = re.compile(r"(s?(ua)+)?")
sys.setrecursionlimit(20_000)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def judged(rows):
    """The faults of one conversation's rows in order."""
    seen, out = set(), []
    for _, _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[0] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def exhaustive(roles, faults, most=2):
    """The least (cost, audit) of all edits with up to two inserts in a row."""
    inserts = [x for n in range(most + 1) for x in itertools.product("ua", repeat=n)]
    best = None
    for gaps in itertools.product(inserts, repeat=len(roles) + 1):
        for edits in itertools.product("DKua", repeat=len(roles)):
            audit, made, cost = "I" * len(gaps[0]), list(gaps[0]), 2 * len(gaps[0])
            for role, fault, edit, gap in zip(roles, faults, edits, gaps[1:], strict=True):
                if edit == "D":
                    audit, cost = audit + "D", cost + 3
                elif fault in ("blank", "duplicate"):
                    break
                else:
                    audit += "K" if edit == "K" else "R"
                    cost += (0 if edit == "K" else 2) + (fault == "truncated")
                    made.append(role[:1] if edit == "K" else edit)
                audit, made, cost = audit + "I" * len(gap), made + list(gap), cost + 2 * len(gap)
            else:
                if ORDER.fullmatch("".join(x or "?" for x in made)) and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def searched(rows, faults):
    """(cost, audit, repaired lines), least by cost and audit, by recursion over the rest of the rows and the last role."""

    @functools.cache
    def rest(i, last, inserted):
        options = [(0, "", ())] if i == len(rows) and last in "-a" else []
        wanted = {"-": "su", "s": "u", "u": "a", "a": "u"}[last]

        def add(cost, letter, line, following):
            options.append((cost + following[0], letter + following[1], (*((line,) if line is not None else ()), *following[2])))

        if inserted < 3:
            for w in set(wanted) - {"s"}:
                add(2, "I", {"u": "user:", "a": "assistant:"}[w], rest(i, w, inserted + 1))
        if i < len(rows):
            _, _, role, text = rows[i]
            add(3, "D", None, rest(i + 1, last, 0))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                if role and role[0] in wanted:
                    add(extra, "K", f"{role}:{text}", rest(i + 1, role[0], 0))
                for w in set(wanted) - {"s"}:
                    add(2 + extra, "R", {"u": "user:", "a": "assistant:"}[w] + text, rest(i + 1, w, 0))
        return min(options, key=lambda o: o[:2], default=(10**9, "", ()))

    return rest(0, "-", 0)


def expected(rows):
    out, after = {}, damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        faults, turns = judged(own), {r[1] for r in own} - {None}
        cost, audit, lines = searched(own, faults)
        illegal = sum((a[2][:1], b[2][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


CODES = {"": op.FINE, "blank": op.BLANK, "duplicate": op.DUPLICATE, "truncated": op.TRUNCATED}


def solve(conversations):
    starts = np.concatenate([[0], np.cumsum([len(r) for r, _ in conversations])]).astype(np.int64)
    initials = np.array(["sua".find(x[:1]) if x[:1] and x[0] in "sua" else 3 for r, _ in conversations for x in r], np.int64)
    faults = np.array([CODES[f] for _, fs in conversations for f in fs], np.int64)
    cost, audit = op.cheapest(initials, faults, starts)
    return list(zip(cost.tolist(), [a.decode() for a in audit], strict=True))


def test_search_and_tensor_equal_all_edits():
    rng = random.Random(4)
    cases = [([], [])] + [([a, b], [f, g]) for a in ("s", "u", "a", "t") for b in ("s", "u", "a", "") for f, g in (("", ""), ("truncated", "blank"), ("", "truncated"))]
    cases += [([rng.choice(["system", "u", "assistant", "x"]) for _ in range(3)], [rng.choice(list(CODES)) for _ in range(3)]) for _ in range(3)]
    want = [exhaustive(*c) for c in cases]
    assert solve(cases) == want
    assert [searched([(1, 1, r, "x") for r in roles], faults)[:2] for roles, faults in cases] == want


@pytest.mark.parametrize("turns", [op.TENSOR_TURNS, 7])
def test_many_lengths_at_once(monkeypatch, turns):
    monkeypatch.setattr(op, "TENSOR_TURNS", turns)
    rng = random.Random(5)
    cases = []
    for _ in range(400):
        n = rng.choice([0, 1, 2, 3, 5, 8, 13, 40])
        cases.append(([rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]) for _ in range(n)], [rng.choice(["", "", "", "blank", "duplicate", "truncated"]) for _ in range(n)]))
    assert solve(cases) == [searched([(1, 1, r, "x") for r in roles], faults)[:2] for roles, faults in cases]


def messy(seed, n=900):
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "\x0b\x0c", "Yes.", "no", "What? ", "é!", " ", "a.b", "x.\x0b", "..."]
    return [(rng.choice([None, *range(60)]), rng.choice([None, *range(-2, 12), 40]), rng.choice([None, "user", "assistant", "system", "User", "", "sys"]), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_recursion(spark, seed):
    rows = messy(seed)
    # one conversation holds a third of all rows
    rows += [(7, i, ["user", "assistant", "assistant"][i % 3], f"text {i % 90}.") for i in range(450)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, gone string, part int").repartition(6)
    got = op.repair(op.damaged(df), gone="gone").collect()
    assert {r["conv"]: tuple(r)[1:] for r in got} == expected(rows) and len(got) == len({r[0] for r in rows})
    assert op.repair(op.damaged(df.limit(0)), gone="gone").count() == 0


def test_given_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op.op12_conversation_repair(spark, folder).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == expected(rows)


def test_all_rows_dropped_and_long_text(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    kept = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 > 4 and zlib.crc32(f"{i}:1".encode()) % 20 > 4)
    rows = [(gone, 0, "user", "a."), (kept, 0, "user", "word " * 400_000 + "."), (kept, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv"]: tuple(r)[1:] for r in op.repair(op.damaged(df), gone="gone").collect()}
    assert got == expected(rows) and got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_undamaged_rows_of_other_names(spark):
    df = spark.createDataFrame([("c", 1, "user", "Hi."), ("c", 2, "bot", "Hello.")], "talk string, n int, who string, said string")
    assert [tuple(r)[5:8] for r in op.repair(df, "talk", "n", "who", "said").collect()] == [(1, 2, "KR")]
