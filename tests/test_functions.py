"""Functions on names, paths, ignore rules and cursors."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import kinds
from tessera.functions import text as T
from tessera.limits import RequestError
from tessera.operators import paging
from tessera.operators.search import python_identifier_tokens, python_index_tokens, index_tokens, qualified_leaf
from tessera.sources.paths import denied, dialect, glob_regex, ignored, supported, valid_path


def values(spark, column, rows):
    return [r["v"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def test_identifier_tokens(spark):
    rng = random.Random(1)
    names = ["getHTTPServer2Foo_bar", "", "ABC", "aB", "x1Y", "ÖzetÜnite", "HTTPServer", "__a__", "snake_case", "İx"] + ["".join(rng.choice("aAbB1_Éé.") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    got = values(spark, T.identifier_tokens, names)
    assert got[0] == ["get", "http", "server2", "foo", "bar"]
    assert got == [python_identifier_tokens(n) for n in names] or [(n, g) for n, g in zip(names, got, strict=True) if g != python_identifier_tokens(n)] == [("İx", got[9])]
    assert values(spark, index_tokens, ["Özet_fooBar2", "É é", None]) == [["ozet", "foobar2"], ["e", "e"], []]
    assert python_index_tokens("Özet_fooBar2") == ["ozet", "foobar2"]


def test_folding_is_of_ascii_only(spark):
    assert values(spark, T.ascii_lower, ["ÖZET", "SRC/a"]) == ["Özet", "src/a"]
    assert values(spark, lambda c: T.under(c, "Src/a"), ["Src/a", "src/a", "SRC/A/b", "Src/ab", "x"]) == [True, False, True, False, False]


def test_paths(spark):
    assert values(spark, T.normalized_path, ["a/./b/../c", "../a", "a/..", "", "/a//b/", "a/../../b"]) == ["a/c", None, None, None, "a/b", None]
    assert values(spark, T.ancestors, ["a/b/c", "x"]) == [["a", "a/b"], []]
    assert values(spark, T.last_segment, ["a::b.c", "a.b/c", "a/b", "x"]) == ["b.c", "b/c", "b", "x"]
    assert values(spark, kinds.qualifier, ["a::b::c", "a.b", "x/y", "z"]) == ["a::b", "a", "x", None]
    paths = ["a/b.rs", "", "a//b", "./a", "a/../b", "a\\b", "C:/x", "a\0b", "x" * 256, "/".join("a" * 257), None]
    assert values(spark, valid_path, paths) == [True] + [False] * 10
    assert values(spark, denied, ["a/NODE_MODULES/x.js", ".env", ".env.x", ".environment", "k.PEM", "a.min.js", "id_rsa", "a/id_rsa.rs", "src/targets/a.rs"]) == [True, True, True, False, True, True, True, False, False]
    assert values(spark, supported, ["a.RS", "a.d.ts", "rs", ".rs", "a.py"]) == [True, True, False, False, False]
    assert values(spark, dialect, ["a.RS", "a.d.ts", "a.tsx", "a.mjs"]) == [None, "typescript", "tsx", "javascript"]
    assert qualified_leaf("a.b::c") == "c" and qualified_leaf("a::b.c") == "c" and qualified_leaf("x") is None and qualified_leaf(".foo") == "foo"


def test_ignore_rules(spark):
    lines = ["# c", "", "*.log", "!keep.log", "/top", "dir/", "a/**/z", "b/**", "**/deep", "q?x", "[!m]n", "sp\\ ", "\\!bang"]
    rules = [r for line in lines if (r := glob_regex(line))] + [glob_regex("*.tmp", "sub")]
    cases = {"x.log": 1, "d/keep.log": 0, "top": 1, "d/top": 0, "dir/f": 1, "dir": 0, "x/dir/f": 1, "a/z": 1, "a/b/c/z": 1, "b/x/y": 1, "b": 0, "p/deep/f": 1, "qax": 1, "q/x": 0, "kn": 1, "mn": 0, "!bang": 1, "sub/d/x.tmp": 1, "x.tmp": 0}
    got = ignored(spark.createDataFrame([(p,) for p in cases], "relative_path string"), rules).collect()
    assert {r["relative_path"]: int(r["ignored"]) for r in got} == cases


def test_bytes(spark):
    row = spark.createDataFrame([("aé\nb\r\nc",)], "x string").select(F.hex(T.byte_slice(F.col("x"), F.lit(1), F.lit(3))).alias("b"), *[T.line_of(F.col("x"), F.lit(i)).alias(f"l{i}") for i in (0, 3, 4, 7)]).first()
    assert tuple(row) == ("C3A9", 1, 1, 2, 3)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=6, max_size=8))
def test_cursors_round_trip(parts):
    cursor = paging.Cursor(*parts[:4], tuple(parts[4:]))
    assert paging.decode(paging.encode(cursor)) == cursor


def test_cursor_faults():
    good = paging.encode(paging.Cursor("op", "r", "g", "q", ("1",)))
    assert paging.checked(good, "op", "r", "g", "q").sort == ("1",)
    for args, code in ((("x", "r", "g", "q"), "INVALID_CURSOR"), (("op", "z", "g", "q"), "CROSS_REPOSITORY_ID"), (("op", "r", "z", "q"), "STALE_CURSOR"), (("op", "r", "g", "z"), "INVALID_CURSOR")):
        with pytest.raises(RequestError, match=code):
            paging.checked(good, *args)
    for bad in ("", "zz", "31", good + ".0", "é", "a" * 5000):
        with pytest.raises(RequestError, match="INVALID_CURSOR"):
            paging.decode(bad)
    assert paging.score_of(paging.score_text(-1.25e-7)) == -1.25e-7
    with pytest.raises(RequestError):
        paging.score_of(str(0x7FF0000000000000))


def test_byte_budget():
    value = {"items": ["é" * 50] * 40, "truncated": False}
    got = paging.fit(value, 1000, paging.drop_last("items"))
    assert paging.wire_bytes(got) <= 1000 and got["truncated"] and len(got["items"]) > 0
    with pytest.raises(RequestError, match="RESPONSE_TOO_LARGE"):
        paging.fit({"x": "a" * 2000, "items": []}, 1000, paging.drop_last("items"))
    done = paging.with_token_estimate({"a": "b" * 100})
    assert done["approximate_tokens"] == -(-len(paging.compact(done).encode()) // 4)


def test_ranges_of_short_and_null_texts(spark):
    """The texts that the query content_ranges leaves out."""
    texts = ["", "\n", "a", "é", "é\n\nb", "x\r\ny", "\n" * 39, "ab" * 19 + "\n"]
    rows = [(x, a, b) for x in texts for a in (0, 1, 7, 38) for b in (0, 1, 7, 31, 50) if a <= b] + [(None, 0, 5)]
    df = spark.createDataFrame(rows, "x string, a int, b int").select("x", "a", "b", T.byte_slice(F.col("x"), F.col("a"), F.col("b")).alias("cut"), T.line_of(F.col("x"), F.col("b")).alias("line"))
    for x, a, b, cut, line in df.collect():
        if x is None:
            assert cut is None and line is None
        else:
            assert bytes(cut) == x.encode()[a:b] and line == x.encode()[:b].count(b"\n") + 1, (x, a, b)


def test_ranges_around_a_place_equal_brute_force():
    from tessera.operators.nesting import Open

    rng = random.Random(5)

    def split(a, b, out):
        """Ranges that nest, side by side too."""
        out.append((a, b))
        at = a
        while b - at > 2 and rng.random() < 0.8:
            end = rng.randint(at + 1, b)
            split(at + rng.randint(0, 1) if end - at > 2 else at, end, out)
            at = end

    for turn in range(300):
        found = []
        split(0, 60, found)
        if turn % 3 == 0:
            found += [tuple(sorted((rng.randint(0, 60), rng.randint(0, 60)))) for _ in range(5)]
        ranges = [(a, b, (i,), None) for i, (a, b) in enumerate(found)]
        places = sorted((a, a + rng.randint(1, 3)) for a in rng.sample(range(58), 20))
        own = Open(list(ranges))
        assert own.nested
        for a, b in places:
            own.move(a)
            assert [r[2] for r in own.around(a, b)] == [r[2] for r in sorted((r for r in ranges if r[0] <= a and r[1] >= b), key=lambda r: (r[1] - r[0], r[2]))]
        if turn % 3:
            assert own.nested


def test_a_long_answer_is_written_out_a_few_times_and_keeps_what_fits(monkeypatch):
    looks, real = [], paging.wire_bytes

    def look(value):
        looks.append(1)
        return real(value)

    monkeypatch.setattr(paging, "wire_bytes", look)
    r = random.Random(5)
    for settle in (None, paging.with_token_estimate):
        for _ in range(20):
            items = [{"s": r.choice(['"', "\\", "é", "x", "\n"]) * r.randrange(40), "n": r.randrange(10**6)} for _ in range(r.choice([0, 3, 400]))]
            most, value = r.randrange(512, 30_000), {"items": items, "truncated": False}
            if settle:
                settle(value)
            want = {"items": list(items), "truncated": False}
            while True:
                if settle:
                    settle(want)
                if real(want) <= most:
                    break
                want = {"items": want["items"][:-1], "truncated": True}
            looks.clear()
            assert paging.fit(value, most, paging.drop_last("items"), settle) == want and len(looks) < 20
