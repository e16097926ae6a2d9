"""Candidates of common names and searches through re-exports, against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import kinds as K
from tessera.operators import resolution

KEY = ("m_language", "module", "m_place", "name")
USE = "m_language string, module string, m_place string, name string, source_path string, use long, need int"
DECLARED = "m_language string, module string, m_place string, name string, d_relative_path string, d_observation_id string, d_start_byte long, d_kind string, d_attributes array<string>, d_top boolean"


def meets(need, kind, attributes, top):
    is_type = "role:type" in attributes or kind in K.TYPE
    is_value = "role:value" in attributes or kind not in K.NO_VALUE
    level = kind in K.MEMBER if need & 8 else top
    return (not need & 1 or is_type) and (not need & 2 or is_value) and (not need & 4 or kind in K.CALLABLE) and level


@pytest.mark.parametrize("most", [2, 32])
def test_candidates_elsewhere_equal_a_loop(spark, monkeypatch, most):
    monkeypatch.setattr(resolution, "CANDIDATES", most)
    r = random.Random(most)
    files = [f"f{i}" for i in range(6)]
    declared = [("go", r.choice("mn"), "", r.choice("xyz"), r.choice(files), f"d{i:03}", r.randrange(50), r.choice(["function", "class", "method", "interface"]), r.choice([[], ["role:type"], ["role:value"]]), r.random() < 0.7) for i in range(300)]
    uses = [("go", r.choice("mno"), "", r.choice("xyzw"), r.choice([*files, "other"]), i, r.randrange(16)) for i in range(200)]
    got = resolution.elsewhere(spark.createDataFrame(uses, USE), spark.createDataFrame(declared, DECLARED), KEY).collect()
    want = {}
    for language, module, place, name, path, use, need in uses:
        found = sorted((d[4], d[6], d[5]) for d in declared if d[:4] == (language, module, place, name) and d[4] != path and meets(need, *d[7:]))
        if found:
            want[use] = (len(found), found[:most])
    assert {u["use"]: (u["total"], [tuple(d) for d in u["first"]]) for u in got} == want and len(got) == len(want)


def test_a_common_name_is_joined_once_a_use(spark):
    """20,000 uses of a name with 5,000 declarations: 10^8 pairs if they met."""
    uses = spark.range(20_000).select(F.lit("java").alias("m_language"), F.lit("p").alias("module"), F.lit("").alias("m_place"), F.lit("get").alias("name"), F.concat(F.lit("u"), F.col("id") % 100).alias("source_path"), F.col("id").alias("use"), F.lit(12).alias("need"))
    declared = spark.range(5_000).select(F.lit("java").alias("m_language"), F.lit("p").alias("module"), F.lit("").alias("m_place"), F.lit("get").alias("name"), F.concat(F.lit("u"), F.col("id") % 50).alias("d_relative_path"), F.col("id").cast("string").alias("d_observation_id"), F.col("id").alias("d_start_byte"), F.lit("method").alias("d_kind"), F.array().cast("array<string>").alias("d_attributes"), F.lit(False).alias("d_top"))
    got = resolution.elsewhere(uses, declared, KEY)
    rows = got.groupBy((F.substring("source_path", 2, 9).cast("int") < 50).alias("own"), "total", F.size("first").alias("n")).count().collect()
    assert sorted(tuple(x) for x in rows) == [(False, 5_000, 32, 10_000), (True, 4_900, 32, 10_000)]


STEPS = "x_path string, x_start long, x_id string, x_alias string, x_attributes array<string>, x_language string, target string"


def queue(root, steps, depth, nodes, most):
    """One search with a queue: places with their level, and what bounds it met."""
    seen, waiting, taken, limits = {root: 0}, [root], 0, set()
    while waiting:
        file, name = waiting.pop(0)
        level = seen[file, name] + 1
        for s in sorted((s for s in steps if s[0] == file and s[3] in (None, name)), key=lambda s: (s[1], s[2], s[6])):
            taken += 1
            if taken > most:
                limits.add((file, "import_edge_limit_reached"))
                break
            local = next((a[6:] for a in s[4] if a.startswith("local:")), name)
            if (s[6], local) in seen:
                continue
            if level > depth:
                limits.add((file, "import_depth_limit_reached"))
            elif len(seen) >= nodes:
                limits.add((file, "import_node_limit_reached"))
            else:
                seen[s[6], local] = level
                waiting.append((s[6], local))
        if taken > most:
            break
    return {(*k, v) for k, v in seen.items()}, limits


@pytest.mark.parametrize("depth, nodes, most", [(16, 1024, 4096), (2, 1024, 4096), (16, 9, 4096), (16, 1024, 12)])
def test_searches_equal_a_queue(spark, depth, nodes, most):
    r = random.Random(depth * nodes + most)
    steps = [(f"f{r.randrange(12)}", i, f"x{i}", r.choice([None, None, "p", "q"]), r.choice([[], ["local:p"], ["local:r"]]), "typescript", f"f{r.randrange(12)}") for i in range(30)]
    roots = [(f"f{i}", n) for i in range(12) for n in "pqr"]
    reached, limits = resolution.closure(spark.createDataFrame(roots, "root_file string, root_name string"), spark.createDataFrame(steps, STEPS), depth, nodes, most)
    got, told = {}, {}
    for row in reached.collect():
        got.setdefault((row["root_file"], row["root_name"]), []).append((row["file"], row["name"], row["level"]))
    for row in limits.collect():
        told.setdefault((row["root_file"], row["root_name"]), set()).add(row["code"])
    for root in roots:
        want, bounds = queue(root, steps, depth, nodes, most)
        assert sorted(got[root]) == sorted(want), root
        assert told.get(root, set()) == {code for _, code in bounds}, root


def test_a_diamond_of_twenty_levels_ends(spark):
    """2^20 ways lead to the last file; each file is one place."""
    steps = [(f"f{i}{a}", n, f"x{i}{a}{b}", None, [], "typescript", f"f{i + 1}{b}") for i in range(20) for a in "ab" for n, b in enumerate("ab")]
    search = spark.createDataFrame([("f0a", "p")], "root_file string, root_name string")
    reached, limits = resolution.closure(search, spark.createDataFrame(steps, STEPS), 20)
    assert reached.count() == 41 and limits.count() == 0
    reached, limits = resolution.closure(search, spark.createDataFrame(steps, STEPS))
    assert reached.count() == 33 and [r["code"] for r in limits.select("code").distinct().collect()] == ["import_depth_limit_reached"]


@pytest.mark.parametrize("most", [2, 1024])
def test_members_of_a_package(spark, monkeypatch, most):
    monkeypatch.setattr(resolution, "NODES", most)
    asked = spark.createDataFrame([("a", "i1", "p"), ("a", "i1", "p"), ("b", "i2", "p"), ("b", "i3", "q"), ("c", "i4", "gone"), ("c", "i5", None), ("d", "i6", "p"), ("d", "i6", "q")], "relative_path string, observation_id string, module string")
    members = spark.createDataFrame([(f"f{i}", "p") for i in range(4)] + [("g", "q"), ("g", "q"), ("h", None)], "target_path string, module string")
    targets, totals = resolution._members(asked, members, ("module",))
    p = [f"f{i}" for i in range(min(most, 4))]
    want = [("a", "i1", t) for t in p] + [("b", "i2", t) for t in p] + [("b", "i3", "g"), ("d", "i6", "g")] + [("d", "i6", t) for t in p]
    assert sorted(tuple(r) for r in targets.collect()) == sorted(want)
    assert sorted(tuple(r) for r in totals.collect()) == [("a", "i1", 4), ("b", "i2", 4), ("b", "i3", 1), ("d", "i6", 5)]
