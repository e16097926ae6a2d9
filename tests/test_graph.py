"""Caps, order and folds that SQL can't check, against plain loops."""

from __future__ import annotations

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tessera.limits import RequestError
from tessera.operators import generations, graph, notes, retrieval

EDGE = "edge_id string, relationship string, source_symbol_id string, target_symbol_id string, resolution string, source_path string, target_path string, source_start_byte long"


def random_edges(seed, n=200, nodes=25):
    rng = random.Random(seed)
    return [(f"e{i:03d}", rng.choice(["calls", "references"]), f"s{rng.randrange(nodes)}", rng.choice([None, f"s{rng.randrange(nodes)}"]) if rng.random() < 0.1 else f"s{rng.randrange(nodes)}", rng.choice(["candidate", "lexically_resolved"]), f"p{rng.randrange(9)}", f"p{rng.randrange(9)}", rng.randrange(5)) for i in range(n)]


def loop(edges, roots, depth, nodes, most, candidates=True):
    visited, queue, out, cut = {}, deque(), [], len(roots) > nodes
    for r in roots[:nodes]:
        if r not in visited:
            visited[r] = 1
            queue.append((r, 0))
    while queue:
        node, d = queue.popleft()
        if d >= depth:
            continue
        left = most - len(out)
        if left <= 0:
            cut = True
            break
        near = sorted((e for e in edges if e[2] == node and (candidates or e[4] != "candidate")), key=lambda e: (e[5], e[7], e[0]))
        if len(near) > left:
            near, cut = near[:left], True
        for e in near:
            out.append(e[0])
            if e[3] is not None and e[3] not in visited:
                if len(visited) >= nodes:
                    cut = True
                else:
                    visited[e[3]] = 1
                    queue.append((e[3], d + 1))
    return sorted(visited), out, cut


@pytest.mark.parametrize(("depth", "nodes", "most"), [(3, 500, 2000), (2, 6, 2000), (8, 500, 17), (5, 4, 9), (0, 5, 5), (3, 1, 2000)])
def test_walk_equals_the_queue(spark, depth, nodes, most):
    for seed in (1, 2):
        edges = random_edges(seed)
        df = spark.createDataFrame(edges, EDGE).repartition(3)
        roots = ["s1", "s2", "s1", "s3"]
        ids, taken, cut = graph.walk(df, roots, depth=depth, max_nodes=nodes, max_edges=most)
        want = loop(edges, roots, depth, nodes, most)
        assert (ids, [r["edge_id"] for r in taken]) == want[:2]
        assert cut == want[2]


def test_registered_walks_read_all_edges_within_their_caps(spark, folder):
    from tessera.limits import DEFAULTS
    from tessera.plans import catalog
    from tessera.plans.graphs import EDGE as NAMES
    from tessera.plans.graphs import ROOT
    from tessera.sources import corpus

    run = lambda name: catalog.queries()[name](spark, folder).collect()
    order = ("edge_id", "relationship", "source_symbol_id", "target_symbol_id", "resolution", "source_path", "target_path", "source_start_byte")
    frame = corpus.edges(spark, folder)
    edges = [tuple(r) for r in frame.select(*order).collect()]
    back = [(e[0], e[1], e[3], e[2], *e[4:]) for e in edges]
    assert len({e[1] for e in edges}) == 3 and len(run("labelled_edges")) == len(edges)
    for name, way in (("walk_outgoing_all", edges), ("walk_incoming_all", back)):
        nodes, _, cut = loop(way, [ROOT], 3, DEFAULTS.nodes, DEFAULTS.edges)
        assert cut and [r["symbol_id"] for r in run(name)] == nodes
    traced = loop([e for e in back if e[1] == "calls"], [ROOT], 3, DEFAULTS.nodes, DEFAULTS.edges)[1]
    assert NAMES == order and [r["edge_id"] for r in run("trace_calls_all")] == list(dict.fromkeys(traced))
    path = "src/pkg4/file4.rs"
    own = sorted(r["symbol_id"] for r in corpus.symbols(spark, folder).filter(F.col("relative_path") == path).collect())
    into = sorted((e for e in edges if e[6] == path), key=lambda e: (e[5], e[7], e[0]))[: DEFAULTS.edges]
    seeds = sorted({ROOT, *own, *(e[2] for e in into)})
    walked = set(loop(back, seeds, 2, DEFAULTS.nodes, max(1, DEFAULTS.edges - len(into)))[1]) | {e[0] for e in into}
    reached = {path} | {p for e in edges if e[0] in walked for p in (e[5], e[6])}
    assert [r["relative_path"] for r in run("analyze_impact_all")] == sorted(reached)


def test_walk_limits(spark):
    df = spark.createDataFrame([], EDGE)
    assert graph.walk(df, ["a"]) == (["a"], [], False)
    with pytest.raises(RequestError):
        graph.walk(df, ["a"], depth=9)
    edges, warnings = graph.trace_calls(df, "a")
    assert edges.count() == 0 and warnings == ["no_callers_is_not_dead_code"]


def test_greedy_overlaps(spark):
    rng = random.Random(3)
    rows = [(f"p{rng.randrange(3)}", i, a := rng.randrange(60), a + rng.randrange(1, 15)) for i in range(40)]
    df = spark.createDataFrame(rows, "relative_path string, rank int, start_byte long, end_byte long")
    kept = []
    for r in sorted(rows, key=lambda r: r[1]):
        if all(k[0] != r[0] or k[3] <= r[2] or r[3] <= k[2] for k in kept):
            kept.append(r)
    assert sorted(tuple(r) for r in retrieval.suppress_overlaps(df, "relative_path", ["rank"]).collect()) == sorted(kept)


def test_excerpts_keep_whole_lines(spark):
    sources = spark.createDataFrame([("a", bytearray("one\ntwé\nthree\n".encode())), ("b", bytearray(b"x"))], "relative_path string, content binary")
    good = sources.select("relative_path", F.sha2("content", 256).alias("content_hash"))
    rows = {r["relative_path"]: r for r in retrieval.line_excerpts(sources, good, 1, 2, 8).collect()}
    assert rows["a"]["text"] == "one\n" and rows["a"]["truncated"] and rows["b"]["status"] == "invalid_range"
    assert {r["status"] for r in retrieval.line_excerpts(sources, good, 1, 1, 0).collect()} == {"response_too_large"}
    assert retrieval.line_excerpts(sources, good, 2, 3, 100).filter("relative_path = 'a'").first()["text"] == "twé\nthree\n"


def test_generations(spark):
    rows = [("g1", None, "active", True, True), ("g2", "g1", "building", True, True), ("g3", "g1", "building", False, True)]
    df = spark.createDataFrame(rows, "generation_id string, parent_id string, status string, scan_complete boolean, resolved boolean")
    after = {r["generation_id"]: r["status"] for r in generations.activate(df, "g2").collect()}
    assert after == {"g1": "superseded", "g2": "active", "g3": "building"}
    for bad in ("g3", "g1", "zz"):
        with pytest.raises(RequestError):
            generations.activate(df, bad)
    assert {r["generation_id"]: r["status"] for r in generations.abandon(df, "g3").collect()}["g3"] == "abandoned"
    jobs = spark.createDataFrame([("j1", "parsing", False, 1), ("j2", "completed", False, 2)], "job_id string, state string, cancel_requested boolean, created_at long")
    _, recovered = generations.recover(df, jobs)
    assert {r["job_id"]: r["state"] for r in recovered.collect()} == {"j1": "interrupted", "j2": "completed"}
    changed, outcome = generations.request_cancel(jobs, "j1")
    assert outcome == "requested" and generations.request_cancel(changed, "j1")[1] == "already_requested" and generations.request_cancel(jobs, "j2")[1] == "already_finished"
    assert generations.latest_job(jobs).first()["job_id"] == "j2"
    members = spark.createDataFrame([("a", "h", "v")], "relative_path string, content_hash string, analysis_key string")
    with pytest.raises(RequestError):
        generations.begin(members, "g4", spark.createDataFrame([("zz",)], "relative_path string"))
    assert generations.begin(None, "g4") is None


def test_note_bounds(spark):
    kind = "memory_id string, relative_path string, content_hash string, symbol_id string"
    have = spark.createDataFrame([("a", "x" * 20000), ("b", "y")], "id string, body string")
    evidence = spark.createDataFrame([("b", f"p{i}", "h", None) for i in range(33)], kind)
    assert {(r["id"], r["fault"]) for r in notes.bound_faults(have, evidence).collect()} == {("a", "body"), ("b", "evidence")}
