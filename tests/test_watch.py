"""A running watch: hints, overflow, idle periods, restarts, and the generation that a clean build gives."""

from __future__ import annotations

import json
import time

import pytest

from tessera.plans.indexing import Indexer
from tessera.plans.service import build
from tessera.sources import scan
from tessera.sources.store import Store
from tessera.streaming.watch import Watch
from tests.test_sources import write

TREE = {"go.mod": "module example.com/m\n", ".gitignore": "skip/\n", "a.rs": "fn a() { b(); }\nfn b() {}\n", "web/c.ts": "export function f() {}\n", "x/d.go": "package x\nfunc D() {}\n", "skip/e.rs": "fn e() {}"}


def same(spark, indexer, root):
    files = scan.tree(spark, root)
    whole, index = build(files, "repository", indexer.store.active(), scan.ignore_rules(files)), indexer.open()
    for name in ("files", "observations", "edges", "symbols"):
        a, b = getattr(whole, name), getattr(index, name)
        assert a.exceptAll(b.select(*a.columns)).count() == 0 == b.select(*a.columns).exceptAll(a).count(), name


@pytest.fixture
def watch(spark, tmp_path):
    write(tmp_path / "tree", TREE)
    return Watch(Indexer(Store(spark, f"file://{tmp_path}/store")), f"file://{tmp_path}/tree")


def row(trigger, mode, *paths):
    return {"tree": "", "trigger": trigger, "mode": mode, "hints": len(paths), "overflow": 0, "paths": list(paths)}


def test_named_paths_are_read_alone(spark, watch, tmp_path):
    write(tmp_path / "tree", {".hidden/h.rs": "fn h() {}", "_u.rs": "fn u() {}", "x/.ignore": "d.go\n"})
    asked = ["a.rs", "x/d.go", "x", "no/such.rs", "../store", "/etc/passwd", "", ".hidden/h.rs", "_u.rs", "a.rs"]
    found = {r["relative_path"]: bytes(r["content"]) for r in scan.named(spark, watch.root, asked).collect()}
    assert sorted(found) == [".gitignore", ".hidden/h.rs", "_u.rs", "a.rs", "go.mod", "x/.ignore", "x/d.go"]
    assert found["a.rs"] == TREE["a.rs"].encode()
    assert scan.named(spark, f"file://{tmp_path}/none", ["a.rs"]).count() == 0


def test_reconciliations_once_each_and_no_more_than_named(spark, watch, tmp_path):
    watch.reconcile(row("event", "targeted", "a.rs"), "q", 0)  # there is no generation yet, so all is scanned
    same(spark, watch.indexer, watch.root)
    first = watch.indexer.store.active()
    watch.reconcile(row("periodic", "full"), "q", 1)
    assert watch.indexer.store.active() == first  # nothing changed
    write(tmp_path / "tree", {"a.rs": "fn a() { b(); }\nfn b() {}\nfn z() {}\n", "n.rs": "fn n() {}", "web/c.ts": "export function g() {}\n", "skip/e.rs": "fn e2() {}"})
    (tmp_path / "tree/x/d.go").unlink()
    watch.reconcile(row("event", "targeted", "a.rs", "n.rs", "x/d.go", "skip/e.rs"), "q", 2)
    active, spellings = watch.indexer.store.active(), {r["spelling"] for r in watch.indexer.open().symbols.collect()}
    assert {"z", "n", "f"} <= spellings and not {"D", "g", "e2"} & spellings
    assert watch.indexer.jobs()[-1]["parsed"] == 2
    watch.reconcile(row("event", "targeted", "web/c.ts"), "q", 2)  # the batch comes again
    assert watch.indexer.store.active() == active
    watch.reconcile(row("event", "targeted", "web/c.ts"), "q", 3)
    same(spark, watch.indexer, watch.root)
    watch.reconcile(row("event", "full", "x"), "of another checkpoint", 0)
    status = watch.status()
    assert [status[c] for c in ("hints", "event_scans", "periodic_scans", "targeted_scans", "full_scans", "last_error")] == [7, 4, 1, 3, 2, None]


def test_failures_are_told_and_mended(spark, watch, tmp_path, monkeypatch):
    watch.reconcile(row("periodic", "full"), "q", 0)
    write(tmp_path / "tree", {"a.rs": "fn only() {}"})
    monkeypatch.setattr(Indexer, "_resolve", lambda *_: 1 / 0)
    watch.reconcile(row("event", "targeted", "a.rs"), "q", 1)
    assert "division" in watch.status()["last_error"] and watch.indexer.jobs()[-1]["state"] == "failed"
    monkeypatch.undo()
    watch.reconcile(row("periodic", "full"), "q", 2)
    assert watch.status()["last_error"] is None
    same(spark, watch.indexer, watch.root)


def test_stream_of_hints(spark, watch, tmp_path):
    hints = tmp_path / "hints"
    hints.mkdir()
    count = 0

    def hint(*paths):
        nonlocal count
        aside = tmp_path / "aside"
        aside.write_text("".join(json.dumps({"path": p}) + "\n" for p in paths))
        aside.rename(hints / f"{count}.json")
        count += 1

    def start():
        stream = spark.readStream.schema("path string").json(f"file://{hints}")
        return watch.start(stream, f"file://{tmp_path}/checkpoint", every="200 milliseconds", debounce_ms=500, period_s=8, capacity=4)

    def until(query, **wanted):
        end = time.monotonic() + 60
        while any(watch.status().get(k, 0) < n for k, n in wanted.items()):
            assert query.isActive, query.exception()
            assert time.monotonic() < end, watch.status()
            time.sleep(0.2)

    query = start()
    try:
        until(query, periodic_scans=1)  # no hint yet: the first full scan comes by time alone
        write(tmp_path / "tree", {"a.rs": "fn a1() {}", "new.rs": "fn new() { a1(); }"})
        hint("a.rs", "new.rs", "a.rs")
        until(query, targeted_scans=1)
        assert "new.rs" in {r["relative_path"] for r in watch.indexer.open().files.collect()}
        write(tmp_path / "tree", {f"o{i}.rs": f"fn o{i}() {{}}" for i in range(6)})
        hint(*(f"o{i}.rs" for i in range(6)))
        until(query, overflow_scans=1)
        same(spark, watch.indexer, watch.root)
        assert watch.status()["overflow"] == 2
    finally:
        query.stop()
    write(tmp_path / "tree", {"late.rs": "fn late() {}", "silent.rs": "fn silent() {}"})
    hint("late.rs")
    seen = watch.status()["periodic_scans"]
    query = start()
    try:
        until(query, targeted_scans=2)
        until(query, periodic_scans=seen + 1)  # what no hint named
        same(spark, watch.indexer, watch.root)
    finally:
        query.stop()
    status = watch.status()
    assert (status["hints"], status["event_scans"], status["overflow_scans"], status["last_error"]) == (10, 2, 1, None)
