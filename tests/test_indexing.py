"""Jobs, generations and the store: whole runs over small trees."""

from __future__ import annotations

import json
import threading
import time

import pytest

from tessera.__main__ import main
from tessera.limits import RequestError
from tessera.operators import extraction
from tessera.plans.indexing import Indexer
from tessera.plans.service import Service, build
from tessera.sources import scan
from tessera.sources.store import Store
from tests.test_sources import TREE, write


@pytest.fixture
def indexer(spark, tmp_path):
    return Indexer(Store(spark, f"file://{tmp_path}/store"))


def tree(spark, folder, files):
    write(folder, files)
    found = scan.tree(spark, f"file://{folder}")
    return found, scan.ignore_rules(found)


def test_generations_follow_each_other(spark, indexer, tmp_path):
    files, rules = tree(spark, tmp_path / "one", TREE)
    job = indexer.run(files, "first", "g1", rules)
    assert job["state"] == "completed" and indexer.run(files, "first", "gx", rules) == job
    index = indexer.open()
    whole = build(files, "repository", "g1", rules)
    for name in ("files", "observations", "edges", "symbols"):
        a, b = getattr(whole, name), getattr(index, name)
        assert a.exceptAll(b.select(*a.columns)).count() == 0 == b.select(*a.columns).exceptAll(a).count(), name
    changed = {k: v for k, v in TREE.items() if k != "other.go"} | {"web/c.ts": "export function f2() {}\n", "bad.rs": "fn x( {"}
    files, rules = tree(spark, tmp_path / "two", changed)
    job = indexer.run(files, "second", "g2", rules)
    assert (job["state"], job["parsed"]) == ("completed", 2)
    whole, index = build(files, "repository", "g2", rules), indexer.open()
    for name in ("files", "observations", "edges", "symbols"):
        a, b = getattr(whole, name), getattr(index, name)
        assert a.exceptAll(b.select(*a.columns)).count() == 0 == b.select(*a.columns).exceptAll(a).count(), name
    assert indexer.store.read("diagnostics").filter("relative_path = 'bad.rs'").count() == 2
    job = indexer.run(files, "third", "g3", rules)
    assert job["parsed"] == 0 and indexer.status()["files"] == whole.files.count()
    states = {g["generation_id"]: g["status"] for g in indexer.store.registry()["generations"]}
    assert states == {"g1": "superseded", "g2": "superseded", "g3": "active"} and indexer.store.registry()["previous"] == "g2"
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        indexer.store.read("files", "g1").count()


def test_cancel_fail_and_recover(spark, indexer, tmp_path, monkeypatch):
    files, rules = tree(spark, tmp_path / "one", {"a.rs": "fn a() {}"})
    indexer.run(files, "first", "g1", rules)
    resolve = indexer._resolve

    def cancelled(*args):
        resolve(*args)
        assert indexer.cancel(indexer.jobs()[-1]["job_id"]) == "requested"
        assert indexer.cancel(indexer.jobs()[-1]["job_id"]) == "already_requested"

    monkeypatch.setattr(indexer, "_parse", lambda *a, own=indexer._parse: (own(*a), indexer.cancel(indexer.jobs()[-1]["job_id"]))[0])
    job = indexer.run(files, "second", "g2", rules)
    assert job["state"] == "cancelled" and indexer.store.active() == "g1" and indexer.cancel(job["job_id"]) == "already_finished"
    monkeypatch.undo()
    monkeypatch.setattr(indexer, "_resolve", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        indexer.run(files, "third", "g3", rules)
    assert indexer.jobs()[-1]["state"] == "failed" and indexer.store.active() == "g1"
    monkeypatch.setattr(indexer, "_resolve", cancelled)
    job = indexer.run(files, "late", "g4", rules)
    assert job["state"] == "completed"  # too late: it commits
    monkeypatch.setattr(indexer, "_end", lambda *a, **b: None)  # the process dies
    monkeypatch.setattr(indexer, "_resolve", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        indexer.run(files, "crash", "g5", rules)
    assert indexer.jobs()[-1]["state"] == "resolving"
    monkeypatch.undo()
    indexer.recover()
    assert indexer.jobs()[-1]["state"] == "interrupted" and indexer.store.active() == "g4"
    assert indexer.store.registry()["generations"][-1]["status"] == "abandoned"
    monkeypatch.setattr(scan, "FILES", 0)
    with pytest.raises(RequestError, match="incomplete"):
        indexer.run(files, "many", "g6", rules)


def test_half_written_registries_do_not_count(spark, indexer, tmp_path):
    files, rules = tree(spark, tmp_path / "one", {"a.rs": "fn a() {}"})
    indexer.run(files, "first", "g1", rules)
    before = indexer.store.registry()
    (tmp_path / "store/registry/next-dead").write_text("{")
    assert indexer.store.registry() == before
    stale = dict(before)
    indexer.store.commit(indexer.store.registry() | {"previous": "x"})
    with pytest.raises(RequestError, match="WRITER_BUSY"):
        indexer.store.commit(stale)


def test_service_over_a_store_in_the_background(spark, indexer, tmp_path):
    files, rules = tree(spark, tmp_path / "one", {"a.rs": "fn a() { b(); }\nfn b() {}"})
    indexer.run(files, "first", "g1", rules)
    service = Service(indexer.open(), indexer)
    files, rules = tree(spark, tmp_path / "two", {"a.rs": "fn a() { b(); }\nfn c() {}"})
    job = service.index_repository(files, "second", "g2", rules, background=True)
    assert job["state"] == "queued" and service.search_symbols("b")["symbols"]
    assert indexer.wait(job["job_id"], 120)["state"] == "completed"
    service.refresh()
    assert service.index.generation_id == "g2" and [s["spelling"] for s in service.search_symbols("c")["symbols"]] == ["c"]
    assert service.repository_status()["latest_job"]["job_id"] == job["job_id"] == service.job_status(job["job_id"])["job_id"]


def test_command_line(spark, tmp_path, capsys):
    write(tmp_path / "tree", {"a.rs": "fn a() { b(); }\nfn b() {}"})
    store = f"file://{tmp_path}/store"
    assert main(["index", f"file://{tmp_path}/tree", store, "--key", "k"], spark) == 0
    assert main(["status", store], spark) == 0 and main(["doctor", store], spark) == 0
    job, status, checks = (json.loads(line) for line in capsys.readouterr().out.splitlines())
    assert job["state"] == "completed" and status["files"] == 1 and status["symbols"] == 2 and checks["edge_faults"] == checks["membership_faults"] == 0


def test_searches_read_the_partitions_of_their_terms(spark, indexer, tmp_path):
    files, rules = tree(spark, tmp_path / "one", {f"m{i}.rs": f"fn parse_config_{i}() {{ load_file_{i}(); }}\nfn load_file_{i}(path: i32) {{}}\n" for i in range(30)})
    indexer.run(files, "first", "g1", rules)
    service = Service(indexer.open(), indexer)
    plain = Service(build(files, "repository", "g1", rules))
    for query in ("config", "file load", "loadFile7", "nothing"):
        a, b = service.search_symbols(query, limit=50), plain.search_symbols(query, limit=50)
        assert [(s["symbol_id"], s["match_kind"]) for s in a["symbols"]] == [(s["symbol_id"], s["match_kind"]) for s in b["symbols"]], query
    plan = service.index.postings.terms(["load"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,load)]" in plan


def test_cancel_in_the_middle_of_a_parse(spark, indexer, tmp_path, monkeypatch):
    files, rules = tree(spark, tmp_path / "one", {"a.rs": "fn a() {}"})
    indexer.run(files, "first", "g1", rules)
    slow = extraction.parsed

    def parsed(sources):
        """A parse of an hour: every row waits."""
        return slow(sources.mapInPandas(lambda frames: (time.sleep(3600) or f for f in frames), sources.schema))

    monkeypatch.setattr(extraction, "parsed", parsed)
    files, rules = tree(spark, tmp_path / "two", {"a.rs": "fn b() {}", "b.rs": "fn c() {}"})
    job = indexer.run(files, "second", "g2", rules, background=True)
    until = time.monotonic() + 60
    while not (indexer.job(job["job_id"])["state"] == "parsing" and spark.sparkContext.statusTracker().getActiveJobsIds()):
        assert time.monotonic() < until
        time.sleep(0.1)
    time.sleep(1)  # the task has begun
    # another process asks, over the registry alone
    assert Indexer(Store(spark, indexer.store.folder)).cancel(job["job_id"]) == "requested"
    began = time.monotonic()
    assert indexer.wait(job["job_id"], 20)["state"] == "cancelled" and time.monotonic() - began < 5
    assert indexer.store.active() == "g1" and indexer.store.read("files").count() == 1
    assert indexer.store.registry()["generations"][-1]["status"] == "abandoned"
    monkeypatch.undo()
    job = indexer.run(files, "third", "g3", rules)
    assert job["state"] == "completed" and indexer.store.read("files").count() == 2


def test_registry_without_jobs_and_with_two_writers(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    for i in range(6):
        store.change(lambda r, i=i: r.update(previous=f"p{i}"))
    assert store.registry()["previous"] == "p5" and set(tracker.getJobIdsForGroup(None)) == before
    names = [f"w{i}-{k}" for i in range(3) for k in range(5)]

    def write(i):
        for k in range(5):
            while True:
                try:
                    store.change(lambda r, k=k: r["jobs"].append(f"w{i}-{k}"))
                    break
                except RequestError as error:
                    assert error.code == "WRITER_BUSY"

    writers = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(store.registry()["jobs"]) == sorted(names)
