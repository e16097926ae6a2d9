"""Notes of a store: what survives a process, two writers, and the cap."""

from __future__ import annotations

import threading

import pytest

from tessera import schema
from tessera.limits import RequestError
from tessera.operators import notes
from tessera.plans.indexing import Indexer
from tessera.plans.service import Service
from tessera.sources import scan
from tessera.sources.notebook import BUCKETS, Notebook
from tessera.sources.store import Store
from tests.test_sources import write



def note(spark, *rows):
    """rows: (id, body, expected_revision, delete)."""
    made = [(i, b, "fact", None, "me", "test", "all", 1, 2, r, d) for i, b, r, d in rows]
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.NOTES) + ", expected_revision long, delete boolean"
    return spark.createDataFrame(made, kind)


def held(book):
    return {r["id"]: (r["body"], r["revision"]) for r in book.read()[0].collect()}


def test_writes_follow_the_rules_of_notes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    book = Notebook(store)
    assert book.read()[0].count() == book.read()[1].count() == 0 == book.count()
    evidence = spark.createDataFrame([(f"n{i}", "a.rs", "h", None) for i in range(40)], schema.NOTE_EVIDENCE)
    done = book.write(note(spark, *((f"n{i}", f"body {i}", None, False) for i in range(40))), evidence)
    assert {d["outcome"] for d in done} == {"created"} and book.count() == 40
    done = {d["id"]: (d["outcome"], d["revision"]) for d in book.write(note(spark, ("n1", "new", 1, False), ("n2", "x", 7, False), ("n3", "x", None, False), ("n4", None, 1, True), ("gone", None, 1, True), ("late", "x", 3, False), ("n40", "more", None, False)))}
    assert done == {"n1": ("updated", 2), "n2": ("conflict", None), "n3": ("revision_required", None), "n4": ("deleted", None), "gone": ("not_found", None), "late": ("conflict", None), "n40": ("created", 1)}
    want = {f"n{i}": (f"body {i}", 1) for i in range(40) if i != 4} | {"n1": ("new", 2), "n40": ("more", 1)}
    assert held(Notebook(Store(spark, store.folder))) == want and book.count() == 40
    assert {r["memory_id"] for r in book.read()[1].collect()} == {f"n{i}" for i in range(40) if i != 4}
    book.write(note(spark, ("n5", "again", 1, False)), spark.createDataFrame([("n5", "b.rs", "h2", "s"), ("n6", "c.rs", "h", None)], schema.NOTE_EVIDENCE))
    assert [tuple(r)[1:] for r in book.read()[1].filter("memory_id IN ('n5', 'n6')").orderBy("memory_id").collect()] == [("b.rs", "h2", "s"), ("a.rs", "h", None)]
    # nothing is left but what buckets point to, now and before
    folders = {p.name for p in (tmp_path / "store/notes").iterdir()}
    state = store.registry()["notes"]
    assert folders == {p.split("/")[0] for p in [*state["places"].values(), *state["before"].values()]} and len(state["places"]) <= BUCKETS


def test_two_writers_of_one_note(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    books = [Notebook(Store(spark, folder)) for _ in range(3)]
    books[0].write(note(spark, ("n", "first", None, False), *((f"m{i}", "x", None, False) for i in range(3))))
    answers = []

    def update(i):
        answers.append(books[i].write(note(spark, ("n", f"by {i}", 1, False), (f"m{i}", f"own {i}", 1, False))))

    writers = [threading.Thread(target=update, args=(i,)) for i in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    outcomes = sorted(d["outcome"] for a in answers for d in a if d["id"] == "n")
    assert outcomes == ["conflict", "conflict", "updated"]
    found = held(books[0])
    assert found["n"][1] == 2 and all(found[f"m{i}"] == (f"own {i}", 2) for i in range(3))


def test_cap_of_notes(spark, tmp_path):
    book = Notebook(Store(spark, f"file://{tmp_path}/store"), most=5)
    done = {d["id"]: d["outcome"] for d in book.write(note(spark, *((f"n{i}", "x", None, False) for i in range(7))))}
    assert done == {f"n{i}": "created" if i < 5 else "limit" for i in range(7)} and book.count() == 5
    done = {d["id"]: d["outcome"] for d in book.write(note(spark, ("n0", None, 1, True), ("n6", "x", None, False), ("n7", "x", None, False)))}
    assert done == {"n0": "deleted", "n6": "created", "n7": "limit"} and sorted(held(book)) == ["n1", "n2", "n3", "n4", "n6"]


def test_services_share_notes(spark, tmp_path, monkeypatch):
    write(tmp_path / "tree", {"a.rs": "fn a() {}"})
    files = scan.tree(spark, f"file://{tmp_path}/tree")
    indexer = Indexer(Store(spark, f"file://{tmp_path}/store"))
    indexer.run(files, "k", "g1", scan.ignore_rules(files))
    one, two = Service(indexer.open(), indexer), Service(indexer.open(), Indexer(Store(spark, indexer.store.folder)))
    assert one.upsert_memory(note(spark, ("n", "the parser is slow", None, False)).drop("delete"))["outcome"] == "created"
    with pytest.raises(RequestError, match="MEMORY_REVISION_CONFLICT"):
        two.upsert_memory(note(spark, ("n", "mine", None, False)).drop("delete"))
    two.refresh()
    assert [n["id"] for n in two.search_memories("parser")] == ["n"]
    assert two.upsert_memory(note(spark, ("n", "the parser is fast", 1, False)).drop("delete"))["revision"] == 2
    with pytest.raises(RequestError, match="MEMORY_REVISION_CONFLICT"):
        one.forget_memory("n", 1)
    fresh = Indexer(Store(spark, indexer.store.folder))  # another process
    assert [r["body"] for r in fresh.open().notes.collect()] == ["the parser is fast"]
    assert one.forget_memory("n", 2)["outcome"] == "deleted"
    with pytest.raises(RequestError, match="MEMORY_NOT_FOUND"):
        one.forget_memory("n", 2)
    monkeypatch.setattr(indexer, "notebook", Notebook(indexer.store, most=0))
    with pytest.raises(RequestError, match="MEMORY_LIMIT_EXCEEDED"):
        one.upsert_memory(note(spark, ("m", "x", None, False)).drop("delete"))
    assert Notebook(indexer.store).most == notes.NOTES == 10_000
