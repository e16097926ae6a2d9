"""Trees with links, files that change between listing and reading, and directories that can't be listed."""

from __future__ import annotations

import os

import pytest

from tessera.sources import guarded, scan
from tests.test_sources import write

FILES = {"a.rs": "fn a() {}", "d/b.rs": "fn b() {}", "d/e/c.go": "package c", "_x/.y.rs": "fn y() {}", "node_modules/z.js": "z", "README": "text", "go.mod": "module m", ".gitignore": "gen/\n", "gen/g.rs": "fn g() {}"}


@pytest.fixture
def root(tmp_path):
    folder = tmp_path / "tree with space"
    write(folder, FILES)
    return folder


def listed(root, path):
    parent = path.rpartition("/")[0]
    return next(e for e in guarded.entries(str(root), parent) if e[0] == path)[2:]


def test_a_tree_is_that_of_the_scan(spark, root):
    (root / "big.rs").write_bytes(b"x" * (scan.FILE_BYTES + 1))
    files = guarded.tree(spark, f"file://{root}".replace(" ", "%20"))
    plain = scan.tree(spark, f"file://{root}")
    rules = scan.ignore_rules(files)
    assert rules == scan.ignore_rules(plain) and scan.manifests(files).collect() == scan.manifests(plain).collect()
    take = lambda df: [tuple(r) for r in scan.safe_sources(scan.scan(df, rules)).collect()]
    assert take(files) == take(plain) and [r[0] for r in take(files)] == ["_x/.y.rs", "a.rs", "d/b.rs", "d/e/c.go"]
    assert scan.scan_status(files, rules).first() == scan.scan_status(plain, rules).first()
    assert {r["relative_path"]: r["fault"] for r in scan.safe_sources(files).collect()}["big.rs"] == "too_large"


def test_links_are_rows_and_not_followed(spark, root, tmp_path):
    write(tmp_path / "outside", {"s.rs": "secret"})
    (root / "link.rs").symlink_to(tmp_path / "outside" / "s.rs")
    (root / "ring").symlink_to(root)
    files = guarded.tree(spark, str(root))
    faults = {r["relative_path"]: r["fault"] for r in files.filter("fault IS NOT NULL").collect()}
    assert faults == {"link.rs": "link", "ring": "link"} and files.filter("relative_path LIKE 'ring/%'").isEmpty()
    assert scan.scan_status(files).first()["complete"]  # what is left out on purpose is not missing


def test_what_cannot_be_listed_clears_complete(spark, root):
    open(os.fsencode(root) + b"/d/bad\xff.rs", "w").close()
    files = guarded.tree(spark, str(root))
    assert [(r["relative_path"], r["fault"]) for r in files.filter("fault IS NOT NULL").collect()] == [("d", "unlisted")]
    assert not scan.scan_status(files).first()["complete"] and files.filter("relative_path = 'd/e/c.go'").count() == 1
    assert [(r["relative_path"], r["fault"]) for r in guarded.tree(spark, str(root / "gone")).collect()] == [("", "unlisted")]
    assert list(guarded.entries(str(root), "a.rs")) == [("a.rs", "unlisted", None, None, None)]


def test_changes_after_the_listing(root, tmp_path):
    known = {p: listed(root, p) for p in ("a.rs", "d/b.rs", "d/e/c.go")}
    read = lambda p: guarded.content(str(root), p, *known[p])
    assert read("a.rs") == (b"fn a() {}", None)
    (root / "a.rs").write_text("fn a() { more }")
    assert read("a.rs") == (None, "changed")
    other = root / "d/new.rs"
    other.write_text("fn b() {}")
    os.utime(other, ns=(known["d/b.rs"][1],) * 2)
    other.replace(root / "d/b.rs")  # same size and time, another file
    assert read("d/b.rs") == (None, "changed")
    (root / "d/e").rename(tmp_path / "moved")
    (root / "d/e").symlink_to(tmp_path / "moved")  # a link on the way leads to the very file
    assert read("d/e/c.go") == (None, "changed")
    (root / "d/e").unlink()
    assert read("d/e/c.go") == (None, "changed")


def test_a_file_that_changes_while_it_is_read(root, monkeypatch):
    known, real = listed(root, "a.rs"), os.read

    def read(opened, size):
        got = real(opened, size)
        if got:
            (root / "a.rs").write_text("fn a() {} // longer")
        return got

    monkeypatch.setattr(guarded.os, "read", read)
    assert guarded.content(str(root), "a.rs", *known) == (None, "changed")


def test_a_file_that_changed_since_does_not_count_as_deleted(spark, root):
    files = guarded.tree(spark, str(root))
    changed = files.withColumn("fault", __import__("pyspark").sql.functions.expr("CASE WHEN relative_path = 'a.rs' THEN 'changed' END"))
    assert not scan.scan_status(changed).first()["complete"] and scan.scan_status(files).first()["complete"]
