"""Extraction, resolution, scans, the store and the service on small source trees."""

from __future__ import annotations

import time

import pytest

from tessera.functions.syntax import extract
from tessera.limits import RequestError
from tessera.operators import extraction, resolution
from tessera.plans.service import Service, build, rebuild
from tessera.sources import scan
from tessera.sources.store import Store, backup

SNIPPETS = {
    "rust": ("use a::{b, c::{self, D as E}};\nimpl<T> P<T> { pub fn new(x: i32) -> Self { let z = x; helper(z); println!(\"phantom_call()\"); z } }\ntrait Tr { fn go(&self); }\nenum K { A, B(i32) }\n#[cfg(test)]\nmod t {}\n/* /* phantom_call() */ */",
             {("impl", "P"), ("method", "new"), ("local", "z"), ("trait_method", "go"), ("enum_variant", "B"), ("module", "t"), ("parameter", "x")}, {("use", "a::b", None), ("use", "a::c", "self"), ("use", "a::c::D", "E")}, {"helper", "println"}),
    "go": ("package m\nimport (\n\"fmt\"\nx \"a/b\"\n)\ntype T struct {\n N string\n *O\n}\ntype I interface { Do(q int) error }\ntype L = T\nfunc (t *T) Run(a, c int) { b := a; fmt.Println(b) }\nconst Z = `phantom_call(`\n",
           {("type", "T"), ("field", "N"), ("embedded_field", "O"), ("interface_method", "Do"), ("type_alias", "L"), ("method", "Run"), ("local", "b"), ("const", "Z")}, {("package", "m", None), ("import", "fmt", "fmt"), ("import", "a/b", "x")}, {"Println"}),
    "java": ("package a.b;\nimport java.util.*;\nimport static x.Y.z;\npublic class F<T> extends B { private int n = 0; F(int c) { n = c; } @Override List<String> run(String a) { int l = 1; go(l); return new Q(2).w(); } enum C { RED, BLUE; } }",
             {("class", "F"), ("type_parameter", "T"), ("field", "n"), ("constructor", "F"), ("method", "run"), ("parameter", "a"), ("local", "l"), ("enum_constant", "BLUE")}, {("package", "a.b", None), ("import", "java.util", None), ("import", "x.Y.z", None)}, {"go", "Q", "w"}),
    "csharp": ("using S;\nusing A = X.Y;\nnamespace N.M { partial class C : B { int f; public string P { get; set; } C(int a) { f = a; } int M(int q) { var l = q; Foo(l); return 1; } } }\n#if DEBUG\n#endif",
               {("namespace", "N.M"), ("class", "C"), ("field", "f"), ("property", "P"), ("constructor", "C"), ("method", "M"), ("local", "l")}, {("using", "S", None), ("using", "X.Y", "A")}, {"Foo"}),
    "dart": ("library x;\nimport 'package:a/b.dart' as p show Q, R hide W;\nclass A extends B { final int f = 1; A(this.f); factory A.make() => A(2); int get g => f; void run(int n) { var l = n; foo(l); } }\nmixin M {}\nenum E { one, two }\n",
             {("class", "A"), ("field", "f"), ("constructor", "A"), ("factory_constructor", "make"), ("getter", "g"), ("method", "run"), ("local", "l"), ("mixin", "M"), ("enum_constant", "two")}, {("library", "x", None), ("import", "package:a/b.dart", "p")}, {"foo", "A"}),
    "typescript": ("import d, { a as b } from './m';\nexport { b as c } from './n';\nconst q = require('z');\nexport interface I { f(x: number): void; p: string }\ntype L = string;\nclass K extends B { private n = 1; constructor(x: number) { super(); this.go(x); } go(y) { return b(y); } }\nexport const fn = (x: I) => { const w = x; return help(w); };\nconst r = /phantom_call\\(/;",
                   {("interface", "I"), ("method_signature", "f"), ("type_alias", "L"), ("class", "K"), ("constructor", "constructor"), ("method", "go"), ("function_binding", "fn"), ("variable", "w")}, {("esm_import", "./m", "d"), ("esm_import", "./m", "b"), ("reexport", "./n", "c"), ("commonjs_require", "z", "q")}, {"b", "help", "go", "require"}),
}


@pytest.mark.parametrize("language", sorted(SNIPPETS))
def test_snippets(language):
    text, symbols, imports, calls = SNIPPETS[language]
    rows, status, _ = extract(text, language, "f")
    of = lambda c: [r for r in rows if r["category"] == c]
    assert status == "complete"
    assert symbols <= {(r["kind"], r["spelling"]) for r in of("symbol")}
    assert imports == {(r["kind"], r["spelling"], r["alias"]) for r in of("import")}
    assert calls <= {r["spelling"] for r in of("call_site")}
    assert not any("phantom_call" in r["spelling"] for r in rows)
    data = text.encode()
    assert all(data[r["start_byte"] : r["end_byte"]].decode() == r["spelling"] for r in of("symbol") if r["kind"] != "namespace")
    assert len({r["observation_id"] for r in rows}) == len(rows)
    scopes = {r["observation_id"] for r in of("scope")}
    assert all(r["scope_id"] in scopes for r in rows if r["category"] != "scope")


def test_ids_survive_new_lines_and_offsets_count_bytes():
    text = SNIPPETS["rust"][0]
    ids = lambda t: {r["observation_id"] for r in extract(t, "rust", "f")[0] if r["category"] == "symbol"}
    assert ids(text) == ids("\n// é\r\n\n" + text)
    (row,) = [r for r in extract("// é\r\nfn é_x() {}", "rust", "f")[0] if r["category"] == "symbol"]
    assert (row["start_byte"], row["end_byte"]) == (10, 14)


def test_broken_sources_are_partial():
    assert extract("fn x( {", "rust", "f")[1] == "partial"
    assert extract("", "go", "f")[1] == "complete"
    assert extract("x" * (2 << 20) + "y", "rust", "f")[1] == "failed"
    for language in SNIPPETS:
        for cut in range(0, len(SNIPPETS[language][0]), 7):
            extract(SNIPPETS[language][0][:cut], language, "f")


TREE = {
    "go.mod": "module example.org/app\n\ngo 1.22\n",
    "main.go": 'package main\nimport "example.org/app/util"\nimport "os"\nfunc main() { util.Help(); other(); gone() }\n',
    "other.go": "package main\nfunc other() {}\n",
    "util/u.go": "package util\nfunc Help() int { x := 1; return x }\n",
    "src/lib.rs": "mod inner;\nuse crate::inner::deep;\nuse serde::Serialize;\npub fn top() { let v = 1; helper(v); deep(); let f = || helper(v); mac!(v); }\nfn helper(a: i32) {}\n",
    "src/inner.rs": "pub fn deep() {}\nfn hidden() {}\n",
    "web/a.ts": "import { f as g } from './b';\nimport pkg from 'pkg';\nexport function run() { const obj = {}; obj.m(); return g(1); }\nfunction shadow(g) { return g(2); }\nimport(x);\n",
    "web/b.ts": "export { f } from './c';\nexport * from './a';\n",
    "web/c.ts": "export function f(x: number) { return x; }\nexport { f as h } from './b';\n",
    "j/A.java": "package j; class A { void one() { two(); B.three(); } void two() {} }\n",
    "j/B.java": "package j; class B { static void three() {} }\n",
    ".gitignore": "gen/\n*.skip.rs\n!keep.skip.rs\n",
    "gen/y.js": "function y() {}",
    "a.skip.rs": "fn a() {}",
    "keep.skip.rs": "fn kept() {}",
    "node_modules/x.js": "1",
    "Up.RS": "fn u() {}",
    "nul.rs": "fn a() {}\0",
    "_private/p.rs": "fn p() {}",
    "_own.rs": "fn own() {}",
}


def write(folder, tree):
    for name, text in tree.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tree with space")
    write(folder, TREE)
    return folder


@pytest.fixture(scope="module")
def index(spark, root):
    files = scan.tree(spark, f"file://{root}")
    return build(files, "repo", "g1", scan.ignore_rules(files))


def test_scan(spark, root):
    files = scan.tree(spark, f"file://{root}")
    rules = scan.ignore_rules(files)
    paths = [r["relative_path"] for r in scan.scan(files, rules).select("relative_path").collect()]
    assert paths == sorted(["Up.RS", "_own.rs", "_private/p.rs", "j/A.java", "j/B.java", "keep.skip.rs", "main.go", "nul.rs", "other.go", "src/inner.rs", "src/lib.rs", "util/u.go", "web/a.ts", "web/b.ts", "web/c.ts"])
    faults = {r["relative_path"]: r["fault"] for r in scan.safe_sources(files).collect()}
    assert faults["nul.rs"] == "binary" and faults["Up.RS"] == "unsupported_dialect" and faults["go.mod"] == "excluded" and faults["main.go"] is None
    wanted = spark.createDataFrame([("main.go",), ("gone.go",), ("gen/y.js",)], "relative_path string")
    assert [r["relative_path"] for r in scan.scan_paths(files, wanted, rules).collect()] == ["main.go"]
    assert scan.scan_status(files, rules).first()["complete"]
    assert [r["relative_path"] for r in scan.manifests(files).collect()] == ["go.mod"]


LABELS = [
    ("go", "main.go", "call_site", "other", 0, "calls", "lexically_resolved", 1, [("other.go", "other")]),
    ("go", "main.go", "call_site", "Help", 0, "calls", "candidate", 1, [("util/u.go", "Help")]),
    ("go", "main.go", "call_site", "gone", 0, "calls", "unresolved", 0, []),
    ("go", "main.go", "import", "example.org/app/util", 0, "imports", "lexically_resolved", 1, [("util/u.go", None)]),
    ("go", "main.go", "import", "os", 0, "imports", "syntax_observation", 1, []),
    ("go", "util/u.go", "reference", "x", 0, "references", "lexically_resolved", 1, [("util/u.go", "x")]),
    ("rust", "src/lib.rs", "call_site", "helper", 0, "calls", "lexically_resolved", 1, [("src/lib.rs", "helper")]),
    ("rust", "src/lib.rs", "call_site", "deep", 0, "calls", "lexically_resolved", 1, [("src/inner.rs", "deep")]),
    ("rust", "src/lib.rs", "call_site", "mac", 0, "calls", "unresolved", 0, []),
    ("rust", "src/lib.rs", "import", "serde::Serialize", 0, "imports", "syntax_observation", 1, []),
    ("rust", "src/lib.rs", "import", "crate::inner::deep", 0, "imports", "lexically_resolved", 1, [("src/inner.rs", "deep")]),
    ("typescript", "web/a.ts", "call_site", "g", 0, "calls", "lexically_resolved", 1, [("web/c.ts", "f")]),
    ("typescript", "web/a.ts", "call_site", "g", 1, "calls", "lexically_resolved", 1, [("web/a.ts", "g")]),
    ("typescript", "web/a.ts", "call_site", "m", 0, "calls", "unresolved", 0, []),
    ("typescript", "web/a.ts", "import", "pkg", 0, "imports", "syntax_observation", 1, []),
    ("typescript", "web/a.ts", "import", "x", 0, "imports", "unresolved", 0, []),
    ("java", "j/A.java", "call_site", "two", 0, "calls", "lexically_resolved", 1, [("j/A.java", "two")]),
    ("java", "j/A.java", "call_site", "three", 0, "calls", "candidate", 1, [("j/B.java", "three")]),
]


def test_labelled_sites(spark, index):
    schema = "language string, source_path string, source_category string, source_spelling string, occurrence int, relationship string, resolution string, candidate_count long, targets array<struct<path:string,name:string>>"
    labels = spark.createDataFrame(LABELS, schema)
    edges = index.edges.fillna({"target_symbol_id": ""})
    got = {r["language"]: r for r in resolution.evaluate(index.edges, labels, index.observations).collect()}
    assert sum(r["sites"] for r in got.values()) == len(LABELS) and edges.count() > 0
    assert all(r["exact"] >= r["sites"] - 1 for r in got.values()), got
    assert all(r["recall"] == 1.0 for r in got.values()), got


def test_edges_are_sound(index):
    from tessera.schema import edge_faults, membership_faults

    assert edge_faults(index.edges).count() == 0
    assert membership_faults(index.edges, index.files).count() == 0
    assert index.edges.count() == index.edges.select("edge_id").distinct().count()


def test_incremental_equals_full(spark, root, index, tmp_path):
    changed = {k: v for k, v in TREE.items() if k not in ("other.go",)}
    changed["web/c.ts"] = "export function f2(x: number) { return x; }\n"
    changed["new.go"] = "package main\nfunc gone() {}\n"
    write(tmp_path, changed)
    files = scan.tree(spark, f"file://{tmp_path}")
    rules = scan.ignore_rules(files)
    full, step = build(files, "repo", "g2", rules), rebuild(index, files, "g2", rules)
    for name in ("files", "observations", "edges"):
        a, b = getattr(full, name), getattr(step, name)
        b = b.select(*a.columns)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name


def test_service(spark, index):
    service = Service(index)
    first = service.search_symbols("f", limit=1)
    assert first["truncated"] and first["cursor"] and first["symbols"][0]["match_kind"] == "exact"
    pages, cursor = [], None
    while True:
        page = service.search_symbols("h", limit=1, cursor=cursor)
        pages += [s["symbol_id"] for s in page["symbols"]]
        cursor = page["cursor"]
        if cursor is None:
            break
    assert pages == [s["symbol_id"] for s in service.search_symbols("h", limit=50)["symbols"]]
    with pytest.raises(RequestError, match="INVALID_CURSOR"):
        service.search_symbols("other", cursor=service.search_symbols("h", limit=1)["cursor"] or "00")
    target = service.search_symbols("other", limit=5)["symbols"][0]
    assert [r["source_path"] for r in service.find_references(target["symbol_id"])["references"]] == ["main.go"]
    assert service.trace_calls(target["symbol_id"])["edges"][0]["source_path"] == "main.go"
    assert "main.go" in service.analyze_impact(paths=["other.go"])["paths"]
    assert service.get_file_outline("other.go")["symbols"][0]["spelling"] == "other"
    for call, code in ((lambda: service.get_symbol("nope"), "SYMBOL_NOT_FOUND"), (lambda: service.get_file_outline("nope"), "FILE_NOT_INDEXED"), (lambda: service.search_symbols(""), "INVALID_ARGUMENT"), (lambda: service.job_status("x"), "JOB_NOT_FOUND")):
        with pytest.raises(RequestError, match=code):
            call()
    row = index.files.filter("relative_path = 'other.go'").first()
    assert service.read_code("other.go", row["content_hash"], 2, 2)["text"] == "func other() {}\n"
    with pytest.raises(RequestError, match="CONTENT_CHANGED"):
        service.read_code("other.go", "0" * 64, 1, 1)
    with pytest.raises(RequestError, match="SOURCE_DELETED"):
        service.read_code("zzz.go", "0" * 64, 1, 1)
    with pytest.raises(RequestError, match="INVALID_ARGUMENT"):
        service.read_code("other.go", row["content_hash"], 2, 9)
    context = service.build_context("helper")
    assert context["snippets"][0]["code"] and context["approximate_tokens"] > 0
    assert service.repository_status()["files"] == index.files.count()


def test_notes(spark, index):
    notes = spark.createDataFrame([("n1", "cold anvil here", "decision", 2, "a", "o", "repo", 1, 5), ("n2", "anvil cold", "decision", 1, "a", "o", "repo", 1, 9)], "id string, body string, kind string, revision long, author string, origin string, scope string, created_at long, updated_at long")
    good = index.files.filter("relative_path = 'other.go'").first()["content_hash"]
    kind = "memory_id string, relative_path string, content_hash string, symbol_id string"
    index.notes, index.evidence = notes, spark.createDataFrame([("n1", "other.go", good, None), ("n2", "other.go", "0", None)], kind)
    service = Service(index)
    assert [n["id"] for n in service.search_memories("anvil")] == ["n1"]
    assert {n["id"]: n["evidence_status"] for n in service.search_memories("anvil", include_stale=True)} == {"n1": "verified", "n2": "stale"}
    assert service.search_memories("cold anvil", include_stale=True)[0]["id"] == "n1"
    write = lambda i, r: spark.createDataFrame([(i, "new body", "decision", "a", "o", "repo", 1, 7, r)], "id string, body string, kind string, author string, origin string, scope string, created_at long, updated_at long, expected_revision long").withColumn("revision", __import__("pyspark").sql.functions.lit(0).cast("long"))
    with pytest.raises(RequestError, match="MEMORY_REVISION_CONFLICT"):
        service.upsert_memory(write("n1", 1))
    assert service.upsert_memory(write("n1", 2))["revision"] == 3
    assert service.upsert_memory(write("n9", None))["outcome"] == "created"
    with pytest.raises(RequestError, match="MEMORY_EVIDENCE_INVALID"):
        service.upsert_memory(write("n8", None), spark.createDataFrame([("n8", "other.go", "1", None)], kind))
    with pytest.raises(RequestError, match="MEMORY_NOT_FOUND"):
        service.forget_memory("zz", 1)
    assert service.forget_memory("n9", 1)["outcome"] == "deleted"


def test_store(spark, index, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    with pytest.raises(RequestError, match="INDEX_NOT_READY"):
        store.active()
    store.write("files", index.files, "g1")
    store.switch("g1")
    store.write("files", index.files.limit(2), "g2")
    assert store.active() == "g1" and store.read("files").count() == index.files.count()
    store.switch("g2")
    assert store.pointer()["previous"] == "g1" and store.read("files").count() == 2
    with pytest.raises(RequestError, match="STORAGE_ERROR"):
        Store(spark, f"file://{tmp_path}/store", "another").pointer()
    backup(index.files, f"file://{tmp_path}/backup")
    with pytest.raises(Exception, match="exists"):
        backup(index.files, f"file://{tmp_path}/backup")
    versions = index.files.drop("generation_id").withColumn("analysis_key", __import__("pyspark").sql.functions.lit("v"))
    for _ in range(2):
        store.append_versions(versions, versions.schema)
    assert spark.read.parquet(f"file://{tmp_path}/store/file_versions").count() == index.files.count()
    store.drop(["g1"], ("files",))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        store.read("files", "g1").count()


def test_smallest_scopes_agree_with_the_reader(index):
    got = {r["id"]: r["scope"] for r in extraction.smallest_scopes(index.observations.filter("category IN ('scope', 'call_site')")).collect()}
    rows = index.observations.filter("category = 'call_site'").collect()
    assert rows and sum(got[r["observation_id"]] == r["scope_id"] for r in rows) >= 0.8 * len(rows)


def test_nested_and_cut_off_files():
    for language in ("rust", "javascript", "java", "go", "csharp", "dart"):
        began = time.time()
        rows, status, notes = extract("fn x() " + "{" * 100_000 + "}" * 100_000, language, "f")
        assert status in ("failed", "partial") and notes and rows and time.time() - began < 10
    assert extract("fn a() {\n  é(\n}", "rust", "f")[2] == [("syntax_error", "( without a partner", 13, 14)]
    assert extract("f();" * 21_000, "javascript", "f")[1:] == ("partial", [("observation_limit_reached", "read up to observation 20000", 79996, 79997)])
    assert [n[0] for n in extract("a " * 200_001, "javascript", "f")[2]] == ["observation_limit_reached", "node_limit_reached"]
    assert [n[0] for n in extract("f(); " * 100, "javascript", "f", -1.0)[2]] == ["time_limit_reached"]
    assert extract("require(" * 60_000, "javascript", "f")[1] in ("failed", "partial")


def test_a_fault_of_the_reader_fails_one_file(spark, monkeypatch):
    df = spark.createDataFrame([("a.rs", "rust", b"fn a() {}"), ("b.rs", "rust", b"\xff"), ("c.xx", "unknown", b"x"), ("d.rs", "rust", None)], "relative_path string, language string, content binary")
    got = {r["relative_path"]: (r["parse_status"], [n["code"] for n in r["notes"]]) for r in extraction.parsed(df).collect()}
    assert got["a.rs"] == ("complete", []) and got["b.rs"] == ("failed", ["invalid_utf8"]) and got["c.xx"][0] == "failed" and got["d.rs"] == ("complete", [])
