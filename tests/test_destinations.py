"""Where imports lead: paths without an ending, and packages of very many files."""

from __future__ import annotations

from tessera.cluster import cut
from tessera.operators import extraction, resolution
from tessera.schema import MANIFESTS


def found(spark, sources: list[tuple]):
    df = spark.createDataFrame([(p, d, bytearray(t.encode())) for p, d, t in sources], "relative_path string, language string, content binary").repartition(4)
    return cut(extraction.observations(extraction.parsed(df))), cut(df.select("relative_path", "language"))


def records(spark) -> int:
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_paths_without_an_ending_equal_all_that_are_tried(spark):
    files = ["a.ts", "a.d.ts", "a/index.js", "a/index.d.ts", "a.test.ts", "a.test", "b", "b.tsx", "b/index.ts/index.mjs", "c.rs", "c.rs.ts", "index.ts", "d/index", "d/index.cjs", "e.d", "e.d.ts"]
    asked = ["./a", "./a.ts", "./a.test", "./b", "./b/index", "./b/index.ts", "./c.rs", "./c", "./index", ".", "./d", "./d/index", "./e", "./e.d", "../../a", "./gone"]
    observations, have = found(spark, [(f"s/{f}", "typescript", "let x = 1;\n") for f in files] + [("s/main.ts", "typescript", "".join(f"import x{i} from '{a}';\n" for i, a in enumerate(asked)))])
    before = records(spark)
    rows = resolution.destinations(observations, have, spark.createDataFrame([], MANIFESTS)).collect()
    assert records(spark) - before < 16 * len(asked)  # 17 endings of each path are not exchanged
    want = set()
    for a in asked:
        base = "/".join(["s", a.removeprefix("./")]) if a != "." else "s"
        tried = [base] + ([] if "." in base.rsplit("/", 1)[-1] else [f"{base}{s}.{e}" for s in ("", "/index") for e in resolution.ECMA_EXTENSIONS])
        hits = [] if a.startswith("..") else [f"s/{f}" for f in files if f"s/{f}" in tried]
        want |= {(a, h) for h in hits} or {(a, None)}
    assert sorted(((r["spelling"], r["target_path"]) for r in rows), key=str) == sorted(want, key=str)


def test_every_file_of_a_large_package_is_a_destination(spark):
    """1,100 files of a package and of a namespace: more than a search for a name looks at."""
    java = [(f"p/F{i}.java", "java", f"package p;\nclass F{i} {{ }}\n") for i in range(1_100)]
    go = [(f"g/f{i}.go", "go", f"package g\nfunc F{i}() {{}}\n") for i in range(1_030)]
    observations, have = found(spark, [*java, *go, ("Main.java", "java", "import p.*;\nclass Main { }\n"), ("main.go", "go", 'package main\nimport "example.org/g"\n')])
    manifests = spark.createDataFrame([("go.mod", "module example.org\n")], MANIFESTS)
    rows = {(r["relative_path"], r["outcome"]): r["n"] for r in resolution.destinations(observations, have, manifests).groupBy("relative_path", "outcome").agg({"target_path": "count"}).withColumnRenamed("count(target_path)", "n").collect()}
    assert rows == {("Main.java", "local"): 1_100, ("main.go", "local"): 1_030}
    bounded = resolution.destinations(observations, have, manifests, whole=False)
    assert sorted((r["relative_path"], r["total"]) for r in bounded.select("relative_path", "total").distinct().collect()) == [("Main.java", 1_100), ("main.go", 1_030)] and bounded.count() == 2 * resolution.NODES
