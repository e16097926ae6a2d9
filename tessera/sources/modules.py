"""Source trees of modules that import, re-export and hide names: one of each form for every file of the corpus.

A text holds {K}, the number of its tree; so whoever knows the forms knows every import and call that must be resolved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.cluster import spread
from tessera.sources.corpus import PER_FILE, read

#: (path, dialect, text) of each file of a tree.
FORMS = (
    ("ts/m{K}/a.ts", "typescript", "import { f{K} as g } from './b';\nimport pkg from 'pkg{K}';\nimport { h{K} } from './gone';\nexport function run{K}() { g(); h{K}(); }\n"),
    ("ts/m{K}/b.ts", "typescript", "export { f{K} } from './c';\n"),
    ("ts/m{K}/c.ts", "typescript", "export { x{K} as f{K} } from './d';\nexport * from './b';\n"),
    ("ts/m{K}/d.ts", "typescript", "export function x{K}() { return 1; }\nfunction hidden{K}() { return 2; }\n"),
    ("ts/m{K}/e.ts", "typescript", "export * from './d';\n"),
    ("ts/m{K}/u.ts", "typescript", "import { x{K}, hidden{K} } from './e';\nimport * as all from './d';\nexport function use{K}() { x{K}(); hidden{K}(); all.x{K}(); }\n"),
    ("js/m{K}/a.js", "javascript", "const dep = require('./b');\nimport(dep);\nimport './c/index.js';\nexport default class Own{K} { go() { return 1; } }\n"),
    ("js/m{K}/b.js", "javascript", "export const made{K} = () => 1;\n"),
    ("js/m{K}/c/index.js", "javascript", "export function side{K}() { return 1; }\n"),
    ("rs/m{K}/src/lib.rs", "rust", "mod inner;\nuse crate::inner::{deep{K}, kept{K} as other{K}};\nuse serde::Serialize;\npub fn top{K}() { deep{K}(); other{K}(); hid{K}(); mac!(); }\n"),
    ("rs/m{K}/src/inner.rs", "rust", "pub fn deep{K}() {}\npub fn kept{K}() {}\nfn hid{K}() {}\n"),
    ("dart/m{K}/a.dart", "dart", "import 'b.dart' show f{K};\nimport 'c.dart' hide g{K};\nimport 'dart:io';\nvoid run{K}() { f{K}(); g{K}(); h{K}(); _p{K}(); }\n"),
    ("dart/m{K}/b.dart", "dart", "void f{K}() {}\nvoid g{K}() {}\nvoid _p{K}() {}\n"),
    ("dart/m{K}/c.dart", "dart", "void g{K}() {}\nvoid h{K}() {}\n"),
    ("java/m{K}/A.java", "java", "package m{K};\nimport x{K}.B{K};\nimport java.util.List;\nclass A{K} { void one{K}() { two{K}(); B{K}.three{K}(); } void two{K}() {} }\n"),
    ("java/x{K}/B.java", "java", "package x{K};\npublic class B{K} { static void three{K}() {} }\n"),
    ("go/m{K}/a.go", "go", "package m{K}\nimport \"example.org/app/go/n{K}\"\nimport \"os\"\nfunc Run{K}() { n{K}.Help{K}(); near{K}() }\n"),
    ("go/m{K}/b.go", "go", "package m{K}\nfunc near{K}() {}\n"),
    ("go/n{K}/c.go", "go", "package n{K}\nfunc Help{K}() {}\nfunc help{K}() {}\n"),
    ("cs/m{K}/A.cs", "csharp", "using Space{K};\nusing System;\nnamespace App{K} { class A{K} { void One{K}() { Two{K}(); } void Two{K}() {} } }\n"),
    ("cs/m{K}/B.cs", "csharp", "namespace Space{K} { class B{K} { } }\n"),
)
#: Files of many kinds of declarations.
KINDS = (
    ("kinds/k{K}.rs", "rust", "struct S{K}<T> { one: T, pub two: i32 }\nenum E{K} { A, B(i32) }\nunion U{K} { x: u8 }\ntrait T{K} { fn ask{K}(&self); }\nimpl<T> T{K} for S{K}<T> { fn ask{K}(&self) { let v = 1; } }\nmod m{K} { pub const C{K}: i32 = 1; pub static D{K}: i32 = 2; type L{K} = i32; }\nmacro_rules! mac{K} { () => {} }\n#[cfg(test)]\nfn tested{K}() {}\n"),
    ("kinds/k{K}.go", "go", "package kinds\ntype S{K} struct {\n\tOne int\n\t*Base{K}\n}\ntype I{K} interface { Ask{K}(q int) error }\ntype L{K} = S{K}\nfunc (s *S{K}) Run{K}(a, c int) { b := a; _ = b }\nconst C{K} = 1\nvar V{K}, W{K} int\n"),
    ("kinds/K{K}.java", "java", "package kinds;\nimport java.util.*;\nimport static x.Y.z{K};\npublic class F{K}<T> extends B { private int n{K} = 0; F{K}(int c) { n{K} = c; } int run{K}(String a) { int l = 1; return l; } enum C{K} { RED, BLUE; } }\ninterface I{K} { void ask{K}(); }\nrecord R{K}(int x, int y) { }\n"),
    ("kinds/K{K}.cs", "csharp", "using A = B.C;\nnamespace N{K} { public partial class P{K} { private int f{K}; public int Prop{K} { get; set; } public P{K}() { } void M{K}(int a) { var v = a; } } interface I{K} { void Ask{K}(); } struct S{K} { } enum E{K} { One, Two } record R{K}(int X); }\n#if DEBUG\n#endif\n"),
    ("kinds/k{K}.dart", "dart", "library kinds{K};\nexport 'x.dart' show y;\npart 'p.dart';\nclass C{K} { int f{K} = 1; C{K}(); C{K}.named(); factory C{K}.made() { return C{K}(); } int get g{K} => 1; void run{K}(int a) { var v = a; } }\nmixin M{K} { }\nenum E{K} { one, two }\nextension X{K} on C{K} { }\ntypedef T{K} = int;\n"),
    ("kinds/k{K}.ts", "typescript", "export interface I{K} { ask(): void; }\nexport type L{K} = string;\nenum E{K} { A, B }\nnamespace N{K} { export const c{K} = 1; }\nabstract class B{K}<T> { constructor(x: number) { } @Dec() run{K}(a: T) { const v = a; } get g{K}() { return 1; } }\nexport const arrow{K} = (q: number) => q;\nexport { arrow{K} as other{K} };\n"),
    ("kinds/k{K}.jsx", "jsx", "const { a{K}, b{K} } = source;\nmodule.exports = { a{K} };\nexport default function View{K}(props) { return <Item{K} name=\"x\"/>; }\n"),
)
#: The manifest at the root.
GO_MOD = "module example.org/app\n\ngo 1.22\n"


def trees(spark: SparkSession, folder: str) -> DataFrame:
    """k of every tree: a file of the corpus' symbols."""
    return spread(read(spark, folder, "part").select(F.floor(F.col("p_partkey") / PER_FILE).alias("k")), "k").distinct()


def grown(spark: SparkSession, folder: str, rows: tuple[tuple, ...], columns: str) -> DataFrame:
    """The rows once for every tree, with its number for {K}."""
    names = columns.split()
    put = lambda v: F.lit(v) if not isinstance(v, str) else F.replace(F.lit(v), F.lit("{K}"), F.col("k").cast("string"))
    every = F.explode(F.array(*[F.struct(*[put(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows]))
    return trees(spark, folder).select(every.alias("r")).select("r.*")


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """(relative_path, language, content) of all trees."""
    return grown(spark, folder, FORMS, "relative_path language content").withColumn("content", F.encode("content", "UTF-8"))


def manifests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("go.mod", GO_MOD)], "relative_path string, contents string")


def sql_rows(rows: tuple[tuple, ...], columns: str) -> str:
    """The same rows for the oracle, as a query."""
    said = lambda v: "NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
    values = ", ".join(f"({', '.join(map(said, row))})" for row in rows)
    names = columns.split()
    text = {n for i, n in enumerate(names) if any(isinstance(r[i], str) for r in rows)}
    put = ", ".join(f"replace({n}, '{{K}}', k::VARCHAR) AS {n}" if n in text else n for n in names)
    return f"SELECT {put} FROM (VALUES {values}) v({', '.join(names)}), (SELECT DISTINCT p_partkey // {PER_FILE} AS k FROM part) trees"
