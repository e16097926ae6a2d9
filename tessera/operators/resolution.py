"""Name resolution: observations of source files to edges with evidence.

Containment and scope chains are one pass over each file with the open ranges on a stack; all other rules are joins on
keys: bindings are joins on (file, name, scope) with a rank over the distance.
Stages of an occurrence fall back by rank, not by control flow, so every stage runs once over all files.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.cluster import cut
from tessera.functions import kinds as K
from tessera.functions.text import content_id, last_segment, normalized_path, parent_path
from tessera.operators.nesting import Open, by_file
from tessera.schema import EDGES, EXTERNALS, RELATIONSHIPS

#: Candidates kept of a site, depth, places and steps of a search through re-exports, scopes of a chain, diagnostics kept.
CANDIDATES, REEXPORTS, NODES, STEPS, CHAIN, DIAGNOSTICS = 32, 16, 1024, 4096, 512, 1024
ECMA_EXTENSIONS = ("js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts", "d.ts")
SITE = ("source_path", "source_category", "source_observation_id")
#: Edges of no generation yet.
EDGE_ROWS = T.StructType([f for f in EDGES.fields if f.name != "generation_id"])


def of(observations: DataFrame, category: str, prefix: str, *columns: str) -> DataFrame:
    rows = observations.filter(F.col("category") == category)
    return rows.select(*[F.col(c).alias(f"{prefix}{c}") for c in columns or observations.columns])


def _ranges(rows: list[dict], category: str, kinds: tuple[str, ...] | None = None) -> Open:
    """The syntax ranges of a file's rows; of equal sizes the first in source order is smaller."""
    return Open([(r["syntax_start_byte"], r["syntax_end_byte"], (r["start_byte"], r["observation_id"]), r) for r in rows if r["category"] == category and (kinds is None or r["kind"] in kinds)])


def containment(observations: DataFrame) -> DataFrame:
    """(path, child, container): the smallest declaration around the name of each declaration.

    Of equally small ones, the first in source order. A pass over each file, with the open declarations on a stack.
    """

    def each(rows: list[dict]) -> Iterator[tuple]:
        outer, said = _ranges(rows, "symbol", K.CONTAINER), set()
        for c in sorted((r for r in rows if r["category"] == "symbol"), key=lambda r: r["start_byte"]):
            outer.move(c["start_byte"])
            o = next((r[3] for r in outer.around(c["start_byte"], c["end_byte"]) if r[3]["observation_id"] != c["observation_id"]), None)
            if o is not None and (pair := (c["observation_id"], o["observation_id"])) not in said:
                said.add(pair)
                yield c["relative_path"], *pair, o["start_byte"], o["end_byte"], c["syntax_start_byte"], c["syntax_end_byte"]

    text, number = pa.string(), pa.int64()
    return by_file(observations.filter("category = 'symbol'"), each, "relative_path string, child_id string, container_id string, start_byte long, end_byte long, from long, to long", [text, text, text, number, number, number, number])


def enclosing(observations: DataFrame, categories: tuple[str, ...] = ("import", "reference", "call_site")) -> DataFrame:
    """(path, category, id, symbol): the smallest callable or type around each occurrence."""

    def each(rows: list[dict]) -> Iterator[tuple]:
        outer = _ranges(rows, "symbol", K.CALLABLE_CONTAINER)
        for c in sorted((r for r in rows if r["category"] in categories), key=lambda r: r["start_byte"]):
            outer.move(c["start_byte"])
            o = next(outer.around(c["start_byte"], c["end_byte"]), None)
            if o is not None:
                yield c["relative_path"], c["category"], c["observation_id"], o[3]["observation_id"]

    held = F.col("category").isin(*categories) | ((F.col("category") == "symbol") & F.col("kind").isin(*K.CALLABLE_CONTAINER))
    return by_file(observations.filter(held), each, "e_path string, e_category string, e_id string, source_symbol_id string", [pa.string()] * 4)


def scope_chains(observations: DataFrame) -> DataFrame:
    """(path, scope, ancestor, distance), each scope its own ancestor at distance 0, up to the file.

    Scopes are nodes of a syntax tree, so the scopes around one nest, and the chain is their list by size: of those of
    one range, one stands in it, not the file if there is another.
    """

    def each(rows: list[dict]) -> Iterator[tuple]:
        scopes = [r for r in rows if r["category"] == "scope"]
        outer = Open([(r["syntax_start_byte"], r["syntax_end_byte"], (r["kind"] == "file", r["observation_id"]), r) for r in scopes])
        for s in sorted(scopes, key=lambda r: r["syntax_start_byte"]):
            yield s["relative_path"], s["observation_id"], s["observation_id"], 0
            if s["kind"] == "file":
                continue
            a, b = s["syntax_start_byte"], s["syntax_end_byte"]
            outer.move(a)
            distance, last = 0, (a, b, False)
            for x, y, (is_file, own), _ in outer.around(a, b):
                if (x, y, is_file) == last or own == s["observation_id"]:
                    continue
                distance, last = distance + 1, (x, y, is_file)
                if distance >= CHAIN:
                    break
                yield s["relative_path"], s["observation_id"], own, distance

    return by_file(observations.filter("category = 'scope'"), each, "relative_path string, scope_id string, ancestor_id string, distance int", [pa.string(), pa.string(), pa.string(), pa.int32()])


def declared_modules(observations: DataFrame, files: DataFrame) -> DataFrame:
    """(path, language, module): the first namespace of a C# file, the first package declaration of any other."""
    first = lambda df: df.groupBy("relative_path").agg(F.min_by("spelling", F.struct("start_byte", "observation_id")).alias("module"))
    spaces = first(observations.filter("category = 'symbol' AND kind = 'namespace'")).withColumn("csharp", F.lit(True))
    packages = first(observations.filter("category = 'import' AND kind = 'package'")).withColumn("csharp", F.lit(False))
    rows = spaces.unionByName(packages).withColumnRenamed("relative_path", "m_path")
    return files.join(rows, (F.col("relative_path") == F.col("m_path")) & (F.col("csharp") == (F.col("language") == "csharp"))).select("relative_path", "language", "module")


def manifests_of(manifests: DataFrame) -> DataFrame:
    """(kind, directory, name) of the module line of go.mod and the name line of pubspec.yaml."""
    path, body = F.col("relative_path"), F.col("contents")
    go, dart = path.endswith("go.mod"), path.endswith("pubspec.yaml")
    name = F.when(go, F.regexp_extract(body, r"(?m)^[ \t]*module [ \t]*(\S+)[ \t\r]*$", 1)).when(dart, F.regexp_extract(body, r"(?m)^[ \t]*name:[ \t]*[\"']*([^\s\"']+)[\"']*[ \t\r]*$", 1))
    return manifests.select(F.when(go, "go").otherwise("dart").alias("kind"), parent_path(path).alias("directory"), name.alias("name")).filter("name <> ''")


def _joined(directory: Column, rest: Column) -> Column:
    return normalized_path(F.when(directory == "", rest).otherwise(F.concat(directory, F.lit("/"), rest)))


def destinations(observations: DataFrame, files: DataFrame, manifests: DataFrame, whole: bool = True) -> DataFrame:
    """One row for each import and file that it leads to; or one row that tells why there is none.

    (path, import, outcome, rule, target_path, node_kind, total): outcome is local, external or unresolved. If not whole, the first
    NODES files by path of a package or namespace have rows, as a search for a name looks at no more; total counts all of them, and is null elsewhere.
    """
    lang = files.select(F.col("relative_path").alias("f_path"), "language")
    imports = of(observations, "import", "").filter(~F.col("kind").isin("package", "library"))
    rows = imports.join(lang, F.col("relative_path") == F.col("f_path")).drop("f_path")
    spec, path = F.col("spelling"), F.col("relative_path")
    dynamic = K.has(F.col("attributes"), "dynamic_specifier") | (spec == "<missing>")
    ecma, root = F.col("language").isin(*K.ECMASCRIPT), parent_path(path)
    base = _joined(root, spec)
    plain = ~F.element_at(F.split(base, "/"), -1).rlike(r"[^.]\.[^./]*$")
    tried = lambda exts: F.when(plain, F.concat(F.array(base), *[F.array(F.concat(base, F.lit(f"{s}.{e}"))) for s in ("", "/index") for e in exts])).otherwise(F.array(base))
    parts = F.split(spec, "::")
    local_root = parts[0].isin("crate", "self", "super")
    rest = F.when(parts[0] == "super", F.filter(parts, lambda p: p != "super")).when(local_root, F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    modules = F.when(F.size(rest) > 1, F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(1)))).otherwise(K.strings())
    roots = _crate_roots(files)
    rows = rows.join(roots.hint("merge"), F.col("relative_path") == F.col("r_path"), "left").drop("r_path")
    start = F.when(parts[0] == "crate", F.coalesce("crate_root", root)).when(parts[0] == "super", parent_path(root)).otherwise(root)
    module_path = _joined(start, F.array_join(modules, "/"))
    rust = F.when(F.size(rest) == 0, K.strings()).when(F.size(modules) == 0, F.array(path)).otherwise(F.array(F.concat(module_path, F.lit(".rs")), F.concat(module_path, F.lit("/mod.rs"))))
    package = F.regexp_extract(spec, r"^package:([^/]+)/(.+)$", 1)
    named = manifests_of(manifests)
    dart_dirs = F.broadcast(named.filter("kind = 'dart'").groupBy(F.col("name").alias("d_name")).agg(F.min("directory").alias("d_dir")))  # of root manifests
    rows = rows.join(dart_dirs, (F.col("language") == "dart") & (package == F.col("d_name")), "left")
    dart = F.when(spec.startswith("package:"), F.when(F.col("d_dir").isNotNull(), F.array(_joined(F.col("d_dir"), F.concat(F.lit("lib/"), F.regexp_extract(spec, r"^package:[^/]+/(.+)$", 1)))))).when(~spec.startswith("dart:"), tried(("dart",)))
    candidates = F.when(dynamic, K.strings()).when(ecma, F.when(spec.startswith("."), F.array(base))).when(F.col("language") == "dart", dart).when(F.col("language") == "rust", rust)
    keyed = cut(rows.withColumns({"dynamic": dynamic, "local_root": local_root, "candidates": F.coalesce(candidates, K.strings()), "open": ecma & plain}).drop("r_path", "crate_root", "d_name"))
    key = ("relative_path", "observation_id")
    # an ECMAScript path without an ending is met by the files that may be meant, under what is left of their paths, instead of being tried with every ending
    own = F.col("relative_path")
    short = [F.when(own.endswith(end), F.expr(f"left(relative_path, length(relative_path) - {len(end)})")) for end in (f"{s}.{e}" for s in ("", "/index") for e in ECMA_EXTENSIONS)]
    names = files.select(own.alias("target_path"), F.explode(F.array_distinct(F.filter(F.array(own, *short), lambda n: n.isNotNull()))).alias("candidate"))
    by_path = keyed.select(*key, "open", F.explode(F.array_distinct("candidates")).alias("candidate")).join(names, "candidate").filter((F.col("candidate") == F.col("target_path")) | F.col("open")).select(*key, "target_path")
    # Rust: a module of that name inside the same file
    inline = keyed.filter("language = 'rust'").select(*key, F.get(F.filter(parts, lambda p: ~p.isin("crate", "self", "super")), 0).alias("inline"))
    inside = of(observations, "symbol", "i_", "relative_path", "kind", "spelling").filter("i_kind = 'module'").select("i_relative_path", "i_spelling").distinct()
    inline = inline.join(by_path, list(key), "left_anti").join(inside, (F.col("relative_path") == F.col("i_relative_path")) & (F.col("inline") == F.col("i_spelling"))).select(*key, F.col("relative_path").alias("target_path"))
    # Go: the files of the directory that the module prefix leads to
    go_names = F.broadcast(named.filter("kind = 'go'").select(F.col("name").alias("g_name"), F.col("directory").alias("g_dir")))  # of root manifests
    go = keyed.filter("language = 'go'").join(go_names, (spec == F.col("g_name")) | spec.startswith(F.concat("g_name", F.lit("/"))))
    suffix = F.regexp_replace(F.expr("substring(spelling, length(g_name) + 1)"), "^/+", "")
    go = go.withColumn("g_target", F.when(suffix == "", F.col("g_dir")).otherwise(F.coalesce(_joined(F.col("g_dir"), suffix), F.col("g_dir"))))
    go_files = files.filter("language = 'go'").select(F.col("relative_path").alias("target_path"), parent_path(F.col("relative_path")).alias("g_parent"))
    by_go, go_sums = _members(go.select(*key, F.col("g_target").alias("group")), go_files.select(F.col("g_parent").alias("group"), "target_path"), ("group",), whole)
    # Java and C#: the files that declare the package or namespace
    owner = F.when(F.col("language") == "csharp", F.regexp_replace(spec, r"(\.\*)+$", "")).when(K.has(F.col("attributes"), "wildcard_import"), spec).otherwise(F.regexp_extract(spec, r"^(.*)\.[^.]*$", 1))
    spaces = declared_modules(observations, files).select(F.col("relative_path").alias("target_path"), F.col("language").alias("s_language"), "module")
    by_space, space_sums = _members(keyed.filter(F.col("language").isin("java", "csharp")).select(*key, F.col("language").alias("s_language"), owner.alias("module")), spaces, ("s_language", "module"), whole)
    sums = go_sums.unionByName(space_sums).withColumnsRenamed({"relative_path": "n_path", "observation_id": "n_id"})
    found = reduce(DataFrame.unionByName, [by_path, inline, by_go, by_space]).distinct().withColumnsRenamed({"relative_path": "t_path", "observation_id": "t_id"})
    go_known = go.select(*key).distinct().withColumn("go_known", F.lit(True)).withColumnsRenamed({"relative_path": "k_path", "observation_id": "k_id"})
    out = keyed.join(found, (F.col("relative_path") == F.col("t_path")) & (F.col("observation_id") == F.col("t_id")), "left").join(go_known, (F.col("relative_path") == F.col("k_path")) & (F.col("observation_id") == F.col("k_id")), "left")
    out = out.join(sums, (F.col("relative_path") == F.col("n_path")) & (F.col("observation_id") == F.col("n_id")), "left")
    language, relative = F.col("language"), spec.startswith(".")
    external = (
        F.when(ecma & ~relative, "package")
        .when((language == "dart") & spec.startswith("dart:"), "sdk_library")
        .when((language == "dart") & spec.contains("/") & spec.startswith("package:") & F.col("d_dir").isNull(), "package")
        .when((language == "rust") & ~F.col("local_root"), "crate")
        .when((language == "go") & F.col("go_known").isNull(), "go_package")
        .when(language == "java", "java_package")
        .when(language == "csharp", "dotnet_namespace")
    )
    local_rule = (
        F.when(ecma, "ecmascript-relative-module-v1")
        .when((language == "dart") & spec.startswith("package:"), "dart-package-manifest-v1")
        .when(language == "dart", "dart-relative-library-v1")
        .when(language == "rust", "rust-module-path-v1")
        .when(language == "go", "go-module-manifest-v1")
        .when(language == "java", "java-declared-package-v1")
        .when(language == "csharp", "csharp-declared-namespace-v1")
    )
    external_rule = (
        F.when(ecma, "ecmascript-external-package-v1")
        .when((language == "dart") & spec.startswith("dart:"), "dart-sdk-library-v1")
        .when(language == "dart", "dart-external-package-v1")
        .when(language == "rust", "rust-external-crate-v1")
        .when(language == "go", "go-external-package-v1")
        .when(language == "java", "java-external-classpath-v1")
        .when(language == "csharp", "csharp-external-namespace-v1")
    )
    outcome = F.when(F.col("dynamic"), "unresolved").when(F.col("target_path").isNotNull(), "local").when(external.isNotNull(), "external").otherwise("unresolved")
    code = F.when(F.col("dynamic"), "dynamic_module_specifier").when((language == "dart") & spec.rlike("^package:[^/]*$"), "invalid_package_uri").when(local_rule.isNull(), "unsupported_language_rule").otherwise("local_module_not_found")
    out = out.withColumn("outcome", outcome)
    return out.select(*imports.columns, "language", "outcome", F.when(F.col("outcome") == "local", F.col("target_path")).alias("target_path"), F.when(F.col("outcome") == "external", external).alias("node_kind"), F.when(F.col("outcome") == "local", local_rule).when(F.col("outcome") == "external", external_rule).otherwise("unsupported-import-v1").alias("rule"), F.when(F.col("outcome") == "unresolved", code).alias("code"), F.when(F.col("outcome") == "local", F.col("total")).alias("total"))


def _members(asked: DataFrame, members: DataFrame, group: tuple[str, ...], whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(targets, totals): the files of the groups that imports name, and how many there are in all: every file, or the first NODES of each group by path.

    No search for a name looks at more than these, so its imports meet NODES rows of a group at most, however large it is.
    """
    members = members.distinct()
    first = members if whole else members.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("target_path"))).filter(F.col("place") <= NODES)
    key = ("relative_path", "observation_id")
    asked = asked.distinct()
    sizes = members.groupBy(*group).agg(F.count(F.lit(1)).alias("size"))
    return asked.join(first.hint("merge"), list(group)).select(*key, "target_path"), asked.join(sizes.hint("merge"), list(group)).groupBy(*key).agg(F.sum("size").alias("total"))


def _crate_roots(files: DataFrame) -> DataFrame:
    """(path, crate_root) of Rust files: the nearest directory above with a lib.rs or main.rs."""
    rust = files.filter("language = 'rust'").select(F.col("relative_path").alias("r_path"))
    parts = F.split(parent_path(F.col("r_path")), "/")
    above = F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dir"), i.alias("depth"))), F.array(F.struct(F.lit("").alias("dir"), F.lit(0).alias("depth"))))
    heads = rust.filter(F.col("r_path").rlike(r"(^|/)(lib|main)\.rs$")).select(parent_path(F.col("r_path")).alias("head")).distinct()
    return rust.select("r_path", F.explode(above).alias("a")).join(heads, F.col("a.dir") == F.col("head")).groupBy("r_path").agg(F.max_by("head", F.col("a.depth")).alias("crate_root"))


def _module_level(observations: DataFrame) -> DataFrame:
    """Declarations with `top`: whether they stand in no scope, or in that of a file, namespace or module."""
    scopes = of(observations, "scope", "s_", "relative_path", "observation_id", "kind").filter(F.col("s_kind").isin(*K.MODULE_SCOPE)).select("s_relative_path", "s_observation_id").distinct()
    rows = of(observations, "symbol", "")
    joined = rows.join(scopes, (F.col("relative_path") == F.col("s_relative_path")) & (F.col("scope_id") == F.col("s_observation_id")), "left")
    return joined.withColumn("top", F.col("scope_id").isNull() | F.col("s_observation_id").isNotNull()).drop("s_relative_path", "s_observation_id")


def _declarations(observations: DataFrame, files: DataFrame) -> DataFrame:
    lang = files.select(F.col("relative_path").alias("f_path"), F.col("language").alias("d_language"))
    rows = _module_level(observations).join(lang, F.col("relative_path") == F.col("f_path"))
    names = ("relative_path", "observation_id", "kind", "spelling", "start_byte", "scope_id", "signature", "attributes", "top")
    return rows.select("d_language", *[F.col(c).alias(f"d_{c}") for c in names])


def _need() -> Column:
    """What a use asks of a declaration, as bits: a type, a value, something callable, a member instead of a name of the module level."""
    asks = (K.has(F.col("o_attributes"), "role:type"), K.has(F.col("o_attributes"), "role:value"), F.col("category") == "call_site", F.col("uncertain"))
    return reduce(Column.__add__, [F.when(a, 1 << i).otherwise(0) for i, a in enumerate(asks)])


def _meets(need: Column) -> Column:
    asks = lambda i: need.bitwiseAND(F.lit(1 << i)) != 0
    level = F.when(asks(3), F.col("d_kind").isin(*K.MEMBER)).otherwise(F.col("d_top"))
    return K.roles_fit(asks(0), asks(1), F.col("d_attributes"), F.col("d_kind")) & (~asks(2) | F.col("d_kind").isin(*K.CALLABLE)) & level


def elsewhere(uses: DataFrame, declared: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """uses with `total` and `first`: how many declarations in other files meet a use, and CANDIDATES of them, the first in source order.

    Declarations are counted and cut by key and need before a use meets them, so each use is joined with one row however common
    its name is. A file adds CANDIDATES to a list at most and a list holds twice as many, so it is still whole without the use's own file.
    uses: key, need, source_path; declared: key and the columns of a declaration. Uses that nothing meets are left out.
    """
    group, file = [*key, "need"], [*key, "need", "d_relative_path"]
    in_file = ("d_start_byte", "d_observation_id")
    fitting = declared.join(uses.select(*group).distinct(), list(key)).filter(_meets(F.col("need")))  # 16 needs of a key at most
    by_file = fitting.groupBy(*file).agg(F.count(F.lit(1)).alias("own"))
    whole = by_file.groupBy(*group).agg(F.sum("own").alias("all"))
    kept = fitting.withColumn("place", F.row_number().over(Window.partitionBy(*file).orderBy(*in_file))).filter(F.col("place") <= CANDIDATES)
    kept = kept.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("d_relative_path", *in_file))).filter(F.col("place") <= 2 * CANDIDATES)
    lists = kept.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("d_relative_path", *in_file))).alias("first"))
    met = uses.join(lists.join(whole, group), group).join(by_file.withColumnRenamed("d_relative_path", "source_path"), [*group, "source_path"], "left")
    others = F.slice(F.filter("first", lambda d: d["d_relative_path"] != F.col("source_path")), 1, CANDIDATES)
    return met.withColumn("total", F.col("all") - F.coalesce("own", F.lit(0))).withColumn("first", others).filter("total > 0").drop("all", "own")


def closure(searches: DataFrame, steps: DataFrame, depth: int = REEXPORTS, nodes: int = NODES, most: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """(reached, limits): the files and names that each search comes to through re-exports, breadth first, each once.

    searches: root_file, root_name. steps: x_path, x_start, x_id, x_alias, x_attributes, x_language, target.
    A search is a queue: re-exports of a file follow in source order, each counts as one of `most` steps, also if it leads to
    a known place, and each new place as one of `nodes`. What is past a bound is left and told in limits (root_file, root_name,
    file, code). Counters and positions are columns of the open places, so all searches go on together, one level a round.
    reached: root_file, root_name, file, name, level.
    """
    root, place = ("root_file", "root_name"), ("root_file", "root_name", "file", "name")
    whole, steps = Window.partitionBy(*root), cut(steps)
    open_ = cut(searches.select(*root).distinct().select(*root, F.col("root_file").alias("file"), F.col("root_name").alias("name"), *[F.lit(n).alias(c) for c, n in (("level", 0), ("position", 1), ("nodes", 1), ("steps", 0))]))
    reached, limits = [open_.select(*place, "level")], []

    def limit(df: DataFrame, code: str) -> None:
        limits.append(df.select(*root, "file", F.lit(f"import_{code}_limit_reached").alias("code")))

    for level in range(1, depth + 2):
        if steps.isEmpty() or open_.isEmpty():
            break
        ways = open_.join(steps, F.col("file") == F.col("x_path"))
        ways = ways.filter(((F.col("x_language") != "dart") | K.combinators_allow(F.col("x_attributes"), F.col("name"))) & (F.col("x_alias").isNull() | (F.col("x_alias") == F.col("name"))))
        order = whole.orderBy("position", "x_start", "x_id", "target")
        ways = ways.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most + 1).withColumn("n", F.col("n") + F.col("steps")).filter(F.col("n") <= most + 1)
        ways = cut(ways.select(*root, "file", "nodes", "n", "target", F.coalesce(K.attribute(F.col("x_attributes"), "local:"), "name").alias("local")))
        limit(ways.filter(F.col("n") > most), "edge")
        taken = ways.filter(F.col("n") <= most).withColumn("steps", F.max("n").over(whole))
        new = taken.groupBy(*root, F.col("target").alias("file"), F.col("local").alias("name")).agg(F.min(F.struct("n", F.col("file").alias("by"))).alias("first"), F.max("nodes").alias("nodes"), F.max("steps").alias("steps"))
        new = new.join(reduce(DataFrame.unionByName, reached).select(*place), list(place), "left_anti").withColumn("position", F.row_number().over(whole.orderBy("first.n"))).withColumn("node", F.col("nodes") + F.col("position"))
        if level > depth:
            limit(new.select(*root, F.col("first.by").alias("file")), "depth")
            break
        new = cut(new.filter(F.col("node") <= nodes + 1).withColumn("nodes", F.max(F.least("node", F.lit(nodes))).over(whole)))
        limit(new.filter(F.col("node") > nodes).select(*root, F.col("first.by").alias("file")), "node")
        open_ = new.filter(F.col("node") <= nodes).select(*place, F.lit(level).alias("level"), "position", "nodes", "steps")
        reached.append(open_.select(*place, "level"))
    none = open_.filter(F.lit(False)).select(*root, "file", F.lit("").alias("code"))
    return reduce(DataFrame.unionByName, reached), reduce(DataFrame.unionByName, limits, none).distinct()


def exported(requests: DataFrame, observations: DataFrame, files: DataFrame, dests: DataFrame, decl: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, limits): declarations that files give out under a name, also through re-exports of re-exports.

    requests: SITE, category, o_attributes, file, name, rule. What a search comes to depends on file and name alone: all
    requests of one share it, and differ in what fits them. limits: source_path, code, message.
    """
    decl = _declarations(observations, files) if decl is None else decl
    lang = files.select(F.col("relative_path").alias("l_path"), F.col("language").alias("x_language"))
    exports = observations.filter("category = 'import' AND kind IN ('reexport', 'export')").select(*[F.col(c).alias(n) for c, n in (("relative_path", "x_path"), ("observation_id", "x_id"), ("kind", "x_kind"), ("start_byte", "x_start"), ("spelling", "x_spelling"), ("alias", "x_alias"), ("attributes", "x_attributes"))])
    exports = exports.join(lang, F.col("x_path") == F.col("l_path")).drop("l_path").withColumn("plain", (F.col("x_kind") == "export") & (F.col("x_language") != "dart"))
    targets = dests.filter("outcome = 'local'").select(F.col("relative_path").alias("t_path"), F.col("observation_id").alias("t_id"), F.col("target_path").alias("target"))
    steps = exports.filter("NOT plain").join(targets, (F.col("x_path") == F.col("t_path")) & (F.col("x_id") == F.col("t_id")))
    site = [*SITE, "category", "o_attributes"]
    asked = cut(requests.select(*site, F.col("file").alias("root_file"), F.col("name").alias("root_name"), "rule"))
    reached, limits = closure(asked, steps.select("x_path", "x_start", "x_id", "x_alias", "x_attributes", "x_language", "target"))
    declared = (F.col("file") == F.col("d_relative_path")) & (F.col("wanted") == F.col("d_spelling"))
    given = ["root_file", "root_name", "d_relative_path", "d_observation_id", "d_start_byte", "d_kind", "d_attributes", "open", "own_rule", "evidence"]
    visible = K.module_visible(F.col("d_language"), F.col("d_attributes"), F.col("d_spelling"), F.col("d_signature"))
    own = reached.withColumn("wanted", F.col("name")).join(decl, declared).filter(visible).withColumn("open", (F.col("d_language") == "rust") | F.col("d_top"))
    own = own.withColumn("own_rule", F.when(F.col("level") > 0, "bounded-reexport-v1")).withColumn("evidence", F.array(F.concat(F.lit("export_name:"), "name"), F.concat(F.lit("module:"), "file")))
    named = reached.join(exports.filter("plain"), F.col("file") == F.col("x_path")).filter(F.coalesce("x_alias", "x_spelling") == F.col("name"))
    named = named.withColumn("wanted", F.coalesce(K.attribute(F.col("x_attributes"), "local:"), "x_spelling")).join(decl, declared).filter("d_top").withColumn("open", F.lit(True))
    named = named.withColumn("own_rule", F.lit("local-export-v2")).withColumn("evidence", F.array(F.concat(F.lit("export_name:"), "name"), F.concat(F.lit("local_name:"), "wanted")))
    fits = K.role_compatible(F.col("o_attributes"), F.col("d_attributes"), F.col("d_kind")) & ((F.col("category") != "call_site") | F.col("d_kind").isin(*K.CALLABLE))
    found = asked.join(own.select(*given).unionByName(named.select(*given)), ["root_file", "root_name"]).filter(fits & (F.col("open") | K.has(F.col("o_attributes"), "static_import")))
    found = found.select(*site, "d_relative_path", "d_observation_id", "d_start_byte", F.coalesce("own_rule", "rule").alias("rule"), "evidence")
    told = asked.select("source_path", "root_file", "root_name").distinct().join(limits, ["root_file", "root_name"]).select("source_path", "code", F.concat_ws("#", "root_file", "root_name").alias("message"))
    return found, told.distinct()


def occurrences(observations: DataFrame, files: DataFrame, categories: tuple[str, ...] = ("reference", "call_site")) -> DataFrame:
    """References and calls with their name, qualifier, and whether they are dynamic or of an uncertain receiver."""
    lang = files.select(F.col("relative_path").alias("f_path"), "language")
    rows = observations.filter(F.col("category").isin(*categories)).join(lang, F.col("relative_path") == F.col("f_path"))
    return rows.select(
        F.col("relative_path").alias("source_path"), F.col("category").alias("source_category"), F.col("observation_id").alias("source_observation_id"), "category", "language",
        F.col("start_byte").alias("o_start"), F.col("end_byte").alias("o_end"), F.col("scope_id").alias("o_scope"), F.col("attributes").alias("o_attributes"), F.col("limitations").alias("o_limitations"),
        last_segment(F.col("spelling")).alias("name"), F.coalesce(K.qualifier(F.col("spelling")), F.col("receiver")).alias("qualifier"),
        K.is_dynamic(F.col("attributes"), F.col("limitations")).alias("dynamic"), K.uncertain_receiver(F.col("spelling"), F.col("receiver"), F.col("limitations")).alias("uncertain"),
    )


def _chained(occ: DataFrame, observations: DataFrame) -> DataFrame:
    """Occurrences with each scope of their chain; one without a known scope sees the file's."""
    chains = scope_chains(observations).withColumnsRenamed({"relative_path": "h_path", "scope_id": "h_scope"})
    known = occ.join(chains, (F.col("source_path") == F.col("h_path")) & (F.col("o_scope") == F.col("h_scope")), "left").drop("h_path", "h_scope")
    whole = of(observations, "scope", "w_", "relative_path", "observation_id", "kind").filter("w_kind = 'file'")
    lost = known.filter("ancestor_id IS NULL").drop("ancestor_id", "distance").join(whole, F.col("source_path") == F.col("w_relative_path")).withColumn("ancestor_id", F.col("w_observation_id")).withColumn("distance", F.lit(0)).drop("w_relative_path", "w_observation_id", "w_kind")
    return known.filter("ancestor_id IS NOT NULL").unionByName(lost)


def bindings(occ: DataFrame, decl: DataFrame, observations: DataFrame, files: DataFrame, dests: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(candidates, limits) of every occurrence that is not dynamic, from the first stage that has any. dests: none where nothing is imported.

    Stage 0: the nearest scope with the name, ties kept; for uncertain receivers, members of the file. Stage 1: the
    nearest imports that give the name. Stage 2: other files of the same package or namespace, where `total` counts all and
    the rows are the first CANDIDATES; elsewhere the rows are all. Those of uncertain receivers say so, whatever stage they are of.
    """
    occ = occ.filter("NOT dynamic")
    fits = K.role_compatible(F.col("o_attributes"), F.col("d_attributes"), F.col("d_kind")) & ((F.col("category") != "call_site") | F.col("d_kind").isin(*K.CALLABLE))
    site = [*SITE, "category", "o_attributes"]
    out = [*site, "d_relative_path", "d_observation_id", "d_start_byte", "rule", "evidence"]

    def stage(df: DataFrame, n: int) -> DataFrame:
        total = F.col("total") if "total" in df.columns else F.lit(None)
        return df.select(*out, total.cast("long").alias("total"), F.lit(n).alias("stage"))

    def unsure(df: DataFrame) -> DataFrame:
        told = F.concat("evidence", K.strings("receiver_type_not_inferred"))
        return df.withColumns({"rule": F.when(F.col("uncertain"), "receiver-name-candidate-v1").otherwise(F.col("rule")), "evidence": F.when(F.col("uncertain"), told).otherwise(F.col("evidence"))})

    nearest = Window.partitionBy(*SITE).orderBy("distance")
    chained = cut(_chained(occ.select(*site, "language", "o_start", "o_scope", "name", "qualifier", "uncertain"), observations).drop("o_scope"))
    lexical = chained.filter("NOT uncertain").join(decl, (F.col("source_path") == F.col("d_relative_path")) & (F.col("name") == F.col("d_spelling")) & (F.col("ancestor_id") == F.col("d_scope_id")))
    lexical = lexical.filter(fits & ~(F.col("d_kind").isin(*K.ORDER_SENSITIVE) & (F.col("d_start_byte") > F.col("o_start")))).withColumn("place", F.rank().over(nearest)).filter("place = 1")
    lexical = lexical.withColumn("rule", F.lit("lexical-scope-v1")).withColumn("evidence", F.array(F.concat(F.lit("scope_distance:"), F.col("distance").cast("string")), F.concat(F.lit("name:"), "name")))
    member = occ.filter("uncertain").join(decl, (F.col("source_path") == F.col("d_relative_path")) & (F.col("name") == F.col("d_spelling"))).filter(fits & F.col("d_kind").isin(*K.MEMBER))
    member = member.withColumn("rule", F.lit("receiver-name-candidate-v1")).withColumn("evidence", F.array(F.concat(F.lit("member_name:"), "name")))
    stages, limits = [stage(lexical, 0), stage(unsure(member), 0)], None
    if dests is not None:
        imports = dests.filter("kind <> 'export'").select(F.col("relative_path").alias("i_path"), F.col("observation_id").alias("i_id"), F.col("scope_id").alias("i_scope"), F.col("attributes").alias("i_attributes"), F.col("alias").alias("i_alias"), F.col("spelling").alias("i_spelling"), "outcome", "target_path", F.col("rule").alias("rule"))
        near = chained.join(imports, (F.col("source_path") == F.col("i_path")) & (F.col("ancestor_id") == F.col("i_scope")))
        near = near.withColumn("wanted", K.imported_name(F.col("language"), F.col("i_attributes"), F.col("i_alias"), F.col("i_spelling"), F.col("qualifier"), F.col("name"))).filter("wanted IS NOT NULL")
        near = near.withColumn("place", F.rank().over(nearest)).filter("place = 1 AND outcome = 'local'")
        imported, limits = exported(near.select(*site, F.col("target_path").alias("file"), F.col("wanted").alias("name"), "rule"), observations, files, dests, decl)
        stages.append(stage(unsure(imported.join(occ.select(*SITE, "uncertain"), list(SITE))), 1))
    modules = declared_modules(observations, files).filter(F.col("language").isin("go", "java", "csharp"))
    # keyed by language, module, directory for Go, and name, so that only names of one module meet
    key = ("m_language", "module", "m_place", "name")
    place = F.when(F.col("language") == "go", parent_path(F.col("relative_path"))).otherwise(F.lit(""))
    modules = modules.select(F.col("relative_path").alias("m_path"), F.col("language").alias("m_language"), "module", place.alias("m_place"))
    open_to_all = decl.filter(F.col("d_top") | F.col("d_kind").isin(*K.MEMBER)).join(modules, F.col("d_relative_path") == F.col("m_path")).withColumnRenamed("d_spelling", "name")
    same = elsewhere(occ.join(modules, F.col("source_path") == F.col("m_path")).withColumn("need", _need()), open_to_all, key)
    same = same.select(*site, "uncertain", "total", "module", "name", F.explode("first").alias("f")).select("*", "f.*")
    same = same.withColumn("rule", F.lit("same-module-v1")).withColumn("evidence", F.array(F.concat(F.lit("module:"), "module")))
    every = reduce(DataFrame.unionByName, [*stages, stage(unsure(same), 2)])
    first = Window.partitionBy(*SITE).orderBy("stage")
    return every.withColumn("place", F.rank().over(first)).filter("place = 1").drop("place"), limits


def _edge(relationship: Column | str, **columns) -> list[Column]:
    """The edge columns in order; those not given are null. The id is the hash of what makes an edge."""
    kinds = {"source_start_byte": "long", "source_end_byte": "long", "candidate_count": "long", "evidence": "array<string>", "limitations": "array<string>"}
    names = ("source_path", "source_observation_id", "source_category", "source_start_byte", "source_end_byte", "source_symbol_id", "target_path", "target_symbol_id", "external_node_id", "resolution", "rule", "candidate_count", "reason", "evidence", "limitations")
    get = {n: (c if isinstance(c := columns.get(n, F.lit(None)), Column) else F.lit(c)).cast(kinds.get(n, "string")) for n in names}
    relationship = relationship if isinstance(relationship, Column) else F.lit(relationship)
    tag = F.when(get["external_node_id"].isNotNull(), "external").when(get["target_symbol_id"].isNotNull(), "symbol").when(get["target_path"].isNotNull(), "file").otherwise("none")
    own = content_id(relationship, get["source_path"], get["source_observation_id"], get["resolution"], get["rule"], tag, get["target_path"], get["target_symbol_id"], get["external_node_id"])
    return [own.alias("edge_id"), relationship.alias("relationship"), *[c.alias(n) for n, c in get.items()]]


def emitted(candidates: DataFrame, sites: DataFrame, reason: str) -> DataFrame:
    """Edges of candidate rows: counted, labelled, the first CANDIDATES of a site in source order.

    One candidate resolves a site unless its receiver is uncertain. sites: SITE, o_start, o_end, o_limitations,
    source_symbol_id, relationship. A `total` of candidates stands for their number where they were cut before.
    """
    key = (*SITE, "d_relative_path", "d_observation_id")
    known = F.max("total" if "total" in candidates.columns else F.lit(None).cast("long"))
    once = candidates.groupBy(*key).agg(F.min(F.struct("d_start_byte", "rule", "evidence")).alias("c"), known.alias("total")).select(*key, "c.*", "total")
    all_ = Window.partitionBy(*SITE)
    once = once.withColumn("n", F.coalesce(F.max("total").over(all_), F.count(F.lit(1)).over(all_))).withColumn("forced", F.max(F.col("rule") == "receiver-name-candidate-v1").over(all_))
    once = once.withColumn("place", F.row_number().over(all_.orderBy("d_relative_path", "d_start_byte", "d_observation_id"))).filter(F.col("place") <= CANDIDATES)
    rows = once.join(sites, list(SITE))
    more = F.concat(F.coalesce("o_limitations", K.strings()), F.when(F.col("n") > 1, K.strings("ambiguous_candidate_set")).otherwise(K.strings()))
    return rows.select(*_edge(
        F.col("relationship"), source_path=F.col("source_path"), source_observation_id=F.col("source_observation_id"), source_category=F.col("source_category"), source_start_byte=F.col("o_start"), source_end_byte=F.col("o_end"),
        source_symbol_id=F.col("source_symbol_id"), target_path=F.col("d_relative_path"), target_symbol_id=F.col("d_observation_id"), resolution=F.when((F.col("n") == 1) & ~F.col("forced"), "lexically_resolved").otherwise("candidate"),
        rule=F.col("rule"), candidate_count=F.col("n"), reason=reason, evidence=F.col("evidence"), limitations=more,
    ))


def resolve(observations: DataFrame, files: DataFrame, manifests: DataFrame, relationships: tuple[str, ...] = RELATIONSHIPS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, externals, diagnostics) of one generation, or of some relationships of it; edges once by id.

    An edge comes once where its site does, so sites are told apart before they meet anything. Each kind of edge is a table by itself, written
    when the shuffles of the one before are gone.
    """
    observations, files = cut(observations), cut(files)
    uses = tuple(c for c, r in (("reference", "references"), ("call_site", "calls")) if r in relationships)
    binding = bool(uses) or "imports" in relationships
    importing = binding and not observations.filter("category = 'import' AND kind NOT IN ('package', 'library')").isEmpty()
    dests = cut(destinations(observations, files, manifests, whole=False)) if importing else None
    decl = cut(_declarations(observations, files)) if binding else None
    spark = observations.sparkSession
    edges, told, externals = [], [], spark.createDataFrame([], EXTERNALS)

    def add(df: DataFrame) -> None:
        edges.append(cut(df))

    def enclosed(occ: DataFrame, categories: tuple[str, ...]) -> DataFrame:
        around = enclosing(observations, categories).withColumnsRenamed(dict(zip(("e_path", "e_category", "e_id"), SITE, strict=True)))
        return occ.join(around, list(SITE), "left")

    if "contains" in relationships:
        add(containment(observations).select(*_edge(
            "contains", source_path=F.col("relative_path"), source_observation_id=F.col("container_id"), source_category="symbol", source_start_byte=F.col("start_byte"), source_end_byte=F.col("end_byte"), source_symbol_id=F.col("container_id"),
            target_path=F.col("relative_path"), target_symbol_id=F.col("child_id"), resolution="lexically_resolved", rule="lexical-containment-v1", candidate_count=1, reason="smallest enclosing declaration",
            evidence=F.array(F.concat(F.lit("child_range:"), F.col("from").cast("string"), F.lit(".."), F.col("to").cast("string"))), limitations=K.strings(),
        )))
    if uses:
        sites = enclosed(occurrences(observations, files, uses), uses).dropDuplicates(SITE)
        sites = cut(sites.withColumn("relationship", F.when(F.col("category") == "call_site", "calls").otherwise("references")))
        bound, limits = bindings(sites, decl, observations, files, dests)
        bound = cut(bound)
        add(emitted(bound.repartition(*SITE), sites.select(*SITE, "o_start", "o_end", "o_limitations", "source_symbol_id", "relationship"), "bounded rules selected declarations"))
        rule = F.when(F.col("dynamic"), "dynamic-target-v1").when(F.col("uncertain"), "receiver-uncertainty-v1").otherwise("no-supported-binding-v1")
        add(sites.join(bound.select(*SITE), list(SITE), "left_anti").select(*_edge(
            F.col("relationship"), source_path=F.col("source_path"), source_observation_id=F.col("source_observation_id"), source_category=F.col("source_category"), source_start_byte=F.col("o_start"), source_end_byte=F.col("o_end"),
            source_symbol_id=F.col("source_symbol_id"), resolution="unresolved", rule=rule, candidate_count=0, reason="no rule selected a declaration", evidence=K.strings(), limitations=F.coalesce("o_limitations", K.strings()),
        )))
        many = bound.groupBy(*SITE).agg(F.coalesce(F.max("total"), F.countDistinct("d_relative_path", "d_observation_id")).alias("n")).filter(F.col("n") > CANDIDATES)
        told += [many.select("source_path", F.lit("candidate_limit_reached").alias("code"), F.col("n").cast("string").alias("message")), *([] if limits is None else [limits])]
    if importing and "imports" in relationships:
        imports = dests.filter("kind <> 'export'").withColumnsRenamed({"relative_path": "source_path", "category": "source_category", "observation_id": "source_observation_id", "start_byte": "o_start", "end_byte": "o_end", "limitations": "o_limitations", "attributes": "o_attributes"})
        imports = enclosed(imports, ("import",)).dropDuplicates([*SITE, "target_path"])
        imports = cut(imports.select(*SITE, "o_start", "o_end", "o_limitations", "o_attributes", "source_symbol_id", "spelling", "language", "outcome", "target_path", "node_kind", "rule", "code", "total", F.lit("imports").alias("relationship")))
        specifier = F.array(F.concat(F.lit("specifier:"), "spelling"))
        base = {"source_path": F.col("source_path"), "source_observation_id": F.col("source_observation_id"), "source_category": F.col("source_category"), "source_start_byte": F.col("o_start"), "source_end_byte": F.col("o_end"), "source_symbol_id": F.col("source_symbol_id"), "evidence": specifier, "limitations": F.coalesce("o_limitations", K.strings())}
        local = imports.filter("outcome = 'local'")
        asked = local.withColumn("name", K.binding_name(F.col("language"), F.col("o_attributes"), F.col("spelling"))).filter("name IS NOT NULL")
        wide = local.filter(F.col("total") > NODES).select("source_path", F.lit("import_node_limit_reached").alias("code"), F.col("spelling").alias("message"))
        named, more_limits = exported(asked.select(*SITE, F.lit("reference").alias("category"), "o_attributes", F.col("target_path").alias("file"), "name", F.lit("explicit-import-v1").alias("rule")), observations, files, dests, decl)
        named = cut(named)
        add(emitted(named.repartition(*SITE), imports.select(*SITE, "o_start", "o_end", "o_limitations", "source_symbol_id", "relationship").distinct(), "an import names declarations"))
        whole = local.join(named.select(*SITE).distinct(), list(SITE), "left_anti").withColumn("n", F.coalesce("total", F.count(F.lit(1)).over(Window.partitionBy(*SITE))))
        whole = whole.withColumn("place", F.row_number().over(Window.partitionBy(*SITE).orderBy("target_path"))).filter(F.col("place") <= CANDIDATES)
        add(whole.select(*_edge("imports", **base, target_path=F.col("target_path"), resolution=F.when(F.col("n") == 1, "lexically_resolved").otherwise("candidate"), rule=F.col("rule"), candidate_count=F.col("n"), reason="a module rule selected files")))
        node = F.concat(F.lit("external:"), content_id(F.col("language"), F.col("node_kind"), F.col("spelling")))
        outside = imports.filter("outcome = 'external'").withColumn("node", node)
        outside_edges = outside.select(*_edge("imports", **base, external_node_id=F.col("node"), resolution="syntax_observation", rule=F.col("rule"), candidate_count=1, reason="outside of the indexed modules"))
        lost = imports.filter("outcome = 'unresolved'")
        add(outside_edges.unionByName(lost.select(*_edge("imports", **base, resolution="unresolved", rule=F.col("rule"), candidate_count=0, reason=F.col("code")))))
        externals = outside.select(F.col("node").alias("external_node_id"), "language", F.col("node_kind").alias("kind"), F.col("spelling").alias("label")).distinct()
        told += [lost.select("source_path", "code", F.col("spelling").alias("message")), more_limits, wide]
    every = reduce(DataFrame.unionByName, edges, spark.createDataFrame([], EDGE_ROWS)).hint("merge")
    every._tessera_cut = True
    diagnostics = reduce(DataFrame.unionByName, told, spark.createDataFrame([], "source_path string, code string, message string"))
    return every, externals, diagnostics.distinct().orderBy("source_path", "code", "message").limit(DIAGNOSTICS)


def stats(edges: DataFrame) -> DataFrame:
    """One row: sites by outcome, as the generation's summary has them."""
    return edges.agg(*[F.coalesce(F.sum((F.col("resolution") == v).cast("long")), F.lit(0)).alias(k) for k, v in (("resolved", "lexically_resolved"), ("candidate", "candidate"), ("unresolved", "unresolved"), ("external", "syntax_observation"))])


def evaluate(edges: DataFrame, labels: DataFrame, observations: DataFrame) -> DataFrame:
    """By language: labelled sites whose label, count and targets are all met, and precision and recall of targets.

    A label names a site as the nth occurrence of a spelling in a file.
    """
    nth = F.row_number().over(Window.partitionBy("relative_path", "category", "spelling").orderBy("start_byte", "observation_id")) - 1
    places = observations.withColumn("occurrence", nth).select(F.col("relative_path").alias("source_path"), F.col("category").alias("source_category"), F.col("spelling").alias("source_spelling"), "occurrence", F.col("observation_id").alias("source_observation_id"))
    wanted = labels.join(places, ["source_path", "source_category", "source_spelling", "occurrence"])
    names = observations.filter("category = 'symbol'").select(F.col("relative_path").alias("target_path"), F.col("observation_id").alias("target_symbol_id"), F.col("spelling").alias("target_name"))
    got = edges.join(names, ["target_path", "target_symbol_id"], "left").groupBy("source_path", "source_category", "source_observation_id", "relationship")
    got = got.agg(F.max("resolution").alias("got_resolution"), F.max("candidate_count").alias("got_count"), F.collect_list(F.when(F.col("target_path").isNotNull(), F.concat_ws("#", "target_path", "target_name"))).alias("got_targets"))
    rows = wanted.join(got, ["source_path", "source_category", "source_observation_id", "relationship"], "left").withColumn("got_targets", F.coalesce("got_targets", K.strings()))
    expected = F.transform("targets", lambda t: F.concat_ws("#", t["path"], t["name"]))
    hit = F.size(F.array_intersect(expected, "got_targets"))
    exact = (F.col("resolution") == F.col("got_resolution")) & (F.col("candidate_count") == F.col("got_count")) & (F.sort_array(expected) == F.sort_array("got_targets"))
    sums = rows.groupBy("language").agg(F.count(F.lit(1)).alias("sites"), F.sum(F.coalesce(exact, F.lit(False)).cast("long")).alias("exact"), F.sum(hit).alias("hits"), F.sum(F.size("got_targets")).alias("returned"), F.sum(F.size("targets")).alias("expected"))
    return sums.withColumn("precision", F.when(F.col("returned") > 0, F.col("hits") / F.col("returned"))).withColumn("recall", F.when(F.col("expected") > 0, F.col("hits") / F.col("expected")))
