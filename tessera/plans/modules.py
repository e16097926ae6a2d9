"""Queries on imports, exports and declarations, and on the predicates that resolution is made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import kinds as K
from tessera.functions.text import file_name, last_segment, normalized_path, parent_path
from tessera.operators import extraction, resolution
from tessera.sources import corpus, modules


def _found(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(observations, files, manifests) of the module trees, parsed once."""
    sources = modules.sources(spark, folder)
    return resolution.cut(extraction.observations(extraction.parsed(sources))), resolution.cut(sources.select("relative_path", "language")), modules.manifests(spark)


def import_destinations(spark, folder):
    """Where every import leads: a file, outside, or nowhere, and by which rule."""
    return resolution.destinations(*_found(spark, folder)).select("relative_path", "spelling", "alias", "outcome", "rule", "target_path", "node_kind", "code")


def _edges(spark, folder, *relationships: str) -> tuple[DataFrame, DataFrame]:
    """(edges, observations), read once; edges of the named relationships."""
    observations, files, manifests = _found(spark, folder)
    return resolution.resolve(observations, files, manifests, relationships)[0], observations


def _named(edges: DataFrame, observations: DataFrame) -> DataFrame:
    names = observations.filter("category IN ('symbol', 'import', 'call_site', 'reference')").select(F.col("relative_path").alias("p"), F.col("category").alias("c"), F.col("observation_id").alias("id"), "spelling")
    site = names.select(F.col("p").alias("p1"), F.col("c").alias("c1"), F.col("id").alias("id1"), F.col("spelling").alias("site"))
    target = names.filter("c = 'symbol'").select(F.col("p").alias("p2"), F.col("id").alias("id2"), F.col("spelling").alias("target"))
    rows = edges.join(site, (F.col("source_path") == F.col("p1")) & (F.col("source_category") == F.col("c1")) & (F.col("source_observation_id") == F.col("id1")))
    rows = rows.join(target, (F.col("target_path") == F.col("p2")) & (F.col("target_symbol_id") == F.col("id2")), "left")
    return rows.select("source_path", "site", "target_path", "target", "resolution", "rule", "candidate_count")


def import_edges(spark, folder):
    """Edges of imports: to the declarations that they name, through re-exports too, else to files, or outside."""
    return _named(*_edges(spark, folder, "imports"))


def imported_calls(spark, folder):
    """Edges of calls: bound in the file, through imports and re-exports, in the same package, or not at all."""
    return _named(*_edges(spark, folder, "calls"))


def site_scores(spark, folder):
    """Labelled sites, by the nth occurrence of a spelling, against the edges: exact ones, precision and recall by language."""
    edges, observations = _edges(spark, folder, "imports", "calls", "references")
    rows = modules.grown(spark, folder, _LABELS, "language source_path source_category source_spelling occurrence relationship resolution candidate_count path name")
    target = F.when(F.col("path") == "", F.array().cast("array<struct<path:string,name:string>>")).otherwise(F.array(F.struct("path", "name")))
    labels = rows.withColumn("targets", target).withColumn("candidate_count", F.col("candidate_count").cast("long")).drop("path", "name")
    return resolution.evaluate(edges, labels, observations).select("language", "sites", "exact", "hits", "returned", "expected", "precision", "recall")


#: Bounds of the registered searches, low enough to be met.
_DEPTH, _NODES, _STEPS = 2, 24, 40


def export_searches(spark, folder):
    """Where searches for two names of each supplier's file come to, and the bounds that they meet.

    A file gives on to another one for each line number that it has; alias and local name come from its last order.
    """
    lines = corpus.read(spark, folder, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("x_start"), F.max("l_orderkey").alias("last"))
    named = lambda by: F.when(F.col("last") % by == 0, "n").when(F.col("last") % by == 1, "r")
    local = F.when(named(5).isNotNull(), F.array(F.concat(F.lit("local:"), named(5)))).otherwise(F.array().cast("array<string>"))
    target = F.concat(F.lit("s"), F.floor(F.col("l_suppkey") / 2) + F.col("l_linenumber"))
    steps = lines.select(F.concat(F.lit("s"), "l_suppkey").alias("x_path"), "x_start", F.col("x_start").cast("string").alias("x_id"), named(4).alias("x_alias"), local.alias("x_attributes"), F.lit("typescript").alias("x_language"), target.alias("target"))
    roots = corpus.read(spark, folder, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("root_file"), F.explode(F.array(F.lit("n"), F.lit("r"))).alias("root_name"))
    reached, limits = resolution.closure(roots, steps, _DEPTH, _NODES, _STEPS)
    met = limits.groupBy("root_file", "root_name").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("limits"))
    return reached.join(met, ["root_file", "root_name"], "left").select("root_file", "root_name", "file", "name", F.col("level").cast("long").alias("level"), F.coalesce("limits", F.lit("")).alias("limits"))


def _searches_sql() -> str:
    parts = ["""steps AS (SELECT 's' || l_suppkey AS x_path, min(l_orderkey * 8 + l_linenumber) AS x_start, CASE max(l_orderkey) % 4 WHEN 0 THEN 'n' WHEN 1 THEN 'r' END AS x_alias,
  CASE max(l_orderkey) % 5 WHEN 0 THEN 'n' WHEN 1 THEN 'r' END AS local, 's' || (l_suppkey // 2 + l_linenumber) AS target FROM lineitem GROUP BY l_suppkey, l_linenumber)""",
        "o0 AS (SELECT 's' || s_suppkey AS rf, rn, 's' || s_suppkey AS file, rn AS name, 1 AS position, 1 AS nodes, 0 AS taken FROM supplier, (VALUES ('n'), ('r')) v(rn))", "seen0 AS (SELECT rf, rn, file, name, 0 AS level FROM o0)"]
    limits = []
    for k in range(1, _DEPTH + 2):
        parts += [
            f"w{k} AS (SELECT rf, rn, nodes, target, coalesce(local, name) AS local, taken + row_number() OVER (PARTITION BY rf, rn ORDER BY position, x_start) AS n FROM o{k - 1} JOIN steps ON file = x_path AND (x_alias IS NULL OR x_alias = name))",
            f"f{k} AS (SELECT rf, rn, target AS file, local AS name, min(n) AS n, any_value(nodes) AS nodes, any_value(least({_STEPS}, total)) AS taken FROM (SELECT *, max(n) OVER (PARTITION BY rf, rn) AS total FROM w{k}) w WHERE n <= {_STEPS} GROUP BY rf, rn, target, local)",
            f"n{k} AS (SELECT *, row_number() OVER (PARTITION BY rf, rn ORDER BY n) AS position FROM f{k} ANTI JOIN seen{k - 1} USING (rf, rn, file, name))",
            f"o{k} AS (SELECT rf, rn, file, name, position, max(nodes + position) OVER (PARTITION BY rf, rn) AS nodes, taken FROM n{k} WHERE nodes + position <= {_NODES})",
            f"seen{k} AS (SELECT * FROM seen{k - 1} UNION ALL SELECT rf, rn, file, name, {k} FROM o{k})",
        ]
        limits.append(f"SELECT rf, rn, 'import_edge_limit_reached' AS code FROM w{k} WHERE n > {_STEPS}")
        limits.append(f"SELECT rf, rn, 'import_node_limit_reached' FROM n{k} WHERE nodes + position > {_NODES}" if k <= _DEPTH else f"SELECT rf, rn, 'import_depth_limit_reached' FROM n{k}")
    parts.append(f"met AS (SELECT rf, rn, string_agg(DISTINCT code, ',' ORDER BY code) AS limits FROM ({' UNION ALL '.join(limits)}) l GROUP BY rf, rn)")
    return f"WITH {', '.join(parts)} SELECT rf AS root_file, rn AS root_name, file, name, CAST(level AS BIGINT) AS level, coalesce(limits, '') AS limits FROM seen{_DEPTH} LEFT JOIN met USING (rf, rn)"


def declared_kinds(spark, folder):
    """Declarations, imports and conditions of seven dialects, of many kinds, with what contains them."""
    sources = modules.grown(spark, folder, modules.KINDS, "relative_path language content").withColumn("content", F.encode("content", "UTF-8"))
    found = extraction.observations(extraction.parsed(sources)).filter("category IN ('symbol', 'import', 'condition')")
    return found.select("relative_path", "category", "kind", "spelling", "container", "alias")


def syntax_diagnostics(spark, folder):
    """Broken files: what is wrong, at which bytes, and the state of the parse."""
    sources = modules.grown(spark, folder, _BROKEN, "relative_path language content").withColumn("content", F.when(F.col("relative_path").startswith("bad/bytes"), F.unhex(F.lit("66FF"))).otherwise(F.encode("content", "UTF-8")))
    parses = extraction.parsed(sources)
    return parses.select("relative_path", "parse_status", F.explode_outer("notes").alias("n")).select("relative_path", "parse_status", F.coalesce("n.code", F.lit("")).alias("code"), F.coalesce("n.start_byte", F.lit(-1)).alias("start_byte"), F.coalesce("n.end_byte", F.lit(-1)).alias("end_byte"))


def _lists(spark, folder) -> DataFrame:
    """Attributes, limitations, names and languages in many combinations, one row a part."""
    key = F.col("p_partkey")
    listed = lambda values, by: F.element_at(F.array(*[F.array(*map(F.lit, v)) if v else F.array().cast("array<string>") for v in values]), (by % len(values) + 1).cast("int"))
    picked = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    return corpus.read(spark, folder, "part").select(
        key.alias("key"),
        listed(_ATTRIBUTES, key).alias("attributes"),
        listed(_ATTRIBUTES, F.floor(key / 3)).alias("others"),
        listed(_LIMITATIONS, F.floor(key / 2)).alias("limitations"),
        picked(_KINDS, F.floor(key / 5)).alias("kind"),
        picked(_LANGUAGES, F.floor(key / 7)).alias("language"),
        picked(_SPELLINGS, F.floor(key / 11)).alias("spelling"),
        F.nullif(picked(_NAMES, F.floor(key / 13)), F.lit("")).alias("name"),
        F.nullif(picked(_NAMES, F.floor(key / 17)), F.lit("")).alias("alias"),
        F.nullif(picked(_NAMES, F.floor(key / 19)), F.lit("")).alias("qualifier"),
    )


_ATTRIBUTES = ((), ("role:type",), ("role:value",), ("exported",), ("show:Foo,bar",), ("hide:Foo",), ("show:Foo", "hide:bar"), ("imported:Foo",), ("imported:*",), ("computed_target",), ("wildcard_import",))
_LIMITATIONS = ((), ("macro_not_expanded",), ("receiver_type_not_inferred",), ("other",))
_KINDS = ("class", "function", "interface", "local", "type_alias")
_LANGUAGES = ("typescript", "dart", "go", "rust", "java", "csharp")
_SPELLINGS = ("Foo", "bar", "_x", "a::b::Foo", "p.q.Foo", "dir/sub/bar", "Ünï", "./a/../b/./c", "../up")
_NAMES = ("Foo", "bar", "")


def role_fits(spark, folder):
    """Occurrences and declarations whose roles go together."""
    return _lists(spark, folder).select("key", K.role_compatible(F.col("attributes"), F.col("others"), F.col("kind")).alias("fits"))


def visible_names(spark, folder):
    """Declarations that other modules may see, by language."""
    signature = F.when(F.col("key") % 2 == 0, F.concat(F.lit(" pub fn "), "spelling"))
    return _lists(spark, folder).select("key", K.module_visible(F.col("language"), F.col("attributes"), F.col("spelling"), signature).alias("visible"))


def uncertain_sites(spark, folder):
    """Dynamic targets and receivers of unknown type."""
    return _lists(spark, folder).select("key", K.is_dynamic(F.col("attributes"), F.col("limitations")).alias("dynamic"), K.uncertain_receiver(F.col("spelling"), F.col("qualifier"), F.col("limitations")).alias("uncertain"))


def show_hide(spark, folder):
    """Names that lists of shown and hidden names let through."""
    return _lists(spark, folder).filter("name IS NOT NULL").select("key", K.combinators_allow(F.col("attributes"), F.col("name")).alias("allowed"))


def import_names(spark, folder):
    """The name by which an import serves an occurrence, and the one that it binds by itself."""
    name = F.coalesce("name", F.lit("Foo"))
    served = K.imported_name(F.col("language"), F.col("attributes"), F.col("alias"), F.col("spelling"), F.col("qualifier"), name)
    return _lists(spark, folder).select("key", served.alias("served"), K.binding_name(F.col("language"), F.col("attributes"), F.col("spelling")).alias("bound"))


def split_names(spark, folder):
    """Last segments and qualifiers of names, and paths without detours."""
    s = F.col("spelling")
    return _lists(spark, folder).select("key", last_segment(s).alias("last"), K.qualifier(s).alias("qualifier"), normalized_path(s).alias("path"), parent_path(s).alias("parent"), file_name(s).alias("file"))


QUERIES = {
    "export_searches": export_searches,
    "import_destinations": import_destinations,
    "import_edges": import_edges,
    "imported_calls": imported_calls,
    "site_scores": site_scores,
    "declared_kinds": declared_kinds,
    "syntax_diagnostics": syntax_diagnostics,
    "role_fits": role_fits,
    "visible_names": visible_names,
    "uncertain_sites": uncertain_sites,
    "show_hide": show_hide,
    "import_names": import_names,
    "split_names": split_names,
}

#: What the forms must give, read off their texts.
_DESTINATIONS = (
    ("cs/m{K}/A.cs", "Space{K}", None, "local", "csharp-declared-namespace-v1", "cs/m{K}/B.cs", None, None),
    ("cs/m{K}/A.cs", "System", None, "external", "csharp-external-namespace-v1", None, "dotnet_namespace", None),
    ("dart/m{K}/a.dart", "b.dart", None, "local", "dart-relative-library-v1", "dart/m{K}/b.dart", None, None),
    ("dart/m{K}/a.dart", "c.dart", None, "local", "dart-relative-library-v1", "dart/m{K}/c.dart", None, None),
    ("dart/m{K}/a.dart", "dart:io", None, "external", "dart-sdk-library-v1", None, "sdk_library", None),
    ("go/m{K}/a.go", "example.org/app/go/n{K}", "n{K}", "local", "go-module-manifest-v1", "go/n{K}/c.go", None, None),
    ("go/m{K}/a.go", "os", "os", "external", "go-external-package-v1", None, "go_package", None),
    ("java/m{K}/A.java", "java.util.List", None, "external", "java-external-classpath-v1", None, "java_package", None),
    ("java/m{K}/A.java", "x{K}.B{K}", None, "local", "java-declared-package-v1", "java/x{K}/B.java", None, None),
    ("js/m{K}/a.js", "./b", "dep", "local", "ecmascript-relative-module-v1", "js/m{K}/b.js", None, None),
    ("js/m{K}/a.js", "./c/index.js", None, "local", "ecmascript-relative-module-v1", "js/m{K}/c/index.js", None, None),
    ("js/m{K}/a.js", "dep", None, "unresolved", "unsupported-import-v1", None, None, "dynamic_module_specifier"),
    ("rs/m{K}/src/lib.rs", "crate::inner::deep{K}", None, "local", "rust-module-path-v1", "rs/m{K}/src/inner.rs", None, None),
    ("rs/m{K}/src/lib.rs", "crate::inner::kept{K}", "other{K}", "local", "rust-module-path-v1", "rs/m{K}/src/inner.rs", None, None),
    ("rs/m{K}/src/lib.rs", "serde::Serialize", None, "external", "rust-external-crate-v1", None, "crate", None),
    ("ts/m{K}/a.ts", "./b", "g", "local", "ecmascript-relative-module-v1", "ts/m{K}/b.ts", None, None),
    ("ts/m{K}/a.ts", "./gone", "h{K}", "unresolved", "unsupported-import-v1", None, None, "local_module_not_found"),
    ("ts/m{K}/a.ts", "pkg{K}", "pkg", "external", "ecmascript-external-package-v1", None, "package", None),
    ("ts/m{K}/b.ts", "./c", "f{K}", "local", "ecmascript-relative-module-v1", "ts/m{K}/c.ts", None, None),
    ("ts/m{K}/c.ts", "./b", None, "local", "ecmascript-relative-module-v1", "ts/m{K}/b.ts", None, None),
    ("ts/m{K}/c.ts", "./d", "f{K}", "local", "ecmascript-relative-module-v1", "ts/m{K}/d.ts", None, None),
    ("ts/m{K}/e.ts", "./d", None, "local", "ecmascript-relative-module-v1", "ts/m{K}/d.ts", None, None),
    ("ts/m{K}/u.ts", "./d", "all", "local", "ecmascript-relative-module-v1", "ts/m{K}/d.ts", None, None),
    ("ts/m{K}/u.ts", "./e", "x{K}", "local", "ecmascript-relative-module-v1", "ts/m{K}/e.ts", None, None),
    ("ts/m{K}/u.ts", "./e", "hidden{K}", "local", "ecmascript-relative-module-v1", "ts/m{K}/e.ts", None, None),
)
_L, _U, _S = "lexically_resolved", "unresolved", "syntax_observation"
_IMPORTS = (
    ("cs/m{K}/A.cs", "Space{K}", "cs/m{K}/B.cs", None, _L, "csharp-declared-namespace-v1", 1),
    ("cs/m{K}/A.cs", "System", None, None, _S, "csharp-external-namespace-v1", 1),
    ("dart/m{K}/a.dart", "b.dart", "dart/m{K}/b.dart", None, _L, "dart-relative-library-v1", 1),
    ("dart/m{K}/a.dart", "c.dart", "dart/m{K}/c.dart", None, _L, "dart-relative-library-v1", 1),
    ("dart/m{K}/a.dart", "dart:io", None, None, _S, "dart-sdk-library-v1", 1),
    ("go/m{K}/a.go", "example.org/app/go/n{K}", "go/n{K}/c.go", None, _L, "go-module-manifest-v1", 1),
    ("go/m{K}/a.go", "os", None, None, _S, "go-external-package-v1", 1),
    ("java/m{K}/A.java", "java.util.List", None, None, _S, "java-external-classpath-v1", 1),
    ("java/m{K}/A.java", "x{K}.B{K}", "java/x{K}/B.java", "B{K}", _L, "explicit-import-v1", 1),
    ("js/m{K}/a.js", "./b", "js/m{K}/b.js", None, _L, "ecmascript-relative-module-v1", 1),
    ("js/m{K}/a.js", "./c/index.js", "js/m{K}/c/index.js", None, _L, "ecmascript-relative-module-v1", 1),
    ("js/m{K}/a.js", "dep", None, None, _U, "unsupported-import-v1", 0),
    ("rs/m{K}/src/lib.rs", "crate::inner::deep{K}", "rs/m{K}/src/inner.rs", "deep{K}", _L, "explicit-import-v1", 1),
    ("rs/m{K}/src/lib.rs", "crate::inner::kept{K}", "rs/m{K}/src/inner.rs", "kept{K}", _L, "explicit-import-v1", 1),
    ("rs/m{K}/src/lib.rs", "serde::Serialize", None, None, _S, "rust-external-crate-v1", 1),
    ("ts/m{K}/a.ts", "./b", "ts/m{K}/d.ts", "x{K}", _L, "bounded-reexport-v1", 1),
    ("ts/m{K}/a.ts", "./gone", None, None, _U, "unsupported-import-v1", 0),
    ("ts/m{K}/a.ts", "pkg{K}", None, None, _S, "ecmascript-external-package-v1", 1),
    ("ts/m{K}/b.ts", "./c", "ts/m{K}/d.ts", "x{K}", _L, "bounded-reexport-v1", 1),
    ("ts/m{K}/c.ts", "./b", "ts/m{K}/b.ts", None, _L, "ecmascript-relative-module-v1", 1),
    ("ts/m{K}/c.ts", "./d", "ts/m{K}/d.ts", "x{K}", _L, "explicit-import-v1", 1),
    ("ts/m{K}/e.ts", "./d", "ts/m{K}/d.ts", None, _L, "ecmascript-relative-module-v1", 1),
    ("ts/m{K}/u.ts", "./d", "ts/m{K}/d.ts", None, _L, "ecmascript-relative-module-v1", 1),
    ("ts/m{K}/u.ts", "./e", "ts/m{K}/d.ts", "x{K}", _L, "bounded-reexport-v1", 1),
    ("ts/m{K}/u.ts", "./e", "ts/m{K}/e.ts", None, _L, "ecmascript-relative-module-v1", 1),
)
_CALLS = (
    ("cs/m{K}/A.cs", "Two{K}", "cs/m{K}/A.cs", "Two{K}", _L, "lexical-scope-v1", 1),
    ("dart/m{K}/a.dart", "_p{K}", None, None, _U, "no-supported-binding-v1", 0),
    ("dart/m{K}/a.dart", "f{K}", "dart/m{K}/b.dart", "f{K}", _L, "dart-relative-library-v1", 1),
    ("dart/m{K}/a.dart", "g{K}", None, None, _U, "no-supported-binding-v1", 0),
    ("dart/m{K}/a.dart", "h{K}", "dart/m{K}/c.dart", "h{K}", _L, "dart-relative-library-v1", 1),
    ("go/m{K}/a.go", "Help{K}", "go/n{K}/c.go", "Help{K}", "candidate", "receiver-name-candidate-v1", 1),
    ("go/m{K}/a.go", "near{K}", "go/m{K}/b.go", "near{K}", _L, "same-module-v1", 1),
    ("java/m{K}/A.java", "three{K}", None, None, _U, "receiver-uncertainty-v1", 0),
    ("java/m{K}/A.java", "two{K}", "java/m{K}/A.java", "two{K}", _L, "lexical-scope-v1", 1),
    ("js/m{K}/a.js", "import", None, None, _U, "dynamic-target-v1", 0),
    ("js/m{K}/a.js", "require", None, None, _U, "no-supported-binding-v1", 0),
    ("rs/m{K}/src/lib.rs", "deep{K}", "rs/m{K}/src/inner.rs", "deep{K}", _L, "rust-module-path-v1", 1),
    ("rs/m{K}/src/lib.rs", "hid{K}", None, None, _U, "no-supported-binding-v1", 0),
    ("rs/m{K}/src/lib.rs", "mac", None, None, _U, "dynamic-target-v1", 0),
    ("rs/m{K}/src/lib.rs", "other{K}", "rs/m{K}/src/inner.rs", "kept{K}", _L, "rust-module-path-v1", 1),
    ("ts/m{K}/a.ts", "g", "ts/m{K}/d.ts", "x{K}", _L, "bounded-reexport-v1", 1),
    ("ts/m{K}/a.ts", "h{K}", None, None, _U, "no-supported-binding-v1", 0),
    ("ts/m{K}/u.ts", "hidden{K}", None, None, _U, "no-supported-binding-v1", 0),
    ("ts/m{K}/u.ts", "x{K}", "ts/m{K}/d.ts", "x{K}", "candidate", "receiver-name-candidate-v1", 1),
    ("ts/m{K}/u.ts", "x{K}", "ts/m{K}/d.ts", "x{K}", _L, "bounded-reexport-v1", 1),
)
#: Labels of sites, some of them wrong on purpose; an empty path is no target.
_LABELS = (
    ("rust", "rs/m{K}/src/lib.rs", "call_site", "deep{K}", 0, "calls", _L, 1, "rs/m{K}/src/inner.rs", "deep{K}"),
    ("rust", "rs/m{K}/src/lib.rs", "call_site", "hid{K}", 0, "calls", _U, 0, "", ""),
    ("rust", "rs/m{K}/src/lib.rs", "call_site", "other{K}", 0, "calls", _L, 1, "rs/m{K}/src/inner.rs", "hid{K}"),
    ("typescript", "ts/m{K}/u.ts", "call_site", "x{K}", 0, "calls", _L, 1, "ts/m{K}/d.ts", "x{K}"),
    ("typescript", "ts/m{K}/u.ts", "call_site", "x{K}", 1, "calls", "candidate", 1, "ts/m{K}/d.ts", "x{K}"),
    ("dart", "dart/m{K}/a.dart", "call_site", "g{K}", 0, "calls", _L, 1, "dart/m{K}/b.dart", "g{K}"),
)
_DECLARED = {
    "kinds/k{K}.rs": "struct S{K} -; type_parameter T S{K}; field one S{K}; field two S{K}; enum E{K} -; enum_variant A E{K}; enum_variant B E{K}; union U{K} -; field x U{K}; trait T{K} -; trait_method ask{K} T{K}; impl S{K} -; method ask{K} impl<T>_T{K}_for_S{K}<T>; local v ask{K}; module m{K} -; const C{K} m{K}; static D{K} m{K}; type_alias L{K} m{K}; macro mac{K} -; function tested{K} -; condition:cfg cfg(test) -",
    "kinds/k{K}.go": "type S{K} -; field One S{K}; embedded_field Base{K} S{K}; type I{K} -; interface_method Ask{K} I{K}; type_alias L{K} -; parameter s -; method Run{K} *S{K}; parameter a Run{K}; parameter c Run{K}; local b Run{K}; const C{K} -; variable V{K} -; variable W{K} -; import:package kinds -",
    "kinds/K{K}.java": "class F{K} -; type_parameter T F{K}; field n{K} F{K}; constructor F{K} F{K}; parameter c F{K}; method run{K} F{K}; parameter a run{K}; local l run{K}; enum C{K} F{K}; enum_constant RED C{K}; enum_constant BLUE C{K}; interface I{K} -; method ask{K} I{K}; record R{K} -; parameter x R{K}; parameter y R{K}; import:package kinds -; import:import java.util -; import:import x.Y.z{K} -",
    "kinds/K{K}.cs": "namespace N{K} -; class P{K} N{K}; field f{K} P{K}; property Prop{K} P{K}; constructor P{K} P{K}; method M{K} P{K}; parameter a M{K}; local v M{K}; interface I{K} N{K}; method Ask{K} I{K}; struct S{K} N{K}; enum E{K} N{K}; enum_member One E{K}; enum_member Two E{K}; record R{K} N{K}; parameter X R{K}; import:using B.C - A; condition:preprocessor if_DEBUG -",
    "kinds/k{K}.dart": "class C{K} -; field f{K} C{K}; constructor C{K} C{K}; constructor named C{K}; factory_constructor made C{K}; getter g{K} C{K}; method run{K} C{K}; parameter a run{K}; local v run{K}; mixin M{K} -; enum E{K} -; enum_constant one E{K}; enum_constant two E{K}; extension X{K} -; type_alias T{K} -; import:library kinds{K} -; import:export x.dart -; import:part p.dart -",
    "kinds/k{K}.ts": "interface I{K} -; method_signature ask I{K}; type_alias L{K} -; enum E{K} -; namespace N{K} -; variable c{K} N{K}; class B{K} -; type_parameter T B{K}; constructor constructor B{K}; parameter x constructor; method run{K} B{K}; parameter a run{K}; variable v run{K}; method g{K} B{K}; function_binding arrow{K} -; parameter q -; import:export arrow{K} - other{K}",
    "kinds/k{K}.jsx": "variable a{K} -; variable b{K} -; function View{K} -; parameter props View{K}; import:commonjs_export exports -",
}


def _declared_rows() -> tuple[tuple, ...]:
    """(path, category, kind, spelling, container, alias); in the list '-' is null and '_' a space inside of a name."""
    rows = []
    for path, text in _DECLARED.items():
        for entry in text.split("; "):
            kind, spelling, container, *alias = entry.split(" ")
            category, _, kind = kind.rpartition(":")
            spaced = lambda v: None if v == "-" else v.replace("_", " ")
            rows.append((path, category or "symbol", kind, spaced(spelling), spaced(container), alias[0] if alias else None))
    return tuple(rows)


_BROKEN = (
    ("bad/open{K}.rs", "rust", "fn a{K}( {"), ("bad/close{K}.js", "javascript", "f();\n}"), ("bad/wide{K}.go", "go", "// é\n("), ("bad/none{K}.ts", "typescript", ""), ("bad/bytes{K}.java", "java", "f"), ("bad/good{K}.dart", "dart", "void f() {}"),
)
_BROKEN_SQL = """SELECT relative_path, parse_status, code, CAST(a AS BIGINT) AS start_byte, CAST(b AS BIGINT) AS end_byte FROM (
  SELECT 'bad/open' || k || '.rs' AS relative_path, 'partial' AS parse_status, 'syntax_error' AS code, 4 + length(k) AS a, 5 + length(k) AS b FROM trees
  UNION ALL SELECT 'bad/open' || k || '.rs', 'partial', 'syntax_error', 6 + length(k), 7 + length(k) FROM trees
  UNION ALL SELECT 'bad/close' || k || '.js', 'partial', 'syntax_error', 5, 6 FROM trees
  UNION ALL SELECT 'bad/wide' || k || '.go', 'partial', 'syntax_error', 6, 7 FROM trees
  UNION ALL SELECT 'bad/none' || k || '.ts', 'complete', '', -1, -1 FROM trees
  UNION ALL SELECT 'bad/bytes' || k || '.java', 'failed', 'invalid_utf8', 1, 2 FROM trees
  UNION ALL SELECT 'bad/good' || k || '.dart', 'complete', '', -1, -1 FROM trees) x"""


def _array(values: tuple) -> str:
    return "[" + ", ".join(_array(v) if isinstance(v, tuple) else f"'{v}'" for v in values) + "]"


_LISTS = f"""lists AS (SELECT p_partkey AS key, CAST({_array(_ATTRIBUTES)} AS VARCHAR[][])[p_partkey % 11 + 1] AS attributes, CAST({_array(_ATTRIBUTES)} AS VARCHAR[][])[p_partkey // 3 % 11 + 1] AS others,
  CAST({_array(_LIMITATIONS)} AS VARCHAR[][])[p_partkey // 2 % 4 + 1] AS limitations, ({_array(_KINDS)})[p_partkey // 5 % 5 + 1] AS kind, ({_array(_LANGUAGES)})[p_partkey // 7 % 6 + 1] AS language,
  ({_array(_SPELLINGS)})[p_partkey // 11 % 9 + 1] AS spelling, nullif(({_array(_NAMES)})[p_partkey // 13 % 3 + 1], '') AS name, nullif(({_array(_NAMES)})[p_partkey // 17 % 3 + 1], '') AS alias, nullif(({_array(_NAMES)})[p_partkey // 19 % 3 + 1], '') AS qualifier FROM part)"""
_HAS = "list_contains({0}, '{1}')".format
_SHOWN = "(NOT list_contains(attributes, 'show:Foo,bar') OR {0} IN ('Foo', 'bar')) AND (NOT list_contains(attributes, 'hide:Foo') OR {0} <> 'Foo') AND (NOT list_contains(attributes, 'show:Foo') OR {0} = 'Foo') AND (NOT list_contains(attributes, 'hide:bar') OR {0} <> 'bar')"
_IMPORTED = "CASE WHEN list_contains(attributes, 'imported:Foo') THEN 'Foo' WHEN list_contains(attributes, 'imported:*') THEN '*' END"
_LAST_OF = "CASE WHEN spelling LIKE '%::%' THEN split_part(spelling, '::', -1) ELSE spelling END"
_ALIASED = "CASE WHEN alias = qualifier OR (alias IS NULL AND qualifier IS NULL) THEN wanted END"
SQL = {
    "export_searches": _searches_sql(),
    "import_destinations": modules.sql_rows(_DESTINATIONS, "relative_path spelling alias outcome rule target_path node_kind code"),
    "import_edges": modules.sql_rows(_IMPORTS, "source_path site target_path target resolution rule candidate_count"),
    "imported_calls": modules.sql_rows(_CALLS, "source_path site target_path target resolution rule candidate_count"),
    "site_scores": "WITH trees AS (SELECT count(DISTINCT p_partkey // 20) AS n FROM part) SELECT language, CAST(sites * n AS BIGINT) AS sites, CAST(exact * n AS BIGINT) AS exact, CAST(hits * n AS BIGINT) AS hits, CAST(returned * n AS BIGINT) AS returned, CAST(expected * n AS BIGINT) AS expected, CASE WHEN returned > 0 THEN hits / returned END AS precision, hits / expected AS recall FROM trees, (VALUES ('rust', 3, 2, 1, 2, 2), ('typescript', 2, 2, 2, 2, 2), ('dart', 1, 0, 0, 0, 1)) v(language, sites, exact, hits, returned, expected)",
    "declared_kinds": modules.sql_rows(_declared_rows(), "relative_path category kind spelling container alias"),
    "syntax_diagnostics": f"WITH trees AS (SELECT DISTINCT (p_partkey // 20)::VARCHAR AS k FROM part) {_BROKEN_SQL}",
    "role_fits": f"WITH {_LISTS} SELECT key, (NOT {_HAS('attributes', 'role:type')} OR {_HAS('others', 'role:type')} OR kind IN ('class', 'interface', 'type_alias')) AND (NOT {_HAS('attributes', 'role:value')} OR {_HAS('others', 'role:value')} OR kind NOT IN ('interface', 'type_alias')) AS fits FROM lists",
    "visible_names": f"WITH {_LISTS} SELECT key, CASE language WHEN 'typescript' THEN {_HAS('attributes', 'exported')} WHEN 'dart' THEN spelling <> '_x' WHEN 'go' THEN spelling IN ('Foo', 'Ünï') WHEN 'rust' THEN key % 2 = 0 ELSE true END AS visible FROM lists",
    "uncertain_sites": f"WITH {_LISTS} SELECT key, {_HAS('attributes', 'computed_target')} OR {_HAS('limitations', 'macro_not_expanded')} AS dynamic, qualifier IS NOT NULL OR spelling NOT IN ('Foo', 'bar', '_x', 'Ünï') OR {_HAS('limitations', 'receiver_type_not_inferred')} AS uncertain FROM lists",
    "show_hide": f"WITH {_LISTS} SELECT key, {_SHOWN.format('name')} AS allowed FROM lists WHERE name IS NOT NULL",
    "import_names": f"""WITH {_LISTS}, wanting AS (SELECT *, coalesce(name, 'Foo') AS wanted, {_IMPORTED} AS imported FROM lists)
SELECT key, CASE language
    WHEN 'typescript' THEN CASE WHEN imported = '*' THEN CASE WHEN alias IS NOT DISTINCT FROM qualifier THEN wanted END WHEN qualifier IS NULL AND alias = wanted THEN imported END
    WHEN 'dart' THEN CASE WHEN {_SHOWN.format('wanted')} THEN {_ALIASED} END
    WHEN 'rust' THEN CASE WHEN qualifier IS NULL AND coalesce(alias, {_LAST_OF}) = wanted THEN {_LAST_OF} END
    WHEN 'go' THEN CASE WHEN alias IS NOT DISTINCT FROM qualifier THEN wanted END
    WHEN 'java' THEN CASE WHEN qualifier IS NULL AND ({_HAS('attributes', 'wildcard_import')} OR split_part(spelling, '.', -1) = wanted) THEN wanted END
    WHEN 'csharp' THEN {_ALIASED} END AS served,
  CASE language WHEN 'typescript' THEN CASE WHEN imported <> '*' THEN imported END WHEN 'rust' THEN {_LAST_OF} WHEN 'java' THEN CASE WHEN NOT {_HAS('attributes', 'wildcard_import')} THEN split_part(spelling, '.', -1) END END AS bound FROM wanting""",
    "split_names": f"""WITH {_LISTS}, known(spelling, last, q, path, parent, file) AS (VALUES ('Foo', 'Foo', NULL, 'Foo', '', 'Foo'), ('bar', 'bar', NULL, 'bar', '', 'bar'), ('_x', '_x', NULL, '_x', '', '_x'), ('a::b::Foo', 'Foo', 'a::b', 'a::b::Foo', '', 'a::b::Foo'),
  ('p.q.Foo', 'Foo', 'p.q', 'p.q.Foo', '', 'p.q.Foo'), ('dir/sub/bar', 'bar', 'dir/sub', 'dir/sub/bar', 'dir/sub', 'bar'), ('Ünï', 'Ünï', NULL, 'Ünï', '', 'Ünï'), ('./a/../b/./c', '/c', './a/../b/', 'b/c', './a/../b/.', 'c'), ('../up', '/up', '.', NULL, '..', 'up'))
SELECT key, last, q AS qualifier, path, parent, file FROM lists JOIN known USING (spelling)""",
}
