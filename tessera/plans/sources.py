"""Queries on source text: sources are generated from the parts, so SQL knows what must be found in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.cluster import spread
from tessera.operators import extraction, resolution
from tessera.sources import corpus
from tessera.sources.paths import dialect


def extract_symbols(spark, folder):
    """Declarations, calls and references of nine dialects."""
    found = extraction.observations(extraction.parsed(corpus.dialect_sources(spark, folder)))
    return found.filter("category IN ('symbol', 'call_site', 'reference')").select("relative_path", "category", "kind", "spelling", "container")


def extract_files(spark, folder):
    return extraction.file_versions(extraction.parsed(corpus.dialect_sources(spark, folder))).withColumn("dialect", dialect(F.col("relative_path")))


def extract_ranges(spark, folder):
    """Byte ranges of Go functions: names, and the slices that they cut out of the content."""
    sources = corpus.go_sources(spark, folder)
    found = extraction.observations(extraction.parsed(sources)).filter("kind = 'function' AND category = 'symbol'").withColumnRenamed("relative_path", "p")
    rows = found.join(sources, F.col("p") == F.col("relative_path"))
    return rows.select("relative_path", "spelling", "start_byte", F.expr("CAST(substring(content, CAST(start_byte AS INT) + 1, CAST(end_byte - start_byte AS INT)) AS STRING)").alias("cut"))


def resolve_calls(spark, folder):
    """Calls of Go functions: in the file, in another file of the package, or nowhere."""
    sources = corpus.go_sources(spark, folder)
    found = resolution.cut(extraction.observations(extraction.parsed(spread(sources, "relative_path"))))
    files = sources.select("relative_path", "language")
    manifests = spark.createDataFrame([], "relative_path string, contents string")
    edges, _, _ = resolution.resolve(found, files, manifests, ("calls",))
    names = found.filter("category IN ('symbol', 'call_site')").select(F.col("relative_path").alias("p"), F.col("observation_id").alias("id"), "spelling")
    own, to = names.select(F.col("p").alias("p1"), F.col("id").alias("id1"), F.col("spelling").alias("source")), names.select(F.col("p").alias("p2"), F.col("id").alias("id2"), F.col("spelling").alias("target"))
    rows = edges.join(own, (F.col("source_path") == F.col("p1")) & (F.col("source_symbol_id") == F.col("id1")))
    rows = rows.join(to, (F.col("target_path") == F.col("p2")) & (F.col("target_symbol_id") == F.col("id2")), "left")
    return rows.select("source_path", "source", "target_path", "target", "resolution", "rule", "candidate_count")


def resolved_stats(spark, folder):
    """Sites of all Go sources by outcome."""
    sources = corpus.go_sources(spark, folder)
    found = resolution.cut(extraction.observations(extraction.parsed(spread(sources, "relative_path"))))
    edges, _, _ = resolution.resolve(found, sources.select("relative_path", "language"), spark.createDataFrame([], "relative_path string, contents string"), ("calls",))
    return resolution.stats(edges)


QUERIES = {"extract_symbols": extract_symbols, "extract_files": extract_files, "extract_ranges": extract_ranges, "resolve_calls": resolve_calls, "resolved_stats": resolved_stats}

_PARTS = "parts AS (SELECT p_partkey AS k, p_partkey // 20 AS f, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) AS t FROM part)"
_NAMES = {"rust": "fn_", "go": "Fn", "java": "m", "csharp": "M", "dart": "fn", "javascript": "fn", "jsx": "fn", "typescript": "fn", "tsx": "fn"}


def _extract_sql() -> str:
    parts = []
    for n, (d, e) in enumerate(corpus.GENERATED):
        name, inside = f"'{_NAMES[d]}' || k::VARCHAR", d in ("java", "csharp")
        box = "'C' || k::VARCHAR" if inside else "NULL"
        own = "method" if inside else "function"
        local = {"rust": "local", "go": "local", "java": "local", "csharp": "local", "dart": "local"}.get(d, "variable")
        call = "method" if d == "java" else "function"
        rows = [("symbol", own, name, box), ("symbol", "parameter", "'a'", name), ("symbol", local, "'v'", name), ("call_site", call, f"'{_NAMES[d]}' || t::VARCHAR", "NULL"), ("reference", "identifier", "'v'", "NULL")]
        if d in ("rust", "java", "typescript", "tsx"):
            rows.append(("reference", "identifier", "'a'", "NULL"))
        if d in ("rust", "go"):
            rows += [("reference", "type", "'i32'", "NULL") if d == "rust" else ("reference", "identifier", "'int'", "NULL")] * 2
        if inside:
            rows.append(("symbol", "class", box, "NULL"))
        parts += [f"SELECT 'src/file' || f::VARCHAR || '.{e}' AS relative_path, '{c}' AS category, '{kind}' AS kind, {s} AS spelling, {b} AS container FROM parts WHERE f % 9 = {n}" for c, kind, s, b in rows]
    return f"WITH {_PARTS} " + " UNION ALL ".join(parts)


_LINE = {d: corpus.LINES[d].replace("{{", "{").replace("}}", "}").replace("'", "''").replace("{k}", "' || k::VARCHAR || '").replace("{t}", "' || t::VARCHAR || '") for d in corpus.LINES}
_TEXTS = "CASE f % 9 " + " ".join(f"WHEN {n} THEN '{_LINE[d]}'" for n, (d, _) in enumerate(corpus.GENERATED)) + " END"
_GO = f"{_PARTS}, lines AS (SELECT *, '{_LINE['go']}' AS line, 'src/pkg' || (f % 10)::VARCHAR || '/file' || f::VARCHAR || '.go' AS path FROM parts)"
SQL = {
    "extract_symbols": _extract_sql(),
    "extract_files": f"""WITH {_PARTS}, texts AS (SELECT f, string_agg({_TEXTS}, chr(10) ORDER BY k) || chr(10) AS text FROM parts GROUP BY f)
SELECT 'src/file' || f::VARCHAR || '.' || (['rs', 'go', 'java', 'cs', 'dart', 'js', 'jsx', 'ts', 'tsx'])[f % 9 + 1] AS relative_path, (['rust', 'go', 'java', 'csharp', 'dart', 'javascript', 'jsx', 'typescript', 'tsx'])[f % 9 + 1] AS language,
  sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS byte_length, 'complete' AS parse_status, (['rust', 'go', 'java', 'csharp', 'dart', 'javascript', 'jsx', 'typescript', 'tsx'])[f % 9 + 1] AS dialect FROM texts""",
    "extract_ranges": f"WITH {_GO} SELECT path AS relative_path, 'Fn' || k::VARCHAR AS spelling, CAST(11 + 5 + coalesce(sum(strlen(line) + 1) OVER (PARTITION BY f ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte, 'Fn' || k::VARCHAR AS cut FROM lines",
    "resolve_calls": f"""WITH {_GO}, calls AS (SELECT a.path AS source_path, 'Fn' || a.k::VARCHAR AS source, b.path AS other, 'Fn' || a.t::VARCHAR AS name, a.f = b.f AS own, a.f % 10 = b.f % 10 AS near FROM lines a JOIN lines b ON b.k = a.t)
SELECT source_path, source, CASE WHEN near THEN other END AS target_path, CASE WHEN near THEN name END AS target, CASE WHEN near THEN 'lexically_resolved' ELSE 'unresolved' END AS resolution,
  CASE WHEN own THEN 'lexical-scope-v1' WHEN near THEN 'same-module-v1' ELSE 'no-supported-binding-v1' END AS rule, CASE WHEN near THEN 1 ELSE 0 END::BIGINT AS candidate_count FROM calls""",
    "resolved_stats": f"WITH {_PARTS} SELECT count(*) FILTER (k // 20 % 10 = t // 20 % 10) AS resolved, CAST(0 AS BIGINT) AS candidate, count(*) FILTER (k // 20 % 10 <> t // 20 % 10) AS unresolved, CAST(0 AS BIGINT) AS external FROM parts",
}
