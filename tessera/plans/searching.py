"""Queries on symbols, files and text."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.cluster import shared_folder
from tessera.operators import lookups, retrieval, search
from tessera.operators import postings as index
from tessera.sources import corpus
from tessera.sources.corpus import sql

SHOWN = ("tier", "match_kind", "relative_path", "spelling", "start_byte", "symbol_id")


def _search(query, **options):
    def run(spark, folder):
        return search.search_symbols(corpus.symbols(spark, folder), query, **options).select(*SHOWN, F.round("score", 6).alias("score"))

    return run


def _written(spark, folder) -> index.Postings:
    """The index of the corpus' symbols, written once a session and folder."""
    key = f"tessera_postings_{folder}"
    if not hasattr(spark, key):
        target = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
        index.write(corpus.symbols(spark, folder), target)
        setattr(spark, key, target)
    return index.Postings(spark, getattr(spark, key))


def _indexed(query, **options):
    def run(spark, folder):
        found = search.search_symbols(corpus.symbols(spark, folder), query, postings=_written(spark, folder), **options)
        return found.select(*SHOWN, F.round("score", 6).alias("score"))

    return run


def _named(query, **options):
    """The tiers of names from the files that can hold them; the dictionary is written once a session and folder."""

    def run(spark, folder):
        key = f"tessera_names_{folder}"
        if not hasattr(spark, key):
            target = f"{shared_folder(spark)}/names-{uuid.uuid4().hex}"
            lookups.write_names(corpus.symbols(spark, folder), target)
            setattr(spark, key, target)
        names = lookups.Names(spark, getattr(spark, key))
        return search.search_symbols(corpus.symbols(spark, folder), query, tokens=False, names=names, **options).select(*SHOWN, "score")

    return run


def _indexed_phrase(query):
    def run(spark, folder):
        return search.phrase_search(corpus.symbols(spark, folder), query, 200, _written(spark, folder)).select("symbol_id", "relative_path", "spelling", F.round("score", 6).alias("score"))

    return run


def _direct_sql(query: str, where: str = "true", limit: int = 201, qualified: str = "", after: str = "true") -> str:
    folded = query.lower()
    tier = f"CASE {qualified} WHEN spelling = '{query}' THEN 1 WHEN lower(spelling) = '{folded}' THEN 2 WHEN starts_with(lower(spelling), '{folded}') THEN CASE WHEN starts_with(spelling, '{query}') THEN 3 ELSE 4 END END"
    return sql("symbols", f"""SELECT CAST(tier AS INTEGER) AS tier, (['qualified_exact', 'exact', 'case_folded_exact', 'prefix', 'case_folded_prefix'])[tier + 1] AS match_kind, relative_path, spelling, start_byte, symbol_id, 0.0 AS score
FROM (SELECT *, {tier} AS tier FROM symbols WHERE {where}) t WHERE tier IS NOT NULL AND {after} ORDER BY tier, relative_path, spelling, start_byte, symbol_id LIMIT {limit}""")


_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda t: t <> '')"
_PARTS = r"trim(regexp_replace(lower(regexp_replace(regexp_replace(spelling, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+', ' ', 'g'))"
_DOCS = f"docs AS (SELECT *, {_TOKENS.format('spelling')} || {_TOKENS.format('relative_path')} || {_TOKENS.format('content')} AS tokens FROM (SELECT *, kind || ' ' || spelling || ' ' || {_PARTS} || ' ' || signature AS content FROM symbols) s)"


def _bm25_sql(terms: list[str]) -> str:
    freq = ", ".join(f"len(list_filter(tokens, lambda t: t = '{w}')) AS f{i}" for i, w in enumerate(terms))
    n = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(terms)))
    part = " + ".join(f"greatest(ln((rows - n{i} + 0.5) / (n{i} + 0.5)), 0.000001) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len(tokens) / mean))" for i in range(len(terms)))
    every = " AND ".join(f"f{i} > 0" for i in range(len(terms)))
    return f"{_DOCS}, counted AS (SELECT *, {freq} FROM docs), stats AS (SELECT count(*) AS rows, avg(len(tokens)) AS mean, {n} FROM counted), matched AS (SELECT c.*, -({part}) AS score FROM counted c, stats WHERE {every})"


def _token_sql(query: str, terms: list[str], limit: int) -> str:
    folded = query.lower()
    more = _bm25_sql(terms) + f""", best AS (SELECT relative_path AS p, spelling AS n, min(score) AS score FROM matched WHERE NOT starts_with(lower(spelling), '{folded}') GROUP BY ALL),
tiers AS (SELECT s.*, CASE WHEN spelling = '{query}' THEN 1 WHEN lower(spelling) = '{folded}' THEN 2 WHEN starts_with(lower(spelling), '{folded}') THEN CASE WHEN starts_with(spelling, '{query}') THEN 3 ELSE 4 END END AS direct FROM symbols s),
everything AS (SELECT direct AS tier, 0.0 AS score, relative_path, spelling, start_byte, symbol_id FROM tiers WHERE direct IS NOT NULL
  UNION ALL SELECT 5, b.score, relative_path, spelling, start_byte, symbol_id FROM tiers JOIN best b ON p = relative_path AND n = spelling WHERE direct IS NULL)"""
    return sql("symbols", f"SELECT CAST(tier AS INTEGER) AS tier, (['qualified_exact', 'exact', 'case_folded_exact', 'prefix', 'case_folded_prefix', 'identifier_tokens'])[tier + 1] AS match_kind, relative_path, spelling, start_byte, symbol_id, round(score, 6) AS score FROM (SELECT * FROM everything ORDER BY tier, score, relative_path, spelling, start_byte, symbol_id LIMIT {limit}) e", more=more)


def _phrase(query):
    def run(spark, folder):
        return search.phrase_search(corpus.symbols(spark, folder), query, 200).select("symbol_id", "relative_path", "spelling", F.round("score", 6).alias("score"))

    return run


def _phrase_sql(terms: list[str], limit: int) -> str:
    n, target = len(terms), "[" + ", ".join(f"'{t}'" for t in terms) + "]"
    count = " + ".join(f"len(list_filter(range(1, greatest(len({c}) - {n} + 2, 1)), lambda i: {c}[i : i + {n - 1}] = {target}))" for c in ("a", "b", "c"))
    more = f"{_DOCS}, split AS (SELECT *, {_TOKENS.format('spelling')} AS a, {_TOKENS.format('relative_path')} AS b, {_TOKENS.format('content')} AS c FROM docs), counted AS (SELECT *, {count} AS f FROM split), stats AS (SELECT count(*) AS rows, avg(len(tokens)) AS mean, count(*) FILTER (f > 0) AS n FROM counted)"
    score = "-(greatest(ln((rows - n + 0.5) / (n + 0.5)), 0.000001) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(tokens) / mean)))"
    return sql("symbols", f"SELECT symbol_id, relative_path, spelling, round({score}, 6) AS score FROM counted, stats WHERE f > 0 ORDER BY {score}, relative_path, spelling, symbol_id LIMIT {limit}", more=more)


def identifier_tokens(spark, folder):
    return corpus.symbols(spark, folder).select("symbol_id", F.array_join(T.identifier_tokens(F.col("spelling")), " ").alias("tokens"))


def postings(spark, folder):
    docs = search.search_documents(corpus.symbols(spark, folder))
    return search.postings(docs, "symbol_id", "spelling", "relative_path", "content").select("term", "symbol_id", "times", F.col("length").cast("long").alias("length"))


def get_symbol(spark, folder):
    return retrieval.get_symbol(corpus.symbols(spark, folder), "sym-42").select("symbol_id", "relative_path", "kind", "spelling", "container", "signature", "start_byte", "end_byte")


def file_outline(spark, folder):
    return retrieval.file_outline(corpus.symbols(spark, folder), "src/pkg4/file4.rs").select("symbol_id", "kind", "spelling", "start_byte", "end_byte")


def repository_files(spark, folder):
    return retrieval.repository_files(corpus.files(spark, folder), corpus.symbols(spark, folder))


def coverage(spark, folder):
    return retrieval.coverage(corpus.files(spark, folder))


def _map(**options):
    def run(spark, folder):
        return retrieval.repo_map(corpus.files(spark, folder), corpus.symbols(spark, folder), **options)

    return run


def _map_sql(limit: int, depth: int, scope: str | None = None) -> str:
    where = f"relative_path = '{scope}' OR starts_with(lower(relative_path), '{scope.lower()}/')" if scope else "true"
    above = scope.count("/") + 1 if scope else 0
    more = f"""first AS (SELECT f.relative_path, f.language, f.parse_status, count(symbol_id) AS symbol_count FROM files f LEFT JOIN symbols s ON f.relative_path = s.relative_path WHERE {where.replace('relative_path', 'f.relative_path')} GROUP BY ALL ORDER BY f.relative_path LIMIT {limit}),
parts AS (SELECT string_split(relative_path, '/') AS p, symbol_count, unnest(range(1, len(string_split(relative_path, '/')))) AS i FROM first),
entries AS (SELECT array_to_string(p[1:i], '/') AS path, 'directory' AS kind, NULL AS language, NULL AS parse_status, CAST(sum(symbol_count) AS BIGINT) AS symbol_count FROM parts GROUP BY 1
  UNION ALL SELECT relative_path, 'file', language, parse_status, symbol_count FROM first)"""
    return sql("files symbols", f"SELECT * FROM entries WHERE greatest(len(string_split(path, '/')) - {above}, 0) <= {depth + 1} ORDER BY path, kind LIMIT {limit + 1}", more=more)


def path_rules(spark, folder):
    """Host and path of pages as relative paths, tried, normalised and classified."""
    from tessera.sources.paths import denied, dialect, supported, valid_path

    url = F.regexp_replace("url", "^https?://", "")
    path = F.concat(url, F.when(F.col("page_id") % 5 == 0, "/../a.rs").when(F.col("page_id") % 5 == 1, "/./build/x.min.js").when(F.col("page_id") % 5 == 2, "/.env.local").when(F.col("page_id") % 5 == 3, "/Q.RS").otherwise("//b"))
    rows = corpus.read(spark, folder, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", valid_path(F.col("path")).alias("valid"), denied(F.col("path")).alias("denied"), supported(F.col("path")).alias("supported"), dialect(F.col("path")).alias("dialect"), T.normalized_path(F.col("path")).alias("normalized"), T.parent_path(F.col("path")).alias("parent"))


_CLEAN = "regexp_replace(url, '^https?://', '')"
PATH_SQL = f"""WITH p AS (SELECT page_id, {_CLEAN} || (['/../a.rs', '/./build/x.min.js', '/.env.local', '/Q.RS', '//b'])[page_id % 5 + 1] AS path FROM pages),
s AS (SELECT *, string_split(path, '/') AS parts, regexp_extract(path, '[^/]*$') AS name FROM p),
n AS (SELECT *, list_filter(parts, lambda x: x <> '' AND x <> '.') AS real FROM s)
SELECT page_id, len(list_filter(parts, lambda x: x = '' OR x = '.' OR x = '..')) = 0 AS valid,
  name LIKE '.env.%' OR name LIKE '%.min.js' OR list_contains(parts, 'build') AS denied, page_id % 5 IN (0, 1, 3) AS supported,
  CASE page_id % 5 WHEN 0 THEN 'rust' WHEN 1 THEN 'javascript' END AS dialect,
  CASE WHEN page_id % 5 = 0 THEN array_to_string(real[1 : len(real) - 3] || ['a.rs'], '/') ELSE array_to_string(real, '/') END AS normalized,
  regexp_replace(path, '/[^/]*$', '') AS parent FROM n"""


def content_ranges(spark, folder):
    """Byte slices and line numbers of documents: offsets count bytes of UTF-8, not characters."""
    docs = corpus.read(spark, folder, "documents").filter(F.octet_length("text") >= 40)
    return docs.select("doc_id", F.hex(T.byte_slice(F.col("text"), F.lit(7), F.lit(31))).alias("bytes"), T.line_of(F.col("text"), F.octet_length("text") - 5).cast("long").alias("line"))


def _document_sources(spark, folder):
    docs = corpus.read(spark, folder, "documents")
    return docs.select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("relative_path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def read_code(spark, folder):
    """Second and third lines of documents: some hashes are old, some files are gone, some have fewer lines."""
    sources, key = _document_sources(spark, folder), F.col("doc_id")
    expected = sources.select("relative_path", F.when(key % 7 == 0, F.lit("0" * 64)).otherwise(F.sha2("content", 256)).alias("content_hash"))
    return retrieval.line_excerpts(sources.filter(key % 11 != 0).select("relative_path", "content"), expected, 2, 3, 200).fillna({"text": "", "lines": 0, "truncated": False})


def byte_excerpts(spark, folder):
    """Starts of documents, cut to 40 bytes before a character."""
    sources = _document_sources(spark, folder)
    ranges = sources.select("relative_path", F.lit(0).cast("long").alias("start_byte"), (F.col("doc_id") % 60).alias("end_byte"))
    return retrieval.byte_excerpts(sources.select("relative_path", "content"), ranges, 40).select("relative_path", "start_byte", F.col("end_byte").cast("long").alias("end_byte"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "code")


def greedy_snippets(spark, folder):
    """Ranges of all symbols, those left out that overlap one of a better rank in their file; rank goes by name."""
    ranges = corpus.symbols(spark, folder).filter("kind <> 'module'").select("relative_path", "symbol_id", F.concat("spelling", F.lit(":"), "symbol_id").alias("rank"), F.col("syntax_start_byte").alias("start_byte"), F.col("syntax_end_byte").alias("end_byte"))
    return retrieval.suppress_overlaps(ranges, "relative_path", ["rank"]).select("relative_path", "symbol_id")


def value_percentiles(spark, folder):
    """Percentiles, mean and extremes of samples by kind, as of latencies."""
    v = F.col("value")
    return corpus.read(spark, folder, "events").groupBy("event_type").agg(F.round(F.percentile(v, 0.5), 6).alias("p50"), F.round(F.percentile(v, 0.95), 6).alias("p95"), F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"))


QUERIES = {
    "read_code": read_code,
    "byte_excerpts": byte_excerpts,
    "greedy_snippets": greedy_snippets,
    "value_percentiles": value_percentiles,
    "search_symbols_direct": _search("redring", limit=200, tokens=False),
    "search_symbols_prefix": _search("red", limit=200, tokens=False),
    "search_symbols_filtered": _search("hot", limit=200, tokens=False, language="rust", kind="class", path_prefix="src"),
    "search_symbols_qualified": _search("Brand17.RedWidget", limit=200, tokens=False),
    "search_symbols_page": _search("old", limit=20, tokens=False, after=(4, 0.0, "src/pkg1/file1.go", "Old", 0, "")),
    "search_symbols_tokens": _search("boltNew", limit=200),
    "phrase_search": _phrase("cold anvil"),
    "indexed_tokens": _indexed("boltNew", limit=200),
    "indexed_phrase": _indexed_phrase("cold anvil"),
    "indexed_direct": _named("redring", limit=200),
    "indexed_prefix": _named("red", limit=200),
    "indexed_qualified": _named("Brand17.RedWidget", limit=200),
    "identifier_tokens": identifier_tokens,
    "postings": postings,
    "get_symbol": get_symbol,
    "file_outline": file_outline,
    "repository_files": repository_files,
    "coverage": coverage,
    "repo_map": _map(limit=150, depth=2),
    "repo_map_scoped": _map(limit=100, depth=1, scope="src/pkg1"),
    "path_rules": path_rules,
    "content_ranges": content_ranges,
}

SQL = {
    "read_code": """WITH s AS (SELECT doc_id, 'doc_' || doc_id::VARCHAR AS relative_path, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT *, CASE WHEN parts[len(parts)] = '' THEN len(parts) - 1 ELSE len(parts) END AS n FROM s),
c AS (SELECT *, parts[2] || chr(10) AS second, parts[3] || CASE WHEN len(parts) > 3 THEN chr(10) ELSE '' END AS third FROM l),
o AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'source_deleted' WHEN doc_id % 7 = 0 THEN 'content_changed' WHEN n < 3 THEN 'invalid_range' WHEN strlen(second) > 200 THEN 'response_too_large' ELSE 'ok' END AS status, strlen(second) + strlen(third) > 200 AS cut FROM c)
SELECT relative_path, status, CASE WHEN status = 'ok' THEN CASE WHEN cut THEN second ELSE second || third END ELSE '' END AS text, CAST(CASE WHEN status = 'ok' THEN CASE WHEN cut THEN 1 ELSE 2 END ELSE 0 END AS INTEGER) AS lines, status = 'ok' AND cut AS truncated FROM o""",
    "byte_excerpts": """WITH s AS (SELECT 'doc_' || doc_id::VARCHAR AS relative_path, doc_id % 60 AS e, text, list_transform(range(1, length(text) + 1), lambda i: strlen(text[1:i])) AS ends FROM (SELECT doc_id, substr(coalesce(text, ''), 1, 60) AS text, strlen(coalesce(text, '')) AS size FROM documents) d WHERE doc_id % 60 > 0 AND doc_id % 60 <= size),
c AS (SELECT *, text[1:len(list_filter(ends, lambda n: n <= least(e, 40)))] AS code FROM s)
SELECT relative_path, CAST(0 AS BIGINT) AS start_byte, CAST(strlen(code) AS BIGINT) AS end_byte, CAST(1 AS BIGINT) AS start_line, CAST(1 + strlen(code) - strlen(replace(code, chr(10), '')) AS BIGINT) AS end_line, code FROM c WHERE code <> ''""",
    "greedy_snippets": sql("symbols", """SELECT relative_path, symbol_id FROM (SELECT relative_path, unnest(list_reduce(list_prepend([], list_transform(rows, lambda r: [r])), lambda kept, r: CASE WHEN len(list_filter(kept, lambda k: k.a < r[1].b AND r[1].a < k.b)) = 0 THEN kept || r ELSE kept END)).id AS symbol_id
FROM (SELECT relative_path, list({'a': syntax_start_byte, 'b': syntax_end_byte, 'id': symbol_id} ORDER BY spelling || ':' || symbol_id) AS rows FROM symbols WHERE kind <> 'module' GROUP BY 1) g) x"""),
    "value_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1",
    "search_symbols_direct": _direct_sql("redring"),
    "indexed_direct": _direct_sql("redring"),
    "indexed_prefix": _direct_sql("red"),
    "indexed_qualified": _direct_sql("Brand17.RedWidget", qualified="WHEN spelling = 'RedWidget' AND (coalesce(container, '') || '.' || spelling = 'Brand17.RedWidget' OR coalesce(container, '') || '::' || spelling = 'Brand17.RedWidget') THEN 0"),
    "search_symbols_prefix": _direct_sql("red"),
    "search_symbols_filtered": _direct_sql("hot", "language = 'rust' AND kind = 'class' AND (relative_path = 'src' OR starts_with(lower(relative_path), 'src/'))"),
    "search_symbols_qualified": _direct_sql("Brand17.RedWidget", qualified="WHEN spelling = 'RedWidget' AND (coalesce(container, '') || '.' || spelling = 'Brand17.RedWidget' OR coalesce(container, '') || '::' || spelling = 'Brand17.RedWidget') THEN 0"),
    "search_symbols_page": _direct_sql("old", limit=21, after="(tier, 0.0, relative_path, spelling, start_byte, symbol_id) > (4, 0.0, 'src/pkg1/file1.go', 'Old', 0, '')"),
    "search_symbols_tokens": _token_sql("boltNew", ["bolt", "new"], 201),
    "phrase_search": _phrase_sql(["cold", "anvil"], 200),
    "indexed_tokens": _token_sql("boltNew", ["bolt", "new"], 201),
    "indexed_phrase": _phrase_sql(["cold", "anvil"], 200),
    "identifier_tokens": sql("symbols", f"SELECT symbol_id, {_PARTS} AS tokens FROM symbols"),
    "postings": sql("symbols", "SELECT term, symbol_id, count(*) AS times, length FROM (SELECT symbol_id, CAST(len(tokens) AS BIGINT) AS length, unnest(tokens) AS term FROM docs) d GROUP BY ALL", more=_DOCS),
    "get_symbol": sql("symbols", "SELECT symbol_id, relative_path, kind, spelling, container, signature, start_byte, end_byte FROM symbols WHERE symbol_id = 'sym-42'"),
    "file_outline": sql("symbols", "SELECT symbol_id, kind, spelling, start_byte, end_byte FROM symbols WHERE relative_path = 'src/pkg4/file4.rs' ORDER BY start_byte, end_byte, symbol_id LIMIT 201"),
    "repository_files": sql("files symbols", "SELECT f.*, n AS symbol_count FROM files f JOIN (SELECT f.relative_path AS p, count(symbol_id) AS n FROM files f LEFT JOIN symbols s ON f.relative_path = s.relative_path GROUP BY 1) c ON f.relative_path = p"),
    "coverage": sql("files", "SELECT count(*) AS files, count(*) FILTER (parse_status = 'complete') AS complete, count(*) FILTER (parse_status = 'partial') AS partial, count(*) FILTER (parse_status = 'failed') AS failed, CASE WHEN bool_and(parse_status = 'complete') THEN 'syntax_and_name_resolution' ELSE 'ready_with_warnings' END AS status FROM files"),
    "repo_map": _map_sql(150, 2),
    "repo_map_scoped": _map_sql(100, 1, "src/pkg1"),
    "path_rules": PATH_SQL,
    "content_ranges": "SELECT doc_id, substr(hex(encode(text)), 15, 48) AS bytes, 1 + len(string_split(substr(hex(encode(text)), 1, 0), 'x')) - 1 + CAST((SELECT count(*) FROM (SELECT unnest(range(strlen(text) - 5)) AS i) r WHERE substr(hex(encode(text)), 2 * i + 1, 2) = '0A') AS BIGINT) AS line FROM documents WHERE strlen(text) >= 40",
}
