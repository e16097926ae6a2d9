"""Queries on scans, the store, the registry's states, notes' bounds, cursors and single rows of a generation."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.cluster import shared_folder, ship
from tessera.functions.text import content_id
from tessera.limits import RequestError
from tessera.operators import generations, graph, notes, paging, retrieval
from tessera.sources import corpus, modules, scan
from tessera.sources.corpus import sql
from tessera.sources.notebook import Notebook
from tessera.sources.store import Store
from tessera.streaming import hints

#: Files of a tree: (path, content, bytes). A size of its own stands for a file that is larger than its content.
_FILES = (
    ("app{K}/main.rs", "fn a() {}", None), ("app{K}/wide.go", "// é\n", None), ("app{K}/node_modules/x.js", "1", None), ("app{K}/gen/y.ts", "1", None), ("app{K}/a.skip.go", "1", None),
    ("app{K}/keep.skip.go", "package a", None), ("app{K}/big.java", "1", 3 << 20), ("app{K}/note.txt", "1", None), ("app{K}/.env.rs", "1", None), ("app{K}/../x.rs", "1", None),
    ("app{K}/Up.RS", "fn u() {}", None), ("app{K}/nul.rs", "\0", None), ("app{K}/deep/er/gen/z.dart", "1", None),
)
_IGNORE = "gen/\n*.skip.go\n!keep.skip.go\n# a comment\n"
_MANIFEST = "module example.org/app\n"


def _tree(spark, folder) -> DataFrame:
    """(relative_path, byte_length, content) of a tree a file of the corpus, an ignore file and a manifest."""
    rows = modules.grown(spark, folder, _FILES, "relative_path content size").withColumn("content", F.encode("content", "UTF-8"))
    rows = rows.select("relative_path", F.coalesce("size", F.octet_length("content")).cast("long").alias("byte_length"), "content")
    roots = spark.createDataFrame([(".gitignore", bytearray(_IGNORE.encode())), ("go.mod", bytearray(_MANIFEST.encode()))], "relative_path string, content binary")
    return rows.unionByName(roots.select("relative_path", F.octet_length("content").cast("long").alias("byte_length"), "content"))


def scanned_files(spark, folder):
    """What a scan takes of trees with ignored, denied, unsound, unsupported and large files."""
    files = _tree(spark, folder)
    return scan.scan(files, scan.ignore_rules(files)).select("relative_path", "byte_length")


def targeted_scan(spark, folder):
    """Wanted paths that a scan takes; others are simply absent."""
    files = _tree(spark, folder)
    wanted = modules.grown(spark, folder, (("app{K}/main.rs",), ("app{K}/gen/y.ts",), ("app{K}/gone.rs",)), "relative_path")
    return scan.scan_paths(files, wanted, scan.ignore_rules(files)).select("relative_path")


def scan_state(spark, folder):
    files = _tree(spark, folder)
    return scan.scan_status(files, scan.ignore_rules(files))


def source_faults(spark, folder):
    """Sources with their hash, and why some may not be parsed."""
    return scan.safe_sources(_tree(spark, folder)).select("relative_path", "language", "content_hash", "fault")


def root_manifests(spark, folder):
    return scan.manifests(_tree(spark, folder))


def written_tree(spark, folder):
    """A tree that is written to the shared folder and scanned there: paths and lengths."""
    root = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    lines = corpus.read(spark, folder, "nation").select(F.col("n_regionkey").alias("region"), F.concat(F.lit("// "), "n_name").alias("line"))
    lines.repartition(1).sortWithinPartitions("region").write.partitionBy("region").option("lineSep", "\n").text(root)
    return scan.tree(spark, root).filter("relative_path LIKE '%.txt'").select(F.regexp_extract("relative_path", "^([^/]*)/", 1).alias("directory"), "byte_length", F.sha2("content", 256).alias("content_hash"))


def _store(spark) -> Store:
    return Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


def activated_files(spark, folder):
    """Files of the active generation, read from a store that holds two."""
    first, second = corpus.scans(spark, folder)
    store = _store(spark)
    for name, rows in (("g1", first), ("g2", second)):
        store.write("files", rows, name)
        store.switch(name)
    return store.read("files").select("relative_path", "content_hash", "generation_id")


def appended_versions(spark, folder):
    """File versions after two generations were appended, and the second once more: each is there once."""
    first, second = corpus.scans(spark, folder)
    store, kind = _store(spark), first.schema
    for rows in (first, second, second):
        store.append_versions(rows, kind)
    return spark.read.schema(kind).parquet(f"{store.folder}/file_versions").select("relative_path", "content_hash", "analysis_key")


def replaced_edges(spark, folder):
    """Edges of a generation after its graph was written anew; the other generation's stay."""
    edges, store = corpus.edges(spark, folder), _store(spark)
    store.write("edges", edges.filter("relationship = 'calls'"), "g1")
    store.write("edges", edges, "g2")
    store.write("edges", edges.filter("relationship = 'imports'"), "g2")
    return store.read("edges", "g1").unionByName(store.read("edges", "g2")).select("edge_id", "relationship", "generation_id")


def _generations(spark, folder) -> DataFrame:
    """A chain of generations, one a supplier: the second is active, the third may follow, later ones are building or abandoned."""
    key = F.col("s_suppkey")
    name = lambda k: F.concat(F.lit("g"), k.cast("string"))
    status = F.when(key < 2, "superseded").when(key == 2, "active").when(key % 3 == 0, "building").otherwise("abandoned")
    return corpus.read(spark, folder, "supplier").select(name(key).alias("generation_id"), F.when(key > 1, name(key - 1)).alias("parent_id"), status.alias("status"), (key % 2 == 1).alias("scan_complete"), (key % 2 == 1).alias("resolved"))


def activated_generation(spark, folder):
    return generations.activate(_generations(spark, folder), "g3").select("generation_id", "status")


def abandoned_generation(spark, folder):
    return generations.abandon(_generations(spark, folder), "g6").select("generation_id", "status")


def _jobs(spark, folder) -> DataFrame:
    states = ("queued", "scanning", "parsing", "resolving", "committing", "completed", "failed", "cancelled")
    key = F.col("event_id")
    return corpus.read(spark, folder, "events").select(F.concat(F.lit("job-"), key.cast("string")).alias("job_id"), F.element_at(F.array(*map(F.lit, states)), (key % 8 + 1).cast("int")).alias("state"), (key % 5 == 0).alias("cancel_requested"), (key % 997).alias("created_at"))


def recovered_generations(spark, folder):
    return generations.recover(_generations(spark, folder), _jobs(spark, folder))[0].select("generation_id", "status")


def recovered_jobs(spark, folder):
    return generations.recover(_generations(spark, folder), _jobs(spark, folder))[1].select("job_id", "state")


def latest_job(spark, folder):
    return generations.latest_job(_jobs(spark, folder)).select("job_id", "state")


def cancelled_job(spark, folder):
    """Jobs after one was asked to stop: one more has the mark."""
    return generations.request_cancel(_jobs(spark, folder), "job-1")[0].groupBy("cancel_requested").agg(F.count(F.lit(1)).alias("n"))


def replaced_evidence(spark, folder):
    """Evidence after writes to some notes: all rows of a written note are replaced."""
    have = corpus.note_evidence(spark, folder)
    fresh = have.filter("memory_id LIKE '%1'").select("memory_id", F.lit("new.rs").alias("relative_path"), F.lit("0").alias("content_hash"), F.lit(None).cast("string").alias("symbol_id")).distinct()
    return notes.replace_evidence(have, fresh).select("memory_id", "relative_path", "symbol_id")


def _written_notes(spark, folder, **options) -> tuple[Notebook, list[dict]]:
    """A store to which all notes of the corpus were written in one call, and the answers."""
    have = notes.latest(corpus.notes(spark, folder))
    book = Notebook(_store(spark), have.schema, **options)
    return book, book.write(have.withColumns({"expected_revision": F.lit(None).cast("long"), "delete": F.lit(False)}))


def stored_notes(spark, folder):
    """Notes of a store after a second round of writes: some expect a revision that is not there, some delete, one note in four is left alone."""
    book, _ = _written_notes(spark, folder)
    have, n = notes.latest(corpus.notes(spark, folder)), F.regexp_extract("id", r"(\d+)", 1).cast("long")
    writes = have.filter(n % 4 != 0).withColumns({"body": F.concat(F.lit("again "), "body"), "expected_revision": F.when(n % 3 == 0, F.lit(2)).otherwise(F.lit(1)).cast("long"), "delete": n % 5 == 0})
    book.write(writes)
    return book.read()[0].select("id", "revision", "body")


def capped_notes(spark, folder):
    """Answers of a store that holds 60 notes at most."""
    answers = _written_notes(spark, folder, most=60)[1]
    return spark.createDataFrame([(a["id"], a["outcome"], a["revision"]) for a in answers], "id string, outcome string, revision long")


def note_bounds(spark, folder):
    """Notes whose body or evidence is past the bounds."""
    have = notes.latest(corpus.notes(spark, folder)).withColumn("body", F.repeat("body", (F.regexp_extract("id", r"(\d+)", 1).cast("int") % 40) * 10))
    evidence = corpus.edges(spark, folder).select(F.concat(F.lit("note-"), (F.regexp_extract("source_symbol_id", r"(\d+)", 1).cast("long") % 50).cast("string")).alias("memory_id"), F.col("target_path").alias("relative_path"), F.lit("0").alias("content_hash"), F.col("target_symbol_id").alias("symbol_id"))
    return notes.bound_faults(have, evidence)


def generation_counts(spark, folder):
    return retrieval.counts(corpus.files(spark, folder), corpus.symbols(spark, folder), corpus.edges(spark, folder))


def neighbours(spark, folder):
    """Edges around a symbol in both directions, one step."""
    found = graph.neighbours(corpus.edges(spark, folder), "sym-7", max_edges=2000)
    return found.select("edge_id", "direction", F.col("position").cast("long").alias("position"))


def content_ids(spark, folder):
    """Stable ids of rows with nulls and numbers."""
    s = corpus.symbols(spark, folder)
    return s.select("symbol_id", content_id(F.col("symbol_id"), F.col("container"), F.col("start_byte")).alias("id"))


def cursor_checks(spark, folder):
    """Cursors of symbols, sound or spoilt in one of six ways: the code that reading them ends with, or the key that they hold."""
    ship(spark)

    @F.pandas_udf("string")
    def checked(keys: pd.Series, spelling: pd.Series) -> pd.Series:
        def one(key: int, name: str) -> str:
            way, query = key % 7, paging.fingerprint("q", key)
            text = paging.encode(paging.Cursor("search", "repo", "g1", query, (name, paging.score_text(key / 7))))
            text = {1: text + "00", 2: "zz", 3: text.upper() if text.upper() != text else text + "x"}.get(way, text)
            asked = ("other" if way == 4 else "search", "repo2" if way == 5 else "repo", "g2" if way == 6 else "g1", query)
            try:
                found = paging.checked(text, *asked)
                return f"{found.sort[0]}/{paging.score_of(found.sort[1]) == key / 7}"
            except RequestError as error:
                return str(error).split(":")[0].split(" ")[0]

        return pd.Series([one(k, s) for k, s in zip(keys, spelling, strict=True)])

    s = corpus.symbols(spark, folder).withColumn("key", F.regexp_extract("symbol_id", r"(\d+)", 1).cast("long"))
    return s.select("key", checked("key", "spelling").alias("outcome"))


def periodic_scans(spark, folder):
    """Reconciliations of hints, and the full scans that are due where none came for two hours."""
    rows = hints.reconciliations(corpus.hints(spark, folder).filter("event_id % 40 = 0"), "2 hours", capacity=25)
    end = F.lit("2030-01-01 00:00:00").cast("timestamp")
    rows = hints.with_periodic(rows, F.least(F.lit(end), F.max("start").over(Window.partitionBy()) + F.make_dt_interval(days=F.lit(1))), 7200)
    return rows.select(F.unix_seconds("start").alias("start"), "hints", "trigger", "mode")


QUERIES = {
    "scanned_files": scanned_files, "targeted_scan": targeted_scan, "scan_state": scan_state, "source_faults": source_faults, "root_manifests": root_manifests, "written_tree": written_tree,
    "activated_files": activated_files, "appended_versions": appended_versions, "replaced_edges": replaced_edges, "activated_generation": activated_generation, "abandoned_generation": abandoned_generation,
    "recovered_generations": recovered_generations, "recovered_jobs": recovered_jobs, "latest_job": latest_job, "cancelled_job": cancelled_job, "replaced_evidence": replaced_evidence, "note_bounds": note_bounds,
    "stored_notes": stored_notes, "capped_notes": capped_notes,
    "generation_counts": generation_counts, "neighbours": neighbours, "content_ids": content_ids, "cursor_checks": cursor_checks, "periodic_scans": periodic_scans,
}

_TREES = f"trees AS (SELECT DISTINCT (p_partkey // {corpus.PER_FILE})::VARCHAR AS k FROM part)"
_GEN = "gens AS (SELECT 'g' || s_suppkey::VARCHAR AS generation_id, s_suppkey AS k, CASE WHEN s_suppkey < 2 THEN 'superseded' WHEN s_suppkey = 2 THEN 'active' WHEN s_suppkey % 3 = 0 THEN 'building' ELSE 'abandoned' END AS status FROM supplier)"
_JOBS = "jobs AS (SELECT 'job-' || event_id::VARCHAR AS job_id, (['queued', 'scanning', 'parsing', 'resolving', 'committing', 'completed', 'failed', 'cancelled'])[event_id % 8 + 1] AS state, event_id % 5 = 0 AS cancel_requested, event_id % 997 AS created_at FROM events)"
_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY revision DESC, body DESC) AS n FROM notes) x WHERE n = 1)"
_STEP = "source_path, source_start_byte, edge_id"


def _faults_sql() -> str:
    """Every file of a tree with its dialect, hash and fault, said one by one."""
    said = {"main.rs": ("rust", None), "wide.go": ("go", None), "node_modules/x.js": ("javascript", "excluded"), "gen/y.ts": ("typescript", None), "a.skip.go": ("go", None), "keep.skip.go": ("go", None), "big.java": ("java", None), "note.txt": (None, "excluded"), ".env.rs": ("rust", "excluded"), "../x.rs": ("rust", "excluded"), "Up.RS": (None, "unsupported_dialect"), "nul.rs": ("rust", "binary"), "deep/er/gen/z.dart": ("dart", None)}
    quoted = lambda v: "NULL" if v is None else f"'{v}'"
    text = lambda v: "chr(0)" if v == "\0" else "'" + v.replace("\n", "' || chr(10) || '") + "'"
    rows = [f"SELECT 'app' || k || '/{p[7:]}' AS relative_path, {quoted(said[p[7:]][0])} AS language, sha256({text(c)}) AS content_hash, {quoted(said[p[7:]][1])} AS fault FROM trees" for p, c, _ in _FILES]
    roots = [f"SELECT '{p}', NULL, sha256({text(c)}), 'excluded'" for p, c in ((".gitignore", _IGNORE), ("go.mod", _MANIFEST))]
    return f"WITH {_TREES} " + " UNION ALL ".join(rows + roots)


SQL = {
    "scanned_files": f"WITH {_TREES} SELECT 'app' || k || name AS relative_path, CAST(n AS BIGINT) AS byte_length FROM trees, (VALUES ('/main.rs', 9), ('/wide.go', 6), ('/keep.skip.go', 9), ('/Up.RS', 9), ('/nul.rs', 1)) v(name, n)",
    "targeted_scan": f"WITH {_TREES} SELECT 'app' || k || '/main.rs' AS relative_path FROM trees",
    "scan_state": f"WITH {_TREES} SELECT 6 * count(*) AS found, CAST(count(*) AS BIGINT) AS too_large, count(*) AS directories, true AS complete FROM trees",
    "source_faults": _faults_sql(),
    "root_manifests": "SELECT 'go.mod' AS relative_path, 'module example.org/app' || chr(10) AS contents",
    "written_tree": "SELECT 'region=' || n_regionkey::VARCHAR AS directory, CAST(sum(length(n_name) + 4) AS BIGINT) AS byte_length, sha256(string_agg('// ' || n_name || chr(10), '' ORDER BY n_nationkey)) AS content_hash FROM nation GROUP BY n_regionkey",
    "activated_files": sql("scans", "SELECT relative_path, content_hash, 'g2' AS generation_id FROM scanned"),
    "appended_versions": sql("scans", "SELECT relative_path, content_hash, analysis_key FROM active UNION SELECT relative_path, content_hash, analysis_key FROM scanned"),
    "replaced_edges": sql("edges", "SELECT edge_id, relationship, 'g1' AS generation_id FROM edges WHERE relationship = 'calls' UNION ALL SELECT edge_id, relationship, 'g2' FROM edges WHERE relationship = 'imports'"),
    "activated_generation": f"WITH {_GEN} SELECT generation_id, CASE k WHEN 3 THEN 'active' WHEN 2 THEN 'superseded' ELSE status END AS status FROM gens",
    "abandoned_generation": f"WITH {_GEN} SELECT generation_id, CASE k WHEN 6 THEN 'abandoned' ELSE status END AS status FROM gens",
    "recovered_generations": f"WITH {_GEN} SELECT generation_id, replace(status, 'building', 'abandoned') AS status FROM gens",
    "recovered_jobs": f"WITH {_JOBS} SELECT job_id, CASE WHEN state IN ('completed', 'failed', 'cancelled') THEN state ELSE 'interrupted' END AS state FROM jobs",
    "latest_job": f"WITH {_JOBS} SELECT job_id, state FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 1",
    "cancelled_job": f"WITH {_JOBS} SELECT cancel_requested OR job_id = 'job-1' AS cancel_requested, count(*) AS n FROM jobs GROUP BY 1",
    "replaced_evidence": sql("files note_evidence", "SELECT memory_id, relative_path, symbol_id FROM note_evidence WHERE memory_id NOT LIKE '%1' UNION ALL SELECT DISTINCT memory_id, 'new.rs', NULL FROM note_evidence WHERE memory_id LIKE '%1'"),
    "note_bounds": sql("notes edges", "SELECT id, 'body' AS fault FROM latest WHERE strlen(body) * (CAST(regexp_extract(id, '([0-9]+)', 1) AS BIGINT) % 40) * 10 > 16384 UNION ALL SELECT memory_id, 'evidence' FROM (SELECT 'note-' || (CAST(regexp_extract(source_symbol_id, '([0-9]+)', 1) AS BIGINT) % 50)::VARCHAR AS memory_id, * FROM edges) e GROUP BY memory_id HAVING count(*) > 32 OR sum(strlen(target_path) + 1 + strlen(target_symbol_id)) > 8192", more=_LATEST),
    "stored_notes": sql("notes", "SELECT id, CASE WHEN n % 4 = 0 OR n % 3 = 0 THEN 1 ELSE 2 END AS revision, CASE WHEN n % 4 = 0 OR n % 3 = 0 THEN body ELSE 'again ' || body END AS body FROM (SELECT *, CAST(regexp_extract(id, '([0-9]+)', 1) AS BIGINT) AS n FROM latest ORDER BY id LIMIT 10000) x WHERE NOT (n % 5 = 0 AND n % 4 <> 0 AND n % 3 <> 0)", more=_LATEST.replace(" AS n FROM notes) x WHERE n = 1", " AS r FROM notes) x WHERE r = 1")),
    "capped_notes": sql("notes", "SELECT id, CASE WHEN place <= 60 THEN 'created' ELSE 'limit' END AS outcome, CASE WHEN place <= 60 THEN 1 END AS revision FROM (SELECT id, row_number() OVER (ORDER BY id) AS place FROM (SELECT DISTINCT id FROM notes) d) x"),
    "generation_counts": sql("symbols files edges", "SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM edges) AS edges"),
    "neighbours": sql("edges", f"SELECT edge_id, direction, row_number() OVER (PARTITION BY direction ORDER BY {_STEP}) - 1 AS position FROM (SELECT *, 'outgoing' AS direction FROM edges WHERE source_symbol_id = 'sym-7' UNION ALL SELECT *, 'incoming' FROM edges WHERE target_symbol_id = 'sym-7') e"),
    "content_ids": sql("symbols", "SELECT symbol_id, sha256(symbol_id || chr(0) || coalesce(container, '') || chr(0) || start_byte::VARCHAR || chr(0)) AS id FROM symbols"),
    "cursor_checks": sql("symbols", "SELECT key, CASE WHEN key % 7 IN (1, 2, 3, 4) THEN 'INVALID_CURSOR' WHEN key % 7 = 5 THEN 'CROSS_REPOSITORY_ID' WHEN key % 7 = 6 THEN 'STALE_CURSOR' ELSE spelling || '/True' END AS outcome FROM (SELECT *, CAST(regexp_extract(symbol_id, '([0-9]+)', 1) AS BIGINT) AS key FROM symbols) s"),
    "periodic_scans": sql("hints", """SELECT s AS start, CAST(coalesce(n, 0) AS BIGINT) AS hints, CASE WHEN n > 25 THEN 'overflow' WHEN n > 0 THEN 'event' ELSE 'periodic' END AS trigger, CASE WHEN n > 25 OR n IS NULL OR NOT ok THEN 'full' ELSE 'targeted' END AS mode
FROM (SELECT unnest(range((SELECT min(start) FROM windows), (SELECT max(start) FROM windows) + 86400, 7200)) AS s) g LEFT JOIN windows ON s = start""",
        more="windows AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) % 7200 AS start, count(*) AS n, bool_and(path LIKE '%.rs') AS ok FROM hints WHERE event_id % 40 = 0 GROUP BY 1)"),
}
