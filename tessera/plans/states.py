"""Queries on generations, notes and change hints."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import generations, notes, search
from tessera.sources import corpus
from tessera.sources.corpus import sql
from tessera.streaming import hints

GAP_US = 6 * 3600 * 1_000_000


def generation_diff(spark, folder):
    first, second = corpus.scans(spark, folder)
    return generations.diff(second, first)


def generation_progress(spark, folder):
    return generations.progress(generation_diff(spark, folder))


def to_parse(spark, folder):
    first, second = corpus.scans(spark, folder)
    return generations.to_parse(second, first).select("relative_path", "content_hash")


def next_generation(spark, folder):
    """Membership of a generation that begins with the active one, loses deleted files and gets what was parsed."""
    first, second = corpus.scans(spark, folder)
    gone = generations.deleted_paths(second, first)
    members = generations.begin(first, "g2", gone)
    return generations.staged(members, generations.to_parse(second, first), "g2").select("relative_path", "language", "content_hash", "analysis_key", "byte_length", "generation_id")


def _generations(spark):
    rows = [("g1", None, "superseded", True, True), ("g2", "g1", "superseded", True, True), ("g3", "g2", "active", True, True), ("g4", "g1", "building", False, False), ("g5", "g3", "abandoned", True, False)]
    from tessera.schema import GENERATIONS

    return spark.createDataFrame(rows, GENERATIONS)


def garbage(spark, folder):
    """File versions that stay after a clean-up of five generations."""
    first, second = corpus.scans(spark, folder)
    members = first.withColumn("generation_id", F.when(F.octet_length("relative_path") % 2 == 0, "g1").otherwise("g5")).unionByName(second.withColumn("generation_id", F.lit("g3")))
    versions = first.unionByName(second).select("relative_path", "content_hash", "analysis_key").distinct()
    return generations.collect_garbage(members, versions, _generations(spark))[1]


def job_dedup(spark, folder):
    """Requests of events as jobs: known keys start none, equal ones start one."""
    events = corpus.read(spark, folder, "events")
    requests = events.select(F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("job_id"), F.col("event_type").alias("operation"), F.col("user_id").cast("string").alias("request_key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("created_at"))
    jobs = requests.filter("operation = 'view' AND request_key < '2'").select("operation", "request_key").distinct()
    return generations.create_jobs(jobs, requests).select("operation", "request_key", "job_id", "created_at")


def job_transitions(spark, folder):
    """Steps of the event log that the state machine refuses: a step is an event and the one after it of its user."""
    names = ("queued", "scanning", "parsing", "resolving", "committing", "completed", "failed", "cancelled")
    at = lambda c: F.element_at(F.array(*map(F.lit, names)), (c % len(names) + 1).cast("int"))
    log = corpus.read(spark, folder, "events").select(F.col("event_id").cast("string").alias("job_id"), at(F.col("event_id")).alias("from_state"), at(F.col("event_id") + F.col("user_id")).alias("to_state"))
    return generations.transition_faults(log).groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))


def note_latest(spark, folder):
    return notes.latest(corpus.notes(spark, folder)).select("id", "revision", "scope", "updated_at", F.md5("body").alias("body"))


def note_status(spark, folder):
    files = corpus.files(spark, folder)
    return notes.evidence_status(notes.latest(corpus.notes(spark, folder)), corpus.note_evidence(spark, folder), files, corpus.symbols(spark, folder))


def note_writes(spark, folder):
    """Outcomes of writes with missing, right and wrong revisions, to known and unknown notes."""
    have = notes.latest(corpus.notes(spark, folder))
    key = F.regexp_extract("id", r"(\d+)", 1).cast("long")
    known = have.select("id", F.when(key % 4 == 0, F.lit(None)).when(key % 4 == 1, F.col("revision")).otherwise(F.col("revision") + 1).alias("expected_revision"), (key % 5 == 0).alias("delete"))
    fresh = have.select(F.concat("id", F.lit("-new")).alias("id"), F.when(key % 3 == 0, F.lit(1).cast("long")).alias("expected_revision"), (key % 5 == 0).alias("delete"))
    return notes.decide(have, known.unionByName(fresh)).fillna(0, ["revision"])


def search_notes(spark, folder):
    have = notes.latest(corpus.notes(spark, folder))
    found = search.search_notes(have, note_status(spark, folder), "the", include_stale=False, limit=100)
    return found.select("id", "revision", "evidence_status", F.round("score", 6).alias("score"))


def hint_bursts(spark, folder):
    return hints.bursts(corpus.hints(spark, folder), GAP_US)


def hint_windows(spark, folder):
    rows = hints.reconciliations(corpus.hints(spark, folder), "2 hours", capacity=25)
    return rows.select(F.unix_seconds("start").alias("start"), "hints", "path_count", "overflow", "trigger", "mode", "paths")


def hint_counters(spark, folder):
    return hints.counters(hints.reconciliations(corpus.hints(spark, folder), "2 hours", capacity=25))


QUERIES = {
    "generation_diff": generation_diff,
    "generation_progress": generation_progress,
    "files_to_parse": to_parse,
    "next_generation": next_generation,
    "garbage_collection": garbage,
    "job_dedup": job_dedup,
    "job_transition_faults": job_transitions,
    "note_latest": note_latest,
    "note_evidence_status": note_status,
    "note_write_outcomes": note_writes,
    "search_notes": search_notes,
    "hint_bursts": hint_bursts,
    "hint_reconciliations": hint_windows,
    "hint_counters": hint_counters,
}

_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY revision DESC, body DESC) AS n FROM notes) x WHERE n = 1)"
_STATUS = """checked AS (SELECT memory_id, bool_and(EXISTS (SELECT 1 FROM files f WHERE f.relative_path = e.relative_path AND f.content_hash = e.content_hash) AND (e.symbol_id IS NULL OR EXISTS (SELECT 1 FROM symbols s WHERE s.relative_path = e.relative_path AND s.symbol_id = e.symbol_id))) AS ok FROM note_evidence e GROUP BY 1),
status AS (SELECT id AS memory_id, CASE WHEN ok IS NULL THEN 'unverified' WHEN ok THEN 'verified' ELSE 'stale' END AS evidence_status FROM latest LEFT JOIN checked ON id = memory_id)"""
_DIFF = "diff AS (SELECT coalesce(a.relative_path, s.relative_path) AS relative_path, CASE WHEN s.relative_path IS NULL THEN 'deleted' WHEN a.relative_path IS NULL THEN 'added' WHEN a.content_hash = s.content_hash AND a.analysis_key = s.analysis_key THEN 'reused' ELSE 'changed' END AS state FROM active a FULL OUTER JOIN scanned s ON a.relative_path = s.relative_path)"
_WINDOWS = """flagged AS (SELECT *, path LIKE '%.rs' AS ok, CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) % 7200 AS start FROM hints),
windows AS (SELECT start, count(*) AS hints, count(DISTINCT path) AS path_count, CAST(greatest(count(*) - 25, 0) AS BIGINT) AS overflow, CASE WHEN count(*) > 25 THEN 'overflow' ELSE 'event' END AS trigger,
  CASE WHEN count(*) > 25 OR NOT bool_and(ok) THEN 'full' ELSE 'targeted' END AS mode, array_to_string(list_sort(list(DISTINCT path)), ',') AS paths FROM flagged GROUP BY start)"""
_FOUND = "list_filter(regexp_split_to_array(lower(body), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
SQL = {
    "generation_diff": sql("scans", "SELECT * FROM diff", more=_DIFF),
    "generation_progress": sql("scans", "SELECT count(*) FILTER (state <> 'deleted') AS discovered, count(*) FILTER (state = 'reused') AS reused, count(*) FILTER (state IN ('changed', 'added')) AS parsed, count(*) FILTER (state = 'deleted') AS deleted FROM diff", more=_DIFF),
    "files_to_parse": sql("scans", "SELECT relative_path, content_hash FROM scanned s WHERE NOT EXISTS (SELECT 1 FROM active a WHERE a.relative_path = s.relative_path AND a.content_hash = s.content_hash AND a.analysis_key = s.analysis_key)"),
    "next_generation": sql("scans", "SELECT relative_path, language, content_hash, analysis_key, byte_length, 'g2' AS generation_id FROM scanned"),
    "garbage_collection": sql("scans", "SELECT relative_path, content_hash, analysis_key FROM scanned UNION SELECT relative_path, content_hash, analysis_key FROM active WHERE strlen(relative_path) % 2 = 0"),
    "job_dedup": """SELECT operation, request_key, job_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY operation, request_key ORDER BY created_at, job_id) AS n
  FROM (SELECT event_type AS operation, user_id::VARCHAR AS request_key, 'job-' || event_id::VARCHAR AS job_id, CAST(floor(epoch(ts)) AS BIGINT) AS created_at FROM events) e WHERE NOT (operation = 'view' AND request_key < '2')) x WHERE n = 1""",
    "job_transition_faults": """WITH s AS (SELECT (['queued', 'scanning', 'parsing', 'resolving', 'committing', 'completed', 'failed', 'cancelled']) AS n),
l AS (SELECT n[event_id % 8 + 1] AS a, n[(event_id + user_id) % 8 + 1] AS b FROM events, s)
SELECT a AS from_state, b AS to_state, count(*) AS n FROM l WHERE a <> b AND NOT (a IN ('queued', 'scanning', 'parsing', 'resolving') AND b IN ('failed', 'cancelled')) AND NOT (a = 'committing' AND b IN ('completed', 'failed'))
AND NOT ((a, b) IN (('queued', 'scanning'), ('scanning', 'parsing'), ('parsing', 'resolving'), ('resolving', 'committing'))) GROUP BY 1, 2""",
    "note_latest": sql("notes", "SELECT id, revision, scope, updated_at, md5(body) AS body FROM latest", more=_LATEST),
    "note_evidence_status": sql("notes symbols files note_evidence", "SELECT * FROM status", more=f"{_LATEST}, {_STATUS}"),
    "note_write_outcomes": sql("notes", """SELECT id, outcome, CASE outcome WHEN 'updated' THEN had + 1 WHEN 'created' THEN 1 ELSE 0 END AS revision FROM (
  SELECT id, had, CASE WHEN had IS NULL AND del THEN 'not_found' WHEN had IS NOT NULL AND want IS NULL THEN 'revision_required' WHEN had IS NOT NULL AND want <> had THEN 'conflict' WHEN had IS NULL AND want IS NOT NULL THEN 'conflict' WHEN del THEN 'deleted' WHEN had IS NOT NULL THEN 'updated' ELSE 'created' END AS outcome
  FROM (SELECT id, revision AS had, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN revision ELSE revision + 1 END AS want, k % 5 = 0 AS del FROM keyed
    UNION ALL SELECT id || '-new', NULL, CASE WHEN k % 3 = 0 THEN 1 END, k % 5 = 0 FROM keyed) w) o""", more=f"{_LATEST}, keyed AS (SELECT *, CAST(replace(id, 'note-', '') AS BIGINT) AS k FROM latest)"),
    "search_notes": sql("notes symbols files note_evidence", """SELECT id, revision, evidence_status, round(score, 6) AS score FROM (SELECT c.*, evidence_status, -(greatest(ln((rows - n + 0.5) / (n + 0.5)), 0.000001) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(tokens) / mean))) AS score
  FROM counted c, stats, status WHERE f > 0 AND memory_id = id AND evidence_status <> 'stale') x ORDER BY score, updated_at DESC, id LIMIT 100""", more=f"{_LATEST}, {_STATUS}, counted AS (SELECT * EXCLUDE (n), len(list_filter(tokens, lambda t: t = 'the')) AS f FROM (SELECT *, {_FOUND} AS tokens FROM latest) t), stats AS (SELECT count(*) AS rows, avg(len(tokens)) AS mean, count(*) FILTER (f > 0) AS n FROM counted)"),
    "hint_bursts": sql("hints", "SELECT path, s AS burst_start_us, count(*) AS hints FROM (SELECT h.path, h.us, max(w.s) AS s FROM timed h JOIN walk w ON w.path = h.path AND w.s <= h.us GROUP BY h.path, h.us, h.event_id) x GROUP BY 1, 2", recursive=True, more=f"timed AS (SELECT path, epoch_us(ts) AS us, event_id FROM hints), walk(path, s) AS (SELECT path, min(us) FROM timed GROUP BY path UNION ALL SELECT path, nxt FROM (SELECT w.path, (SELECT min(us) FROM timed t WHERE t.path = w.path AND t.us >= w.s + {GAP_US}) AS nxt FROM walk w) y WHERE nxt IS NOT NULL)"),
    "hint_reconciliations": sql("hints", "SELECT start, hints, path_count, overflow, trigger, mode, paths FROM windows", more=_WINDOWS),
    "hint_counters": sql("hints", "SELECT CAST(sum(hints) AS BIGINT) AS hints, CAST(sum(overflow) AS BIGINT) AS overflow, count(*) FILTER (trigger = 'overflow') AS trigger_overflow, count(*) FILTER (trigger = 'event') AS trigger_event, count(*) FILTER (mode = 'full') AS mode_full, count(*) FILTER (mode = 'targeted') AS mode_targeted FROM windows", more=_WINDOWS),
}
