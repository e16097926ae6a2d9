"""Generations of the index: what a scan changes, what is parsed again, and how one generation follows another.

States are DataFrames; every change is a rewrite of keyed rows by anti-joins and unions, so it scales with what changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.limits import RequestError

#: The states that a job may go to from each; staying is always allowed.
TRANSITIONS = {
    "queued": ("scanning", "cancelled", "failed"),
    "scanning": ("parsing", "cancelled", "failed"),
    "parsing": ("resolving", "cancelled", "failed"),
    "resolving": ("committing", "cancelled", "failed"),
    "committing": ("completed", "failed"),
}
LIVE = tuple(TRANSITIONS)


def _equal(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def diff(scanned: DataFrame, active: DataFrame, keys: tuple[str, ...] = ("content_hash", "analysis_key")) -> DataFrame:
    """One row a path of either side: reused (all keys equal), changed, added, or deleted. One exchange a side."""
    mine = scanned.select(F.col("relative_path").alias("__p"), *[F.col(k).alias(f"__{k}") for k in keys])
    both = active.select("relative_path", *keys).join(mine, F.col("relative_path") == F.col("__p"), "full_outer")
    same = F.lit(True)
    for k in keys:
        same = same & _equal(k, f"__{k}")
    state = F.when(F.col("__p").isNull(), "deleted").when(F.col("relative_path").isNull(), "added").when(same, "reused").otherwise("changed")
    return both.select(F.coalesce("relative_path", "__p").alias("relative_path"), state.alias("state"))


def deleted_paths(scanned: DataFrame, active: DataFrame) -> DataFrame:
    return active.select("relative_path").join(scanned.select("relative_path"), "relative_path", "left_anti")


def to_parse(scanned: DataFrame, active: DataFrame) -> DataFrame:
    """Scanned files whose content or analysis is not in the active generation: only these are read and parsed."""
    return scanned.join(active.select("relative_path", "content_hash", "analysis_key"), ["relative_path", "content_hash", "analysis_key"], "left_anti")


def analysis_key(*parts: Column) -> Column:
    """Fingerprints of language, grammar, query, extractor and configuration, each framed by its length."""
    return F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts])


def progress(changes: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Counters of a run: discovered, reused, parsed, deleted, and failed and warned files of what was parsed."""
    count = lambda *states: F.coalesce(F.sum(F.col("state").isin(*states).cast("long")), F.lit(0))
    row = changes.agg(count("reused", "changed", "added").alias("discovered"), count("reused").alias("reused"), count("changed", "added").alias("parsed"), count("deleted").alias("deleted"))
    if parsed is None:
        return row
    bad = parsed.agg(*[F.coalesce(F.sum((F.col("parse_status") == s).cast("long")), F.lit(0)).alias(n) for s, n in (("failed", "failed"), ("partial", "warnings"))])
    return row.join(F.broadcast(bad))  # one row each


def begin(parent: DataFrame | None, generation_id: str, remove: DataFrame | None = None) -> DataFrame | None:
    """Membership of a new generation: the parent's, less the removed paths, each of which must be a member."""
    if parent is None:
        return None
    if remove is not None:
        if not remove.select("relative_path").join(parent.select("relative_path"), "relative_path", "left_anti").isEmpty():
            raise RequestError("INVALID_ARGUMENT", "a removed path is no member")
        parent = parent.join(remove.select("relative_path"), "relative_path", "left_anti")
    return parent.withColumn("generation_id", F.lit(generation_id))


def staged(members: DataFrame | None, versions: DataFrame, generation_id: str) -> DataFrame:
    """Membership after new file versions: the last writer of a path wins."""
    fresh = versions.withColumn("generation_id", F.lit(generation_id))
    if members is None:
        return fresh
    return members.join(versions.select("relative_path"), "relative_path", "left_anti").unionByName(fresh)


def new_versions(versions: DataFrame, stored: DataFrame) -> DataFrame:
    """File versions that the store doesn't have yet; versions never change, so the rest is skipped."""
    return versions.join(stored.select("relative_path", "content_hash", "analysis_key"), ["relative_path", "content_hash", "analysis_key"], "left_anti")


def activate(generations: DataFrame, generation_id: str, job_state: str = "committing") -> DataFrame:
    """The generations after the switch: this one active, the active one superseded.

    Only a building generation of a complete scan that is resolved may follow, while its job commits.
    """
    row = generations.filter(F.col("generation_id") == generation_id).first()
    if row is None or row["status"] != "building" or not row["scan_complete"] or not row["resolved"] or job_state != "committing":
        raise RequestError("STORAGE_ERROR", "the generation can't be activated")
    mine = F.col("generation_id") == generation_id
    return generations.withColumn("status", F.when(mine, "active").when(F.col("status") == "active", "superseded").otherwise(F.col("status")))


def abandon(generations: DataFrame, generation_id: str) -> DataFrame:
    mine = (F.col("generation_id") == generation_id) & (F.col("status") == "building")
    return generations.withColumn("status", F.when(mine, "abandoned").otherwise(F.col("status")))


def retained(generations: DataFrame) -> DataFrame:
    """Generations that a clean-up keeps: the active one, its parent, and parents of building ones, which are kept as well."""
    active = generations.filter("status = 'active'")
    building = generations.filter("status = 'building'")
    ids = active.select("generation_id").unionByName(active.select(F.col("parent_id").alias("generation_id"))).unionByName(building.select("generation_id")).unionByName(building.select(F.col("parent_id").alias("generation_id")))
    return generations.join(ids.filter("generation_id IS NOT NULL").distinct(), "generation_id", "left_semi")


def collect_garbage(members: DataFrame, versions: DataFrame, generations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memberships, file versions) that kept generations still need; orphans go by semi-joins down the chain."""
    kept = members.join(retained(generations).select("generation_id"), "generation_id", "left_semi")
    return kept, versions.join(kept.select("relative_path", "content_hash", "analysis_key"), ["relative_path", "content_hash", "analysis_key"], "left_semi")


def recover(generations: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After a crash: building generations are abandoned, live jobs interrupted."""
    return generations.withColumn("status", F.when(F.col("status") == "building", "abandoned").otherwise(F.col("status"))), jobs.withColumn("state", F.when(F.col("state").isin(*LIVE), "interrupted").otherwise(F.col("state")))


def create_jobs(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests that no job of their (operation, request_key) exists for; of equal requests, the first by (created_at, job_id)."""
    first = requests.groupBy("operation", "request_key").agg(F.min(F.struct("created_at", "job_id")).alias("f")).select("operation", "request_key", F.col("f.job_id").alias("job_id"), F.col("f.created_at").alias("created_at"))
    fresh = first.join(jobs.select("operation", "request_key"), ["operation", "request_key"], "left_anti")
    return fresh.withColumns({"state": F.lit("queued"), "cancel_requested": F.lit(False)})


def transition_faults(log: DataFrame) -> DataFrame:
    """Steps (job_id, from_state, to_state) that the state machine doesn't allow."""
    allowed = F.col("from_state") == F.col("to_state")
    for a, b in TRANSITIONS.items():
        allowed = allowed | ((F.col("from_state") == a) & F.col("to_state").isin(*b))
    return log.filter(~allowed)


def request_cancel(jobs: DataFrame, job_id: str) -> tuple[DataFrame, str]:
    """(jobs, outcome): requested, already_requested or already_finished; asking twice changes nothing more."""
    row = jobs.filter(F.col("job_id") == job_id).first()
    if row is None:
        raise RequestError("JOB_NOT_FOUND", job_id)
    if row["state"] not in LIVE:
        return jobs, "already_finished"
    if row["cancel_requested"]:
        return jobs, "already_requested"
    return jobs.withColumn("cancel_requested", F.col("cancel_requested") | (F.col("job_id") == job_id)), "requested"


def latest_job(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(1)
