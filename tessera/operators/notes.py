"""Project notes: revisions, the evidence that they rest on, and whether it still holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a body, evidence rows of a note, bytes of its evidence, notes of a project.
BODY, EVIDENCE, EVIDENCE_BYTES, NOTES = 16 << 10, 32, 8 << 10, 10_000


def latest(revisions: DataFrame) -> DataFrame:
    """The last revision of each note, by an arg-max that combines before the exchange."""
    rest = [c for c in revisions.columns if c not in ("id", "revision")]
    best = revisions.groupBy("id").agg(F.max(F.struct("revision", *rest)).alias("r"))
    return best.select("id", "r.*")


def decide(notes: DataFrame, writes: DataFrame) -> DataFrame:
    """(id, outcome, revision) of each write (id, expected_revision, delete).

    A note that is there needs its revision named: revision_required without, conflict with another. One that is not
    there must not have one named: conflict on a write, not_found on a delete. Else the revision goes up by one, from 1.
    """
    have = notes.select(F.col("id").alias("__id"), F.col("revision").alias("__revision"))
    rows = writes.join(have, F.col("id") == F.col("__id"), "left")
    there, named = F.col("__id").isNotNull(), F.col("expected_revision").isNotNull()
    outcome = (
        F.when(~there & F.col("delete"), "not_found")
        .when(there & ~named, "revision_required")
        .when(there & (F.col("expected_revision") != F.col("__revision")), "conflict")
        .when(~there & named, "conflict")
        .when(F.col("delete"), "deleted")
        .when(there, "updated")
        .otherwise("created")
    )
    rows = rows.withColumn("outcome", outcome)
    revision = F.when(F.col("outcome") == "updated", F.col("__revision") + 1).when(F.col("outcome") == "created", F.lit(1).cast("long"))
    return rows.select("id", "outcome", revision.alias("revision"))


def apply(notes: DataFrame, writes: DataFrame) -> DataFrame:
    """The notes after the writes that decide() allows; writes hold the columns of notes, expected_revision and delete."""
    done = decide(notes, writes)
    kept = notes.join(done.filter("outcome IN ('updated', 'deleted')").select("id"), "id", "left_anti")
    fresh = writes.drop("revision").join(done.filter("outcome IN ('updated', 'created')").select("id", "revision"), "id").select(*notes.columns)
    return kept.unionByName(fresh)


def replace_evidence(evidence: DataFrame, fresh: DataFrame) -> DataFrame:
    """Evidence after writes: all rows of a written note are replaced."""
    return evidence.join(fresh.select("memory_id").distinct(), "memory_id", "left_anti").unionByName(fresh)


def valid_evidence(evidence: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Evidence with `valid`: whether the active generation has the file with that hash, and the symbol in it if one is named."""
    have = files.select(F.col("relative_path").alias("__path"), F.col("content_hash").alias("__hash")).distinct()
    named = symbols.select(F.col("relative_path").alias("__spath"), F.col("symbol_id").alias("__symbol")).distinct()
    rows = evidence.join(have, (F.col("relative_path") == F.col("__path")) & (F.col("content_hash") == F.col("__hash")), "left")
    rows = rows.join(named, (F.col("relative_path") == F.col("__spath")) & (F.col("symbol_id") == F.col("__symbol")), "left")
    valid = F.col("__path").isNotNull() & (F.col("symbol_id").isNull() | F.col("__symbol").isNotNull())
    return rows.withColumn("valid", valid).select(*evidence.columns, "valid")


def evidence_status(notes: DataFrame, evidence: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(memory_id, evidence_status) of every note: unverified without evidence, stale if any of it fails, else verified."""
    held = valid_evidence(evidence, files, symbols).groupBy("memory_id").agg(F.bool_and("valid").alias("__all"))
    rows = notes.select(F.col("id").alias("__id")).distinct().join(held, F.col("__id") == F.col("memory_id"), "left")
    return rows.select(F.col("__id").alias("memory_id"), F.when(F.col("__all").isNull(), "unverified").when(F.col("__all"), "verified").otherwise("stale").alias("evidence_status"))


def bound_faults(notes: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, fault) of all notes past the bounds of body and evidence. How many notes a project may have is checked where they are committed."""
    size = F.octet_length("relative_path") + F.octet_length(F.coalesce("content_hash", F.lit(""))) + F.octet_length(F.coalesce("symbol_id", F.lit("")))
    sums = evidence.groupBy("memory_id").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    long = notes.filter(F.octet_length("body") > BODY).select("id", F.lit("body").alias("fault"))
    many = sums.filter((F.col("n") > EVIDENCE) | (F.col("bytes") > EVIDENCE_BYTES)).select(F.col("memory_id").alias("id"), F.lit("evidence").alias("fault"))
    return long.unionByName(many)


def history(revisions: DataFrame) -> DataFrame:
    """Revisions with the number of the one before, for a check that none is skipped."""
    return revisions.withColumn("before", F.lag("revision").over(Window.partitionBy("id").orderBy("revision")))
