"""Bounds of notes over all of their evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans import catalog
from tessera.sources import corpus


def test_evidence_of_every_note_is_bounded(spark, folder):
    number = F.regexp_extract("source_symbol_id", r"(\d+)", 1).cast("long") % 50
    counts = {r["n"]: r["count"] for r in corpus.edges(spark, folder).groupBy(number.alias("n")).count().collect()}
    got = {r["id"] for r in catalog.queries()["note_bounds"](spark, folder).filter("fault = 'evidence'").collect()}
    assert {f"note-{n}" for n, c in counts.items() if c > 32} <= got and len(got) > 5
