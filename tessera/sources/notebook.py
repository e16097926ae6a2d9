"""Notes of a store: buckets of notes with their evidence, replaced one by one under a compare-and-set of the registry.

A note and its evidence lie in the bucket of its id. A write reads the buckets of its notes, writes each anew beside the old one, and
commits the registry with their new places. If another writer committed first, the write begins again on what is there then, so
that a revision is checked against the notes that it replaces. A bucket's place before the last is kept for readers that hold it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import schema
from tessera.limits import RequestError
from tessera.operators import notes
from tessera.sources.store import Store

#: Buckets of a store's notes, of which there are NOTES at most.
BUCKETS = 16
#: What decide() may answer to a write that is carried out.
DONE = ("created", "updated", "deleted")


def bucket(note_id: Column) -> Column:
    return F.pmod(F.xxhash64(note_id), F.lit(BUCKETS)).cast("int")


class Notebook:
    """The notes of one store. kind: the columns of its notes, `id` and `revision` among them."""

    def __init__(self, store: Store, kind: T.StructType = schema.NOTES, most: int = notes.NOTES):
        self.store, self.spark, self.kind, self.most = store, store.spark, kind, most

    def _read(self, table: str, kind: T.StructType, places: list[str]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.store.folder}/{table}/{p}" for p in places])

    def _places(self, registry: dict, buckets: list[int] | None = None) -> list[str]:
        held = registry.get("notes", {}).get("places", {})
        return [p for b, p in sorted(held.items()) if buckets is None or int(b) in buckets]

    def read(self) -> tuple[DataFrame, DataFrame]:
        """(notes, evidence) as of now."""
        places = self._places(self.store.registry())
        return self._read("notes", self.kind, places), self._read("note_evidence", schema.NOTE_EVIDENCE, places)

    def count(self) -> int:
        return self.store.registry().get("notes", {}).get("count", 0)

    def decide(self, have: DataFrame, writes: DataFrame, room: int) -> DataFrame:
        """notes.decide(), with the outcome limit for notes that would be more than there may be: the last ones by id."""
        done = notes.decide(have, writes)
        fresh = F.col("outcome") == "created"
        # deletions of the same call make room
        gone = F.sum(F.when(F.col("outcome") == "deleted", 1).otherwise(0)).over(Window.partitionBy(F.lit(0)))
        place = F.sum(F.when(fresh, 1).otherwise(0)).over(Window.partitionBy(F.lit(0)).orderBy("id"))
        ranked = done.withColumns({"__gone": gone, "__place": place})
        over = fresh & (F.col("__place") > F.lit(room) + F.col("__gone"))
        return ranked.select("id", F.when(over, "limit").otherwise(F.col("outcome")).alias("outcome"), F.when(~over, F.col("revision")).alias("revision"))

    def write(self, writes: DataFrame, evidence: DataFrame | None = None) -> list[dict]:
        """(id, outcome, revision) of each write, of which there may be as many as notes: their columns, expected_revision and delete, one row an id.

        Evidence of a written note replaces what it had; a deleted note loses its own. Nothing is written if no write is carried out.
        """
        writes = writes.select(*[F.col(n).cast(t.dataType) if n in writes.columns else F.lit(None).cast(t.dataType).alias(n) for n, t in ((f.name, f) for f in self.kind)], "expected_revision", "delete")
        touched = [r["b"] for r in writes.select(bucket(F.col("id")).alias("b")).distinct().collect()]
        for _ in range(20):
            registry = self.store.registry()
            state = registry.setdefault("notes", {"places": {}, "before": {}, "count": 0})
            places = self._places(registry, touched)
            have, rest = self._read("notes", self.kind, places), self._read("note_evidence", schema.NOTE_EVIDENCE, places)
            done = self.decide(have, writes, self.most - state["count"])
            answer = [r.asDict() for r in done.collect()]
            if not any(a["outcome"] in DONE for a in answer):
                return answer
            ids = {a["id"]: a for a in answer if a["outcome"] in DONE}
            decided = self.spark.createDataFrame([(i, a["outcome"], a["revision"]) for i, a in ids.items()], "__id string, __outcome string, __revision long")
            kept = have.join(decided, F.col("id") == F.col("__id"), "left_anti")
            fresh = writes.join(decided.filter("__outcome <> 'deleted'"), F.col("id") == F.col("__id")).withColumn("revision", F.col("__revision")).select(*self.kind.names)
            rest = rest.join(decided.filter("__outcome = 'deleted'"), F.col("memory_id") == F.col("__id"), "left_anti")
            if evidence is not None:
                new = evidence.join(decided.filter("__outcome <> 'deleted'"), F.col("memory_id") == F.col("__id"), "left_semi").select(*schema.NOTE_EVIDENCE.names)
                rest = notes.replace_evidence(rest, new)
            name = uuid.uuid4().hex
            for table, rows, key in (("notes", kept.unionByName(fresh), "id"), ("note_evidence", rest, "memory_id")):
                rows.withColumn("bucket", bucket(F.col(key))).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.store.folder}/{table}/{name}")
            left = self._change(state, name, touched)
            state["count"] += sum((a["outcome"] == "created") - (a["outcome"] == "deleted") for a in ids.values())
            try:
                self.store.commit(registry)
            except RequestError as error:
                if error.code != "WRITER_BUSY":
                    raise
                self._drop([name])
                continue
            self._drop(left)
            return answer
        raise RequestError("WRITER_BUSY")

    def _change(self, state: dict, name: str, touched: list[int]) -> list[str]:
        """Points the buckets to their new places; returns what no bucket points to any more."""
        old = {p.split("/")[0] for p in [*state["places"].values(), *state["before"].values()]}
        for b in touched:
            if str(b) in state["places"]:
                state["before"][str(b)] = state["places"][str(b)]
            state["places"][str(b)] = f"{name}/bucket={b}"
        # a bucket without rows has no folder
        for table in ("notes", "note_evidence"):
            for b in touched:
                path, fs = self.store._path(f"{table}/{name}/bucket={b}")
                fs.mkdirs(path)
        return sorted(old - {p.split("/")[0] for p in [*state["places"].values(), *state["before"].values()]})

    def _drop(self, names: list[str]) -> None:
        for table in ("notes", "note_evidence"):
            for n in names:
                path, fs = self.store._path(f"{table}/{n}")
                fs.delete(path, True)
