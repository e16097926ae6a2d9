"""A watch that runs: a stream of change hints keeps the active generation of a store in step with its tree.

The first hint starts a timer that later ones don't move; hints that are there when it ends are taken in first. Then one
reconciliation goes out with all paths that were named. Without hints a full scan is due a period after the last reconciliation.
Each is run once by an Indexer, also over a restart: its job has a key made of the batch and its place there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tessera.cluster import ship
from tessera.operators import generations
from tessera.plans.indexing import Indexer
from tessera.sources import scan
from tessera.sources.paths import supported, valid_path
from tessera.streaming.hints import CAPACITY, PERIOD_S

#: Fixed value: milliseconds from the first hint to its reconciliation.
DEBOUNCE_MS = 250
RECONCILIATION = "tree string, trigger string, mode string, hints bigint, overflow bigint, paths array<string>"
COUNTERS = ("hints", "overflow", "overflow_scans", "event_scans", "periodic_scans", "full_scans", "targeted_scans")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Debounce(StatefulProcessor):
    """One row for each reconciliation of a tree (columns of RECONCILIATION), from hints (tree, path, ok, beat).

    State of a tree: its open hints, of which `capacity` paths are kept and the rest counted, and when the next periodic scan is due.
    """

    def __init__(self, debounce_ms: int, period_ms: int, capacity: int):
        self.debounce_ms, self.period_ms, self.capacity = debounce_ms, period_ms, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "due bigint, hints bigint, ok boolean, paths array<string>")
        self.periodic = handle.getValueState("periodic", "due bigint")

    def _next(self, due: int) -> None:
        if self.periodic.exists():
            self.handle.deleteTimer(self.periodic.get()[0])
        self.periodic.update((due,))
        self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        due, hints, ok, paths = self.open.get() if self.open.exists() else (None, 0, True, [])
        named, before = set(paths), hints
        for frame in rows:
            frame = frame[~frame["beat"]]
            named |= set(frame["path"].iloc[: max(0, self.capacity - hints)].dropna())
            ok = ok and bool(frame["ok"].all())
            hints += len(frame)
        if due is None and hints:
            due = now + self.debounce_ms
            self.handle.registerTimer(due)
        if hints > before:
            self.open.update((due, hints, ok, sorted(named)))
        if not self.periodic.exists():
            self._next(now + self.period_ms)
        yield pd.DataFrame(columns=["tree", "trigger", "mode", "hints", "overflow", "paths"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        due, hints, ok, paths = self.open.get() if self.open.exists() else (None, 0, True, [])
        if due is not None and due <= now:
            over = max(0, hints - self.capacity)
            out.append((key[0], "overflow" if over else "event", "full" if over or not ok else "targeted", hints, over, list(paths)))
            self.open.clear()
        elif self.periodic.get()[0] <= now:  # hints that wait keep their own time
            out.append((key[0], "periodic", "full", 0, 0, []))
        if out:
            self._next(now + self.period_ms)
        yield pd.DataFrame(out, columns=["tree", "trigger", "mode", "hints", "overflow", "paths"])

    def close(self) -> None:
        pass


def reconciliation_stream(hints: DataFrame, tree: str, debounce_ms: int = DEBOUNCE_MS, period_s: float = PERIOD_S, capacity: int = CAPACITY) -> DataFrame:
    """The reconciliations of a stream of hints (path) of one tree, a stream of RECONCILIATION rows.

    A null path says that something changed somewhere, and forces a full scan as a path does that is no supported source.
    """
    spark = hints.sparkSession
    ship(spark)
    of_tree, beat = F.lit(tree).alias("tree"), lambda is_beat: F.lit(is_beat).alias("beat")
    rows = hints.select(of_tree, "path", F.coalesce(valid_path(F.col("path")) & supported(F.col("path")), F.lit(False)).alias("ok"), beat(False))
    beats = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()  # a row a batch, so that time passes without hints
    rows = rows.unionByName(beats.select(of_tree, F.lit(None).cast("string").alias("path"), F.lit(True).alias("ok"), beat(True)))
    return rows.groupBy("tree").transformWithStateInPandas(Debounce(debounce_ms, int(period_s * 1000), capacity), RECONCILIATION, "append", "ProcessingTime")


class Watch:
    """Runs the reconciliations of one tree over one store."""

    def __init__(self, indexer: Indexer, root: str, name: str = "watch"):
        self.indexer, self.root, self.name = indexer, root, name

    def start(self, hints: DataFrame, checkpoint: str, every: str = "100 milliseconds", **bounds) -> StreamingQuery:
        """The running query; it goes on from its checkpoint. bounds: debounce_ms, period_s, capacity.

        What a process left half done when it died is given up first.
        """
        self.indexer.recover()
        spark = hints.sparkSession
        before = spark.conf.get(_PROVIDER, None)
        spark.conf.set(_PROVIDER, _ROCKS)  # a query keeps the one that it was started with
        try:
            stream = reconciliation_stream(hints, self.root, **bounds).writeStream.outputMode("append")
            return stream.queryName(self.name).option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(self.batch).start()
        finally:
            if before is None:
                spark.conf.unset(_PROVIDER)
            else:
                spark.conf.set(_PROVIDER, before)

    def batch(self, reconciliations: DataFrame, batch_id: int) -> None:
        """Runs what a batch asks for: a row a tree at most, of `capacity` paths at most."""
        query = reconciliations.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""  # of the checkpoint, over all its runs
        for i, row in enumerate(reconciliations.collect()):
            self.reconcile(row.asDict(), query, batch_id, i)

    def reconcile(self, row: dict, query: str, batch_id: int, place: int = 0) -> None:
        """Brings the generation up to date with the tree, or with the named paths of it; once, however often a batch comes.

        A failure is kept as last_error and ends there: the next full scan mends what it left.
        """
        last = self.status().get("last", ["", -1, -1])
        if last[0] == query and last[1:] >= [batch_id, place]:
            return
        error = None
        try:
            self._index(row, f"{self.name}-{query}-{batch_id}-{place}")
        except Exception as failure:  # the watch goes on
            error = str(failure)[:500]

        def change(registry: dict) -> None:
            now = registry.setdefault("watches", {}).setdefault(self.name, dict.fromkeys(COUNTERS, 0))
            now["hints"] += row["hints"]
            now["overflow"] += row["overflow"]
            now[f"{row['trigger']}_scans"] += 1
            now[f"{row['mode']}_scans"] += 1
            now |= {"last": [query, batch_id, place], "last_trigger": row["trigger"], "last_error": error}

        self.indexer.store.change(change)

    def _index(self, row: dict, key: str) -> None:
        spark, store = self.indexer.spark, self.indexer.store
        targeted = row["mode"] == "targeted" and store.pointer() is not None
        only = spark.createDataFrame([(p,) for p in row["paths"]], "relative_path string") if targeted else None
        files = scan.named(spark, self.root, row["paths"]) if targeted else scan.tree(spark, self.root)
        rules = scan.ignore_rules(files)
        if not self.indexer.stale(files, rules, only):
            return
        jobs = {j["request_key"]: j["state"] for j in self.indexer.jobs()}
        attempt = 0
        while (state := jobs.get(f"{key}#{attempt}")) is not None and state not in (*generations.LIVE, "completed"):
            attempt += 1
        job = self.indexer.run(files, f"{key}#{attempt}", f"g-{key}-{attempt}", rules, only=only)
        if job["state"] != "completed":
            raise RuntimeError(f"{job['job_id']} is {job['state']}")

    def status(self) -> dict:
        """Counters and the last reconciliation, over all runs of this watch."""
        return dict(self.indexer.store.registry().get("watches", {}).get(self.name, {}))
