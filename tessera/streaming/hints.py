"""Change hints: bursts become one reconciliation, in batch and as a stream with the same results.

A burst begins with its first hint and lasts for the gap, however many hints follow; unlike a session window it is never
extended. Overflow of a burst past the capacity forces a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.sources.paths import supported, valid_path

#: Hints that a queue holds, paths that a targeted scan names at most, seconds between periodic scans.
CAPACITY, PERIOD_S = 1024, 60


def anchored(times: Column, gap_us: int) -> Column:
    """The first time of each burst in a sorted list of times in microseconds: a fold, as each burst begins where the last ended."""
    empty = F.array().cast("array<bigint>")
    return F.aggregate(times, empty, lambda acc, t: F.when((F.size(acc) == 0) | (t >= F.element_at(F.when(F.size(acc) > 0, acc).otherwise(F.array(t)), -1) + gap_us), F.concat(acc, F.array(t))).otherwise(acc))


def bursts(hints: DataFrame, gap_us: int, key: str = "path") -> DataFrame:
    """(key, burst_start_us, hints) of each burst of a key; times become whole microseconds.

    The list of one key's times is one row's state; a key is one watched path.
    """
    us = F.unix_micros("ts")
    starts = hints.groupBy(key).agg(F.sort_array(F.collect_list(us)).alias("times")).withColumn("starts", anchored(F.col("times"), gap_us))
    rows = starts.select(key, "times", F.posexplode("starts").alias("i", "burst_start_us"), "starts")
    after = F.element_at(F.concat("starts", F.array(F.lit(1 << 62))), F.col("i") + 2)
    inside = F.size(F.filter("times", lambda t: (t >= F.col("burst_start_us")) & (t < after)))
    return rows.select(key, "burst_start_us", inside.cast("long").alias("hints"))


def reconciliations(hints: DataFrame, window: str, capacity: int = CAPACITY) -> DataFrame:
    """One row a batch window: distinct paths in order, trigger, overflow, and how to scan.

    More hints than the capacity are counted as overflow and force a full scan, as does any path that is not a supported
    source inside of the root; else the paths are scanned alone.
    """
    rows = hints.withColumn("ok", valid_path(F.col("path")) & supported(F.col("path"))).groupBy(F.window("ts", window)["start"].alias("start"))
    row = rows.agg(F.count(F.lit(1)).alias("hints"), F.sort_array(F.collect_set("path")).alias("paths"), F.bool_and("ok").alias("all_ok"))
    over = F.greatest(F.col("hints") - capacity, F.lit(0))
    trigger = F.when(over > 0, "overflow").when(F.col("hints") > 0, "event").otherwise("periodic")
    mode = F.when((over > 0) | ~F.col("all_ok"), "full").otherwise("targeted")
    return row.select("start", "hints", F.size("paths").cast("long").alias("path_count"), over.cast("long").alias("overflow"), trigger.alias("trigger"), mode.alias("mode"), F.array_join("paths", ",").alias("paths"))


def with_periodic(reconciled: DataFrame, until: Column, period_s: int = PERIOD_S) -> DataFrame:
    """Reconciliations with the full scans that are due in between: one a period after the last, as each of either kind sets the clock back.

    until: the time up to which scans are due, exclusive. The next reconciliation is looked for within a day; that of a day's
    last one is the first of the next day that has any, from a table of one row a day.
    """
    names = reconciled.columns
    reconciled = reconciled.withColumn("day", F.date_trunc("day", "start"))
    days = reconciled.groupBy("day").agg(F.min("start").alias("first")).select("day", F.lead("first").over(Window.orderBy("day")).alias("next_day"))
    reconciled = reconciled.withColumn("next", F.lead("start").over(Window.partitionBy("day").orderBy("start"))).join(days, "day")
    after = F.least(F.coalesce("next", "next_day", until), until)
    first = F.col("start") + F.make_dt_interval(secs=F.lit(period_s))
    due = F.when(first < after, F.filter(F.sequence(first, after, F.make_dt_interval(secs=F.lit(period_s))), lambda t: t < after))
    idle = reconciled.withColumn("due", due).filter("due IS NOT NULL").select(F.explode("due").alias("start"))
    zero = F.lit(0).cast("long")
    idle = idle.select("start", zero.alias("hints"), zero.alias("path_count"), zero.alias("overflow"), F.lit("periodic").alias("trigger"), F.lit("full").alias("mode"), F.lit("").alias("paths"))
    return reconciled.select(*names).unionByName(idle)


def counters(reconciled: DataFrame) -> DataFrame:
    """One row: totals of hints, overflow, and scans by trigger and mode."""
    of = lambda c, v: F.coalesce(F.sum((F.col(c) == v).cast("long")), F.lit(0)).alias(f"{c}_{v}")
    return reconciled.agg(F.coalesce(F.sum("hints"), F.lit(0)).alias("hints"), F.coalesce(F.sum("overflow"), F.lit(0)).alias("overflow"), of("trigger", "overflow"), of("trigger", "event"), of("mode", "full"), of("mode", "targeted"))


class BurstProcessor(StatefulProcessor):
    """The same bursts from a stream whose hints come in order of time within a key.

    State is the open burst alone; it goes out when a later burst begins, or when the watermark passes its end.
    """

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start bigint, hints bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        start, hints = self.open.get() if self.open.exists() else (None, 0)
        times = sorted(int(t) for df in rows for t in df["us"])
        closed = []
        for t in times:
            if start is None or t >= start + self.gap_us:
                if start is not None:
                    closed.append((key[0], start, hints))
                start, hints = t, 0
            hints += 1
        self.open.update((start, hints))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((start + self.gap_us) // 1000 + 1)
        yield pd.DataFrame(closed, columns=["path", "burst_start_us", "hints"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rows = []
        if self.open.exists():
            start, hints = self.open.get()
            rows.append((key[0], start, hints))
            self.open.clear()
        yield pd.DataFrame(rows, columns=["path", "burst_start_us", "hints"])

    def close(self) -> None:
        pass


def burst_stream(hints: DataFrame, gap_us: int, delay: str = "0 seconds") -> DataFrame:
    """bursts() of a streaming DataFrame (ts, path)."""
    rows = hints.withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("path").transformWithStateInPandas(BurstProcessor(gap_us), "path string, burst_start_us bigint, hints bigint", "append", "EventTime")


def open_bursts(spark: SparkSession, hints: DataFrame, gap_us: int, checkpoint: str, name: str) -> DataFrame:
    """Runs the stream until all that is there is read, and returns its bursts, those that the watermark has closed."""
    query = burst_stream(hints, gap_us).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
