"""What stands around what in a file: one sorted pass with a stack of open ranges, so work goes with rows and depth, not with pairs.

Ranges of a syntax tree nest. Where a file's do not, as a broken source may give, its stack is searched as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.cluster import ship

FIELDS = ("relative_path", "category", "observation_id", "kind", "start_byte", "end_byte", "syntax_start_byte", "syntax_end_byte")


class Open:
    """The ranges around a place that moves forward. A range is (start, end, order, row); of equal sizes the least order is smaller."""

    def __init__(self, ranges: list[tuple]):
        self.waiting = sorted(ranges, key=lambda r: (r[0], -r[1]))
        self.at, self.stack, self.nested = 0, [], True

    def move(self, start: int) -> None:
        """Opens what begins up to here, and closes what ended before."""
        while self.at < len(self.waiting) and self.waiting[self.at][0] <= start:
            new = self.waiting[self.at]
            self.at += 1
            self._close(new[0] + (new[1] > new[0]))  # what ends where a range begins is beside it
            if self.stack and self.stack[-1][1] < new[1]:
                self.nested = False
            self.stack.append(new)
        self._close(start)

    def _close(self, start: int) -> None:
        if self.nested:
            while self.stack and self.stack[-1][1] < start:
                self.stack.pop()
        else:
            self.stack = [r for r in self.stack if r[1] >= start]

    def around(self, start: int, end: int) -> Iterator[tuple]:
        """The open ranges that hold this one, the smallest first."""
        if not self.nested:
            yield from sorted((r for r in self.stack if r[0] <= start and r[1] >= end), key=lambda r: (r[1] - r[0], r[2]))
            return
        same: list[tuple] = []
        for r in reversed(self.stack):
            if r[1] < end:
                continue
            if same and (r[0], r[1]) != (same[0][0], same[0][1]):
                yield from sorted(same, key=lambda x: x[2])
                same = []
            same.append(r)
        yield from sorted(same, key=lambda x: x[2])


def by_file(observations: DataFrame, each: Callable[[list[dict]], Iterator[tuple]], schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """each() over the rows of every file: one exchange by file; a task holds the rows of one file, which extraction bounds."""
    ship(observations.sparkSession)
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, rows = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["relative_path"] != path and rows:
                    out += each(rows)
                    rows = []
                path = row["relative_path"]
                rows.append(row)
            yield table(out)
        yield table(list(each(rows)) if rows else [])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return observations.select(*FIELDS).repartition("relative_path").sortWithinPartitions("relative_path").mapInArrow(run, schema)
