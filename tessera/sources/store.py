"""The index on a file system: immutable rows by generation, and one registry that a rename switches."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import schema
from tessera.limits import RequestError
from tessera.operators.generations import new_versions


T_ = TypeVar("T_")
#: Writers of one process take turns; between processes the rename decides.
_COMMITS = threading.Lock()


class Store:
    """Tables below a folder of any file system that Spark writes; rows of a generation are a partition of their own."""

    def __init__(self, spark: SparkSession, folder: str, root_id: str = "root"):
        self.spark, self.folder, self.root_id = spark, folder.rstrip("/"), root_id

    # -- the registry

    def _path(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def registry(self) -> dict:
        """What the store holds: the active generation and the one before, all generations, all jobs.

        Every change is a file of its own with the next number; the highest one counts. A change is written aside and becomes
        visible by one rename to a name that isn't there yet, so a crash leaves the last whole state, and of two writers one fails.
        Between processes this holds on file systems that refuse to rename onto a file, as HDFS does; local disks and object stores
        may not, and there one process at a time may write.
        """
        for _ in range(20):
            numbers = self._numbers()
            if not numbers:
                return {"version": schema.VERSION, "root_id": self.root_id, "active": None, "previous": None, "generations": [], "jobs": []}
            text = self._text(f"registry/{numbers[-1]:012d}.json")
            if text is None:  # two commits came between the list and the read
                continue
            found = json.loads(text)
            if found["version"] != schema.VERSION or found["root_id"] != self.root_id:
                raise RequestError("STORAGE_ERROR", "the store is of another version or root")
            return found | {"number": numbers[-1]}
        raise RequestError("STORAGE_ERROR", "the registry changes faster than it can be read")

    def _text(self, name: str) -> str | None:
        """A small file, read by the file system without a job; None if it is gone."""
        path, fs = self._path(name)
        try:
            stream = fs.open(path)
        except Py4JJavaError as error:
            if "FileNotFound" in error.java_exception.getClass().getName():
                return None
            raise
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _numbers(self) -> list[int]:
        path, fs = self._path("registry")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def commit(self, registry: dict) -> None:
        """Makes a registry, changed since it was read, the current one; fails if another writer was first."""
        number = registry.get("number", 0) + 1
        aside, fs = self._path(f"registry/next-{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps({k: v for k, v in registry.items() if k != "number"}).encode()))
        out.close()
        target, _ = self._path(f"registry/{number:012d}.json")
        with _COMMITS:
            first = not fs.exists(target) and (self._numbers() or [0])[-1] < number and fs.rename(aside, target)
        if not first:
            fs.delete(aside, False)
            raise RequestError("WRITER_BUSY", "another writer was first")
        registry["number"] = number
        for old in self._numbers()[:-3]:
            path, _ = self._path(f"registry/{old:012d}.json")
            fs.delete(path, False)

    def change(self, change: Callable[[dict], T_]) -> T_:
        """Applies a change to the registry, again on what is there then if another writer was first."""
        for _ in range(20):
            registry = self.registry()
            got = change(registry)
            try:
                self.commit(registry)
            except RequestError as error:
                if error.code != "WRITER_BUSY":
                    raise
                continue
            return got
        raise RequestError("WRITER_BUSY")

    def pointer(self) -> dict | None:
        found = self.registry()
        return found if found["active"] is not None else None

    def switch(self, generation_id: str) -> None:
        """Makes a generation the active one."""
        now = self.registry()
        self.commit(now | {"active": generation_id, "previous": now["active"]})

    def active(self) -> str:
        found = self.pointer()
        if found is None:
            raise RequestError("INDEX_NOT_READY")
        return found["active"]

    # -- tables

    def write(self, table: str, rows: DataFrame, generation_id: str) -> None:
        """Replaces a table's rows of one generation; other generations are not touched.

        Ids are hashes in hexadecimal digits, of which snappy writes every byte and zstd half.
        """
        rows.drop("generation_id").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{table}/generation_id={generation_id}")

    def append_versions(self, rows: DataFrame, kind: T.StructType) -> None:
        """Adds file versions that are not there yet; versions never change."""
        path, fs = self._path("file_versions")
        if fs.exists(path):
            rows = new_versions(rows, self.spark.read.schema(kind).parquet(f"{self.folder}/file_versions"))
        rows.select(*kind.names).write.mode("append").parquet(f"{self.folder}/file_versions")

    def read(self, table: str, generation_id: str | None = None) -> DataFrame:
        """A table's rows of one generation, the active one if none is named: one partition is read."""
        wanted = generation_id or self.active()
        return self.spark.read.parquet(f"{self.folder}/{table}/generation_id={wanted}").withColumn("generation_id", F.lit(wanted))

    def drop(self, generation_ids: list[str], tables: tuple[str, ...]) -> None:
        for table in tables:
            for g in generation_ids:
                path, fs = self._path(f"{table}/generation_id={g}")
                fs.delete(path, True)


def backup(rows: DataFrame, target: str) -> None:
    """Copies a table to a folder that must not exist, and checks the copy by count and content."""
    rows.write.mode("error").parquet(target)
    back = rows.sparkSession.read.parquet(target)
    digest = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    if tuple(digest(back)) != tuple(digest(rows.select(*back.columns))):
        raise RequestError("STORAGE_ERROR", "the backup differs from its source")
