"""What a session on a cluster needs of this package."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python this package, once a context, should it not be installed there."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()  # the driver serves the file from here as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "tessera.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(package.rglob("*.py")):
            out.write(p, p.relative_to(package.parent))
    context.addPyFile(archive)
    context._tessera_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is named, a local session gets one of its own; a cluster has no folder to guess."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir: name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


#: Tables that are being written now; the shuffles of each go when it is there.
_writing, _lock = {}, threading.Lock()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is run here leaves no shuffle files behind, instead of all until the driver's memory is cleaned."""
    with _lock:
        held, before = _writing.get(spark, (0, None))
        if not held:
            before = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _writing[spark] = held + 1, before
    try:
        yield
    finally:
        with _lock:
            held, before = _writing.pop(spark)
            if held > 1:
                _writing[spark] = held - 1, before
            else:
                spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with a short plan, written to the shared folder, once.

    They are a table of columns: a checkpoint holds rows as they are in memory, several times as large, and is read whole by each that takes
    a few columns of it. Spark would go by the size of its files, so joins with these rows go by sorted keys, unless a broadcast is asked for.
    """
    if getattr(df, "_tessera_cut", False):
        return df
    spark = df.sparkSession
    target = f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    with swept(spark):
        df.write.option("compression", "zstd").parquet(target)
    rows = spark.read.schema(df.schema).parquet(target).hint("merge")
    rows._tessera_cut = True
    return rows


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt by columns into as many partitions as the session shuffles to, however small the rows are now: what follows makes many of one."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
