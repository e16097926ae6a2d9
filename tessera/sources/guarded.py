"""Trees that may change while they are read: listed and read by the tasks, with no link followed and each fault as a row.

Spark's own file source follows links, skips what it can't list and reads whatever stands at a path by then. Here a
directory is a row of a level, and a file is opened part by part from the root without following links, compared with what
was listed, read, and compared again. The root must be a folder that all executors see at one path, such as a mounted share.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.cluster import cut, ship
from tessera.sources.paths import DENIED_DIRECTORIES, IGNORE_FILES, MANIFESTS, PARTS, denied, supported, valid_path
from tessera.sources.scan import FILE_BYTES

#: Faults of a tree: a directory that can't be listed; a link, which is not followed; a file that is not what was listed, or can't be read.
UNLISTED, LINK, CHANGED, UNREADABLE = "unlisted", "link", "changed", "unreadable"
#: Bytes of content that a batch holds before it is handed on.
BATCH_BYTES = 16 << 20

_LISTED = "relative_path string, kind string, byte_length long, modified long, inode long"
_READ = "relative_path string, content binary, fault string"
_DIRECTORY = os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW | os.O_CLOEXEC
_FILE = os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK | os.O_CLOEXEC


def local(root: str) -> str:
    """The path of a root that is given as a path or a file: URL."""
    parts = urlsplit(root)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{root}: only folders that executors have mounted")
    path = unquote(parts.path) if parts.scheme else root
    return path.rstrip("/") or "/"


def _directory(root: str, relative: str) -> int:
    """A descriptor of a directory below the root; none of the parts on the way may be a link."""
    here = os.open(root, os.O_RDONLY | os.O_DIRECTORY | os.O_CLOEXEC)
    for part in relative.split("/") if relative else ():
        try:
            below = os.open(part, _DIRECTORY, dir_fd=here)
        finally:
            os.close(here)
        here = below
    return here


def entries(root: str, relative: str) -> Iterator[tuple]:
    """(path, kind, bytes, modified, inode) of what stands in a directory; of one that can't be listed, the fault."""
    try:
        here = _directory(root, relative)
    except OSError:
        yield relative, UNLISTED, None, None, None
        return
    try:
        with os.scandir(here) as found:
            for e in found:
                path = f"{relative}/{e.name}".lstrip("/")
                try:
                    path.encode()
                    s = e.stat(follow_symlinks=False)
                except (OSError, UnicodeEncodeError):  # gone since, or a name that is no text: the listing is not whole
                    yield relative, UNLISTED, None, None, None
                    continue
                kind = LINK if stat.S_ISLNK(s.st_mode) else "directory" if stat.S_ISDIR(s.st_mode) else "file" if stat.S_ISREG(s.st_mode) else "other"
                if kind != "other":
                    yield path, kind, s.st_size if kind == "file" else None, s.st_mtime_ns, s.st_ino
    except OSError:
        yield relative, UNLISTED, None, None, None
    finally:
        os.close(here)


def content(root: str, relative: str, size: int, modified: int, inode: int) -> tuple[bytes | None, str | None]:
    """(content, fault) of a file that was listed with this size, time and inode, and still has them once it is read."""
    listed = (size, modified, inode)
    look = lambda s: (s.st_size, s.st_mtime_ns, s.st_ino)
    parent, _, name = relative.rpartition("/")
    try:
        above = _directory(root, parent)
    except OSError:
        return None, CHANGED  # it was a directory when it was listed
    try:
        try:
            opened = os.open(name, _FILE, dir_fd=above)
        except PermissionError:
            return None, UNREADABLE
        except OSError:  # gone, or a link by now
            return None, CHANGED
        try:
            if look(os.fstat(opened)) != listed:
                return None, CHANGED
            parts, left = [], FILE_BYTES + 1
            while left and (part := os.read(opened, left)):
                parts.append(part)
                left -= len(part)
            after, named = os.fstat(opened), os.stat(name, dir_fd=above, follow_symlinks=False)
            return (b"".join(parts), None) if look(after) == look(named) == listed else (None, CHANGED)
        except FileNotFoundError:
            return None, CHANGED
        except OSError:
            return None, UNREADABLE
        finally:
            os.close(opened)
    finally:
        os.close(above)


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [c.split(" ") for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, kind, byte_length, modified, inode) of all below a root, a level of directories at a time.

    Directories of a denied name are not entered. A root that is not there is one row of an unlisted directory.
    """
    ship(spark)
    root = local(root)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for relative in batch.column(0).to_pylist():
                rows = entries(root, relative)
                while some := [r for r, _ in zip(rows, range(10_000))]:
                    yield _table(some, _LISTED)

    level, levels = spark.createDataFrame([("",)], "relative_path string"), []
    for _ in range(PARTS):
        found = cut(level.repartition("relative_path").mapInArrow(each, _LISTED).distinct())
        levels.append(found)
        name = F.lower(F.element_at(F.split("relative_path", "/"), -1))
        level = found.filter((F.col("kind") == "directory") & ~name.isin(*DENIED_DIRECTORIES)).select("relative_path")
        if level.isEmpty():
            break
    whole = levels[0]
    for more in levels[1:]:
        whole = whole.unionByName(more)
    return whole


def tree(spark: SparkSession, root: str, wanted: tuple[str, ...] = (*IGNORE_FILES, *MANIFESTS)) -> DataFrame:
    """(relative_path, byte_length, content, fault): what scan.tree gives of sources and wanted files, and faults as rows.

    Content is read for sources of bounded size and wanted files alone; other files have none. A link and a directory that
    can't be listed have a row with a fault and no length. scan.scan_status is not complete with any fault but a link.
    """
    listed = listing(spark, root)
    ship(spark)
    folder = local(root)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for r in batch.to_pylist():
                data, fault = content(folder, r["relative_path"], r["byte_length"], r["modified"], r["inode"])
                rows.append((r["relative_path"], data, fault))
                held += len(data or b"")
                if held > BATCH_BYTES:
                    yield _table(rows, _READ)
                    rows, held = [], 0
            yield _table(rows, _READ)

    path, name = F.col("relative_path"), F.element_at(F.split("relative_path", "/"), -1)
    asked = valid_path(path) & ((supported(path) & ~denied(path)) | name.isin(*wanted)) & (F.col("byte_length") <= FILE_BYTES)
    files = listed.filter("kind = 'file'").withColumn("asked", asked)
    read = cut(files.filter("asked").drop("asked", "kind").repartition("relative_path").mapInArrow(each, _READ))  # once: a second read may see other bytes
    rest = files.filter("NOT asked").select("relative_path", "byte_length", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("fault"))
    faults = listed.filter(F.col("kind").isin(LINK, UNLISTED)).select("relative_path", F.lit(None).cast("long").alias("byte_length"), F.lit(None).cast("binary").alias("content"), F.col("kind").alias("fault"))
    return files.filter("asked").select("relative_path", "byte_length").join(read, "relative_path").unionByName(rest).unionByName(faults)
