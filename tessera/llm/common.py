"""Small helpers that the operators share."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.cluster import shared_folder, ship


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a table in the shared folder, which outlives any executor."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names with underscores after them, until no column of the table has one of them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def uniform_bits(*parts: Column) -> Column:
    """52 bits of the MD5 of the parts joined by '|', as a long; a null part counts as 'null'."""
    key = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")


def spans_digest(spans: list[tuple[str, int, int]], order: dict[str, int]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
