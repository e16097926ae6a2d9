"""Source text to observations: a table function, one file a row in, many rows out.

Files are independent, so extraction is one pass without an exchange; whoever wants only what changed filters the
sources by generations.to_parse() first. Python reads the text, as no built-in function can.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import __version__
from tessera.cluster import ship
from tessera.functions import syntax
from tessera.functions.text import identifier_tokens
from tessera.operators.nesting import Open, by_file
from tessera.schema import OBSERVATIONS

#: Observations after which a task gives on the files that it has read.
HELD = 4096
_FIELDS = [f.name for f in OBSERVATIONS if f.name != "relative_path"]
_LISTS = {"attributes", "limitations"}
_NUMBERS = {f for f in _FIELDS if f.endswith("_byte")}
_ROW = pa.struct([(f, pa.list_(pa.string()) if f in _LISTS else pa.int64() if f in _NUMBERS else pa.string()) for f in _FIELDS])
_NOTE = pa.struct([("code", pa.string()), ("message", pa.string()), ("start_byte", pa.int64()), ("end_byte", pa.int64())])
_DDL = "array<struct<" + ",".join(f"{f}:{'array<string>' if f in _LISTS else 'bigint' if f in _NUMBERS else 'string'}" for f in _FIELDS) + ">>"


def analysis_key() -> str:
    """What a parse depends on besides the content: a file is parsed again when any of it changes."""
    return f"{__version__}:{syntax.fingerprint()}"


def parsed(sources: DataFrame) -> DataFrame:
    """(relative_path, language, parse_status, byte_length, content_hash, rows, notes) of sources (relative_path, language, content).

    Content that is no UTF-8, or too large, fails; unbalanced brackets and limits make a parse partial. A file that the reader
    can't get through fails with a diagnostic of its own, and no other file with it. Nulls count as empty content. A task holds the
    observations of a few files, whatever Spark's batches hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states, rows, notes, held, first = [], [], [], 0, 0
            for i in range(batch.num_rows):
                path, language, content = (c[i].as_py() for c in batch.columns[:3])
                try:
                    found, state, said = syntax.extract((content or b"").decode(), language, path)
                except UnicodeDecodeError as error:
                    found, state, said = [], "failed", [("invalid_utf8", path, error.start, error.end)]
                except Exception as error:  # a fault of the reader
                    found, state, said = [], "failed", [("extractor_failed", type(error).__name__, None, None)]
                states.append(state)
                rows.append(found)
                notes.append([dict(zip(("code", "message", "start_byte", "end_byte"), n, strict=True)) for n in said])
                held += len(found) + len(said)
                if held >= HELD:
                    yield out(batch.slice(first, i + 1 - first), states, rows, notes)
                    states, rows, notes, held, first = [], [], [], 0, i + 1
            yield out(batch.slice(first), states, rows, notes)

    def out(files: pa.RecordBatch, states: list, rows: list, notes: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([files.column(0), files.column(1), pa.array(states, pa.string()), files.column(3), files.column(4), pa.array(rows, pa.list_(_ROW)), pa.array(notes, pa.list_(_NOTE))], ["relative_path", "language", "parse_status", "byte_length", "content_hash", "rows", "notes"])

    ship(sources.sparkSession)
    body = F.coalesce("content", F.lit(b"")).cast("binary")
    rows = sources.select("relative_path", "language", body.alias("content"), F.octet_length(body).cast("long").alias("byte_length"), F.sha2(body, 256).alias("content_hash"))
    return rows.mapInArrow(run, f"relative_path string, language string, parse_status string, byte_length long, content_hash string, rows {_DDL}, notes array<struct<code:string,message:string,start_byte:bigint,end_byte:bigint>>")


def observations(parses: DataFrame) -> DataFrame:
    return parses.select("relative_path", F.explode("rows").alias("r")).select("relative_path", *[F.col(f"r.{f}").alias(f) for f in _FIELDS])


def diagnostics(parses: DataFrame) -> DataFrame:
    return parses.select("relative_path", F.explode("notes").alias("n")).select("relative_path", "n.*")


def file_versions(parses: DataFrame) -> DataFrame:
    return parses.select("relative_path", "language", "content_hash", "byte_length", "parse_status")


def search_rows(found: DataFrame) -> DataFrame:
    """Symbols with the text that a search looks at: kind, spelling, its parts, signature."""
    symbols = found.filter("category = 'symbol'")
    content = F.concat_ws(" ", "kind", "spelling", F.array_join(identifier_tokens(F.col("spelling")), " "), F.coalesce("signature", F.lit("")))
    return symbols.withColumn("content", content).withColumnRenamed("observation_id", "symbol_id")


def smallest_scopes(found: DataFrame) -> DataFrame:
    """(path, id, scope): the smallest scope around each observation, the file's only if there is no other of its size."""

    def each(rows: list[dict]) -> Iterator[tuple]:
        outer = Open([(r["syntax_start_byte"], r["syntax_end_byte"], (r["kind"] == "file", r["observation_id"]), r) for r in rows if r["category"] == "scope"])
        for c in sorted((r for r in rows if r["category"] != "scope"), key=lambda r: r["start_byte"]):
            outer.move(c["start_byte"])
            o = next(outer.around(c["start_byte"], c["end_byte"]), None)
            if o is not None:
                yield c["relative_path"], c["observation_id"], o[3]["observation_id"]

    return by_file(found, each, "relative_path string, id string, scope string", [pa.string()] * 3)
