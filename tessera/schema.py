"""Tables of the engine, their kinds, and the checks that rows must pass.

Schemas are explicit: nothing is inferred or merged on read, and a store of another version is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 8

CATEGORIES = ("symbol", "scope", "import", "reference", "call_site", "condition")
RELATIONSHIPS = ("contains", "imports", "references", "calls")
RESOLUTIONS = ("lexically_resolved", "candidate", "unresolved", "syntax_observation")
GENERATION_STATES = ("building", "active", "superseded", "abandoned")
PARSE_STATES = ("complete", "partial", "failed")


_TYPES = {"string": T.StringType(), "long": T.LongType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType())}


def table(columns: str) -> T.StructType:
    """A schema from 'name type, ...'; Spark's own reader of such text needs a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


FILES = table("generation_id string, relative_path string, language string, content_hash string, analysis_key string, byte_length long, parse_status string")
SOURCES = table("relative_path string, content binary")
OBSERVATIONS = table(
    "relative_path string, category string, observation_id string, kind string, spelling string, start_byte long, end_byte long, "
    "syntax_start_byte long, syntax_end_byte long, scope_id string, container string, signature string, receiver string, alias string, "
    "attributes array<string>, limitations array<string>"
)
EDGES = table(
    "generation_id string, edge_id string, relationship string, source_path string, source_observation_id string, source_category string, "
    "source_start_byte long, source_end_byte long, source_symbol_id string, target_path string, target_symbol_id string, external_node_id string, "
    "resolution string, rule string, candidate_count long, reason string, evidence array<string>, limitations array<string>"
)
EXTERNALS = table("external_node_id string, language string, kind string, label string")
MANIFESTS = table("relative_path string, contents string")
DIAGNOSTICS = table("relative_path string, code string, message string, severity string, start_byte long, end_byte long")
GENERATIONS = table("generation_id string, parent_id string, status string, scan_complete boolean, resolved boolean")
JOBS = table("job_id string, operation string, request_key string, state string, cancel_requested boolean, created_at long")
NOTES = table("id string, body string, kind string, revision long, author string, origin string, scope string, created_at long, updated_at long")
NOTE_EVIDENCE = table("memory_id string, relative_path string, content_hash string, symbol_id string")
HINTS = table("ts timestamp, path string, kind string")


def valid_id(column: Column) -> Column:
    """Ids hold 1 to 128 of the characters A-Z a-z 0-9 . _ -"""
    return column.rlike(r"^[A-Za-z0-9._-]{1,128}$")


def edge_faults(edges: DataFrame) -> DataFrame:
    """Edges whose columns contradict each other, with the reason; an empty result is a sound table."""
    target = F.col("target_symbol_id").isNotNull() | F.col("target_path").isNotNull()
    reason = (
        F.when(~F.col("relationship").isin(*RELATIONSHIPS), "relationship")
        .when(~F.col("resolution").isin(*RESOLUTIONS), "resolution")
        .when(F.col("target_symbol_id").isNotNull() & F.col("target_path").isNull(), "symbol_without_file")
        .when(target & F.col("external_node_id").isNotNull(), "local_and_external")
        .when((F.col("resolution") == "unresolved") & (target | F.col("external_node_id").isNotNull()), "unresolved_with_target")
        .when((F.col("source_start_byte") < 0) | (F.col("source_end_byte") < F.col("source_start_byte")), "range")
    )
    return edges.withColumn("fault", reason).filter("fault IS NOT NULL").select("edge_id", "fault")


def membership_faults(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of which an end is no file of the same generation: two anti-joins on the file key."""
    members = files.select(F.col("generation_id").alias("g"), F.col("relative_path").alias("p"))
    source = edges.join(members, (F.col("generation_id") == F.col("g")) & (F.col("source_path") == F.col("p")), "left_anti").select("edge_id", F.lit("source").alias("fault"))
    local = edges.filter("target_path IS NOT NULL")
    target = local.join(members, (F.col("generation_id") == F.col("g")) & (F.col("target_path") == F.col("p")), "left_anti").select("edge_id", F.lit("target").alias("fault"))
    return source.unionByName(target)
