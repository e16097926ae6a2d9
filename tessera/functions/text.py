"""Column functions on names and paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(column: Column) -> Column:
    """Lowers A-Z and nothing else, as the column side of a folded comparison; F.lower folds all of Unicode."""
    return F.translate(column, UPPER, LOWER)


#: Where an identifier breaks: runs of other characters, lower to upper, digit to upper, and before the last capital of a run that a small letter follows.
_BREAKS = r"[^\p{L}\p{N}]+|(?<=\p{Ll})(?=\p{Lu})|(?<=\p{N})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"


def identifier_tokens(column: Column) -> Column:
    """Lower-case parts of identifiers: getHTTPServer2Foo_bar gives get, http, server2, foo, bar."""
    return F.filter(F.transform(F.split(column, _BREAKS), F.lower), lambda t: t != "")


def last_segment(column: Column) -> Column:
    """What follows the last '::', or else the last '.', or else the last '/'."""
    return F.when(column.contains("::"), F.regexp_extract(column, r"(?s)^.*::(.*)$", 1)).when(column.contains("."), F.regexp_extract(column, r"(?s)^.*\.(.*)$", 1)).when(column.contains("/"), F.regexp_extract(column, r"(?s)^.*/(.*)$", 1)).otherwise(column)


def parent_path(column: Column) -> Column:
    """The directory of a path, '' at the root."""
    return F.when(column.contains("/"), F.regexp_replace(column, r"/[^/]*$", "")).otherwise(F.lit(""))


def file_name(column: Column) -> Column:
    return F.element_at(F.split(column, "/"), -1)


def extension(column: Column) -> Column:
    """Lower-case last extension of a path's file name, '' if there is none."""
    return F.lower(F.regexp_extract(file_name(column), r"[^.]\.([^.]+)$", 1))


def normalized_path(column: Column) -> Column:
    """a/./b/../c gives a/c; null if it climbs above the root or ends nowhere."""
    step = lambda acc, part: (
        F.when(acc.isNull(), acc)
        .when((part == "") | (part == "."), acc)
        .when(part == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)))
        .otherwise(F.concat(acc, F.array(part)))
    )
    whole = F.aggregate(F.split(column, "/"), F.array().cast("array<string>"), step)
    return F.when(F.size(whole) > 0, F.array_join(whole, "/"))


def ancestors(column: Column) -> Column:
    """Every directory above a path, from the top."""
    parts = F.split(column, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def under(column: Column, prefix: str | None) -> Column:
    """The path itself, or one below it: equality is exact, the prefix folds ASCII letters."""
    if prefix is None:
        return F.lit(True)
    folded = reduce(lambda s, pair: s.replace(*pair), zip(UPPER, LOWER, strict=True), prefix)
    return (column == prefix) | ascii_lower(column).startswith(f"{folded}/")


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """Bytes start to end of a text's UTF-8, as binary; Spark's substring of a text counts characters."""
    return F.substring(F.encode(text, "UTF-8"), start.cast("int") + 1, (end - start).cast("int"))


def line_of(text: Column, at: Column) -> Column:
    """Line of a byte offset, from 1; null for a null text."""
    before = F.substring(F.encode(text, "UTF-8"), F.lit(1), at.cast("int")).cast("string")  # may end inside of a character: a break is a byte of its own
    return F.octet_length(before) - F.octet_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def content_id(*parts: Column) -> Column:
    """A stable id: the hash of the parts, each ended by a NUL; null counts as empty."""
    return F.sha2(F.concat(*[F.concat(F.coalesce(p.cast("string"), F.lit("")), F.lit("\0")) for p in parts]), 256)
