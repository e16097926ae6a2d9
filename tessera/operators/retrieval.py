"""Files, outlines, references, repository maps, source excerpts and context packs of one generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import ancestors, under
from tessera.limits import DEFAULTS, LIMITS, RequestError, check_limit

OUTLINE_ORDER = ("start_byte", "end_byte", "symbol_id")


def get_symbol(symbols: DataFrame, symbol_id: str) -> DataFrame:
    """The symbol of an id; of several files, that of the first path."""
    return symbols.filter(F.col("symbol_id") == symbol_id).orderBy("relative_path").limit(1)


def file_outline(symbols: DataFrame, path: str, limit: int = DEFAULTS.outline) -> DataFrame:
    """Symbols of one file in source order, limit + 1 at most."""
    check_limit(limit, LIMITS.outline)
    return symbols.filter(F.col("relative_path") == path).orderBy(*OUTLINE_ORDER).limit(limit + 1)


def repository_files(files: DataFrame, symbols: DataFrame, scope: str | None = None) -> DataFrame:
    """Files with the number of their symbols, 0 for none."""
    counts = symbols.filter(under(F.col("relative_path"), scope)).groupBy(F.col("relative_path").alias("__path")).agg(F.count("symbol_id").alias("symbol_count"))
    found = files.filter(under(F.col("relative_path"), scope)).join(counts, F.col("relative_path") == F.col("__path"), "left").drop("__path")
    return found.withColumn("symbol_count", F.coalesce("symbol_count", F.lit(0).cast("long")))


def counts(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: files, symbols and edges of a generation, in one job."""
    every = files.select(F.lit("files").alias("t")).unionByName(symbols.select(F.lit("symbols").alias("t"))).unionByName(edges.select(F.lit("edges").alias("t")))
    return every.agg(*[F.coalesce(F.sum((F.col("t") == t).cast("long")), F.lit(0)).alias(t) for t in ("files", "symbols", "edges")])


def coverage(files: DataFrame) -> DataFrame:
    """One row: files by parse status, and the status of the whole."""
    states = {s: F.sum((F.col("parse_status") == s).cast("long")) for s in ("complete", "partial", "failed")}
    row = files.agg(F.count(F.lit(1)).alias("files"), *[F.coalesce(c, F.lit(0)).cast("long").alias(s) for s, c in states.items()])
    return row.withColumn("status", F.when(F.col("files") == F.col("complete"), "syntax_and_name_resolution").otherwise("ready_with_warnings"))


def repo_map(files: DataFrame, symbols: DataFrame, scope: str | None = None, depth: int = DEFAULTS.depth, limit: int = DEFAULTS.repo_entries) -> DataFrame:
    """Directories and files in path order, a directory before a file of its path.

    Directories add up the symbols of the first `limit` files only, and those above the scope appear, too: both belong
    to the operation. At most limit + 1 entries return; a caller that sees limit + 1 knows that the map is cut.
    """
    check_limit(limit, LIMITS.repo_entries)
    if not 0 <= depth <= LIMITS.depth:
        raise RequestError("INVALID_ARGUMENT", "depth")
    first = repository_files(files, symbols, scope).orderBy("relative_path").limit(limit)
    above = scope.count("/") + 1 if scope else 0
    within = F.greatest(F.size(F.split("path", "/")) - above, F.lit(0)) <= depth + 1
    none = F.lit(None).cast("string")
    folders = first.select(F.explode(ancestors(F.col("relative_path"))).alias("path"), "symbol_count").groupBy("path").agg(F.sum("symbol_count").alias("symbol_count"))
    folders = folders.select("path", F.lit("directory").alias("kind"), none.alias("language"), none.alias("parse_status"), "symbol_count")
    entries = folders.unionByName(first.select(F.col("relative_path").alias("path"), F.lit("file").alias("kind"), "language", "parse_status", "symbol_count"))
    return entries.filter(within).orderBy("path", "kind").limit(limit + 1)


def references_to(edges: DataFrame, symbol_id: str, include_candidates: bool = True, limit: int = DEFAULTS.results, after: tuple | None = None) -> DataFrame:
    """References and calls that target a symbol, by path, start and id, after a key; limit + 1 at most."""
    check_limit(limit, LIMITS.results)
    found = edges.filter((F.col("target_symbol_id") == symbol_id) & F.col("relationship").isin("references", "calls"))
    if not include_candidates:
        found = found.filter("resolution <> 'candidate'")
    key = ("source_path", "source_start_byte", "edge_id")
    if after is not None:
        found = found.filter(F.struct(*key) > F.struct(*[F.lit(v).cast(t).alias(c) for c, v, t in zip(key, after, ("string", "long", "string"), strict=True)]))
    return found.orderBy(*key).limit(limit + 1)


def labelled_edges(edges: DataFrame, observations: DataFrame, externals: DataFrame | None = None) -> DataFrame:
    """Edges with the spellings of both ends. One table of observations serves all categories, by outer joins on (path, id).

    Joins go by key, so a table of any size is shuffled once and a small one is broadcast by its measured size.
    """
    names = observations.select("relative_path", "symbol_id", "spelling", "kind")

    def side(which: str) -> DataFrame:
        return names.select(F.col("relative_path").alias(f"__{which}_path"), F.col("symbol_id").alias(f"__{which}_id"), F.col("spelling").alias(f"{which}_spelling"), F.col("kind").alias(f"{which}_kind"))

    out = edges
    for which in ("source", "target"):
        out = out.join(side(which), (F.col(f"{which}_path") == F.col(f"__{which}_path")) & (F.col(f"{which}_symbol_id") == F.col(f"__{which}_id")), "left").drop(f"__{which}_path", f"__{which}_id")
    if externals is not None:
        out = out.join(externals.select(F.col("external_node_id").alias("__x"), F.col("label").alias("external_label")), F.col("external_node_id") == F.col("__x"), "left").drop("__x")
    return out


def line_excerpts(sources: DataFrame, expected: DataFrame, first_line: int, last_line: int, most_bytes: int = LIMITS.snippet_bytes) -> DataFrame:
    """Whole lines first_line to last_line, from 1, of each expected (relative_path, content_hash), within most_bytes.

    status: ok, source_deleted (no such file), content_changed (the hash differs), invalid_range (the file has fewer
    lines), response_too_large (the first line alone is). truncated tells whether lines were left out.
    """
    check_limit(last_line - first_line + 1, LIMITS.read_lines, "lines")
    check_limit(first_line, 1 << 31, "first_line")
    lines = F.filter(F.split(F.decode("content", "UTF-8"), "(?<=\n)"), lambda x: x != "")
    have = sources.select(F.col("relative_path").alias("__path"), F.sha2("content", 256).alias("__hash"), lines.alias("__lines"))
    wanted = F.slice("__lines", F.lit(first_line), F.lit(last_line - first_line + 1))
    fold = F.aggregate(
        wanted,
        F.struct(F.lit("").alias("text"), F.lit(0).alias("lines"), F.lit(False).alias("full")),
        lambda acc, line: F.when(acc["full"] | (F.octet_length(acc["text"]) + F.octet_length(line) > most_bytes), F.struct(acc["text"].alias("text"), acc["lines"].alias("lines"), F.lit(True).alias("full"))).otherwise(
            F.struct(F.concat(acc["text"], line).alias("text"), (acc["lines"] + 1).alias("lines"), F.lit(False).alias("full"))
        ),
    )
    rows = expected.join(have, F.col("relative_path") == F.col("__path"), "left").withColumn("__fold", fold)
    status = F.when(F.col("__path").isNull(), "source_deleted").when(F.col("__hash") != F.col("content_hash"), "content_changed").when(F.size("__lines") < last_line, "invalid_range").when(F.col("__fold.lines") == 0, "response_too_large").otherwise("ok")
    ok = F.col("status") == "ok"
    rows = rows.withColumn("status", status)
    return rows.select("relative_path", "status", F.when(ok, F.col("__fold.text")).alias("text"), F.when(ok, F.col("__fold.lines")).alias("lines"), F.when(ok, F.col("__fold.full")).alias("truncated"))


def byte_excerpts(sources: DataFrame, ranges: DataFrame, most_bytes: int = LIMITS.snippet_bytes) -> DataFrame:
    """Ranges (relative_path, start_byte, end_byte) with their code and lines, cut to most_bytes before a character.

    A range that is empty or ends past its file gives no row.
    """
    have = sources.select(F.col("relative_path").alias("__path"), "content")
    rows = ranges.join(have, F.col("relative_path") == F.col("__path")).filter((F.col("start_byte") < F.col("end_byte")) & (F.col("end_byte") <= F.octet_length("content")))
    size = F.least(F.col("end_byte") - F.col("start_byte"), F.lit(most_bytes)).cast("int")
    cut = [F.substring("content", F.col("start_byte").cast("int") + 1, size - k).cast("string") for k in range(4)]
    code = F.coalesce(*[F.when(F.is_valid_utf8(c), c) for c in cut])
    before = F.substring("content", F.lit(1), F.col("start_byte").cast("int")).cast("string")
    breaks = lambda c: F.octet_length(c) - F.octet_length(F.replace(c, F.lit("\n"), F.lit("")))
    rows = rows.withColumn("code", code).filter(F.octet_length("code") > 0).withColumn("start_line", breaks(before) + 1)
    return rows.withColumn("end_line", F.col("start_line") + breaks(F.col("code"))).withColumn("end_byte", F.col("start_byte") + F.octet_length("code")).drop("__path", "content")


def suppress_overlaps(ranges: DataFrame, partition: str, order: list[str], start: str = "start_byte", end: str = "end_byte") -> DataFrame:
    """Ranges in rank order, without those that overlap one accepted before them.

    Acceptance depends on earlier acceptance, so it is a fold over each partition's ranges; a context holds
    LIMITS.context_symbols of them in all, which bounds the list.
    """
    row = F.struct(*[F.col(c) for c in order], *[F.col(c).alias(f"__{c}") for c in ranges.columns])
    lists = ranges.groupBy(partition).agg(F.sort_array(F.collect_list(row)).alias("__rows"))
    kind = lists.schema["__rows"].dataType.simpleString()
    apart = lambda a, b: (a[f"__{end}"] <= b[f"__{start}"]) | (b[f"__{end}"] <= a[f"__{start}"])
    kept = F.aggregate("__rows", F.array().cast(kind), lambda acc, r: F.when(F.forall(acc, lambda a: apart(a, r)), F.concat(acc, F.array(r))).otherwise(acc))
    return lists.select(F.explode(kept).alias("__r")).select(*[F.col(f"__r.__{c}").alias(c) for c in ranges.columns])


def context_symbols(found: DataFrame, edges: DataFrame, symbols: int = LIMITS.context_symbols, roots: int = 12, relations: int = 16) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, snippet ranges, relations): the first symbols of a search with their rank, those of them whose ranges don't overlap
    one of a better rank, and the first relations of the best ones in both directions, once each.
    """
    order = ("tier", "score", "relative_path", "spelling", "start_byte", "symbol_id")
    best = found.orderBy(*order).limit(symbols)
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # of `symbols` rows
    ranges = best.filter("syntax_start_byte < syntax_end_byte").select("rank", "relative_path", "symbol_id", "spelling", F.col("syntax_start_byte").alias("start_byte"), F.col("syntax_end_byte").alias("end_byte"))
    chosen = suppress_overlaps(ranges, "relative_path", ["rank"])
    top = F.broadcast(best.filter(F.col("rank") <= roots).select(F.col("symbol_id").alias("__root")).distinct())  # of `roots` rows
    out = []
    for column in ("source_symbol_id", "target_symbol_id"):
        first = F.row_number().over(Window.partitionBy("__root").orderBy("source_path", "source_start_byte", "edge_id"))
        out.append(edges.join(top, F.col(column) == F.col("__root")).withColumn("__place", first).filter(F.col("__place") <= relations).select(*edges.columns))
    return best, chosen, out[0].unionByName(out[1]).dropDuplicates(["edge_id"])
