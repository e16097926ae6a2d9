"""Walks over the relation graph within caps of depth, nodes and edges.

A walk goes level by level. The frontier holds LIMITS.nodes ids at most and a level adds LIMITS.edges rows at most, so
a level is one filter of the edges by a broadcast frontier and a top-k, whatever the size of the graph; only these
capped rows reach the driver, where the order-dependent caps are applied.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import under
from tessera.limits import DEFAULTS, LIMITS, check_graph
from tessera.operators.lookups import Adjacency

RELATION_ORDER = ("source_path", "source_start_byte", "edge_id")


def relations(edges: DataFrame, relationship: str = "any", include_candidates: bool = True) -> DataFrame:
    """Edges of one relationship, or of any; candidates only if asked for."""
    found = edges if relationship == "any" else edges.filter(F.col("relationship") == relationship)
    return found if include_candidates else found.filter("resolution <> 'candidate'")


def adjacent(edges: DataFrame, symbol_id: str, direction: str = "outgoing", relationship: str = "any", include_candidates: bool = True, limit: int = DEFAULTS.edges) -> DataFrame:
    column = "source_symbol_id" if direction == "outgoing" else "target_symbol_id"
    return relations(edges, relationship, include_candidates).filter(F.col(column) == symbol_id).orderBy(*RELATION_ORDER).limit(limit)


def incoming_to_path(edges: DataFrame, path: str, include_candidates: bool = True, limit: int = DEFAULTS.edges) -> DataFrame:
    return relations(edges, "any", include_candidates).filter(F.col("target_path") == path).orderBy(*RELATION_ORDER).limit(limit)


def call_sites(edges: DataFrame, symbol_id: str) -> DataFrame:
    """Calls that target a symbol, by edge id."""
    return edges.filter((F.col("relationship") == "calls") & (F.col("target_symbol_id") == symbol_id)).orderBy("edge_id")


def walk(edges: DataFrame, roots: list[str], direction: str = "outgoing", relationship: str = "any", include_candidates: bool = True, depth: int = DEFAULTS.depth, max_nodes: int = DEFAULTS.nodes, max_edges: int = DEFAULTS.edges, deadline_ms: int | None = None, index: Adjacency | None = None) -> tuple[list[str], list, bool]:
    """(sorted ids, edges in the order of the walk, whether a cap cut it): breadth first, first in, first out.

    A node's edges come in relation order. The edge cap counts every edge, also to nodes met before; a node past the
    node cap is not entered, but its edge stays. With a deadline, no level begins after it, and the walk counts as cut.
    With the edges' index, a level reads the partitions of its frontier instead of all edges.
    """
    check_graph(depth, max_nodes, max_edges, DEFAULTS.deadline_ms if deadline_ms is None else deadline_ms)
    until = None if deadline_ms is None else time.monotonic() + deadline_ms / 1000
    near, far = ("source_symbol_id", "target_symbol_id") if direction == "outgoing" else ("target_symbol_id", "source_symbol_id")
    visited = dict.fromkeys(roots[:max_nodes])
    level, taken, ids, cut = list(visited), [], set(), len(roots) > max_nodes
    for _ in range(depth):
        left = max_edges - len(taken)
        if not level:
            break
        if left <= 0 or (until is not None and time.monotonic() > until):
            cut = True
            break
        found = relations(edges if index is None else index.of(near, level), relationship, include_candidates)
        frontier = edges.sparkSession.createDataFrame(list(enumerate(level)), "place int, __node string")
        rows = found.join(F.broadcast(frontier), F.col(near) == F.col("__node")).orderBy("place", *RELATION_ORDER).limit(left + 1).drop("__node").collect()
        last = rows[left - 1]["place"] if len(rows) >= left else None
        if len(rows) > left or (last is not None and last < len(level) - 1):
            cut = True
        entered = []
        for row in rows[:left]:
            if row["edge_id"] in ids:
                continue
            ids.add(row["edge_id"])
            taken.append(row)
            if row[far] is not None and row[far] not in visited:
                if len(visited) >= max_nodes:
                    cut = True
                else:
                    visited[row[far]] = None
                    entered.append(row[far])
        level = entered
    return sorted(visited), taken, cut


def _frame(edges: DataFrame, taken: list) -> DataFrame:
    names = edges.columns
    schema = T.StructType([T.StructField("position", T.IntegerType()), *edges.schema.fields])
    return edges.sparkSession.createDataFrame([(i, *(row[c] for c in names)) for i, row in enumerate(taken)], schema)


def walked_edges(edges: DataFrame, roots: list[str], **options) -> DataFrame:
    """The edges of a walk with their position in it."""
    return _frame(edges, walk(edges, roots, **options)[1])


def walked_nodes(edges: DataFrame, roots: list[str], **options) -> DataFrame:
    return edges.sparkSession.createDataFrame([(i,) for i in walk(edges, roots, **options)[0]], "symbol_id string")


def trace_calls(edges: DataFrame, symbol_id: str, direction: str = "incoming", **options) -> tuple[DataFrame, list[str]]:
    """Calls around a symbol, and warnings: that nothing calls a symbol here doesn't make it dead code."""
    _, taken, cut = walk(edges, [symbol_id], direction=direction, relationship="calls", **options)
    warnings = (["graph_truncated"] if cut else []) + (["no_callers_is_not_dead_code"] if not taken and direction == "incoming" else [])
    return _frame(edges, taken), warnings


def analyze_impact(edges: DataFrame, symbols: DataFrame, symbol_ids: list[str], paths: list[str], depth: int = DEFAULTS.depth, max_nodes: int = DEFAULTS.nodes, max_edges: int = DEFAULTS.edges, include_candidates: bool = True, index: Adjacency | None = None) -> tuple[list[str], DataFrame, list[str], bool]:
    """(symbols, edges, paths, cut) that changes of symbols and files reach against the direction of relations.

    Seeds are the ids, the symbols of the files, and the sources of the edges into the files. Edges into the files count
    against the cap; the walk gets the rest of it, one at least.
    """
    check_graph(depth, max_nodes, max_edges, DEFAULTS.deadline_ms)
    seeds, into, cut = dict.fromkeys(symbol_ids), [], False
    if paths:
        own = symbols.filter(F.col("relative_path").isin(paths)).select("symbol_id").distinct().orderBy("symbol_id").limit(max_nodes + 1).collect()
        into = relations(edges if index is None else index.of("target_path", paths), "any", include_candidates).filter(F.col("target_path").isin(paths)).orderBy(*RELATION_ORDER).limit(max_edges + 1).collect()
        cut = len(own) > max_nodes or len(into) > max_edges
        into = into[:max_edges]
        seeds |= dict.fromkeys(r["symbol_id"] for r in own) | dict.fromkeys(r["source_symbol_id"] for r in into if r["source_symbol_id"])
    ids, taken, more = walk(edges, sorted(seeds), direction="incoming", include_candidates=include_candidates, depth=depth, max_nodes=max_nodes, max_edges=max(1, max_edges - len(into)), index=index)
    both = {r["edge_id"]: r for r in [*into, *taken]}
    ordered = sorted(both.values(), key=lambda r: tuple(r[c] for c in RELATION_ORDER))
    reached = {*paths, *(r["source_path"] for r in ordered), *(r["target_path"] for r in ordered if r["target_path"])}
    return ids, _frame(edges, ordered), sorted(reached), cut or more


def impacted_paths(edges: DataFrame, symbols: DataFrame, symbol_ids: list[str], paths: list[str], **options) -> DataFrame:
    spark = edges.sparkSession
    return spark.createDataFrame([(p,) for p in analyze_impact(edges, symbols, symbol_ids, paths, **options)[2]], "relative_path string")


def neighbours(edges: DataFrame, symbol_id: str, depth: int = 1, max_edges: int = 1000, scope: str | None = None) -> DataFrame:
    """Edges around a symbol in both directions, inside a path if one is given."""
    inside = edges.filter(under(F.col("source_path"), scope))
    out = walked_edges(inside, [symbol_id], direction="outgoing", depth=depth, max_edges=max_edges)
    into = walked_edges(inside, [symbol_id], direction="incoming", depth=depth, max_edges=max_edges)
    return out.withColumn("direction", F.lit("outgoing")).unionByName(into.withColumn("direction", F.lit("incoming")))


__all__ = ["LIMITS", "adjacent", "analyze_impact", "call_sites", "impacted_paths", "incoming_to_path", "neighbours", "relations", "trace_calls", "walk", "walked_edges", "walked_nodes"]
