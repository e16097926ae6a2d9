"""Bounds of a request, and the errors that a request can end with."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    """The largest sizes that a request may ask for."""

    query_bytes: int = 256
    filter_bytes: int = 128
    id_bytes: int = 512
    cursor_bytes: int = 4096
    results: int = 200
    outline: int = 2000
    repo_entries: int = 5000
    notes: int = 100
    snippet_bytes: int = 8192
    read_lines: int = 400
    depth: int = 8
    nodes: int = 500
    edges: int = 2000
    deadline_ms: int = 5000
    response_bytes: int = 65536
    context_symbols: int = 24


@dataclass(frozen=True)
class Defaults:
    results: int = 20
    outline: int = 200
    repo_entries: int = 200
    notes: int = 20
    depth: int = 2
    nodes: int = 500
    edges: int = 2000
    deadline_ms: int = 5000


LIMITS, DEFAULTS = Limits(), Defaults()

#: The codes of all errors.
CODES = (
    "WRITER_BUSY", "WRITER_QUEUE_FULL", "WRITER_UNAVAILABLE", "INDEX_NOT_READY", "JOB_NOT_FOUND", "MEMORY_NOT_FOUND",
    "MEMORY_REVISION_CONFLICT", "MEMORY_LIMIT_EXCEEDED", "MEMORY_EVIDENCE_INVALID", "CROSS_REPOSITORY_ID", "INVALID_ARGUMENT",
    "STORAGE_ERROR", "INVALID_CURSOR", "STALE_CURSOR", "SYMBOL_NOT_FOUND", "FILE_NOT_INDEXED", "CONTENT_CHANGED",
    "SOURCE_DELETED", "SOURCE_EXCLUDED", "SOURCE_ACCESS_FAILED", "DEADLINE_EXCEEDED", "RESPONSE_TOO_LARGE", "SERIALIZATION_FAILED",
)


class RequestError(Exception):
    """An error with one of CODES."""

    def __init__(self, code: str, message: str = ""):
        if code not in CODES:
            raise ValueError(code)
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


def check_limit(value: int, most: int, name: str = "limit") -> int:
    if not 1 <= value <= most:
        raise RequestError("INVALID_ARGUMENT", f"{name} must be from 1 to {most}")
    return value


def check_text(value: str | None, most: int, name: str) -> str | None:
    if value is not None and (not value or len(value.encode()) > most or "\0" in value):
        raise RequestError("INVALID_ARGUMENT", f"{name} must hold 1 to {most} bytes")
    return value


def check_graph(depth: int, nodes: int, edges: int, deadline_ms: int, limits: Limits = LIMITS) -> None:
    if not 0 <= depth <= limits.depth:
        raise RequestError("INVALID_ARGUMENT", f"depth must be from 0 to {limits.depth}")
    check_limit(nodes, limits.nodes, "nodes")
    check_limit(edges, limits.edges, "edges")
    check_limit(deadline_ms, limits.deadline_ms, "deadline_ms")
