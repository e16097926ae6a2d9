"""The requests of a user over one index: bounded answers as plain values, in a fixed order, with cursors and coverage."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.limits import DEFAULTS, LIMITS, RequestError, check_graph, check_limit, check_text
from tessera.operators import extraction, generations, graph, notes, paging, resolution, retrieval, search
from tessera.operators.lookups import Adjacency, Names
from tessera.operators.postings import Postings
from tessera.sources import scan


@dataclass
class Index:
    """The tables of one generation."""

    repository_id: str
    generation_id: str
    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    observations: DataFrame | None = None
    externals: DataFrame | None = None
    sources: DataFrame | None = None
    notes: DataFrame | None = None
    evidence: DataFrame | None = None
    postings: Postings | None = None
    names: Names | None = None
    adjacency: Adjacency | None = None
    jobs: dict[str, dict] = field(default_factory=dict)
    known: dict = field(default_factory=dict)


def symbols_of(found: DataFrame, versions: DataFrame) -> DataFrame:
    """Symbols as a search looks at them, with the language of their file."""
    languages = versions.select(F.col("relative_path").alias("__p"), "language")
    return extraction.search_rows(found).join(languages, F.col("relative_path") == F.col("__p")).drop("__p")


def build(files: DataFrame, repository_id: str, generation_id: str, rules=None) -> Index:
    """An index of a tree's files (relative_path, byte_length, content): scan, parse, resolve."""
    sound = scan.safe_sources(scan.scan(files, rules)).filter("fault IS NULL")
    parses = extraction.parsed(sound).cache()
    found = extraction.observations(parses)
    versions = extraction.file_versions(parses).withColumns({"analysis_key": F.lit(extraction.analysis_key()), "generation_id": F.lit(generation_id)})
    edges, externals, _ = resolution.resolve(found, versions.select("relative_path", "language"), scan.manifests(files))
    symbols = symbols_of(found, versions)
    return Index(repository_id, generation_id, versions, symbols, edges.withColumn("generation_id", F.lit(generation_id)), found, externals, sound)


def rebuild(before: Index, files: DataFrame, generation_id: str, rules=None) -> Index:
    """The next generation: only files whose content or analysis changed are parsed, all names are resolved again.

    A scan past its limits is refused, as files that it misses would count as deleted.
    """
    if not scan.whole(scan.scan_status(files, rules).first()):
        raise RequestError("INVALID_ARGUMENT", "the scan is incomplete")
    sound = scan.safe_sources(scan.scan(files, rules)).filter("fault IS NULL")
    keyed = sound.withColumn("analysis_key", F.lit(extraction.analysis_key()))
    fresh = generations.to_parse(keyed, before.files)
    parses = extraction.parsed(fresh.select("relative_path", "language", "content")).cache()
    kept = before.files.join(keyed.select("relative_path", "content_hash", "analysis_key"), ["relative_path", "content_hash", "analysis_key"], "left_semi")
    found = before.observations.join(kept.select("relative_path"), "relative_path", "left_semi").unionByName(extraction.observations(parses))
    versions = kept.drop("generation_id").unionByName(extraction.file_versions(parses).withColumn("analysis_key", F.lit(extraction.analysis_key()))).withColumn("generation_id", F.lit(generation_id))
    edges, externals, _ = resolution.resolve(found, versions.select("relative_path", "language"), scan.manifests(files))
    symbols = symbols_of(found, versions)
    return Index(before.repository_id, generation_id, versions, symbols, edges.withColumn("generation_id", F.lit(generation_id)), found, externals, sound, before.notes, before.evidence)


_SYMBOL = ("symbol_id", "relative_path", "language", "kind", "spelling", "container", "signature", "start_byte", "end_byte")
_EDGE = ("edge_id", "relationship", "source_path", "source_symbol_id", "source_start_byte", "target_path", "target_symbol_id", "resolution")


def _dict(row, names) -> dict:
    return {n: row[n] for n in names}


class Service:
    """Reads of one pinned generation, and writes of its notes and jobs."""

    def __init__(self, index: Index, indexer=None):
        """indexer: the Indexer of the store that the index was opened from; jobs and generations then outlive the process."""
        self.index, self.indexer = index, indexer

    def _answer(self, value: dict, max_bytes: int, *lists: str) -> dict:
        value |= {"repository_id": self.index.repository_id, "generation_id": self.index.generation_id, "coverage": self.coverage()}
        return paging.fit(value, max_bytes, paging.drop_last(*lists))

    def _edges(self, end: str, key: str) -> DataFrame:
        """Edges that hold all with this key at that end: its partition, or all if there is no index."""
        return self.index.edges if self.index.adjacency is None else self.index.adjacency.of(end, [key])

    def coverage(self) -> dict:
        """Counted once for a generation, which never changes."""
        if not self.index.known:
            self.index.known.update(retrieval.coverage(self.index.files).first().asDict())
        return dict(self.index.known)

    def _after(self, cursor: str | None, operation: str, query: str, size: int) -> tuple[str, ...] | None:
        if cursor is None:
            return None
        found = paging.checked(cursor, operation, self.index.repository_id, self.index.generation_id, query)
        if len(found.sort) != size:
            raise RequestError("INVALID_CURSOR")
        return found.sort

    def _cursor(self, operation: str, query: str, key: list[str]) -> str:
        return paging.encode(paging.Cursor(operation, self.index.repository_id, self.index.generation_id, query, tuple(key)))

    def search_symbols(self, query: str, language=None, kind=None, path_prefix=None, limit=DEFAULTS.results, cursor=None, max_bytes=LIMITS.response_bytes) -> dict:
        own = paging.fingerprint(query, language, kind, path_prefix)
        key = self._after(cursor, "search_symbols", own, 6)
        after = (int(key[0]), paging.score_of(key[1]), key[2], key[3], int(key[4]), key[5]) if key else None
        rows = search.search_symbols(self.index.symbols, query, language, kind, path_prefix, limit, after, postings=self.index.postings, names=self.index.names).collect()
        shown, more = paging.page(rows, limit)
        last = shown[-1] if more else None
        following = self._cursor("search_symbols", own, [str(last["tier"]), paging.score_text(last["score"]), last["relative_path"], last["spelling"], str(last["start_byte"]), last["symbol_id"]]) if more else None
        return self._answer({"symbols": [{**_dict(r, _SYMBOL), "match_kind": r["match_kind"], "score": r["score"] if r["tier"] >= 5 else None} for r in shown], "cursor": following, "truncated": more}, max_bytes, "symbols")

    def get_symbol(self, symbol_id: str) -> dict:
        row = retrieval.get_symbol(self.index.symbols, check_text(symbol_id, LIMITS.id_bytes, "symbol_id")).first()
        if row is None:
            raise RequestError("SYMBOL_NOT_FOUND", symbol_id)
        return _dict(row, _SYMBOL)

    def get_file_outline(self, path: str, limit=DEFAULTS.outline, max_bytes=LIMITS.response_bytes) -> dict:
        if self.index.files.filter(F.col("relative_path") == path).isEmpty():
            raise RequestError("FILE_NOT_INDEXED", path)
        rows, more = paging.page(retrieval.file_outline(self.index.symbols, path, limit).collect(), limit)
        return self._answer({"path": path, "symbols": [_dict(r, _SYMBOL) for r in rows], "truncated": more}, max_bytes, "symbols")

    def find_references(self, symbol_id: str, include_candidates=True, limit=DEFAULTS.results, cursor=None, max_bytes=LIMITS.response_bytes) -> dict:
        self.get_symbol(symbol_id)
        own = paging.fingerprint(symbol_id, include_candidates)
        key = self._after(cursor, "find_references", own, 3)
        rows, more = paging.page(retrieval.references_to(self._edges("target_symbol_id", symbol_id), symbol_id, include_candidates, limit, (key[0], int(key[1]), key[2]) if key else None).collect(), limit)
        following = self._cursor("find_references", own, [rows[-1]["source_path"], str(rows[-1]["source_start_byte"]), rows[-1]["edge_id"]]) if more else None
        return self._answer({"references": [_dict(r, _EDGE) for r in rows], "cursor": following, "truncated": more}, max_bytes, "references")

    def trace_calls(self, symbol_id: str, direction="incoming", max_bytes=LIMITS.response_bytes, **options) -> dict:
        self.get_symbol(symbol_id)
        edges, warnings = graph.trace_calls(self.index.edges, symbol_id, direction, index=self.index.adjacency, **options)
        return self._answer({"edges": [_dict(r, _EDGE) for r in edges.orderBy("position").collect()], "warnings": warnings, "truncated": "graph_truncated" in warnings}, max_bytes, "edges")

    def get_repo_map(self, scope=None, depth=DEFAULTS.depth, limit=DEFAULTS.repo_entries, max_bytes=LIMITS.response_bytes) -> dict:
        rows, more = paging.page(retrieval.repo_map(self.index.files, self.index.symbols, scope, depth, limit).collect(), limit)
        return self._answer({"scope": scope, "entries": [r.asDict() for r in rows], "truncated": more}, max_bytes, "entries")

    def analyze_impact(self, symbol_ids=(), paths=(), max_bytes=LIMITS.response_bytes, **options) -> dict:
        if not symbol_ids and not paths:
            raise RequestError("INVALID_ARGUMENT", "symbols or paths")
        for s in symbol_ids:
            self.get_symbol(s)
        ids, edges, reached, cut = graph.analyze_impact(self.index.edges, self.index.symbols, list(symbol_ids), list(paths), index=self.index.adjacency, **options)
        return self._answer({"symbols": ids, "edges": [_dict(r, _EDGE) for r in edges.orderBy("position").collect()], "paths": reached, "truncated": cut}, max_bytes, "edges", "symbols", "paths")

    def read_code(self, path: str, content_hash: str, first_line: int, last_line: int) -> dict:
        if self.index.sources is None:
            raise RequestError("SOURCE_ACCESS_FAILED")
        spark = self.index.files.sparkSession
        wanted = spark.createDataFrame([(path, content_hash)], "relative_path string, content_hash string")
        row = retrieval.line_excerpts(self.index.sources.select("relative_path", "content"), wanted, first_line, last_line).first()
        if row["status"] != "ok":
            raise RequestError("INVALID_ARGUMENT" if row["status"] == "invalid_range" else row["status"].upper(), path)
        return {"path": path, "text": row["text"], "lines": row["lines"], "truncated": row["truncated"]}

    def build_context(self, query: str, scope=None, include_candidates=True, max_bytes=LIMITS.response_bytes) -> dict:
        """What a reader of a few symbols needs: the symbols, their code, their relations, and a token estimate."""
        found = search.search_symbols(self.index.symbols, query, path_prefix=scope, limit=LIMITS.context_symbols, postings=self.index.postings, names=self.index.names)
        best, ranges, related = retrieval.context_symbols(found, graph.relations(self.index.edges, "any", include_candidates))
        snippets = retrieval.byte_excerpts(self.index.sources, ranges) if self.index.sources is not None else ranges
        value = {
            "query": query,
            "symbols": [{**_dict(r, _SYMBOL), "match_kind": r["match_kind"]} for r in best.orderBy("rank").collect()],
            "snippets": [r.asDict() for r in snippets.orderBy("rank").collect()],
            "relations": [_dict(r, _EDGE) for r in related.orderBy(*graph.RELATION_ORDER).collect()],
            "repository_id": self.index.repository_id, "generation_id": self.index.generation_id, "coverage": self.coverage(), "truncated": False,
        }
        paging.with_token_estimate(value)
        drop = paging.drop_last("relations", "snippets", "symbols")
        return paging.fit(value, max_bytes, drop, paging.with_token_estimate)

    # -- notes

    def search_memories(self, query: str, scope=None, include_stale=False, limit=DEFAULTS.notes) -> list[dict]:
        check_text(query, LIMITS.query_bytes, "query")
        status = notes.evidence_status(self.index.notes, self.index.evidence, self.index.files, self.index.symbols)
        return [r.asDict() for r in search.search_notes(self.index.notes, status, query, scope, include_stale, limit).collect()]

    def upsert_memory(self, write: DataFrame, evidence: DataFrame | None = None) -> dict:
        """Writes one note (the columns of notes, expected_revision); its evidence must hold in this generation.

        With an indexer the note goes to its store, where the revision is checked at the moment of the commit.
        """
        write = write.withColumn("delete", F.lit(False))
        if evidence is not None and not notes.valid_evidence(evidence, self.index.files, self.index.symbols).filter("NOT valid").isEmpty():
            raise RequestError("MEMORY_EVIDENCE_INVALID")
        if not notes.bound_faults(write, evidence if evidence is not None else self.index.evidence.limit(0)).isEmpty():
            raise RequestError("MEMORY_LIMIT_EXCEEDED")
        if self.indexer is not None:
            return self._noted(write, evidence)
        done = notes.decide(self.index.notes, write).first()
        if done["outcome"] in ("conflict", "revision_required"):
            raise RequestError("MEMORY_REVISION_CONFLICT", done["outcome"])
        self.index.notes = notes.apply(self.index.notes, write)
        if evidence is not None:
            self.index.evidence = notes.replace_evidence(self.index.evidence, evidence)
        return done.asDict()

    def _noted(self, write: DataFrame, evidence: DataFrame | None = None) -> dict:
        (done,) = self.indexer.notebook.write(write, evidence)
        if done["outcome"] == "limit":
            raise RequestError("MEMORY_LIMIT_EXCEEDED", "notes")
        if done["outcome"] == "not_found":
            raise RequestError("MEMORY_NOT_FOUND", done["id"])
        if done["outcome"] in ("conflict", "revision_required"):
            raise RequestError("MEMORY_REVISION_CONFLICT", done["outcome"])
        self.index.notes, self.index.evidence = self.indexer.notebook.read()
        return done

    def forget_memory(self, note_id: str, expected_revision: int) -> dict:
        spark = self.index.files.sparkSession
        write = spark.createDataFrame([(note_id, expected_revision, True)], "id string, expected_revision long, delete boolean")
        if self.indexer is not None:
            return {"id": note_id, "outcome": self._noted(write)["outcome"]}
        done = notes.decide(self.index.notes, write).first()
        if done["outcome"] == "not_found":
            raise RequestError("MEMORY_NOT_FOUND", note_id)
        if done["outcome"] != "deleted":
            raise RequestError("MEMORY_REVISION_CONFLICT", done["outcome"])
        self.index.notes = self.index.notes.filter(F.col("id") != note_id)
        return {"id": note_id, "outcome": "deleted"}

    # -- jobs

    def repository_status(self) -> dict:
        if self.indexer is not None:
            return {"repository_id": self.index.repository_id, "generation_id": self.index.generation_id, **self.indexer.status()}
        counts = retrieval.counts(self.index.files, self.index.symbols, self.index.edges).first().asDict()
        latest = max(self.index.jobs.values(), key=lambda j: (j["created_at"], j["job_id"]), default=None)
        return {"repository_id": self.index.repository_id, "generation_id": self.index.generation_id, **counts, "latest_job": latest}

    def index_repository(self, files: DataFrame, request_key: str, generation_id: str, rules=None, background: bool = False) -> dict:
        """Indexes a tree into the next generation; a key that was asked for before gives its job again.

        The active generation stays as it is until the new one is whole; a run that fails leaves it in place. With an indexer
        the job writes to its store, in the background if wished; refresh() then turns to what became active.
        """
        if self.indexer is not None:
            job = self.indexer.run(files, request_key, generation_id, rules, background)
            if not background:
                self.refresh()
            return job
        job_id = f"job-{paging.fingerprint('index', request_key)[:16]}"
        if job_id in self.index.jobs:
            return self.index.jobs[job_id]
        job = self.index.jobs[job_id] = {"job_id": job_id, "state": "queued", "created_at": len(self.index.jobs), "cancel_requested": False}
        try:
            fresh = rebuild(self.index, files, generation_id, rules)
            job["state"] = "scanning"
            for state in ("parsing", "resolving", "committing"):
                job["state"] = state
                if state == "resolving":
                    fresh.edges = fresh.edges.cache()
                    job["edges"] = fresh.edges.count()
        except Exception:
            job["state"] = "failed"
            raise
        fresh.jobs, job["state"] = self.index.jobs, "completed"
        self.index = fresh
        return job

    def refresh(self) -> None:
        """Turns to the active generation and the notes of the store."""
        self.index = self.indexer.open(self.index.sources)

    def job_status(self, job_id: str) -> dict:
        if self.indexer is not None:
            return self.indexer.job(job_id)
        if job_id not in self.index.jobs:
            raise RequestError("JOB_NOT_FOUND", job_id)
        return self.index.jobs[job_id]

    def cancel_job(self, job_id: str) -> str:
        if self.indexer is not None:
            return self.indexer.cancel(job_id)
        job = self.job_status(job_id)
        if job["state"] not in generations.LIVE:
            return "already_finished"
        if job["cancel_requested"]:
            return "already_requested"
        job["cancel_requested"] = True
        return "requested"


__all__ = ["Index", "Service", "build", "check_graph", "check_limit", "rebuild"]
