"""Indexing into a store: jobs with states, cancellation at any time, and a generation that one commit makes active.

The Spark jobs of an index job carry its tag. While it runs, a watcher looks at the registry, where any process may ask to cancel, and
cancels what has the tag until the job has ended; half-written tables go with the generation.
"""

from __future__ import annotations

import threading
import time

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.limits import RequestError
from tessera.operators import extraction, generations, lookups, paging, postings, resolution, retrieval
from tessera.operators.postings import Postings
from tessera.plans.service import Index, symbols_of
from tessera.schema import GENERATIONS, JOBS
from tessera.sources import scan
from tessera.sources.notebook import Notebook
from tessera.sources.store import Store

TABLES = ("files", "observations", "symbols", "edges", "externals", "diagnostics", "counts", "postings", "names", "adjacency")


#: Seconds between two looks at the registry while a job runs.
WATCH = 0.25


class Cancelled(Exception):
    """A job that was asked to stop."""


class Watcher(threading.Thread):
    """Cancels the tagged Spark jobs of an index job once the registry asks for it, and goes on until it has ended."""

    def __init__(self, store: Store, job_id: str, tag: str):
        super().__init__(daemon=True)
        self.store, self.job_id, self.tag = store, job_id, tag
        self.over, self.asked = threading.Event(), False

    def stop(self) -> None:
        self.over.set()
        self.join()

    def run(self) -> None:
        while not self.over.wait(WATCH):
            try:
                job = next((j for j in self.store.registry()["jobs"] if j["job_id"] == self.job_id), None)
            except RequestError:  # read again
                continue
            # past its last stage a job commits whatever was asked
            if job is not None and job["cancel_requested"] and job["state"] in generations.LIVE and job["state"] != "committing":
                self.asked = True
                self.store.spark.sparkContext.cancelJobsWithTag(self.tag)


class Indexer:
    """Writes generations of one source tree into a store."""

    def __init__(self, store: Store, repository_id: str = "repository"):
        self.store, self.spark, self.repository_id = store, store.spark, repository_id
        self.notebook = Notebook(store)

    # -- jobs

    def jobs(self) -> list[dict]:
        return self.store.registry()["jobs"]

    def job(self, job_id: str) -> dict:
        found = next((j for j in self.jobs() if j["job_id"] == job_id), None)
        if found is None:
            raise RequestError("JOB_NOT_FOUND", job_id)
        return found

    def cancel(self, job_id: str) -> str:
        """requested, already_requested or already_finished; the Spark jobs of a running job are cancelled where they are."""

        def change(registry: dict) -> str:
            jobs, outcome = generations.request_cancel(self._frame(registry["jobs"], JOBS), job_id)
            self._put(registry["jobs"], jobs, "job_id", "cancel_requested")
            return outcome

        return self.store.change(change)

    def _frame(self, rows: list[dict], kind) -> DataFrame:
        """Rows of the registry as a local relation, which needs no job to be filtered or changed."""
        kinds = {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64()}
        named = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in kind])
        return self.spark.createDataFrame(pa.Table.from_pylist([{n: r.get(n) for n in kind.names} for r in rows], schema=named))

    @staticmethod
    def _put(rows: list[dict], changed: DataFrame, key: str, column: str) -> None:
        """Takes a column of the changed table back into the rows of the registry."""
        new = {r[key]: r[column] for r in changed.select(key, column).collect()}
        for r in rows:
            r[column] = new[r[key]]

    def _move(self, job_id: str, state: str, **more) -> None:
        def change(registry: dict) -> None:
            job = next(j for j in registry["jobs"] if j["job_id"] == job_id)
            if job["cancel_requested"] and state in generations.LIVE and state != "committing":
                raise Cancelled(job_id)
            if state != job["state"] and state not in generations.TRANSITIONS[job["state"]]:
                raise RequestError("STORAGE_ERROR", f"{job['state']} to {state}")
            job["state"] = state
            job |= more

        self.store.change(change)

    def request(self, request_key: str, generation_id: str) -> tuple[dict, bool]:
        """(job, whether it is new): a key that was asked for before gives its job again."""

        def change(registry: dict) -> tuple[dict, bool]:
            have = next((j for j in registry["jobs"] if j["request_key"] == request_key), None)
            if have is not None:
                return have, False
            if any(g["generation_id"] == generation_id for g in registry["generations"]):
                raise RequestError("INVALID_ARGUMENT", "the generation is there")
            job = {"job_id": f"job-{paging.fingerprint('index', request_key)[:16]}", "operation": "index", "request_key": request_key, "state": "queued", "cancel_requested": False, "created_at": len(registry["jobs"]), "generation_id": generation_id}
            registry["jobs"].append(job)
            registry["generations"].append({"generation_id": generation_id, "parent_id": registry["active"], "status": "building", "scan_complete": False, "resolved": False})
            return job, True

        return self.store.change(change)

    def run(self, files: DataFrame, request_key: str, generation_id: str, rules=None, background: bool = False, only: DataFrame | None = None) -> dict:
        """Indexes a tree into a new generation. The active one stays as it is until the new one is whole.

        only: (relative_path) of a targeted scan. Files of other paths stay as the active generation has them, whatever `files` holds.
        In the background, the job returns at once as queued; job() tells its state, cancel() stops it.
        """
        job, new = self.request(request_key, generation_id)
        if not new:
            return job
        if background:
            threading.Thread(target=self._guarded, args=(job["job_id"], files, generation_id, rules, only), daemon=True).start()
            return job
        self._run(job["job_id"], files, generation_id, rules, only)
        return self.job(job["job_id"])

    def wait(self, job_id: str, seconds: float) -> dict:
        until = time.monotonic() + seconds
        while (job := self.job(job_id))["state"] in generations.LIVE and time.monotonic() < until:
            time.sleep(0.2)
        return job

    def _guarded(self, *args) -> None:
        try:
            self._run(*args)
        except Exception:  # the job says so
            return

    def _run(self, job_id: str, files: DataFrame, generation_id: str, rules, only: DataFrame | None) -> None:
        context, tag = self.spark.sparkContext, f"tessera-{job_id}"
        watcher = Watcher(self.store, job_id, tag)
        context.addJobTag(tag)
        context.setInterruptOnCancel(True)
        watcher.start()
        try:
            self._stages(job_id, files, generation_id, rules, only, watcher)
        finally:
            watcher.stop()
            context.removeJobTag(tag)
            context.setInterruptOnCancel(False)

    def _stages(self, job_id: str, files: DataFrame, generation_id: str, rules, only: DataFrame | None, watcher: Watcher) -> None:
        try:
            self._move(job_id, "scanning")
            status = scan.scan_status(files, rules).first()
            if not scan.whole(status):
                raise RequestError("INVALID_ARGUMENT", "the scan is incomplete: missing files are no deletions")
            self._flag(generation_id, "scan_complete")
            self._move(job_id, "parsing", discovered=status["found"])
            found = self._parse(files, generation_id, rules, only)
            self._move(job_id, "resolving", parsed=found)
            self._resolve(files, generation_id)
            self._flag(generation_id, "resolved")
            self._move(job_id, "committing")
            self._activate(job_id, generation_id)
        except Cancelled:
            watcher.stop()
            self._end(job_id, generation_id, "cancelled")
        except Exception as error:
            watcher.stop()  # it must not cancel what ends the job
            if watcher.asked:  # a Spark job that was cancelled fails where it was started
                self._end(job_id, generation_id, "cancelled")
                return
            self._end(job_id, generation_id, "failed", message=str(error)[:500])
            raise
        else:
            self.collect_garbage()

    def _flag(self, generation_id: str, name: str) -> None:
        def change(registry: dict) -> None:
            next(g for g in registry["generations"] if g["generation_id"] == generation_id)[name] = True

        self.store.change(change)

    def _end(self, job_id: str, generation_id: str, state: str, **more) -> None:
        """The job is over and its generation is given up; the active one was never touched."""

        def change(registry: dict) -> None:
            next(j for j in registry["jobs"] if j["job_id"] == job_id).update(state=state, **more)
            abandoned = generations.abandon(self._frame(registry["generations"], GENERATIONS), generation_id)
            self._put(registry["generations"], abandoned, "generation_id", "status")

        self.store.change(change)
        self.store.drop([generation_id], TABLES)

    # -- stages

    def _scope(self, files: DataFrame, rules, only: DataFrame | None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """What a scan finds sound, the active files, and those of them that the scan is about."""
        active = self.store.registry()["active"]
        if only is not None and not active:
            raise RequestError("INDEX_NOT_READY", "a targeted scan follows a full one")
        taken = scan.scan(files, rules) if only is None else scan.scan_paths(files, only, rules)
        sound = scan.safe_sources(taken).filter("fault IS NULL").withColumn("analysis_key", F.lit(extraction.analysis_key()))
        before = self.store.read("files", active) if active else None
        return sound, before, before if only is None else before.join(only.select("relative_path"), "relative_path", "left_semi")

    def stale(self, files: DataFrame, rules=None, only: DataFrame | None = None) -> bool:
        """Whether a run would change anything: some file is new, changed or gone."""
        sound, before, about = self._scope(files, rules, only)
        return before is None or not generations.diff(sound, about).filter("state <> 'reused'").isEmpty()

    def _parse(self, files: DataFrame, generation_id: str, rules, only: DataFrame | None) -> int:
        """Writes files and observations; what did not change is taken from the active generation. Returns the number of parsed files."""
        sound, before, about = self._scope(files, rules, only)
        active = self.store.registry()["active"]
        fresh = generations.to_parse(sound, before) if active else sound
        parses = resolution.cut(extraction.parsed(fresh.select("relative_path", "language", "content")))
        versions = extraction.file_versions(parses).withColumn("analysis_key", F.lit(extraction.analysis_key()))
        found, said = extraction.observations(parses), extraction.diagnostics(parses)
        if active:
            gone = generations.deleted_paths(sound, about)
            members = generations.begin(before, generation_id, gone)
            versions = generations.staged(members, versions, generation_id)
            kept = versions.select("relative_path").join(parses.select("relative_path"), "relative_path", "left_anti")
            found = self.store.read("observations", active).drop("generation_id").join(kept, "relative_path", "left_semi").unionByName(found)
            said = self.store.read("diagnostics", active).drop("generation_id").join(kept, "relative_path", "left_semi").unionByName(said)
        self.store.write("files", versions.select("relative_path", "language", "content_hash", "analysis_key", "byte_length", "parse_status"), generation_id)
        self.store.write("observations", found, generation_id)
        self.store.write("diagnostics", said, generation_id)
        return parses.count()

    def _resolve(self, files: DataFrame, generation_id: str) -> None:
        read = lambda t: self.store.read(t, generation_id)
        versions, found = read("files"), read("observations").drop("generation_id")
        edges, externals, _ = resolution.resolve(found, versions.select("relative_path", "language"), scan.manifests(files))
        self.store.write("edges", edges, generation_id)
        self.store.write("externals", externals, generation_id)
        self.store.write("symbols", symbols_of(found, versions), generation_id)
        postings.write(read("symbols"), self._folder("postings", generation_id))
        lookups.write_names(read("symbols"), self._folder("names", generation_id))
        lookups.write_edges(read("edges"), self._folder("adjacency", generation_id))
        row = retrieval.counts(versions, read("symbols"), read("edges")).join(retrieval.coverage(versions).withColumnRenamed("files", "all_files"))  # one row each
        self.store.write("counts", row, generation_id)

    def _activate(self, job_id: str, generation_id: str) -> None:
        """One commit: the generation becomes active, the one before superseded, the job completed."""

        def change(registry: dict) -> None:
            now = self._frame(registry["generations"], GENERATIONS)
            job = next(j for j in registry["jobs"] if j["job_id"] == job_id)
            self._put(registry["generations"], generations.activate(now, generation_id, job["state"]), "generation_id", "status")
            registry["previous"], registry["active"] = registry["active"], generation_id
            job["state"] = "completed"

        self.store.change(change)

    def collect_garbage(self) -> list[str]:
        """Drops the tables of generations that nothing needs; returns their ids."""
        registry = self.store.registry()
        needed = {registry["active"]} | {g["generation_id"] for g in registry["generations"] if g["status"] == "building"}
        needed |= {g["parent_id"] for g in registry["generations"] if g["generation_id"] in needed}
        gone = [g["generation_id"] for g in registry["generations"] if g["generation_id"] not in needed]
        self.store.drop(gone, TABLES)
        return gone

    def recover(self) -> None:
        """After a crash: building generations are abandoned, live jobs interrupted; what was half written goes."""

        def change(registry: dict) -> list[str]:
            left = [g["generation_id"] for g in registry["generations"] if g["status"] == "building"]
            after, jobs = generations.recover(self._frame(registry["generations"], GENERATIONS), self._frame(registry["jobs"], JOBS))
            self._put(registry["generations"], after, "generation_id", "status")
            self._put(registry["jobs"], jobs, "job_id", "state")
            return left

        self.store.drop(self.store.change(change), TABLES)

    def _folder(self, index: str, generation_id: str) -> str:
        return f"{self.store.folder}/{index}/generation_id={generation_id}"

    # -- reading

    def open(self, sources: DataFrame | None = None) -> Index:
        """The active generation and the notes; with the sources, code can be read as well."""
        generation = self.store.active()
        notes, evidence = self.notebook.read()
        read = lambda t: self.store.read(t, generation)
        return Index(self.repository_id, generation, read("files"), read("symbols"), read("edges"), read("observations").drop("generation_id"), read("externals"), sources, notes, evidence, postings=Postings(self.spark, self._folder("postings", generation)), names=lookups.Names(self.spark, self._folder("names", generation)), adjacency=lookups.Adjacency(self.spark, self._folder("adjacency", generation)))

    def status(self) -> dict:
        """What is there, from what was stored with the generation: no table is counted."""
        registry = self.store.registry()
        row = self.store.read("counts", registry["active"]).first().asDict() if registry["active"] else {}
        latest = max(registry["jobs"], key=lambda j: (j["created_at"], j["job_id"]), default=None)
        return {"active": registry["active"], "previous": registry["previous"], "latest_job": latest, **{k: v for k, v in row.items() if k != "generation_id"}}
