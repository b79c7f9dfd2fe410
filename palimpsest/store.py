"""A store: the tables as versioned parquet folders under one path, written by one writer at a time."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .commits import Fenced, Files, Lease, Locked, Log  # noqa: F401  for callers
from .operators import index, ops
from .operators.extraction import Runner
from .plans.bm25 import Index
from .plans.search import Searcher
from .scratch import drop, shared
from .sources import HANDLES, reader
from .sources.common import Extracted, listed
from .sources.files import glob_condition, relative


def _batches(rows: Iterable[Row], size: int) -> Iterator[list[Row]]:
    rows = iter(rows)
    while batch := list(islice(rows, size)):
        yield batch


class Store:
    """Tables under one path. A table is the folders `<path>/<table>/v<n>` that the log's highest manifest names, so a reader
    sees a commit whole or not at all, also one of several tables (`transaction`).

    The index lies in `index/v<n>` in parts, one for each run that added drawers until `reindex` makes one of all; a part
    counts when its drawers are stored. One writer at a time holds a lease, which lasts while its driver lives; a writer that was
    quiet for `stale` seconds can lose it, and can't commit then (`Fenced`).
    """

    #: Folders of a table, at most; one more append makes one of all.
    PARTS = 64
    #: Tables whose files' digests are kept beside them.
    DIGESTED = ("drawers",)
    #: Files that one commit of an index run reads.
    BATCH = 20_000

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], float] = time.time, stale: float = 60):
        self.spark, self.path, self.clock, self.stale = spark, path.rstrip("/"), clock, stale
        self.files = Files(spark, self.path)
        self.log = Log(self.files, f"{self.path}/_log")
        self._own = threading.local()

    def _file(self, path: str):
        return self.files.path(path)

    @property
    def _fs(self):
        return self.files.fs

    def _manifest(self) -> tuple[int, dict]:
        """The highest manifest: each table's folders, oldest first, those it had before its last replacement, and what was noted. A store without a log has the highest finished folder of each."""
        n, found = self.log.latest()
        if found is None:
            versions = {name: self._finished(name) for name in schemas.TABLES}
            found = {"tables": {name: [v] for name, v in versions.items() if v}, "old": {}, "noted": {}}
        return n, found

    def _finished(self, name: str) -> int:
        folder = f"{self.path}/{name}"
        return max([int(n[1:]) for n in self.files.names(folder) if n[1:].isdigit() and self.files.exists(f"{folder}/{n}/_SUCCESS")], default=0)

    def _folders(self, name: str) -> list[int]:
        """A table's folders; within a transaction, with what it has written."""
        staged = getattr(self._own, "staged", None)
        return (staged or self._manifest()[1])["tables"].get(name, [])

    def _version(self, name: str) -> int:
        return max(self._folders(name), default=0)

    @contextmanager
    def writing(self, wait: float = 0) -> Iterator[None]:
        """Hold the store's lease; Locked if another writer does for all of `wait` seconds."""
        lease = Lease(self.files, f"{self.path}/_lock", self.stale)
        lease.acquire(wait)
        try:
            n, manifest = self._manifest()
            self.log.put(n, manifest | {"writer": lease.name})
            self._own.base = n + 1
            yield
        finally:
            self._own.base = None
            lease.release()

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """What is written within can be seen by others when it ends, all at once, and never if it fails. One within another is part of that."""
        if getattr(self._own, "staged", None) is not None:
            yield
            return
        n, manifest = self._manifest()
        base = getattr(self._own, "base", None)
        if base not in (None, n):
            raise Fenced(f"{self.path} has another writer")
        own = self._own
        own.staged, own.after, own.changes, own.fresh = json.loads(json.dumps(manifest)), [], [], {}
        try:
            yield
            own.staged["at"] = int(time.time())
            while True:
                try:
                    self.log.put(n, own.staged)
                    break
                except Fenced:
                    if base is not None:
                        raise
                    # without a lease, what others committed meanwhile comes first
                    n, own.staged = self._manifest()
                    for change in own.changes:
                        change(own.staged)
            if base is not None:
                own.base = n + 1
            after = own.after
        finally:
            own.staged = None
        for what in after:
            what()

    def _change(self, change: Callable[[dict], None]) -> None:
        self._own.changes.append(change)
        change(self._own.staged)

    def _reserve(self, name: str) -> int:
        """A folder that no other writer has or had."""
        taken = [int(x) for x in (f.lstrip("_")[1:] for f in self.files.names(f"{self.path}/{name}")) if x.isdigit()]
        n = max(taken, default=0) + 1
        while not self.files.put(f"{self.path}/{name}/_v{n}"):
            n += 1
        return n

    # ---- tables ----

    def exists(self) -> bool:
        return self._version("schema_version") > 0

    def create(self) -> None:
        """Write the seeds; a store that is there is brought to this schema. A newer one is refused, and one that a step left half done."""
        if not self.exists():
            for name, rows in schemas.seeds(self.spark, int(self.clock())).items():
                self.replace(name, rows)
        version = self.read("schema_version").where("status = 'applied'").agg(F.max("version")).first()[0] or 0
        if self.read("schema_version").where("status = 'in_progress'").limit(1).count():
            raise RuntimeError("a migration of this store did not finish")
        if version > schemas.VERSION:
            raise RuntimeError(f"the store has schema {version}, newer than {schemas.VERSION}")
        for n in range(version + 1, schemas.VERSION + 1):
            self._step(n)

    def _step(self, n: int) -> None:
        """One migration: noted before it begins, and again when it has ended."""
        text, run = schemas.STEPS.get(n, ("no change of tables", None))
        versions = self.read("schema_version")
        noted = lambda status: versions.unionByName(self.spark.createDataFrame([(n, int(self.clock()), text, status)], schemas.SCHEMA_VERSION))
        self.replace("schema_version", shared(noted("in_progress")))
        if run:
            run(self)
        self.replace("schema_version", shared(noted("applied")))

    def baseline(self) -> None:
        """Note the present schema for a store whose tables were brought here otherwise, in place of what was noted."""
        with self.writing():
            self.replace("schema_version", self.spark.createDataFrame([(schemas.VERSION, int(self.clock()), "baseline", "applied")], schemas.SCHEMA_VERSION))

    def read(self, name: str) -> DataFrame:
        folders = [f"{self.path}/{name}/v{n}" for n in self._folders(name)]
        return self.spark.read.schema(schemas.TABLES[name]).parquet(*folders) if folders else schemas.empty(self.spark, name)

    def _write(self, name: str, rows: DataFrame) -> int:
        n = self._reserve(name)
        folder = f"{self.path}/{name}/v{n}"
        rows.select(*schemas.TABLES[name].names).write.mode("overwrite").parquet(folder)
        if name in self.DIGESTED:
            self._digests(folder).write.mode("overwrite").parquet(f"{folder}/_digests")
        self._own.fresh.setdefault(name, []).append(n)
        return n

    def _digests(self, folder: str) -> DataFrame:
        """(file, size, digest) of a folder's files as they are; a task holds one file."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
        return files.select(F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("digest"))

    def damaged(self, name: str = "drawers") -> list[tuple[str, str]]:
        """(file, reason) of a digested table's files that are not what was written, by folder and file; bytes are compared and nothing is parsed.

        Folders from before digests were kept have none to compare and count as whole here.
        """
        out = []
        for folder in (f"{self.path}/{name}/v{n}" for n in self._folders(name)):
            if self.files.exists(f"{folder}/_digests/_SUCCESS"):
                now = self._digests(folder).select("file", F.col("size").alias("now"), F.col("digest").alias("is"))
                both = self.spark.read.parquet(f"{folder}/_digests").join(now, "file", "left").where("digest IS DISTINCT FROM is")
                reason = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("size"), F.format_string("%d bytes, not %d", "now", "size")).otherwise("other bytes")
                out += [(f"{folder}/{r['file']}", r["reason"]) for r in both.select("file", reason.alias("reason")).collect()]
        return sorted(out)

    def _whole(self, name: str, damaged: list[tuple[str, str]]) -> DataFrame:
        """The rows of a table's files but the damaged ones."""
        bad = {f for f, _ in damaged}
        files = [f"{self.path}/{name}/v{n}/{f}" for n in self._folders(name) for f in self.files.names(f"{self.path}/{name}/v{n}") if f.endswith(".parquet")]
        files = [f for f in files if f not in bad]
        return self.spark.read.schema(schemas.TABLES[name]).parquet(*files) if files else schemas.empty(self.spark, name)

    def replace(self, name: str, rows: DataFrame) -> None:
        """A new version; the one before stays until the next, for readers that still have it."""
        with self.transaction():
            own, gone = {int(x) for x in self._own.fresh.get(name, ())}, []
            n = self._write(name, rows)

            def change(manifest: dict) -> None:
                before = manifest["tables"].get(name, [])
                if set(before) & own:  # nobody has seen what this transaction wrote
                    gone[:] = before
                else:
                    gone[:], manifest["old"][name] = manifest["old"].get(name, []), before
                manifest["tables"][name] = [n]

            self._change(change)
            self._own.after.append(lambda: [self.files.delete(f"{self.path}/{name}/v{v}") for v in gone])

    def append(self, name: str, rows: DataFrame) -> None:
        with self.transaction():
            if len(self._folders(name)) >= self.PARTS:
                self.replace(name, self.read(name).unionByName(rows.select(*schemas.TABLES[name].names)))
            else:
                n = self._write(name, rows)
                self._change(lambda manifest: manifest["tables"].update({name: [*manifest["tables"].get(name, []), n]}))

    # ---- ingest ----

    def add(self, found: Extracted, source: str, enqueue: bool = False, scan_risk: bool = False, once: str | None = None) -> int:
        """Store and index records that are new, with what could not be read; how many came in.

        With enqueue, new records also wait for extraction. What could not be read is noted once for each value of `once`.
        """
        return self._add(found, source, enqueue, scan_risk, once)[0]

    def _add(self, found: Extracted, source: str, enqueue: bool = False, scan_risk: bool = False, once: str | None = None) -> tuple[int, DataFrame]:
        """As `add`; also (source_path, n) of the new records."""
        order = [F.col(c) for c in ("source_path", "thread_id", "position_in_thread", "source_id")]
        new = index.new_records(index.first_of_each(found.drawers, order), self.read("drawers"))
        if scan_risk:
            new = index.completed(new, True)
        new = shared(new)
        count = new.count()
        with self.transaction():
            if count:
                if enqueue:
                    waiting = new.select("drawer_uid", F.lit(int(self.clock())).cast("long").alias("enqueued_at"), F.lit(None).cast("string").alias("prompt_template"), F.lit(None).cast("string").alias("prompt_version"))
                    self.append("extract_pending", waiting.join(self.read("extract_pending"), "drawer_uid", "left_anti"))
                part = f"{self.path}/index/v{max(1, self._finished('index'))}/{uuid.uuid4().hex}"
                index.write_index(new, part)
                self.append("drawers", new)
                self._own.after += [lambda: self.files.mark(f"{part}/_DONE"), lambda: self.files.mark(f"{part.rpartition('/')[0]}/_SUCCESS")]
            what, _, mark = (once or "").rpartition("#")
            if not once or self._own.staged["noted"].get(what) != mark:
                errors = shared(index.error_rows(found.errors.select(F.lit(source).alias("source"), "source_path", "reason"), int(self.clock())))
                if errors.limit(1).count():
                    self.append("ingest_errors", errors)
                drop(errors)
                if once:
                    self._change(lambda manifest: manifest["noted"].update({what: mark}))
        return count, shared(new.groupBy("source_path").agg(F.count("*").alias("n")), new)

    def index_source(self, source: dict, quick: bool = False, **options) -> int:
        """Read one configured source. With quick, only files that are new or changed since the last run.

        Files are listed without their content; those to read are then read by name, in batches of BATCH, in the order of their paths.
        A batch's drawers, errors and state are one commit, so a run that fails goes on where it was.
        """
        path, read = source["path"], reader(source["type"])
        files = listed(self.spark, path).select(F.lit(source["name"]).alias("source"), F.col("path").alias("source_path"), "mtime", "size")
        files = files.where(HANDLES[source["type"]](F.col("source_path")) & glob_condition(F.col("source_path"), relative(F.col("source_path"), path), source.get("include") or (), source.get("exclude") or ()))
        if quick:
            files = index.needs_index(files, self.read("index_state"))
        count = 0
        for batch in _batches(files.orderBy("source_path").toLocalIterator(), self.BATCH):
            seen = self.spark.createDataFrame(batch, files.schema)
            with self.transaction():
                n, own = self._add(read(self.spark, [r["source_path"] for r in batch]), source["name"], **options)
                seen = seen.join(own, "source_path", "left").select("source", "source_path", F.col("mtime").alias("last_indexed_mtime"), F.col("size").alias("last_indexed_size"), F.coalesce("n", F.lit(0)).alias("drawer_count"))
                self.replace("index_state", index.updated_state(self.read("index_state"), seen))
            drop(own)
            count += n
        return count

    def index_all(self, sources: list[dict], quick: bool = False, **options) -> dict[str, int | str]:
        """Records that came in by source; what failed says why, and the others go on."""
        out: dict[str, int | str] = {}
        with self.writing():
            self.create()
            for s in sources:
                if s.get("enabled", True):
                    try:
                        out[s["name"]] = self.index_source(s, quick, **options)
                    except Exception as e:  # noqa: BLE001  one bad source must not stop the rest
                        out[s["name"]] = f"{type(e).__name__}: {e}"
        return out

    # ---- reading ----

    def index(self) -> Index:
        """The stored index; drawers that it doesn't hold yet are indexed as they are used."""
        drawers, folder = self.read("drawers"), self._file(f"{self.path}/index/v{self._finished('index')}")
        parts = [s.getPath().toString() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        parts = [p for p in parts if self._fs.exists(self._file(f"{p}/_DONE"))]
        if not parts:
            return index.build(drawers)
        stored = index.read_index(self.spark, *parts)
        if stored.lengths.count() == drawers.count():
            return stored
        missing = drawers.join(stored.lengths.select(F.col("uid").alias("drawer_uid")), "drawer_uid", "left_anti")
        return index.read_index(self.spark, *parts, missing=missing)

    def reindex(self, parts: int | None = None) -> None:
        """Make one part of the whole index; the version before stays until the next, for readers that still have it."""
        with self.writing():
            n = self._finished("index")
            part = f"{self.path}/index/v{n + 1}/all"
            index.write_index(self.read("drawers"), part, parts)
            self.files.mark(f"{part}/_DONE")
            self.files.mark(f"{self.path}/index/v{n + 1}/_SUCCESS")
            if n > 1:
                self._fs.delete(self._file(f"{self.path}/index/v{n - 1}"), True)

    def searcher(self, **options) -> Searcher:
        return Searcher(self.read("drawers"), self.index(), self.read("hidden_drawers"), **options)

    def forget(self, prefix: str, reason: str | None = None, dry_run: bool = False) -> dict:
        """Hide the drawer that a prefix means."""
        uid = ops.resolve(self.read("drawers"), prefix)
        if not dry_run:
            with self.writing():
                request = self.spark.createDataFrame([(uid, int(self.clock()), reason)], "drawer_uid string, hidden_at long, reason string")
                self.replace("hidden_drawers", ops.hide(self.read("hidden_drawers"), request))
        return {"ok": True, "drawer_uid": uid, "dry_run": dry_run, "reason": reason}

    def check(self) -> dict[str, str]:
        """Tables that can't be read, or have damaged files, and why; a snapshot or a new index run brings them back."""
        bad = {}
        for name in schemas.TABLES:
            if name in self.DIGESTED and (found := self.damaged(name)):
                bad[name] = "; ".join(f"{f}: {reason}" for f, reason in found)
                continue
            try:
                self.read(name).write.format("noop").mode("overwrite").save()
            except Exception as e:  # noqa: BLE001  any failure to read is what is asked for
                bad[name] = str(e).partition("\n")[0]
        return bad

    def rebuild(self, path: str | None = None) -> dict[str, str]:
        """What `check` finds broken, after it was brought back from a snapshot, where there is one, or emptied; then the index is made again.

        Of drawers only what damaged files held is brought back; a file that is whole stays as it is, and without a snapshot
        the next index run fills the gap, as no file's state is kept then.
        """
        bad, damaged = self.check(), {name: self.damaged(name) for name in self.DIGESTED}
        other = Store(self.spark, path) if path else None
        with self.writing(), self.transaction():
            for name in bad:
                back = other.read(name) if other and other._version(name) else schemas.empty(self.spark, name)
                if damaged.get(name):
                    whole = shared(self._whole(name, damaged[name]))
                    back = whole.unionByName(back.join(whole.select("drawer_uid"), "drawer_uid", "left_anti").select(*whole.columns))
                self.replace(name, back)
            if "drawers" in bad:
                self.replace("index_state", schemas.empty(self.spark, "index_state"))
        if "drawers" in bad:
            self.reindex()
        return bad

    def record_runs(self, runs: DataFrame) -> None:
        """Append extraction runs; their ids follow the highest one."""
        with self.writing():
            most = self.read("extraction_runs").agg(F.coalesce(F.max("id"), F.lit(0)).alias("most"))
            rows = runs.crossJoin(F.broadcast(most)).withColumn("id", F.col("id") + F.col("most"))
            self.append("extraction_runs", shared(rows.select(*schemas.RUNS.names)))

    def extract(self, runner: Runner, uid: str | None = None, batch: int = 10, template: str = "{content}") -> list[dict]:
        """Run what waits, or one drawer whether it waits or not, and keep the runs; what succeeded waits no more."""
        pending, drawers = self.read("extract_pending"), self.read("drawers")
        begun = len(runner.rows)
        out = [runner.run_drawer(uid, drawers, pending, template)] if uid else runner.run_pending(pending, drawers, template, batch)[0]
        if out:
            self.record_runs(runner.runs(begun))
            done = self.spark.createDataFrame([(r["drawer_uid"],) for r in out if r["status"] in ("success", "partial")], "drawer_uid string")
            with self.writing():
                self.replace("extract_pending", shared(self.read("extract_pending").join(F.broadcast(done), "drawer_uid", "left_anti")))
        return out

    def snapshot(self, path: str) -> None:
        """Copy every table's current rows to another path."""
        other = Store(self.spark, path)
        for name in schemas.TABLES:
            if self._version(name):
                other.replace(name, self.read(name))
