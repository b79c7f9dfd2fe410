"""Commits are seen whole or not at all, and a writer that lost its lease can't make one."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.commits import Fenced, Files, Lease, Locked, Log
from palimpsest.schemas import empty
from palimpsest.sources.common import Extracted
from palimpsest.store import Store

LONG = "and enough further words to be worth a record of its own"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), clock=lambda: 5)


def hidden(spark, *uids):
    return spark.createDataFrame([(u, 1, None, None) for u in uids], empty(spark, "hidden_drawers").schema)


def uids(store):
    return sorted(r[0] for r in store.read("hidden_drawers").select("drawer_uid").collect())


def test_put_is_for_one(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append((files.put(f"{tmp_path}/log/1.json", str(i)), i))) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert [str(i) for ok, i in won if ok] == [files.read(f"{tmp_path}/log/1.json")]
    assert [n for n in files.names(f"{tmp_path}/log") if "aside" in n and not n.startswith(".")] == []
    assert files.read(f"{tmp_path}/none") is None and files.age(f"{tmp_path}/none") is None
    assert files.put(f"{tmp_path}/x", "a") and not files.put(f"{tmp_path}/x", "b") and files.read(f"{tmp_path}/x") == "a"


def test_log_keeps_some(spark, tmp_path):
    log = Log(Files(spark, str(tmp_path)), f"{tmp_path}/_log")
    assert log.latest() == (0, None)
    log.KEEP = 3
    for n in range(6):
        log.put(n, {"n": n})
    assert log.latest() == (6, {"n": 5}) and log._numbers() == [3, 4, 5, 6]
    for n in (0, 5, 7):
        with pytest.raises(Fenced):
            log.put(n, {})


def test_readers_see_all_or_nothing(store, spark):
    store.append("hidden_drawers", hidden(spark, "a"))
    other = Store(spark, store.path)
    with store.transaction():
        store.append("hidden_drawers", hidden(spark, "b"))
        store.replace("extract_pending", spark.createDataFrame([("b", 1, None, None)], empty(spark, "extract_pending").schema))
        assert uids(store) == ["a", "b"] and uids(other) == ["a"] and other.read("extract_pending").count() == 0
        seen = other.read("hidden_drawers")
    assert uids(other) == ["a", "b"] and other.read("extract_pending").count() == 1 and seen.count() == 1
    with pytest.raises(ZeroDivisionError), store.transaction():
        store.append("hidden_drawers", hidden(spark, "c"))
        store.replace("extract_pending", empty(spark, "extract_pending"))
        1 / 0  # noqa: B018
    assert uids(store) == uids(other) == ["a", "b"] and other.read("extract_pending").count() == 1


def test_a_write_that_fails_is_not_there(store, spark):
    store.append("hidden_drawers", hidden(spark, "a"))
    broken = spark.range(8).select(F.when(F.col("id") > 6, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("drawer_uid"), F.lit(1).cast("long").alias("hidden_at"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("long").alias("unhidden_at"))
    with pytest.raises(Exception, match="no"):
        store.append("hidden_drawers", broken)
    assert uids(store) == ["a"]
    store.append("hidden_drawers", hidden(spark, "b"))
    assert uids(store) == ["a", "b"]


def test_a_drawer_and_its_errors_are_one_commit(store, spark):
    n, _ = store.log.latest()
    drawers = empty(spark, "drawers")
    found = Extracted(drawers, spark.createDataFrame([("/p", "bad")], "source_path string, reason string"))
    store.add(found, "s", once="c#1")
    m, manifest = store.log.latest()
    assert m == n + 1 and manifest["noted"] == {"c": "1"} and len(manifest["tables"]["ingest_errors"]) == 1


def test_who_lost_its_lease_cannot_commit(store, spark):
    """The first writer sleeps beyond its time, the second takes over; the first wakes up in the middle of a transaction."""
    slow, quick = Store(spark, store.path, stale=0.4), Store(spark, store.path, stale=0.4)
    entered, taken, result = threading.Event(), threading.Event(), []

    def sleeper():
        try:
            with slow.writing():
                slow.append("hidden_drawers", hidden(spark, "first"))
                with slow.transaction():
                    slow.append("hidden_drawers", hidden(spark, "late"))
                    slow.files.touch = lambda path: None  # it doesn't get to its heartbeat any more
                    entered.set()
                    taken.wait(60)
        except Locked as e:
            result.append(e)

    t = threading.Thread(target=sleeper)
    t.start()
    assert entered.wait(60)
    with quick.writing(wait=30):
        quick.append("hidden_drawers", hidden(spark, "second"))
        taken.set()
        t.join()
        assert isinstance(result[0], Fenced)
        assert quick.files.exists(f"{store.path}/_lock")  # the sleeper didn't take it along
        quick.append("hidden_drawers", hidden(spark, "third"))
    assert uids(store) == ["first", "second", "third"] and not store.files.exists(f"{store.path}/_lock")


def test_a_lease_lasts_while_its_holder_lives(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    lease = Lease(files, f"{tmp_path}/_lock", stale=0.6)
    lease.acquire()
    time.sleep(1.5)
    with pytest.raises(Locked):
        Lease(files, f"{tmp_path}/_lock", stale=0.6).acquire(wait=0.3)
    lease.release()
    Lease(files, f"{tmp_path}/_lock", stale=0.6).acquire()


def test_of_many_that_wait_one_at_a_time(spark, tmp_path):
    files, inside, most = Files(spark, str(tmp_path)), [], []
    files.mark(f"{tmp_path}/_lock")  # of a writer that died
    time.sleep(0.6)

    def work():
        lease = Lease(files, f"{tmp_path}/_lock", stale=0.5)
        lease.acquire(wait=60)
        inside.append(1)
        most.append(len(inside))
        time.sleep(0.1)
        inside.pop()
        lease.release()

    threads = [threading.Thread(target=work) for _ in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert most == [1] * 5


def test_writers_without_a_lease_keep_each_others_rows(store, spark):
    threads = [threading.Thread(target=lambda i=i: Store(spark, store.path).append("hidden_drawers", hidden(spark, str(i)))) for i in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert uids(store) == list("01234")


def test_many_appends_make_few_folders(store, spark):
    store.PARTS = 3
    for i in range(8):
        store.append("hidden_drawers", hidden(spark, str(i)))
        assert len(store.log.latest()[1]["tables"]["hidden_drawers"]) <= 3
    assert uids(store) == list("01234567")


def test_old_folders_go_with_the_next_but_one(store, spark, tmp_path):
    for i in range(4):
        store.replace("hidden_drawers", hidden(spark, str(i)))
        before = store.read("hidden_drawers") if i == 2 else None
        if before is not None:
            kept = before
    assert [r[0] for r in kept.select("drawer_uid").collect()] == ["2"]
    assert sorted(p.name for p in (tmp_path / "store" / "hidden_drawers").glob("v*")) == ["v3", "v4"]


def test_a_store_without_a_log_is_read(store, spark, tmp_path):
    hidden(spark, "a").write.parquet(f"{store.path}/hidden_drawers/v1")
    hidden(spark, "b").write.parquet(f"{store.path}/hidden_drawers/v2")
    (tmp_path / "store" / "hidden_drawers" / "v2" / "_SUCCESS").unlink()
    assert uids(store) == ["a"]
    store.append("hidden_drawers", hidden(spark, "c"))
    assert uids(store) == ["a", "c"] and json.loads(next((tmp_path / "store" / "_log").glob("*.json")).read_text())["tables"]["hidden_drawers"] == [1, 3]


def test_quick_runs_open_only_what_changed(store, spark, tmp_path):
    """Bytes that tasks read, by Spark's own count; none for a run over files that are as they were."""
    folder = tmp_path / "notes"
    folder.mkdir()
    for name in ("a", "b [1]", "c{x}", "d*", "e?f", "g+h %20"):
        (folder / f"{name}.md").write_text(f"{name} {LONG} " + "word " * 20_000)
    source = {"name": "notes", "type": "markdown", "path": str(folder)}

    def opened(**how):
        read = []
        reader = store.spark.read.format

        spark.sparkContext.setJobGroup("quick", "quick")
        from palimpsest.sources import common

        load, common._load = common._load, lambda s, p, f, **o: (read.append(p), load(s, p, f, **o))[1]
        try:
            n = store.index_all([source], **how)["notes"]
        finally:
            common._load = load
        assert reader
        return n, [p for p in read if not isinstance(p, str)]

    n, names = opened()
    assert n == 6 and sorted(p.rpartition("/")[2] for p in names[0]) == sorted(f.name for f in folder.iterdir())
    assert opened(quick=True) == (0, [])
    (folder / "new.md").write_text("new " + LONG)
    n, names = opened(quick=True)
    assert n == 1 and {p for g in names for p in g} == {str(folder / "new.md")}
    assert opened(quick=True) == (0, [])


def test_batches_of_files_are_commits(store, spark, tmp_path, monkeypatch):
    """A run that fails goes on after the last batch that it committed."""
    folder = tmp_path / "notes"
    folder.mkdir()
    for i in range(5):
        (folder / f"{i}.md").write_text(f"note {i} {LONG}")
    store.BATCH = 2
    source = {"name": "notes", "type": "markdown", "path": str(folder)}
    own, calls = store._add, []

    def failing(*a, **k):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("down")
        return own(*a, **k)

    monkeypatch.setattr(store, "_add", failing)
    assert store.index_all([source])["notes"].startswith("OSError")
    assert store.read("drawers").count() == store.read("index_state").count() == 2
    assert store.index_all([source], quick=True) == {"notes": 3}
    assert store.read("drawers").count() == store.read("index_state").count() == 5
