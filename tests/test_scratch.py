"""Intermediate tables lie in the shared folder, and shuffle files and used tables go."""

import os
import threading
from types import SimpleNamespace

import pytest

from palimpsest import catalog, scratch

from .conftest import SF


def test_tables(spark):
    df = spark.range(100).selectExpr("id", "id % 7 AS k").groupBy("k").count()
    first = scratch.shared(df)
    path = first.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert path.startswith(spark.conf.get("spark.checkpoint.dir")) and first.count() == 7
    second = scratch.shared(first.where("k > 3"), first)
    assert not os.path.exists(path) and second.count() == 3
    assert scratch.shared(spark.range(0).selectExpr("id", "array(id) AS a")).collect() == []


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://host:7077", applicationId="x")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.folder(SimpleNamespace(sparkContext=context))


def files_below(path):
    return sum(len(names) for _, _, names in os.walk(path.removeprefix("file:")))


def test_queries_after_release(spark):
    """What a session remembers lasts; what a query wrote for itself goes."""
    for name in ("status_by_source", "bm25_term"):
        before = catalog.QUERIES[name](spark, SF).collect()
        scratch.release(spark)
        assert sorted(catalog.QUERIES[name](spark, SF).collect()) == sorted(before)


def test_scopes_leave_nothing(spark):
    folder, settings = scratch.folder(spark), [spark.conf.get(k, None) for k in (scratch._CLEANUP, scratch._BATCH)]
    scratch.release(spark)
    n = files_below(folder)
    for i in range(20):
        with scratch.scope(spark):
            own = scratch.shared(spark.range(50 + i))
            with scratch.scope(spark):
                assert scratch.shared(own.where("id > 9")).count() == 40 + i
            assert own.count() == 50 + i
    assert files_below(folder) == n
    assert settings == [spark.conf.get(k, None) for k in (scratch._CLEANUP, scratch._BATCH)]


def test_settings_last_as_long_as_any_write(spark):
    begun, go = threading.Event(), threading.Event()

    def work():
        with scratch._settings(spark):
            begun.set()
            go.wait(30)

    old = spark.conf.get(scratch._CLEANUP, None)
    t = threading.Thread(target=work)
    t.start()
    begun.wait(30)
    scratch.shared(spark.range(3))
    assert spark.conf.get(scratch._CLEANUP) == "true"
    go.set()
    t.join()
    assert spark.conf.get(scratch._CLEANUP, None) == old
