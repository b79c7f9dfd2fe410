"""A stored index: drawers without one, phrases at once from its terms and texts, and parts of earlier versions."""

import os

from pyspark.sql import functions as F

from palimpsest import catalog, scratch
from palimpsest.operators import index
from palimpsest.plans.bm25 import Index

from .conftest import SF

TEXTS = ["a b a b a", "b a b", "a", "", None, "c a b c a b", "a a a a", "x y z a b"]


def rows(df):
    return sorted((r["qid"], r["uid"], round(r["score"], 9)) for r in df.collect())


def stored(spark, path):
    df = spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(TEXTS)], "drawer_uid string, content string")
    index.write_index(df, path, 2)
    return df, index.read_index(spark, path)


def test_phrases_at_once(spark, tmp_path):
    df, own = stored(spark, str(tmp_path))
    assert sorted(own.postings.collect()) == sorted(index.postings(df).collect())
    queries = spark.createDataFrame([(i, q.split()) for i, q in enumerate(["a b", "a b a", "a", "a a", "c a b", "b c", "nowhere a", "nowhere", "", "x y z a b", "a b a b a"])], "qid int, terms array<string>")
    got = rows(own.match_all(queries))
    assert got == rows(Index(own.postings, own.lengths, own.stats).match_all(queries)) and len({r[0] for r in got}) == 8


def test_parts_of_earlier_versions(spark, tmp_path):
    """They have rows for positions and no texts or terms."""
    df, own = stored(spark, f"{tmp_path}/new")
    more = df.withColumn("drawer_uid", F.concat(F.lit("old"), "drawer_uid"))
    index.postings(more).write.parquet(f"{tmp_path}/old/postings")
    index.lengths(more).write.parquet(f"{tmp_path}/old/lengths")
    index.lengths(more).agg(F.count("*").alias("n"), F.sum("length").alias("total")).write.parquet(f"{tmp_path}/old/sums")
    both = index.read_index(spark, f"{tmp_path}/new", f"{tmp_path}/old")
    assert both.cells is None and both.postings.count() == 2 * own.postings.count()


def test_status_makes_no_index(spark, tmp_path):
    """Status reads drawers, and so nothing is shuffled or indexed for it."""
    catalog._STORED.clear()
    catalog._INDEXES.clear()
    before = set(os.listdir(scratch.lasting(spark))) if os.path.exists(scratch.lasting(spark)) else set()
    for name in ("status_by_source", "status_summary", "entities_for_drawer"):
        catalog.QUERIES[name](spark, SF).collect()
    (new,) = set(os.listdir(scratch.lasting(spark).removeprefix("file:"))) - before
    assert os.listdir(f"{scratch.lasting(spark)}/{new}".removeprefix("file:")) == ["drawers"]
