"""The best of many documents from an index's cells: the rows of the plain search, from a part of the postings."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import index
from palimpsest.plans import best as cells
from palimpsest.plans.bm25 import Index
from palimpsest.plans.match import parse
from palimpsest.plans.search import Searcher

QUERIES = ["common", "rare", "common OR rare", "rare OR seldom OR common", "rare OR rare", "(seldom OR rare) OR nowhere", "nowhere"]


def text(rng: random.Random) -> str:
    words = rng.choices(["common", "word", "filler", "seldom", "rare"], weights=[30, 40, 30, 3, 1], k=int(rng.lognormvariate(4, 1)) + 1)
    return " ".join(words)


@pytest.fixture(scope="module")
def drawers(spark):
    rng = random.Random(3)
    rows = [(f"u{i}", i, "a" if i % 3 else "b", "human", i, None, text(rng)) for i in range(3_000)]
    rows += [(f"same{i}", 10_000 + i, "a", "human", i, None, "seldom rare") for i in range(40)]
    return spark.createDataFrame(rows, "drawer_uid string, rowid long, source string, role string, created_at long, register string, content string").repartition(3).persist()


@pytest.fixture(scope="module")
def both(spark, drawers, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    index.write_index(drawers, path, 3)
    stored = index.read_index(spark, path)
    hidden = drawers.where("rowid % 5 = 0").select("drawer_uid", F.lit(1).alias("hidden_at"), F.lit(None).cast("long").alias("unhidden_at"))
    return Searcher(drawers, stored, hidden), Searcher(drawers, Index(stored.postings, stored.lengths, stored.stats), hidden)


def rows(found):
    return [(r["rank"], r["drawer_uid"], pytest.approx(r["score"])) for r in found.collect()]


@pytest.mark.parametrize("query", QUERIES)
@pytest.mark.parametrize("options", [{"limit": 10}, {"limit": 3, "source": "b"}, {"limit": 60, "since": 1500}])
def test_same_rows_as_all_scored(both, query, options):
    fast, plain = both
    assert fast.best(query, options["limit"], True) is not None and plain.best(query, 5, True) is None
    assert rows(fast.search(query, raw=True, **options)) == rows(plain.search(query, raw=True, **options))


def test_cells_are_left_unread(both):
    fast, _ = both
    for query in ("common", "common OR rare"):
        seen = fast.best(query, 10, True)
        assert seen.rows_read < 0.4 * seen.rows and seen.cells_read < seen.cells


def test_a_filter_that_few_pass_reads_on(both):
    fast, plain = both
    every = fast.best("common", 10, True, source="none")
    assert every.rows_read == every.rows and every.found.count() == 0
    assert rows(fast.search("common", limit=5, until=2)) == rows(plain.search("common", limit=5, until=2))


def test_other_queries_and_other_indexes_are_searched_plainly(both, spark, drawers, tmp_path):
    fast, _ = both
    for query in ('"common word"', "com*", "^common", "common AND rare", "common NOT rare", "NEAR(common rare, 2)", "content:common OR rar*"):
        assert fast.best(query, 5, True) is None
    assert cells.single_terms(parse("rare OR (common OR rare)")) == {"rare": 2, "common": 1}
    # parts of one index: cells of equal names are added up; drawers without a part need the plain way
    index.write_index(drawers.where("rowid % 2 = 0"), f"{tmp_path}/a")
    index.write_index(drawers.where("rowid % 2 = 1"), f"{tmp_path}/b")
    parts = index.read_index(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    assert rows(Searcher(drawers, parts).search("common OR seldom", raw=True, limit=20)) == rows(Searcher(drawers, Index(parts.postings, parts.lengths, parts.stats)).search("common OR seldom", raw=True, limit=20))
    assert index.read_index(spark, f"{tmp_path}/a", missing=drawers.where("rowid % 2 = 1")).cells is None
    index.write_index(drawers.limit(0), f"{tmp_path}/none")
    nothing = Searcher(drawers, index.read_index(spark, f"{tmp_path}/none"))
    assert nothing.search("common", limit=5).count() == 0
