"""The MATCH grammar, ranking and the search facade, with SQLite's FTS5 as the judge."""

import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.text import tokens_of
from palimpsest.operators import index
from palimpsest.plans.match import MatchError, literal, parse
from palimpsest.plans.search import Searcher, clamp, source_list

TEXTS = [
    "the quick brown fox jumps over the lazy dog", "acme builds rockets; Acme also builds traps", "a rocket is not a trap", "Café résumé naïve Ünïcode ÀÉÎ",
    "sam met acme at the fox den", "lorem ipsum dolor sit amet", "fox fox fox", "the end of the brown road", "quick brown", "one two three four five six seven eight",
    "two one, four three", "dolor AND sit OR amet", "hyphen-ated under_score it's", "acme sam lorem", "trap the fox; the fox will trap you", "",
]
QUERIES = [
    "fox", "acme OR sam", "fox AND the", "fox the", "fox NOT lazy", "quick + brown", '"quick brown"', "ro*", "^the", "^fox", "NEAR(fox the)", "NEAR(one four, 2)", "NEAR(one four, 1)", "NEAR(fox trap, 1)",
    "acme OR acme", "(acme OR fox) AND the", "content:fox", "{content}:fox", "one two OR fox NOT dolor", '"the brown" OR road', "cafe", "RESUME", "trap* NOT (sam OR fox)", '"fox the"', "a NOT b NOT c", "acme AND (sam OR traps) NOT lorem",
    '"hyphen ated"', "under_score", '"qui" + bro*', '^"the quick"', "NEAR(\"brown fox\" dog, 5)", "fox OR NEAR(one three, 3)", "nothinghere",
]
BAD = ["AND", "fox AND", "(fox", "fox)", "NEAR(", '"open', "fox OR", "title:fox", "fox ! dog", "NOT fox", "", "(acme OR fox) the", "*", "a + "]


@pytest.fixture(scope="module")
def fts():
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE t USING fts5(content, tokenize='unicode61 remove_diacritics 2')")
    c.executemany("INSERT INTO t(rowid, content) VALUES (?, ?)", enumerate(TEXTS, 1))
    return c


@pytest.fixture(scope="module")
def store(spark):
    rows = [(str(i), i, "s" if i % 2 else "t", "human", 1000 + i, "technical" if i % 3 else None, t) for i, t in enumerate(TEXTS, 1)]
    drawers = spark.createDataFrame(rows, "drawer_uid string, rowid long, source string, role string, created_at long, register string, content string").persist()
    return Searcher(drawers, index.build(drawers))


@pytest.mark.parametrize("query", QUERIES)
def test_same_as_fts5(store, fts, query):
    want = dict(fts.execute("SELECT rowid, -bm25(t) FROM t WHERE t MATCH ?", (query,)))
    got = {int(r[0]): r[1] for r in store.index.match(parse(query)).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


@pytest.mark.parametrize("query", BAD)
def test_syntax_errors(fts, query):
    if query:
        with pytest.raises(sqlite3.OperationalError):
            fts.execute("SELECT rowid FROM t WHERE t MATCH ?", (query,)).fetchall()
    with pytest.raises(MatchError):
        parse(query)


def test_literal_is_one_phrase(store, fts):
    for q in ("quick brown", "acme OR sam", "it's", "...", "fox NOT", 'say "fox"'):
        want = {r[0] for r in fts.execute("SELECT rowid FROM t WHERE t MATCH ?", ('"' + q.replace('"', '""') + '"',))}
        assert {int(r[0]) for r in store.index.match(literal(q)).collect()} == want


def test_tokens_on_the_driver_and_in_columns(spark):
    for t in TEXTS + ["ǅ ß ẞ ſµ Ĳ œ \U0001f600 x²"]:
        from palimpsest.functions.text import tokens

        assert spark.range(1).select(tokens(F.lit(t))).first()[0] == tokens_of(t)


def test_order_filters_and_limits(store):
    rows = store.search("fox").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    assert {r["source"] for r in store.search("fox", source="s").collect()} == {"s"}
    assert {r["created_at"] for r in store.search("fox", since=1005, until=1007).collect()} == {1005, 1007}
    assert all(r["register"] == "technical" for r in store.search("fox", register="technical", unknown=1).collect())
    assert store.search("   ").count() == 0 and store.search("", raw=True).count() == 0
    assert [clamp(x) for x in (0, -5, 7, 5000, None, "x")] == [1, 1, 7, 1000, 50, 50]
    assert source_list("a") == ["a"] and source_list(["", "b"]) == ["b"] and source_list(None) == []
    with pytest.raises(ValueError):
        store.search("fox", mode="semantic")


def test_scores_do_not_depend_on_filters(store, spark):
    every = {r["drawer_uid"]: r["score"] for r in store.search("fox").collect()}
    hidden = spark.createDataFrame([("1", 5, None), ("7", 5, 6)], "drawer_uid string, hidden_at long, unhidden_at long")
    some = {r["drawer_uid"]: r["score"] for r in Searcher(store.drawers, store.index, hidden).search("fox").collect()}
    assert "1" not in some and "7" in some and all(every[k] == v for k, v in some.items())


def test_rerank(store):
    longest = Searcher(store.drawers, store.index, scorer=lambda: lambda pairs: [float(len(c)) for _, c in pairs])
    rows = longest.search("fox", mode="rerank", limit=2).collect()
    assert [r["rank"] for r in rows] == [1, 2] and rows[0]["score"] == max(len(t) for t in TEXTS if "fox" in t)

    def broken():
        raise RuntimeError("no model")

    plain = [r["drawer_uid"] for r in store.search("fox", limit=3).collect()]
    assert [r["drawer_uid"] for r in Searcher(store.drawers, store.index, scorer=broken).search("fox", mode="rerank", limit=3).collect()] == plain


def test_batch_is_the_same_as_one_by_one(store, spark):
    queries = spark.createDataFrame([(i, tokens_of(q)) for i, q in enumerate(("fox", "quick brown", "nothinghere", ""))], "qid int, terms array<string>")
    batch = {(r["qid"], r["uid"]): r["score"] for r in store.index.match_all(queries).collect()}
    single = {(i, r["uid"]): r["score"] for i, q in enumerate(("fox", "quick brown")) for r in store.index.match(literal(q)).collect()}
    assert batch == pytest.approx(single)


def test_stored_index(store, spark, tmp_path):
    index.write_index(store.drawers, str(tmp_path), 3)
    stored = index.read_index(spark, str(tmp_path))
    assert sorted(stored.match(parse("fox NOT lazy")).collect()) == sorted(store.index.match(parse("fox NOT lazy")).collect())
