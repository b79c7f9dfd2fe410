"""Terms are counted before the shuffle, and drawers that share a uid count once for df."""

from collections import Counter

from pyspark.sql import functions as F

from palimpsest.operators import index


def rows(df):
    return {r["term"]: (r["df"], r["tf"]) for r in df.collect()}


def test_uids_that_repeat(spark):
    texts = [("a", "one two two"), ("a", "one two three"), ("a", "one"), ("b", "two"), ("c", None), ("d", ""), ("e", "three")]
    want = {}
    for term in ("one", "two", "three"):
        held = [(u, Counter(t.split())[term]) for u, t in texts if t and term in t.split()]
        want[term] = (len({u for u, _ in held}), sum(n for _, n in held))
    df = spark.createDataFrame(texts, "drawer_uid string, content string")
    assert rows(index.vocabulary(df)) == want
    assert rows(index.vocabulary(df.dropDuplicates(["drawer_uid"]).where("content <> ''"))).keys() <= want.keys()


def test_shuffles_no_row_for_each_drawer(spark):
    """Rows that go to the shuffle are terms of a task, not of a drawer."""
    texts = spark.range(0, 2_000, 1, 2).select(F.col("id").cast("string").alias("drawer_uid"), F.lit("some five words of each").alias("content"))
    counted = index.vocabulary(texts)
    assert {k: v for k, v in rows(counted).items()} == {t: (2_000, 2_000) for t in "some five words of each".split()}
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "uid" not in plan.split("Aggregate")[1].split("\n")[0]
