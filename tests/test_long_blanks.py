"""White space is taken away in one pass over a text, however long its runs are."""

import random
import time

from pyspark.sql import functions as F

from palimpsest.functions import text


def test_same_as_the_class(spark):
    rng = random.Random(2)
    letters = list(text.BLANKS) * 2 + list("ab/​᠎‰\U0001f600") + [" "] * 20
    rows = [("".join(rng.choices(letters, k=rng.randint(0, 12))),) for _ in range(3_000)] + [(c,) for c in text.BLANKS] + [(None,), ("",)]
    c = F.col("t")
    plain = F.regexp_replace(c, f"^{text.WS}+|{text.WS}+$", "")
    flat = F.trim(F.regexp_replace(c, f"{text.WS}+", " "))
    df = spark.createDataFrame(rows, "t string").where(~(text.strip(c).eqNullSafe(plain) & text.normalize_ws(c).eqNullSafe(flat)))
    assert df.collect() == []


def test_long_runs_inside(spark):
    df = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit(" \t"), 200_000), F.lit("b")).alias("t"))
    begun = time.perf_counter()
    assert tuple(df.select(F.length(text.strip("t")), text.normalize_ws("t"), text.keeps(F.col("t"))).first()) == (400_002, "a b", True)
    assert time.perf_counter() - begun < 15
