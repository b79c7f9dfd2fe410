"""The best documents of a query of single terms, without scoring all that hold one.

What a term adds to a score depends on how often a document has it and how long the document is. An index keeps these
counts in cells of like ones; a cell's highest count and lowest length bound what it adds, whatever the corpus average is.
Cells are read from the weightiest down until no document outside of them can be among the best.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bm25 import BROADCAST, LEAST_IDF, Index, weight
from .match import Either, Phrase

#: Cells an octave of counts and of lengths; lengths take the lower numbers of a cell's name.
STEPS, LENGTHS = 4, 256
#: Rows of the first round, for each place in the result, and how much more each further round reads.
FIRST, MORE = 16, 8
#: Bounds are raised by this, so that rounding drops nothing.
SLACK = 1 + 1e-9


def cell(tf: Column, length: Column) -> Column:
    step = lambda c: F.floor(F.log2(F.greatest(c, F.lit(1))) * STEPS)
    return (step(tf) * LENGTHS + step(length)).cast("int")


def sums(counts: DataFrame) -> DataFrame:
    """(term, cell, n, tf, length) of counts (term, cell, uid, tf, length): a cell's rows, its highest count and lowest length."""
    return counts.groupBy("term", "cell").agg(F.count("*").alias("n"), F.max("tf").alias("tf"), F.min("length").alias("length"))


def single_terms(tree) -> Counter | None:
    """How often each term scores, if a tree asks for single whole terms, one or any of several; else None."""
    if isinstance(tree, Phrase):
        return Counter(tree.terms) if len(tree.terms) == 1 and not tree.prefix and not tree.initial else None
    if isinstance(tree, Either):
        own = [single_terms(x) for x in tree.parts]
        return sum(own, Counter()) if all(own) else None
    return None


@dataclass(frozen=True)
class Best:
    """What was found, and how many of the terms' cells and rows were read for candidates."""

    found: DataFrame
    cells_read: int
    cells: int
    rows_read: int
    rows: int


def best(index: Index, terms: Counter, k: int, pick: Callable[[DataFrame], DataFrame]) -> Best:
    """(uid, score) of the k best documents by the sum of their terms' scores.

    `pick` gives, from (uid, score) of candidates, the k best rows that it accepts, in their order, with uid and score; so
    filters and the order of ties are the caller's. Scores are of the whole corpus. A round reads some of the terms' cells, and
    ends the search if the last of k rows has more than all unread cells could give. Cells of a term are some hundreds,
    whatever the corpus, and k rows come to the driver.
    """
    spark = index.counts.sparkSession
    stats = index.stats.first()
    rows = index.cells.where(F.col("term").isin(*terms)).groupBy("term", "cell").agg(F.sum("n").alias("n"), F.max("tf").alias("tf"), F.min("length").alias("length")).collect()
    df = Counter()
    for r in rows:
        df[r["term"]] += r["n"]
    rarity = {t: math.log((stats["n"] - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    factor = {t: terms[t] * (x if x > 0 else LEAST_IDF) for t, x in rarity.items()}
    bounds = sorted(((factor[r["term"]] * weight(r["tf"], r["length"], stats["average"]) * SLACK, r["term"], r["cell"], r["n"]) for r in rows), reverse=True)
    total, taken, read, want = sum(df.values()), 0, 0, FIRST * k
    while True:
        while taken < len(bounds) and read < want:
            read += bounds[taken][3]
            taken += 1
        unread: dict[str, float] = {}
        for bound, term, _, _ in bounds[taken:]:
            unread.setdefault(term, bound)
        got = pick(_scores(index, factor, bounds[:taken], read, stats["average"])).select("uid", "score").collect()
        if taken == len(bounds) or len(got) >= k and got[-1]["score"] > sum(unread.values()):
            return Best(spark.createDataFrame(got, "uid string, score double"), taken, len(bounds), read, total)
        want = max(read, want) * MORE


def _scores(index: Index, factor: dict[str, float], cells: list[tuple], n: int, average: float) -> DataFrame:
    """(uid, score) of the documents in some cells; where there are several terms, also what they have of the others."""
    wanted = F.lit(False)
    for term in factor:
        own = [c for _, t, c, _ in cells if t == term]
        wanted = wanted | ((F.col("term") == term) & F.col("cell").isin(*own))
    rows = index.counts.where(wanted)
    if len(factor) > 1:
        near = rows.select("uid").distinct()
        rows = index.counts.where(F.col("term").isin(*factor)).join(F.broadcast(near) if n <= BROADCAST else near, "uid", "left_semi")
    each = F.lit(0.0)
    for term, f in factor.items():
        each = F.when(F.col("term") == term, F.lit(f)).otherwise(each)
    rows = rows.select("uid", (each * weight(F.col("tf"), F.col("length"), F.lit(average))).alias("score"))
    return rows.groupBy("uid").agg(F.sum("score").alias("score")) if len(factor) > 1 else rows
