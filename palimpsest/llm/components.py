"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared


def _lowest(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, low): the lowest of u and its partners, summed up before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("low"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root) for every node of an edge other than the roots; root is the lowest node of the component.

    Each round ends in a checkpoint; rounds go on until the edges form stars, however many that takes.
    """
    step = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    last, written = None, []
    while True:
        both = step.select(F.col("a").alias("u"), F.col("b").alias("v")).union(step.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.join(_lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        joined = large.join(_lowest(large), "u")
        star = joined.select(F.col("u").alias("a"), F.col("low").alias("b")).union(joined.select(F.col("v").alias("a"), F.col("low").alias("b")))
        step = shared(star.where("a <> b").distinct(), *written)
        written = [step]
        mark = step.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            return step.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = mark
