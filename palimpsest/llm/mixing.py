"""Mixing sources to target weights: repetition rates by source, whole copies and one hash-seeded Bernoulli copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, shared, small

WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mix"


def n_words(text: Column) -> Column:
    """Words in a text, a long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> also weight, target, rate.

    Sources by code point, null last, take the weights in turn. A target is weight * level, at most `most` times the
    source's size; the level at which the targets share out the whole is the highest of those got by filling the
    sources in order of the level at which each is full. A source of size 0 has target 0 and rate 0. One row per
    source goes through the windows, none per document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(order)
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((n - 1) % len(weights) + 1).cast("int"))
    df = sizes.withColumn("weight", w.cast("long")).withColumn("cap", F.col("source_size") * F.lit(most))
    full = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = full.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_ = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    df = df.withColumn("level", rest.cast("double") / open_).withColumn("level", F.max("level").over(every))
    df = df.withColumn("target", F.least(F.col("weight") * F.col("level"), F.col("cap").cast("double")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return df.withColumn("rate", rate).select("source", "source_size", "weight", "target", "rate")


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the key (null as empty) and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))


def draw_key(doc_id: Column, text: Column) -> Column:
    """What a row's draw depends on: its id or, where that is null, a digest of its text."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("#"), F.md5(F.coalesce(text, F.lit("")))))


def copies(rate: Column, draw: Column) -> Column:
    """floor(rate), and one more with the fraction's probability."""
    return F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)


def _rates(narrow: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    rates = shared(source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    # names count as more rows by how long they are
    n = rates.agg(F.count("*") + F.coalesce(F.sum(F.octet_length("source")), F.lit(0)) / 64).first()[0]
    return small(rates, int(n))


def mix_report(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes of the document) for each row of docs.

    Rows with one doc_id share their draw, and rows of a null doc_id do if their texts are equal; null texts have size 0;
    null sources form one source; an empty table gives none. Columns other than doc_id, source and text are not read.
    """
    narrow = shared(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), uniform(draw_key(F.col("doc_id"), F.col("text")), seed).alias("draw")))
    df = narrow.alias("d").join(_rates(narrow, weights, most).alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")))
    taken = (F.col("size") * copies(F.col("rate"), F.col("draw"))).cast("long")
    return df.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "rate")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """docs with each row as often as the mix takes it: the same columns, extra ones and their values included."""
    rates = _rates(docs.select("source", n_words(F.col("text")).alias("size")), weights, most)
    rates = rates.select(F.col("source").alias("__mix_source"), F.col("rate").alias("__mix_rate"))
    df = docs.join(rates, docs["source"].eqNullSafe(F.col("__mix_source")))
    n = copies(F.col("__mix_rate"), uniform(draw_key(docs["doc_id"], docs["text"]), seed)).cast("int")
    times = F.transform(F.array(n), lambda n: F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")))[0]
    return df.withColumn("__mix_copy", F.explode(times)).select(*[docs[f"`{c}`"] for c in docs.columns])
