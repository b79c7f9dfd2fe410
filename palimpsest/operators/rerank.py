"""A second ranking of the best candidates by a pair scorer."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates at most, and how many a place in the result is worth (fixed values).
CAP, FACTOR = 200, 3
DEFAULT_MODEL = "cross-encoder/ms-marco-MiniLM-L-6-v2"


def over_fetch(limit: int) -> int:
    return min(CAP, max(1, limit or 10) * FACTOR)


def model_name(explicit: str | None = None) -> str:
    return explicit or os.environ.get("PALIMPSEST_RERANK_MODEL") or DEFAULT_MODEL


def default_scorer(explicit: str | None = None) -> Callable[[], Callable[[list[tuple[str, str]]], list[float]]] | None:
    """What makes the scorer of the named model, or None where the package that runs such models is not installed."""
    if importlib.util.find_spec("sentence_transformers") is None:
        return None
    name = model_name(explicit)

    def make() -> Callable[[list[tuple[str, str]]], list[float]]:
        from sentence_transformers import CrossEncoder

        model = CrossEncoder(name)
        return lambda pairs: [float(x) for x in model.predict(pairs)]

    return make


def rerank(candidates: DataFrame, query: str, make_scorer: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], top_k: int) -> DataFrame:
    """The top_k of at most CAP candidates by the scorer's (query, content) scores; equal ones keep their order.

    make_scorer runs once in each Python worker, so a model is loaded once there. If it fails on the driver the
    candidates keep their ranking.
    """
    if top_k <= 0:
        return candidates.limit(0)
    candidates = candidates.where(F.col("rank") <= CAP)
    try:
        make_scorer()
    except Exception:  # noqa: BLE001  any scorer may fail; the first ranking stands
        return candidates.where(F.col("rank") <= top_k)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = make_scorer()
        for contents in batches:
            yield pd.Series(scorer([(query, c) for c in contents]), dtype="float64")

    order = Window.orderBy(F.desc("score"), F.asc("before"))
    best = candidates.withColumnRenamed("rank", "before").withColumn("score", score("content"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).drop("before")
