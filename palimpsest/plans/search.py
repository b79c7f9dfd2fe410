"""Search over a store: filters, hidden records, top-k, snippets and an optional rerank."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bold, query_terms, snippet
from ..operators.rerank import over_fetch, rerank
from .best import Best, best, single_terms
from .bm25 import Index
from .match import literal, parse

#: Limits (fixed values).
DEFAULT_LIMIT, MAX_LIMIT = 50, 1000
MODES = ("bm25", "rerank")


def clamp(limit: object) -> int:
    """A limit between 1 and the most; the default for what is no number."""
    try:
        return max(1, min(MAX_LIMIT, int(limit)))
    except (TypeError, ValueError):
        return DEFAULT_LIMIT


def ranked() -> list[Column]:
    """The best first; equal scores by rowid."""
    return [F.desc("score"), F.asc("rowid"), F.asc("drawer_uid")]


def source_list(source: str | Iterable[str] | None) -> list[str]:
    return [s for s in ([source] if isinstance(source, str) else source or []) if s]


def filtered(drawers: DataFrame, *, source=None, since: int | None = None, until: int | None = None, register: str | None = None, role: str | None = None, **_ignored) -> DataFrame:
    """The drawers that pass the metadata filters; both ends of the time range are inside. Unknown filters are ignored."""
    sources = source_list(source)
    for wanted, condition in (
        (sources, F.col("source").isin(sources)),
        (since is not None, F.col("created_at") >= (since or 0)),
        (until is not None, F.col("created_at") <= (until or 0)),
        (register, F.col("register") == (register or "")),
        (role, F.col("role") == (role or "")),
    ):
        if wanted:
            drawers = drawers.where(condition)
    return drawers


def visible(drawers: DataFrame, hidden: DataFrame | None) -> DataFrame:
    return drawers if hidden is None else drawers.join(hidden.where("unhidden_at IS NULL").select("drawer_uid"), "drawer_uid", "left_anti")


class Retriever(Protocol):
    """Whatever finds drawers for a query: the best first, with drawer_uid, score and rank."""

    def search(self, query: str, *, limit: object = DEFAULT_LIMIT, **filters) -> DataFrame: ...


class Searcher:
    """drawers, their index, and what is hidden. Scores are of the whole corpus, filtered and hidden rows included."""

    def __init__(self, drawers: DataFrame, index: Index, hidden: DataFrame | None = None, scorer=None, color: bool = False):
        self.drawers, self.index, self.hidden, self.scorer, self.color = drawers, index, hidden, scorer, color

    def matches(self, query: str, raw: bool = False, **filters) -> DataFrame:
        """Every matching drawer with its score; a blank query matches none."""
        return self._scored(self.index.match(self._tree(query, raw)), **filters)

    @staticmethod
    def _tree(query: str, raw: bool):
        return parse(query) if raw and query.strip() else literal(query)

    def _scored(self, found: DataFrame, **filters) -> DataFrame:
        return visible(filtered(self.drawers, **filters), self.hidden).join(found.withColumnRenamed("uid", "drawer_uid"), "drawer_uid")

    def best(self, query: str, k: int, raw: bool = False, **filters) -> Best | None:
        """What the index's cells say of the k best, where the query is of single terms and the index has cells; else None."""
        terms = single_terms(self._tree(query, raw)) if self.index.cells is not None else None
        return best(self.index, terms, k, lambda found: self._scored(found, **filters).orderBy(*ranked()).limit(k).withColumnRenamed("drawer_uid", "uid")) if terms else None

    def search(self, query: str, *, limit: object = DEFAULT_LIMIT, mode: str = "bm25", raw: bool = False, full: bool = False, **filters) -> DataFrame:
        """Best first with a rank from 1: all of a drawer's columns, score, rank, snippet. A query of single terms is looked up at once, others as the result is used."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
        k = clamp(limit)
        again = mode == "rerank" and self.scorer is not None
        n = over_fetch(k) if again else k
        known = self.best(query, n, raw, **filters)
        found = self.matches(query, raw, **filters) if known is None else self._scored(F.broadcast(known.found), **filters)
        top = found.orderBy(*ranked()).limit(n)
        top = top.withColumn("rank", F.row_number().over(Window.orderBy(*ranked())))
        if again:
            top = rerank(top, query, self.scorer, k)
        terms = query_terms(query)
        text = bold(F.col("content"), terms, self.color) if full else snippet(F.col("content"), terms, self.color)
        return top.withColumn("snippet", text).orderBy("rank")

    def hits(self, query: str, **options) -> DataFrame:
        return self.search(query, **options).select("drawer_uid", "score", "snippet", "source", "created_at", "rank")

    def fetch(self, uid: str) -> DataFrame:
        """The drawer of a uid, hidden or not."""
        return self.drawers.where(F.col("drawer_uid") == uid).limit(1)
