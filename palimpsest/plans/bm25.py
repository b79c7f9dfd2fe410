"""Phrase matching over positional postings, and BM25.

A phrase is found without self-joins: every posting of one of its terms votes for the start it would have there, and the
starts with as many votes as terms are occurrences; votes are added up before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import shared
from .match import Both, Either, Near, Phrase, Without

#: Okapi constants, and what stands for an idf of zero or less (fixed values).
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Queries, candidates or uids that are broadcast, at most.
BROADCAST = 500_000


def idf(n: Column, df: Column) -> Column:
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))


def weight(tf, length, average):
    """What a count adds, before its idf; of columns or of numbers."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


class Index:
    """Postings (uid, pos, term), document lengths (uid, length) and one row of statistics (n, average) of a corpus.

    A stored index also has counts (term, cell, uid, tf, length, positions) and the cells' sums, from which `best` reads the
    weightiest, and texts (uid, tokens).
    """

    def __init__(self, postings: DataFrame, lengths: DataFrame, stats: DataFrame, counts: DataFrame | None = None, cells: DataFrame | None = None, texts: DataFrame | None = None):
        self.postings, self.lengths, self.stats, self.counts, self.cells, self.texts = postings, lengths, stats, counts, cells, texts

    def occurrences(self, p: Phrase) -> DataFrame:
        """(uid, start) of a phrase."""
        plain = p.terms[:-1] if p.prefix else p.terms
        wanted = F.col("term").isin(*sorted(set(plain))) if plain else F.lit(False)
        votes = [F.when(F.col("term") == t, i) for i, t in enumerate(plain)]
        if p.prefix:
            wanted = wanted | F.col("term").startswith(p.terms[-1])
            votes.append(F.when(F.col("term").startswith(p.terms[-1]), len(plain)))
        rows = self.postings.where(wanted if p.terms else F.lit(False))
        if len(p.terms) > 1:
            rows = rows.select("uid", "pos", F.explode(F.array_compact(F.array(*votes))).alias("i"))
            rows = rows.groupBy("uid", (F.col("pos") - F.col("i")).alias("start")).count().where(F.col("count") == len(p.terms)).select("uid", "start")
        else:
            rows = rows.select("uid", F.col("pos").alias("start"))
        return rows.where("start = 0") if p.initial else rows

    def _counts(self, p: Phrase) -> DataFrame:
        """(uid, tf) of a phrase."""
        if self.counts is not None and len(p.terms) == 1 and not p.prefix and not p.initial:
            return self.counts.where(F.col("term") == p.terms[0]).groupBy("uid").agg(F.sum("tf").alias("tf"))
        return self.occurrences(p).groupBy("uid").agg(F.count("*").alias("tf"))

    def _scored(self, counts: DataFrame, every: DataFrame) -> DataFrame:
        """(uid, tf) -> (uid, score), with the document frequency that `every`, the phrase's own (uid, tf), has; one exchange serves both if they are the same."""
        df = every.agg(F.count("*").alias("df"))
        return counts.join(self.lengths, "uid").crossJoin(F.broadcast(df)).crossJoin(F.broadcast(self.stats)).select(
            "uid", (idf(F.col("n"), F.col("df")) * weight(F.col("tf"), F.col("length"), F.col("average"))).alias("score")
        )

    def _near(self, near: Near) -> DataFrame:
        """Scores of a NEAR group: an occurrence counts if, with one of every other phrase, it lies within a span.

        The span's last phrase starts at most `within` terms after its first one ends.
        """
        places = [self.occurrences(p).select("uid", "start", F.lit(i).alias("i"), F.lit(len(p.terms)).alias("long")) for i, p in enumerate(near.phrases)]
        every = reduce(DataFrame.union, places)
        # every span begins at an occurrence; what starts soon enough after its end is in it. Occurrences are swept in order:
        # a span is as wide as its first phrase allows, and what an earlier full span reaches is a hit
        order = Window.partitionBy("uid").orderBy("start")
        full = F.lit(False)
        for n in {len(p.terms) for p in near.phrases}:
            span = order.rangeBetween(0, n + near.within)
            held = [F.max(F.col("i") == i).over(span) for i in range(len(near.phrases))]
            full = F.when(F.col("long") == n, reduce(Column.__and__, held)).otherwise(full)
        spans = every.withColumn("reach", F.when(full, F.col("start") + F.col("long") + near.within))
        hits = spans.withColumn("reach", F.max("reach").over(order.rangeBetween(Window.unboundedPreceding, 0))).where("start <= reach")
        hits = hits.groupBy("uid", "i").agg(F.count("*").alias("tf"))
        parts = [self._scored(hits.where(F.col("i") == i).select("uid", "tf"), self._counts(p)) for i, p in enumerate(near.phrases)]
        return self._sum(parts)

    @staticmethod
    def _sum(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.union, parts).groupBy("uid").agg(F.sum("score").alias("score"))

    def match(self, tree) -> DataFrame:
        """(uid, score) of the documents that a tree matches."""
        if isinstance(tree, Phrase):
            return self._scored(*[self._counts(tree)] * 2)
        if isinstance(tree, Near):
            return self._near(tree)
        if isinstance(tree, Without):
            return self.match(tree.left).join(self.match(tree.right), "uid", "left_anti")
        found = [self.match(x) for x in tree.parts]
        if isinstance(tree, Either):
            return self._sum(found)
        assert isinstance(tree, Both)
        marked = [d.withColumn("i", F.lit(i)) for i, d in enumerate(found)]
        both = reduce(DataFrame.union, marked).groupBy("uid").agg(F.sum("score").alias("score"), F.count("*").alias("k"))
        return both.where(F.col("k") == len(found)).select("uid", "score")

    def match_all(self, queries: DataFrame) -> DataFrame:
        """(qid, terms) -> (qid, uid, score): every literal phrase query at once.

        A phrase can only start where its rarest term says; its other terms are looked up at those places alone, so that
        common terms meet no query by themselves.
        """
        hits = self._hits(queries) if self.texts is not None else self._voted(queries).join(self.lengths, "uid")
        df = hits.join(hits.groupBy("qid").agg(F.count("*").alias("df")), "qid").crossJoin(F.broadcast(self.stats))
        return df.select("qid", "uid", (idf(F.col("n"), F.col("df")) * weight(F.col("tf"), F.col("length"), F.col("average"))).alias("score"))

    def _hits(self, queries: DataFrame) -> DataFrame:
        """(qid, uid, length, tf) from a stored index.

        Where the two rarest terms stand as in the phrase, the text itself is compared. Queries and these places are tables of
        their own, broadcast up to a number; so neither the terms nor the texts are shuffled for a few.
        """
        few = lambda df: F.broadcast(df) if df.count() <= BROADCAST else df
        wanted = shared(queries.where(F.size("terms") > 0).select("qid", "terms", F.posexplode("terms").alias("i", "term")))
        often = self.cells.join(few(shared(wanted.select("term").distinct())), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
        order = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "i", "term")))
        plans = wanted.join(often, "term", "left").groupBy("qid").agg(order.alias("o"), F.any_value("terms").alias("terms"))
        plans = shared(plans.select("qid", "terms", F.col("o")[0].alias("a"), F.get("o", F.lit(1)).alias("b")))
        at = lambda i: F.filter(F.transform("positions", lambda p: p - i), lambda p: p >= 0)
        rare = few(plans.select("qid", F.col("a.term").alias("term"), F.col("a.i").alias("i"), "b"))
        places = self.counts.join(rare, "term").select("qid", "uid", "length", "b", at(F.col("i")).alias("starts")).where(F.size("starts") > 0)
        also = self.counts.join(few(shared(plans.where("b IS NOT NULL").select(F.col("b.term").alias("term")).distinct())), "term", "left_semi").select("uid", "term", "positions")
        pairs = places.where("b IS NOT NULL").withColumn("term", F.col("b.term")).join(also, ["uid", "term"])
        pairs = pairs.select("qid", "uid", "length", F.array_intersect("starts", at(F.col("b.i"))).alias("starts")).where(F.size("starts") > 0)
        places = shared(places.where("b IS NULL").select("qid", "uid", "length", "starts").union(pairs))
        texts = self.texts.join(few(places), "uid").join(few(plans.select("qid", "terms")), "qid")
        here = F.filter("starts", lambda s: F.slice("tokens", s + 1, F.size("terms")) == F.col("terms"))
        return shared(texts.select("qid", "uid", "length", F.size(here).cast("long").alias("tf")).where("tf > 0"), places)

    def _voted(self, queries: DataFrame) -> DataFrame:
        """(qid, uid, tf) from postings."""
        wanted = queries.where(F.size("terms") > 0).select("qid", "terms", F.posexplode("terms").alias("i", "term"))
        often = self.postings.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
        rarest = wanted.join(often, "term", "left").groupBy("qid").agg(F.min_by(F.struct("term", "i", "terms"), F.struct(F.coalesce("n", F.lit(0)), "i")).alias("r")).select("qid", "r.*")
        starts = self.postings.join(rarest, "term").select("qid", "uid", (F.col("pos") - F.col("i")).alias("start"), F.col("i").alias("known"), "terms").where("start >= 0")
        rest = starts.select("qid", "uid", "start", F.size("terms").alias("k"), "known", F.posexplode("terms").alias("i", "term"))
        alone = rest.where("i = known").select("qid", "uid", "start", "k")
        others = rest.where("i <> known").select("qid", "uid", "start", "k", "term", (F.col("start") + F.col("i")).alias("pos"))
        found = alone.union(others.join(self.postings, ["uid", "pos", "term"]).select("qid", "uid", "start", "k"))
        return found.groupBy("qid", "uid", "start", "k").count().where("count = k").groupBy("qid", "uid").agg(F.count("*").alias("tf"))


def top_per_query(scored: DataFrame, k: int, tie: str = "uid") -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
