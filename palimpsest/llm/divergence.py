"""Source divergence audit: how far apart the sources of a language are in the words they use, in whole numbers.

Texts are cut into terms on the bytes of a batch, by a lookup table. Equal terms are grouped by xxhash, every slice is compared
with the first of its group byte by byte, and what clashes is hashed again. Counts by term, source and language are summed
up by Spark. The counts of a block of terms then form a sparse matrix, a row a source, and sums over its cells give the
block's part of every divergence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import encode, in_batches, pieces, shared, small

LEAST, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of text that are cut at once, bytes of slices that are compared at once, and cells of a block's matrix, about.
PIECE, COMPARED, CELLS = 4_000_000, 4_000_000, 250_000
#: Sources that a block compares with all others.
STRIP = 256

_TERM = np.zeros(256, bool)
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def slices(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of all texts, where terms start and end, and the text that each is of."""
    data = [encode(t) for t in texts]
    x = _LOWER[np.frombuffer(b"\0" + b"\0".join(data) + b"\0", np.uint8)]
    own = _TERM[x]
    edge = np.flatnonzero(own[1:] != own[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    at = 1 + np.cumsum([len(d) + 1 for d in data])
    return x, starts, ends, np.searchsorted(at, starts, "right")


def _differ(x: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the slices of one size that start at a and at b differ, COMPARED bytes at a time."""
    out = np.zeros(len(a), bool)
    for own in pieces(np.arange(len(a)), size.tolist(), COMPARED):
        n = size[own]
        first = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(first, n)
        out[own] = ~np.logical_and.reduceat(x[np.repeat(a[own], n) + inside] == x[np.repeat(b[own], n) + inside], first)
    return out


def group(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, hash_=xxh64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """Number equal slices alike: the number of each, and the slice that stands for each number. Exact, whatever clashes."""
    size, data = ends - starts, x.tobytes()
    number, first = np.full(len(starts), -1, np.int64), []
    rest, seed = np.arange(len(starts)), 0
    while len(rest):
        hashes = np.fromiter((hash_(data[a:b], seed) for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)), np.uint64, len(rest))
        _, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        stands = rest[where][which]
        bad = size[stands] != size[rest]
        same = np.flatnonzero(~bad)
        bad[same] = _differ(x, starts[stands[same]], starts[rest[same]], size[rest[same]])
        number[rest] = which + sum(map(len, first))
        first.append(rest[where])
        rest, seed = rest[bad], seed + 1
    return number, np.concatenate(first) if first else np.zeros(0, np.int64)


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) for each batch of rows of docs: how often a term stands there, in how many of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source, text = (batch.column(k).to_pylist() for k in range(3))
            order = sorted(range(len(text)), key=lambda i: (lang[i], source[i]))
            for own in pieces(order, [len(text[i]) for i in order], PIECE):
                names = sorted({(lang[i], source[i]) for i in own})
                code = {x: k for k, x in enumerate(names)}
                kind = np.array([code[lang[i], source[i]] for i in own], np.int64)
                x, starts, ends, doc = slices([text[i] for i in own])
                if not len(starts):
                    continue
                number, first = group(x, starts, ends)
                by = np.argsort(number, kind="stable")  # rows of a group lie together, and so do the terms of a row
                number, doc = number[by], doc[by]
                new_doc = np.append(True, (number[1:] != number[:-1]) | (doc[1:] != doc[:-1]))
                new = np.append(True, (number[1:] != number[:-1]) | (kind[doc[1:]] != kind[doc[:-1]]))
                at = np.flatnonzero(new)
                n, n_docs = np.diff(np.append(at, len(number))), np.add.reduceat(new_doc.astype(np.int64), at)
                data = x.tobytes()
                words = pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], pa.string())
                of = pa.array(kind[doc[at]])
                columns = [pa.array([k[0] for k in names], pa.string()).take(of), pa.array([k[1] for k in names], pa.string()).take(of), words.take(pa.array(number[at])), pa.array(n), pa.array(n_docs)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return in_batches(rows, run, "lang string, source string, term string, n long, docs long")


def _share(name: str, n: str, total: str) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)), exactly: a product of 2**63 and SCALE fits 38 digits."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + {SMOOTH} AS DECIMAL(19,0))) div CAST({total} + {SMOOTH} * terms AS DECIMAL(19,0))").alias(name)


def distances(source: np.ndarray, term: np.ndarray, p: np.ndarray, zero: np.ndarray, rows: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b) of sources, a in rows and b above it, and the sum of |p - q| over the terms.

    The cells make a sparse matrix: source and term are places, source ascends, and what has no cell has its source's `zero`.
    A row's values are first summed up against each other source's zero, by their sorted values; then that is mended
    where the other has cells, by one reduceat over the matrix's rows.
    """
    n, terms = len(zero), int(term.max()) + 1 if len(term) else 0
    at = np.searchsorted(source, np.arange(n + 1))
    out_a, out_b, out = [], [], []
    for a in rows:
        own = np.full(terms, zero[a])
        own[term[at[a] : at[a + 1]]] = p[at[a] : at[a + 1]]
        order = np.sort(own)
        sums = np.concatenate([[0], np.cumsum(order)])
        z = zero[a + 1 :]
        below = np.searchsorted(order, z)
        total = z * below - sums[below] + (sums[-1] - sums[below]) - z * (terms - below)
        cells = slice(at[a + 1], at[n])
        other = own[term[cells]]
        more = np.abs(other - p[cells]) - np.abs(other - zero[source[cells]])
        held = np.flatnonzero(at[a + 1 : n] < at[a + 2 :])
        if len(held):
            total[held] += np.add.reduceat(more, at[a + 1 + held] - at[a + 1])
        out_a.append(np.full(len(z), a))
        out_b.append(np.arange(a + 1, n))
        out.append(total)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b, out))


def _block(key: tuple, cells: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """One block of a language's terms, and one strip of its sources against all that come after."""
    names = np.array(sorted(groups["source"], key=lambda s: s.encode()), object)
    place = {s: i for i, s in enumerate(names)}
    zero = np.zeros(len(names), np.int64)
    zero[[place[s] for s in groups["source"]]] = groups["zero"]
    source = cells["source"].map(place).to_numpy(np.int64)
    order = np.argsort(source, kind="stable")
    term = pd.factorize(cells["term"])[0].astype(np.int64)
    strip = range(key[2] * STRIP, min((key[2] + 1) * STRIP, len(names)))
    a, b, value = distances(source[order], term[order], cells["p"].to_numpy(np.int64)[order], zero, strip)
    return pd.DataFrame({"lang": key[0], "source": names[a], "item": names[b], "value": value})


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` rows for each other source of the language, `term` rows for the `top` terms that a source overuses.

    Null text, lang and source are ''. Each row of docs is a document, also if it repeats. Groups without a term have equal
    shares, a language without kept terms has divergence 0, an empty table gives no rows; other columns are not read.

    Counts are summed up before each shuffle, by term, so no source or word meets in one task. Divergences are summed up in blocks of
    a language's terms by strips of STRIP sources.
    """
    triples = shared(counted(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = shared(triples.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= least).drop("docs"))
    n_kept = kept.count()
    cells = shared(triples.join(small(kept, n_kept), ["lang", "term"]).select("lang", "source", "term", "n", "all"), triples)
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("lang_total"))
    names = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("cells"))
    per_lang = F.count("*").over(Window.partitionBy("lang"))
    groups = names.join(totals, ["lang", "source"], "left").fillna(0, ["total", "cells"]).join(langs, "lang", "left").withColumn("sources", per_lang)
    held = F.sum("cells").over(Window.partitionBy("lang"))
    blocks = F.ceil(held / F.greatest(F.lit(CELLS), F.lit(STRIP) * F.col("sources"))).cast("int")
    groups = shared(groups.withColumn("blocks", blocks).withColumn("strips", F.ceil(F.col("sources") / STRIP).cast("int")))
    known, nothing = groups.where("terms is not null"), groups.where("terms is null").select("lang", "source")
    known = small(known.withColumn("zero", _share("zero", "0", "total")), groups.count())

    own = cells.join(known, ["lang", "source"]).select("lang", "source", "term", "n", "total", "terms", "blocks", "strips", "lang_total", "all")
    own = own.select("*", _share("p", "n", "total"))
    strip = F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("strip")
    left = own.select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), strip)
    block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    right = known.select("lang", "source", "zero", "strips", block).select("lang", "source", "zero", "block", strip)
    key = ("lang", "block", "strip")
    parts = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_block, "lang string, source string, item string, value long")
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("e")
    pair = shared(sums).select("lang", both, "value").select("lang", "e.source", "e.item", "value")
    apart = nothing.join(nothing.withColumnRenamed("source", "item"), "lang").where(F.col("source") != F.col("item"))
    pair = pair.unionByName(apart.withColumn("value", F.lit(0).cast("long"))).withColumn("part", F.lit("pair"))

    term = own.select("lang", "source", F.col("term").alias("item"), (F.col("p") - _share("q", "all", "lang_total")).alias("value")).where("value > 0").withColumn("part", F.lit("term"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term = term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pair.withColumn("rank", F.row_number().over(order)).unionByName(term).select("lang", "source", "part", "item", "value", "rank")
