"""What both kinds of substring dedup share: repeated k-mers of a corpus and their nonbranching paths.

Every window of `window` items (bytes or words) has a minimizer, the lowest-hashed of its k-mers, and equal windows have
the same one at the same place; so only windows whose minimizer is repeated can be repeated. Minimizers lie at most k
items apart, so a chain of them with their distances fixes every item between. k-mers are the nodes' overlap and
neighbouring minimizers the edges of a sparse de Bruijn graph; where an edge occurs as often as both of its ends, every
occurrence of one end goes on to the other, and the edge belongs to a nonbranching path. Paths compact to one row for
each occurrence, by joins on the counts of minimizers and edges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U, encode, in_batches, mix64, pieces, shared, sliding_hash, sliding_min, starts_within

#: Turns the texts of a batch into items, 64-bit hashes, and where each text's begin.
Items = Callable[[list[str | None]], tuple[np.ndarray, np.ndarray]]
#: Bits of a place among the k-mers that minimizers are sought in at once; the rest of 64 is for the hash. Longer texts take several turns.
PLACE_BITS = 24
#: Characters of texts that minimizers are sought in at once, if they are not one text's.
PIECE = 100_000
#: Stands for a null doc_id: before all others.
NULL_ID = -(1 << 63)


def byte_items(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    data = [encode(t) for t in texts]
    code = mix64(np.arange(1, 257, dtype=U))
    return code[np.frombuffer(b"".join(data), np.uint8)], np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


def text_mark(text: str | None) -> int:
    """Tells texts of one doc_id apart: 64 bits of a digest."""
    return int.from_bytes(hashlib.blake2b(encode(text), digest_size=8).digest(), "big", signed=True)


def ids_repeat(docs: DataFrame) -> bool:
    """Whether a doc_id, null included, has several rows; only then are texts told apart by a mark."""
    return bool(docs.groupBy("doc_id").count().where("count > 1").limit(1).count())


def own_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("d")


def _lowest(kmers: np.ndarray, w: int) -> np.ndarray:
    """Where the lowest of kmers[i:i+w] is, by the bits of a hash above PLACE_BITS and then by place, for each i."""
    bits, step = U(PLACE_BITS), (1 << PLACE_BITS) - w + 1
    out = np.zeros(max(0, len(kmers) - w + 1), np.int64)
    for a in range(0, len(out), step):
        own = kmers[a : a + step + w - 1]
        low = sliding_min((own >> bits << bits) | np.arange(len(own), dtype=U), w)
        out[a : a + len(low)] = (low & U((1 << PLACE_BITS) - 1)).astype(np.int64) + a
    return out


def minimizers(items: np.ndarray, first: np.ndarray, k: int, window: int) -> tuple[np.ndarray, ...]:
    """(text, place, hash, lo, hi) of each run of a text's windows, starts lo to hi, that have one minimizer; items from the text's first."""
    kmers = sliding_hash(items, k)
    starts, n = starts_within(first, window)
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    kmers = mix64(kmers)
    place = _lowest(kmers, window - k + 1)[starts]
    text = np.repeat(np.arange(len(n)), n)
    begin = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    end = np.append(begin[1:], len(starts)) - 1
    text, place, base = text[begin], place[begin], first[text[begin]]
    return text, place - base, kmers[place], starts[begin] - base, starts[end] - base


def _anchors(docs: DataFrame, items: Items, k: int, window: int, repeat: bool) -> DataFrame:
    """(a, d, mark, p): the minimizers of every text. p packs the place, and how far before it the windows start and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, done = batch.column(1).to_pylist(), 0
            # small pieces stay in a processor's cache; their rows are given together
            for some in pieces(texts, [len(t or "") for t in texts], 4_000_000):
                found: list[list[np.ndarray]] = [[], [], [], []]
                for part in pieces(some, [len(t or "") for t in some], PIECE):
                    text, place, value, lo, hi = minimizers(*items(part), k, window)
                    ids = batch.column(0).slice(done, len(part)).to_numpy()
                    marks = np.array([text_mark(t) if repeat else 0 for t in part], np.int64)
                    done += len(part)
                    packed = (place << 16) | ((place - lo) << 8) | (hi - lo)
                    for column, x in zip(found, (value.view(np.int64), ids[text], marks[text], packed), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in found], ["a", "d", "mark", "p"])

    return in_batches(docs.select(own_id(), "text"), run, "a long, d long, mark long, p long")


def _repeated(docs: DataFrame, items: Items, k: int, window: int, spread: bool, repeat: bool) -> DataFrame:
    anchors = _anchors(docs, items, k, window, repeat)
    counts = anchors.groupBy("a").agg(F.count("*").alias("n"), *([F.min("d").alias("low"), F.max("d").alias("high")] if spread else []))
    # written first, so that both sides of the join are plain exchanges: a k-mer of very many texts can then be split
    counts = shared(counts.where("low < high" if spread else "n > 1").drop("high"))
    return shared(anchors.join(counts, "a"), counts)


def occurrences(docs: DataFrame, items: Items, k: int, window: int, spread: bool, repeat: bool) -> DataFrame:
    """Occurrences of paths of repeated minimizers, (d, mark, path, lo, hi, first, last) and, with spread, low.

    lo to hi are the starts of the windows whose minimizer is in the path, first and last the places of its first and
    last k-mer, low the smallest d with the path. With spread, a minimizer is repeated if two documents have it, else if
    it occurs twice. Rows with one doc_id are taken to have one text, unless `repeat` says that ids repeat.
    """
    if window - k > 254:
        raise ValueError("a window may hold 255 k-mers at most")
    repeated = _repeated(docs, items, k, window, spread, repeat)
    place = F.shiftright("p", 16)
    lo = place - F.shiftright("p", 8).bitwiseAND(255)
    found = repeated.withColumns({"place": place, "lo": lo, "hi": lo + F.col("p").bitwiseAND(255)}).drop("p")
    doc = Window.partitionBy("d", "mark").orderBy("place")
    before = lambda c: F.lag(c).over(doc)
    near = before("hi") + 1 == F.col("lo")
    # an edge that occurs as often as both of its ends can only join two minimizers that occur equally often
    edge = F.when(near & (before("n") == F.col("n")), F.xxhash64(before("a"), "a", F.col("place") - before("place")))
    edges = shared(found.withColumn("edge", edge), repeated)
    often = shared(edges.where("edge is not null").groupBy("edge").agg(F.count("*").alias("n_edge")))
    joined = edges.where("edge is not null").join(often, "edge").withColumn("new", F.when(F.col("n_edge") == F.col("n"), 0).otherwise(1)).drop("n_edge")
    runs = joined.unionByName(edges.where("edge is null").withColumn("new", F.lit(1))).drop("edge", "n")
    runs = runs.withColumn("run", F.sum("new").over(doc)).groupBy("d", "mark", "run")
    low = [F.min("low").alias("low")] if spread else []
    runs = runs.agg(F.min_by("a", "place").alias("path"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("place").alias("first"), F.max("place").alias("last"), *low)
    return shared(runs.drop("run"), edges, often)


def by_text(rows: DataFrame, *columns: str) -> DataFrame:
    """(d, mark, parts): the named columns of all of a text's rows in one array, as long as the text at most."""
    return rows.groupBy("d", "mark").agg(F.collect_list(F.struct(*columns)).alias("parts"))


def joined_spans(rows: DataFrame) -> DataFrame:
    """(d, mark, s, e) -> (d, mark, parts): by text, the spans with those that touch or overlap made one."""
    doc = Window.partitionBy("d", "mark").orderBy("s")
    apart = F.col("s") > F.max("e").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("island", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    return by_text(rows.groupBy("d", "mark", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")), "s", "e")


def with_parts(docs: DataFrame, lists: DataFrame, repeat: bool, how: str = "inner") -> DataFrame:
    """Texts with their parts. Both are dealt by text; a task hashes its lists, which are no longer than its texts, and sorts neither."""
    return marked(docs, repeat).join(lists.hint("shuffle_hash"), ["d", "mark"], how)


def marked(docs: DataFrame, repeat: bool) -> DataFrame:
    """docs as (doc_id, d, text, mark)."""
    if not repeat:
        return docs.select("doc_id", own_id(), "text", F.lit(0).cast("long").alias("mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([text_mark(t) for t in batch.column(2).to_pylist()], pa.int64())], ["doc_id", "d", "text", "mark"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs.select("doc_id", own_id(), "text"), run, f"doc_id {kind}, d long, text string, mark long")
