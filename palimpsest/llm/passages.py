"""Substring dedup of word sequences: a de Bruijn graph of repeated token k-mers, compacted by joins.

The words that a path's occurrence covers are compared as one span, at their source coordinates, by a 128-bit hash; windows
that reach beyond a path, and only those, are compared one by one in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEQ_BASE, U, encode, in_batches, mix64, pieces, shared, split_words, word_hashes
from .repeats import by_text, ids_repeat, joined_spans, occurrences, with_parts

WINDOW, K = 50, 26
OTHER_BASE = U(0xA0761D6478BD642F)


def word_items(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    w = split_words(texts)
    return word_hashes(w), w.first.astype(np.int64)


def _span_hashes(words: np.ndarray, begin: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    """A hash of each words[begin:end], whatever their lengths, from sums up to each place."""
    with np.errstate(over="ignore"):
        back = U(pow(int(base), -1, 1 << 64))
        up, down = (np.multiply.accumulate(np.concatenate([[U(1)], np.full(len(words), b)])) for b in (base, back))
        sums = np.concatenate([[U(0)], np.cumsum(words * down[:-1])])
        return mix64((sums[end] - sums[begin]) * up[begin])


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of some ranges, and which range each is of."""
    n = np.maximum(end - begin, 0)
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - (np.cumsum(n) - n)[of] + begin[of], of


def _spans(texts: DataFrame, window: int, k: int) -> DataFrame:
    """(d, mark, text, parts) -> (x, y, n, d, mark, at): 128 bits of hash of n words from `at`.

    One row stands for all that a path settles: its words, as they are in the text. Each window that reaches beyond a path has its own.
    """
    names = ["x", "y", "n", "d", "mark", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, mark, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            offset = lists.offsets.to_numpy().astype(np.int64)
            lo, hi, first, last = (lists.values.field(i).to_numpy().astype(np.int64) for i in range(4))
            texts = batch.column(2).to_pylist()
            for rows in pieces(list(range(len(texts))), [len(t or "") for t in texts], 250_000):
                words, base = word_items([texts[i] for i in rows])
                own = np.arange(offset[rows[0]], offset[rows[-1] + 1])
                row = np.repeat(np.arange(len(rows)), np.diff(offset)[rows])
                stop = last[own] + k - window + 1
                settled = stop > first[own]
                # of a path without a window inside, all windows count as beyond it
                upto = np.where(settled, np.minimum(first[own], hi[own] + 1), hi[own] + 1)
                left, of_left = _ranges(lo[own], upto)
                right, of_right = _ranges(np.where(settled, np.maximum(stop, lo[own]), hi[own] + 1), hi[own] + 1)
                whole = np.flatnonzero(settled)
                at = np.concatenate([first[own][whole], left, right])
                n = np.concatenate([(last[own] + k - first[own])[whole], np.full(len(left) + len(right), window)])
                of = row[np.concatenate([whole, of_left, of_right])]
                begin = base[of] + at
                x, y = (_span_hashes(w, begin, begin + n, b) for w, b in ((words, SEQ_BASE), (mix64(words), OTHER_BASE)))
                own_rows = np.array(rows)[of]
                columns = [x.view(np.int64), y.view(np.int64), n.astype(np.int32), d[own_rows], mark[own_rows], at.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return in_batches(texts.select("d", "mark", "text", "parts"), run, "x long, y long, n int, d long, mark long, at int")


def repeated_words(docs: DataFrame, window: int = WINDOW, k: int = K, repeat: bool = True) -> DataFrame:
    """(d, mark, parts): by text, the word spans (s, e) covered by windows that a document with a smaller doc_id has too."""
    paths = occurrences(docs, word_items, k, window, True, repeat)
    lists = shared(by_text(paths, "lo", "hi", "first", "last"), paths)
    spans = shared(_spans(with_parts(docs, lists, repeat), window, k), lists)
    lowest = spans.groupBy("x", "y", "n").agg(F.min("d").alias("low"), F.max("d").alias("high")).where("low < high").drop("high")
    # written first, so that a passage of very many texts can be split in the join
    lowest = shared(lowest)
    gone = spans.join(lowest, ["x", "y", "n"]).where("d > low").select("d", "mark", F.col("at").alias("s"), (F.col("at") + F.col("n")).alias("e"))
    return shared(joined_spans(gone), spans, lowest)


def strip_passages(docs: DataFrame, window: int = WINDOW, k: int = K, kept: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with kept, kept of each row of docs; kept is the words that stay, joined by blanks.

    A word goes if a window of `window` words that covers it also starts in a document with a smaller doc_id; windows are
    judged on the input. Words are runs of non-blank characters. Null, empty and shorter texts lose nothing; a null
    doc_id is the smallest; rows that share a doc_id are not earlier than each other. Extra columns are not read.
    """
    repeat = ids_repeat(docs)
    spans = repeated_words(docs, window, k, repeat)
    joined = with_parts(docs, spans, repeat, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, digest, rest = [], [], [], []
            for text, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = encode(text).split()
                n.append(len(words))
                if parts:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [p["s"] for p in parts], 1)
                    np.add.at(edge, [p["e"] for p in parts], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
                gone.append(n[-1] - len(words))
                own = b" ".join(words)
                digest.append(hashlib.sha256(own).hexdigest())
                if kept:
                    rest.append(own.decode("utf-8", "replace"))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(rest, pa.string())] * kept, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * kept)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(joined.select("doc_id", "text", "parts"), run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * kept)
