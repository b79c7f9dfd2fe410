"""Elements of large JSON arrays, found by several tasks a file.

A file is cut at closing braces, wherever they stand, and read in blocks. Whether a block begins inside a string, and how
deep, follows from the blocks before it: a first pass counts each block's quotes, and its brackets for either case. The second pass
knows where it is, and cuts at the commas and brackets of the outermost array. Only what reaches over a block's end is joined up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import shared

#: Where files are cut: a byte that can't stand after the backslash of an escape.
SEPARATOR = "}"

_QUOTE, _COMMA, _OPEN, _CLOSE, _ESCAPE = (ord(c) for c in '",[]\\')
_MARK = np.zeros(256, bool)
_MARK[[_QUOTE, _COMMA, *map(ord, "[]{}")]] = True
_STEP = np.zeros(256, np.int64)
_STEP[[ord("["), ord("{")]], _STEP[[ord("]"), ord("}")]] = 1, -1

_KEY = ("path", "block")


def _marks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of quotes, commas and brackets, without escaped quotes, and how many quotes are before each."""
    at = np.flatnonzero(_MARK[x])
    quoted = x[at] == _QUOTE
    after = at[quoted & (x[np.maximum(at - 1, 0)] == _ESCAPE) & (at > 0)]
    if len(after):
        plain = np.flatnonzero(x != _ESCAPE)
        before = np.searchsorted(plain, after) - 1  # the last byte that is no backslash
        run = after - 1 - np.where(before >= 0, plain[np.maximum(before, 0)], -1)
        keep = ~np.isin(at, after[run % 2 == 1])
        at, quoted = at[keep], quoted[keep]
    return at, np.cumsum(quoted) - quoted


def _chunks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """Runs of rows of one block: its key, and its bytes with the separators that reading took away."""
    for batch in batches:
        rows = list(zip(*(batch.column(k).to_pylist() for k in range(keys)), strict=True))
        values, begin = batch.column(keys).to_pylist(), 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] != rows[begin]:
                yield rows[begin], np.frombuffer(b"".join(v + SEPARATOR.encode() for v in values[begin:i]), np.uint8)
                begin = i


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block: bytes, quotes, and the change of depth if it begins outside a string, or inside."""
    found: dict[tuple, list[int]] = {}
    for key, x in _chunks(batches, 4):
        own = found.setdefault(key, [0, 0, 0, 0])
        at, quotes = _marks(x)
        step, inside = _STEP[x[at]], (quotes + own[1]) % 2 == 1
        own[0] += len(x)
        own[1] += int((x[at] == _QUOTE).sum())
        own[2] += int(step[~inside].sum())
        own[3] += int(step[inside].sum())
    columns = [list(c) for c in zip(*((*k, *v) for k, v in found.items()), strict=True)] or [[] for _ in range(8)]
    kinds = [pa.string(), *[pa.int64()] * 7]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "mtime", "size", "block", "bytes", "quotes", "outside", "inside"])


class _Cutter:
    """Cuts one block's bytes, as they come."""

    def __init__(self, quotes: int, depth: int):
        self.quotes, self.depth, self.cuts, self.open, self.opens, self.closes = quotes, depth, 0, [], 0, 0

    def feed(self, x: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(number, text) of each piece that ends here; a piece's number is how many cuts of the block are before it."""
        at, quotes = _marks(x)
        outside = (quotes + self.quotes) % 2 == 0
        self.quotes += int((x[at] == _QUOTE).sum())
        at = at[outside]
        step = _STEP[x[at]]
        depth = self.depth + np.cumsum(step)
        self.depth += int(step.sum())
        opens, closes = (x[at] == _OPEN) & (depth == 1), (x[at] == _CLOSE) & (depth == 0)
        self.opens, self.closes = self.opens + int(opens.sum()), self.closes + int(closes.sum())
        begin = 0
        for cut in at[opens | closes | ((x[at] == _COMMA) & (depth == 1))].tolist():
            yield self.cuts, b"".join([*self.open, x[begin:cut].tobytes()])
            self.open, self.cuts, begin = [], self.cuts + 1, cut + 1
        self.open.append(x[begin:].tobytes())


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, mtime, block, number, text, last, opens, closes): pieces of blocks (path, mtime, block, quotes, depth, value); the last one of a block is marked, and has its counts."""
    names = ["path", "mtime", "block", "number", "text", "last", "opens", "closes"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64()]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    key = cutter = None

    def end() -> list[tuple]:
        return [(*key[:3], cutter.cuts, b"".join(cutter.open), True, cutter.opens, cutter.closes)] if key else []

    for new, x in _chunks(batches, 5):
        rows = []
        if new != key:
            rows += end()
            key, cutter = new, _Cutter(new[3], new[4])
        rows += [(*key[:3], number, text, False, 0, 0) for number, text in cutter.feed(x)]
        if rows:
            yield pack(rows)
    if key:
        yield pack(end())


def array_elements(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements (path, mtime, at, text) of files as `read_pieces` cuts them at SEPARATOR, and files (path, reason) that are no array.

    An element's text isn't looked into; who parses it finds what is wrong there. Encoding is UTF-8; a byte-order mark is
    left out.
    """
    sums = shared(pieces.select("path", "mtime", "size", "block", "value").mapInArrow(_sums, "path string, mtime long, size long, block long, bytes long, quotes long, outside long, inside long"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    states = sums.withColumn("begins", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    delta = F.when(F.col("begins") == 0, F.col("outside")).otherwise(F.col("inside"))
    states = shared(states.withColumn("delta", delta).withColumn("depth", F.coalesce(F.sum("delta").over(before), F.lit(0))))
    ends = states.groupBy("path").agg(F.sum("quotes").alias("quotes"), F.sum("delta").alias("delta"), F.sum("bytes").alias("bytes"), F.max("size").alias("size"))

    known = F.broadcast(states.select("path", "block", "begins", "depth"))  # 100 bytes for each block of a file, megabytes
    rows = pieces.join(known, list(_KEY)).select("path", "mtime", "block", "begins", "depth", "value")
    cut = shared(rows.mapInArrow(_cut, "path string, mtime long, block long, number long, text binary, last boolean, opens long, closes long"))
    blocks = cut.where("last").select("path", "block", F.col("number").alias("cuts"), "opens", "closes")
    blocks = shared(blocks.withColumn("before", F.coalesce(F.sum("cuts").over(before), F.lit(0))))
    files = blocks.groupBy("path").agg(F.sum("cuts").alias("cuts"), F.sum("opens").alias("opens"), F.sum("closes").alias("closes")).join(ends, "path")
    numbered = cut.join(F.broadcast(blocks.select("path", "block", "before")), list(_KEY)).withColumn("at", F.col("before") + F.col("number"))
    # only a block's first and last piece can go on in another block
    edge = F.col("last") | (F.col("number") == 0)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"])
    joined = numbered.where(edge).groupBy("path", "at").agg(F.max("mtime").alias("mtime"), F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b)).alias("text"))
    every = joined.select("path", "mtime", "at", "text").unionByName(numbered.where(~edge).select("path", "mtime", "at", "text"))
    every = every.join(F.broadcast(files.select("path", "cuts", "bytes", "size")), "path")
    # reading a file that doesn't end with a separator adds one; a byte-order mark's 3 bytes are skipped
    added = F.col("bytes").isin([F.col("size") + 1, F.col("size") - 2])
    stray = (F.col("at") == F.col("cuts")) & added
    text = F.col("text").cast("string")
    text = F.when(F.col("at") == 0, F.regexp_replace(text, "^\ufeff", "")).otherwise(text)
    text = F.when(stray, F.regexp_replace(text, SEPARATOR + "$", "")).otherwise(text)
    every = shared(every.select("path", "mtime", "at", "cuts", F.regexp_replace(text, r"^[\t\n\r ]+|[\t\n\r ]+$", "").alias("text")))

    outer = every.where("at = 0 OR at = cuts").groupBy("path").agg(F.max(F.when(F.col("at") == 0, F.col("text"))).alias("head"), F.max(F.when((F.col("at") == F.col("cuts")) & (F.col("at") > 0), F.col("text"))).alias("tail"))
    whole = (F.col("quotes") % 2 == 0) & (F.col("delta") + F.when(added, 1).otherwise(0) == 0) & (F.col("opens") == 1) & (F.col("closes") == 1) & (F.col("tail") == "")
    bad = files.join(outer, "path", "left").select("path", F.when(F.coalesce(F.col("head"), F.lit("")) != "", "expected top-level JSON array").when(~F.coalesce(whole, F.lit(False)), "invalid JSON").alias("reason")).where("reason IS NOT NULL")
    inner = every.where("at > 0 AND at < cuts")
    return inner.where("cuts > 2 OR text <> ''").select("path", "mtime", "at", "text"), bad
