"""Packing token sequences: a cutting-stock linear program over the histogram of lengths, solved by column generation.

A document longer than a sequence is cut into full ones and a rest. What is packed are lengths, rounded up to classes whose
number is fixed, so the program has as many rows as there are classes, however many documents there are. Its columns are
patterns, how many pieces of each class share a sequence; a knapsack over the dual prices finds the next ones. Patterns are
rounded down to whole numbers, and what is left is filled in from the longest. Documents, ranked in their class, take the
places of the patterns in turn.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, encode, in_batches, pieces, shared, small, word_hashes

MODEL, END, ROOM = public_tokenizers.path("word_bpe_49k.json"), 2, 4096
#: Lengths up to EXACT are classes of their own; beyond, an octave has EXACT / 2 of them.
EXACT = 256
#: Rounds of pricing at most, columns that one round adds, and the excess over the tokens' own space at which the program is good enough.
ROUNDS, COLUMNS, GOOD = 30, 40, 5e-4
#: Units of text whose ids a worker remembers, and characters that are tokenized at once.
KEPT, PIECE = 400_000, 2_000_000

_KIND = np.full(256, 4, np.uint8)  # of bytes: 0 blank, 1 letter, 2 digit, 3 other visible ASCII, 4 what only the library splits
_KIND[0x21:0x7F] = 3
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A] = 2
_KIND[0x27] = 4
#: Code points from U+00C0 to U+024F that are letters and stay one when lower-cased; they are 2 bytes each.
_LETTER = np.array([0xC0 <= i and chr(i).isalpha() and len(chr(i).lower()) == 1 for i in range(0x250)])


class Tokens:
    """Ids of whole texts by the library's model, which sees each distinct unit once.

    No token of this vocabulary reaches over a blank, nor between letters, digits and other signs. So texts are cut there
    in numpy, letters in ASCII are lower-cased, and units of printable ASCII go to the library's merges at once; whatever holds
    an apostrophe, a special token's brackets or a rarer character goes through the whole library, from blank to blank.
    """

    def __init__(self, model: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(model)
        self.merges = self.library.model
        self.forget()

    def forget(self) -> None:
        self.keys, self.unit = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _cut(self, texts: list[str | None]) -> tuple[Words, np.ndarray]:
        """Units of all texts, and which of them only the whole library may cut."""
        data = [encode(t) for t in texts]
        x = np.frombuffer(b"\n" + b"\n".join(data) + b"\n", np.uint8).copy()
        kind = _KIND[x]
        pair = np.flatnonzero((x[:-1] >= 0xC3) & (x[:-1] <= 0xC9))
        pair = pair[_LETTER[np.minimum((x[pair].astype(np.int64) & 31) << 6 | x[pair + 1] & 63, len(_LETTER) - 1)]]
        kind[pair] = kind[pair + 1] = 1
        angle = np.flatnonzero((x[:-1] == 0x3C) & (x[1:] == 0x7C))  # <|
        kind[angle] = 4
        blank = kind == 0
        first = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        last = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        odd = np.logical_or.reduceat(kind == 4, first) if len(first) else np.zeros(0, bool)
        inside = np.zeros(len(x) + 1, np.int8)
        inside[first[odd]], inside[last[odd]] = 1, -1
        whole = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        kind[whole] = 5
        lower = (x >= 0x41) & (x <= 0x5A) & ~whole
        x[lower] += 32
        begin = np.flatnonzero((kind[1:] != 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))) + 1
        change = (kind[:-1] != 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
        ends = np.flatnonzero(change) + 1
        at = 1 + np.concatenate([[0], np.cumsum([len(d) + 1 for d in data])]).astype(np.int64)
        ascii_ = np.logical_and.reduceat(x < 0x80, begin) if len(begin) else np.zeros(0, bool)
        return Words(x, begin, ends, np.searchsorted(begin, at)), (kind[begin] == 5) | ~ascii_

    def _learn(self, keys: np.ndarray, raw: list[bytes], odd: np.ndarray) -> None:
        """Add units that aren't known."""
        got: list[list[int]] = [[]] * len(raw)
        for i in np.flatnonzero(~odd).tolist():
            got[i] = [t.id for t in self.merges.tokenize(raw[i].decode("ascii"))]
        rest = np.flatnonzero(odd).tolist()
        if rest:
            found = self.library.encode([raw[i].decode("utf-8", "replace") for i in rest], is_pretokenized=True, add_special_tokens=False)
            of = np.array(found.word_ids, np.int64)
            edges = np.searchsorted(of, np.arange(len(rest) + 1))
            ids = found.ids
            for k, i in enumerate(rest):
                got[i] = ids[edges[k] : edges[k + 1]]
        size = np.array([len(g) for g in got], np.int64)
        self.ids = np.concatenate([self.ids, np.array([i for g in got for i in g], np.uint32)])
        keys, unit = np.concatenate([self.keys, keys]), np.concatenate([self.unit, len(self.size) + np.arange(len(raw))])
        self.size = np.concatenate([self.size, size])
        self.at = np.cumsum(self.size) - self.size
        order = np.argsort(keys)
        self.keys, self.unit = keys[order], unit[order]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        w, odd = self._cut(texts)
        if not len(w.starts):
            return [np.zeros(0, np.uint32) for _ in texts]
        keys, where, which = np.unique(word_hashes(w) ^ odd.astype(np.uint64), return_index=True, return_inverse=True)
        if len(self.keys) > KEPT:
            self.forget()
        new = ~np.isin(keys, self.keys)
        if new.any():
            own = where[new]
            self._learn(keys[new], [w.buffer[a:b].tobytes() for a, b in zip(w.starts[own].tolist(), w.ends[own].tolist(), strict=True)], odd[own])
        unit = self.unit[np.searchsorted(self.keys, keys)][which]
        size = self.size[unit]
        after = np.cumsum(size)
        ids = self.ids[np.repeat(self.at[unit] - (after - size), size) + np.arange(after[-1])]
        edges = np.concatenate([[0], after])[w.first]
        return [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


@cache
def tokens(model: str) -> Tokens:
    """One for a worker."""
    return Tokens(model)


def class_of(length: np.ndarray) -> np.ndarray:
    """Lengths rounded up to their class."""
    step = np.ones_like(length)
    above = length > EXACT
    step[above] = 2 ** (np.ceil(np.log2(length[above])).astype(np.int64) - 1) // (EXACT // 2)
    return -(-length // step) * step


def tokenized(docs: DataFrame, room: int = ROOM, model: str = MODEL, end: int = END) -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, ids (32-bit little-endian), its class, and part and rank, which number the pieces of a class in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(room + 1, np.int64)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for block in pieces(range(len(texts)), [len(t or "") + 1 for t in texts], PIECE):
                ids = [np.append(x, np.uint32(end)).astype("<u4") for x in tokens(model).encode([texts[i] for i in block])]
                n = np.array([len(x) for x in ids], np.int64)
                each = -(-n // room)
                of = np.repeat(np.arange(len(n)), each)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)) * room
                length = np.minimum(n[of] - start, room)
                kind = class_of(length)
                order = np.argsort(kind, kind="stable")
                first = np.searchsorted(kind[order], kind[order])
                rank = np.empty(len(kind), np.int64)
                rank[order] = np.arange(len(kind)) - first
                rank += seen[kind]
                seen += np.bincount(kind, minlength=room + 1)
                data = [ids[i][a : a + m].tobytes() for i, a, m in zip(of.tolist(), start.tolist(), length.tolist(), strict=True)]
                doc = batch.column(0).take(pa.array(np.asarray(block)[of]))
                columns = [doc, pa.array(start), pa.array(length), pa.array(n[of]), pa.array(data, pa.binary()), pa.array(kind), pa.array(np.full(len(of), part)), pa.array(rank)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "ids", "class", "part", "rank"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary, class long, part long, rank long")


def _knapsack(sizes: np.ndarray, price: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The best sum of prices in each space, and the item that is taken last for it (-1: none)."""
    best, take = np.zeros(room + 1), np.full(room + 1, -1, np.int64)
    fits = np.searchsorted(sizes, np.arange(room + 1), "right").tolist()
    for c in range(1, room + 1):
        k = fits[c]
        best[c] = best[c - 1]
        if k:
            v = best[c - sizes[:k]] + price[:k]
            i = int(v.argmax())
            if v[i] > best[c] + 1e-12:
                best[c], take[c] = v[i], i
    return best, take


def _pattern(take: np.ndarray, sizes: np.ndarray, c: int) -> np.ndarray:
    out = np.zeros(len(sizes))
    while c > 0:
        i = take[c]
        if i < 0:
            c -= 1
        else:
            out[i] += 1
            c -= int(sizes[i])
    return out


def _fill(sizes: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """The pattern that takes the longest that fits, again and again, of what is left."""
    pattern, i = np.zeros(len(sizes), np.int64), len(sizes)
    while (i := int(np.searchsorted(sizes[:i], room, "right"))) > 0:
        own = np.flatnonzero(left[:i] > 0)
        if not len(own):
            break
        i = int(own[-1])
        pattern[i] = min(int(np.ceil(left[i])), room // int(sizes[i]))
        room -= int(pattern[i] * sizes[i])
    return pattern


def _greedy(sizes: np.ndarray, demand: np.ndarray, room: int) -> Iterator[tuple[int, np.ndarray]]:
    """Patterns that use up the demand by filling up from the longest in fractions, and the class that each uses up."""
    left = demand.astype(float)
    while left.any():
        pattern = _fill(sizes, left, room)
        held = np.flatnonzero(pattern)
        times = left[held] / pattern[held]
        gone = int(held[times.argmin()])
        left -= pattern * times.min()
        left[left < 1e-9] = left[gone] = 0
        yield gone, pattern


def generate(sizes: np.ndarray, demand: np.ndarray, room: int = ROOM) -> tuple[np.ndarray, np.ndarray]:
    """The linear program's patterns (a column each) and how often it takes them; sizes ascend.

    A revised simplex that starts from sequences of one class each and first lets in what filling up from the longest gives,
    each pattern in place of the class that it uses up. A round prices all patterns by one knapsack and lets the best ones in,
    one with each class; it ends when none pays, when the sequences are full but for GOOD, or after ROUNDS. Products are by
    einsum: threads of a linear algebra library may not outlive the fork that started Spark.
    """
    alone = (room // sizes).astype(float)
    base, inverse = np.diag(alone), np.diag(1 / alone)
    least = float(sizes @ demand) / room

    def enter(pattern: np.ndarray, step: np.ndarray, out: int) -> None:
        row = inverse[out] / step[out]
        inverse[:] -= np.outer(step, row)
        inverse[out], base[:, out] = row, pattern

    for gone, pattern in _greedy(sizes, demand, room):
        enter(pattern, pattern / alone, gone)
    x = np.maximum(np.einsum("ij,j->i", inverse, demand.astype(float)), 0)
    for _ in range(ROUNDS):
        price = inverse.sum(0)
        best, take = _knapsack(sizes, price, room)
        if best[room] < 1 + 1e-7 or x.sum() <= least * (1 + GOOD):
            break
        worth = price + best[room - sizes]
        for i in np.argsort(-worth)[:COLUMNS].tolist():
            new = _pattern(take, sizes, room - int(sizes[i]))
            new[i] += 1
            if (inverse.sum(0) * new).sum() < 1 + 1e-7:
                continue
            step = np.einsum("ij,j->i", inverse, new)
            ratio = np.where(step > 1e-9, x / np.maximum(step, 1e-9), np.inf)
            out = int(ratio.argmin())
            x = x - ratio[out] * step
            x[out] = ratio[out]
            enter(new, step, out)
    return base, np.maximum(x, 0)


def plan(sizes: np.ndarray, demand: np.ndarray, room: int = ROOM) -> list[tuple[np.ndarray, int]]:
    """Whole patterns and how often each is used; together they hold exactly the demand."""
    if not len(sizes):
        return []
    base, x = generate(sizes, demand, room)
    base, left, out = base.astype(np.int64), demand.copy(), []

    def use(pattern: np.ndarray, times: int) -> None:
        nonlocal left
        out.append((pattern, times))
        left = left - pattern * times

    for k in np.argsort(-x).tolist():
        held = base[:, k] > 0
        times = min(int(x[k] + 1e-9), int((left[held] // base[held, k]).min()))
        if times > 0:
            use(base[:, k], times)
    for k in np.argsort(-(x % 1)).tolist():  # once more where that leaves no gap
        if sizes @ np.minimum(base[:, k], left) >= room * (1 - 0.002):
            use(np.minimum(base[:, k], left), 1)
    while left.any():  # the rest, the longest first
        pattern = _fill(sizes, left, room)
        held = pattern > 0
        use(pattern, int((left[held] // pattern[held]).min()))
    return out


def pack(docs: DataFrame, carry: Column | None = None, room: int = ROOM, model: str = MODEL, end: int = END) -> DataFrame:
    """A row for each piece of a document's ids: doc_id, start, length, doc_tokens, sequence_id, offset, and its ids, or what `carry` makes of them.

    Each document is its text's ids and then `end`; null and empty texts are `end` alone. Rows that repeat, and rows without an id,
    are documents of their own; an empty table gives no rows; other columns are not read. Pieces are a sequence's whole room
    or the rest of a document, uncut. `carry` is a column over `ids` and `length`; it goes through the shuffles in place of the ids.

    The driver sees the histogram of classes only, a fixed number of rows. No class meets in one task: a piece's rank is
    its rank in the task that tokenized it, plus the sums of the tasks before.
    """
    rows = shared(tokenized(docs, room, model, end).withColumn("ids", F.col("ids") if carry is None else carry))
    counts = shared(rows.groupBy("class", "part").agg(F.count("*").alias("n")))
    total = sorted(tuple(r) for r in counts.groupBy("class").agg(F.sum("n")).collect())
    sizes, demand = (np.array(x, np.int64) for x in (zip(*total, strict=True) if total else ((), ())))
    places, next_sequence, done = [], 0, np.zeros(len(sizes), np.int64)
    for pattern, times in plan(sizes, demand, room):
        for i in np.flatnonzero(pattern).tolist():
            much = int(pattern[i]) * times
            places.append((int(sizes[i]), int(done[i]), int(done[i]) + much, next_sequence, int(pattern[i])))
            done[i] += much
        next_sequence += times
    spark = docs.sparkSession
    given = spark.createDataFrame(places, "class long, low long, high long, sequence long, each long")
    before = F.sum("n").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("class", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = rows.join(offsets, ["class", "part"]).withColumn("rank", F.col("rank") + F.col("before")).alias("r")
    here = (F.col("r.class") == F.col("p.class")) & (F.col("r.rank") >= F.col("p.low")) & (F.col("r.rank") < F.col("p.high"))
    placed = ranked.join(small(given, len(places)).alias("p"), here)
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "r.class", "rank")
    offset = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("sequence_id", F.col("sequence") + F.expr("(rank - low) div each"))
    return placed.withColumn("offset", offset).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
