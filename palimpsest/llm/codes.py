"""Vector code compression: product codes by whole-number k-means, entries filtered by segment-mean lower bounds.

The distance from a part of a vector to an entry is at least the distance of their block means, weighted by the blocks' widths,
plus the squared difference of what the means leave, the residuals' norms. Blocks are halved from coarse to fine. An entry whose bound
is above the distance to an entry that is already computed can't be nearest, nor tie with it; only the others get exact distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, shared, small

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Parts of vectors that are compared at once, and the magnitude of components that 64 bits can sum up.
ROWS, MOST = 4096, 1 << 26
#: Blocks of a part at each level, at most its width.
LEVELS = (1, 2, 4, 8)
#: What bounds are lowered by, as a share and as such, so that rounding never drops an entry.
SLACK, LESS = 1 - 1e-9, 1e-6


class Book:
    """The entries of one part, and their block means and residual norms at each level."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        width = entries.shape[1]
        self.cuts = [np.unique(np.linspace(0, width, min(k, width) + 1).astype(int))[:-1] for k in LEVELS if width]
        self.levels = [self._means(entries, c) for c in self.cuts]

    @staticmethod
    def _means(x: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block means times the root of the block's width, and the norm of what they leave."""
        size = np.diff(np.append(cuts, x.shape[1]))
        sums = np.add.reduceat(x, cuts, axis=1).astype(float)
        left = x - np.repeat(sums / size, size, axis=1)
        return sums / np.sqrt(size), np.sqrt((left * left).sum(1))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest entry of each row, ties to the lower one; its squared distance; and how many pairs each level left."""
        n, m = len(x), len(self.entries)
        if not self.cuts:
            return np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(1, np.int64)
        means, norm = self._means(x, self.cuts[0])
        own, own_norm = self.levels[0]
        bound = (means - own[:, 0]) ** 2 + (norm[:, None] - own_norm) ** 2
        first = bound.argmin(1)
        most = self._exact(x, np.arange(n), first)
        row, entry = np.nonzero(bound * SLACK - LESS <= most[:, None])
        left = [n * m, len(row)]
        for cuts, (own, own_norm) in zip(self.cuts[1:], self.levels[1:], strict=True):
            means, norm = self._means(x, cuts)
            gap = means[row] - own[entry]
            bound = np.einsum("ij,ij->i", gap, gap) + (norm[row] - own_norm[entry]) ** 2
            # the lowest bound's entry is often the nearest: its distance lowers what the others must beat
            start = np.searchsorted(row, np.arange(n))
            low = np.minimum.reduceat(bound, start)
            best = np.flatnonzero(bound == low[row])
            np.minimum.at(most, row[best], self._exact(x, row[best], entry[best]))
            stay = bound * SLACK - LESS <= most[row]
            row, entry = row[stay], entry[stay]
            left.append(len(row))
        distance = self._exact(x, row, entry)
        start = np.searchsorted(row, np.arange(n))
        low = np.minimum.reduceat(distance, start)
        hit = np.flatnonzero(distance == low[row])
        hit = hit[np.searchsorted(row[hit], np.arange(n))]  # entries ascend in a row
        return entry[hit], low, np.array(left)

    def _exact(self, x: np.ndarray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
        gap = x[row] - self.entries[entry]
        return np.einsum("ij,ij->i", gap, gap)


def components(table: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label and the whole components of rows whose vector is not null and holds no null and no non-finite component."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(v * SCALE))).cast("long"))
    return table.where(F.col(vector).isNotNull()).where(~bad).select(F.col(id_).alias("vec_id"), F.col(label).alias("label"), whole.alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of one width; what a shorter vector lacks is 0."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            yield part, _matrix(part.column(part.num_columns - 1), width)


def _step(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The books after one round: each entry the floor of the mean of its parts, unused ones as they were."""
    count, width = books.shape[1:]
    given = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Book(b) for b in given.value]
        sums, n = np.zeros((PARTS * count, width), np.int64), np.zeros(PARTS * count, np.int64)
        for _, x in _blocks(batches, PARTS * width):
            for k, book in enumerate(own):
                part = np.ascontiguousarray(x[:, k * width : (k + 1) * width])
                near = k * count + book.nearest(part)[0]
                n += np.bincount(near, minlength=len(n))
                np.add.at(sums, near, part)
        used = np.flatnonzero(n)
        flat = pa.ListArray.from_arrays(np.arange(len(used) + 1, dtype=np.int32) * width, pa.array(sums[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), flat], ["entry", "n", "sums"])

    found = in_batches(rows.select("x"), run, "entry long, n long, sums array<long>")
    totals = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    new = books.reshape(PARTS * count, width).copy()
    for row in found.groupBy("entry").agg(F.sum("n").alias("n"), *totals).collect():  # PARTS * ENTRIES rows at most
        new[row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    given.destroy()
    return new.reshape(books.shape)


def train(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray:
    """The books (part, entry, component) after all rounds, from rows of `components`."""
    width = int(rows.agg(F.max(F.size("x"))).first()[0] or 0)
    width = -(-width // PARTS)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    books = np.zeros((len(first), PARTS * width), np.int64)
    for book, row in zip(books, first, strict=True):
        book[: len(row["x"])] = row["x"]
    books = np.ascontiguousarray(books.reshape(len(first), PARTS, width).transpose(1, 0, 2))
    for _ in range(rounds if len(first) and width else 0):
        books = _step(rows, books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of rows of `components`."""
    width = books.shape[2]
    given = rows.sparkSession.sparkContext.broadcast(books)
    kinds = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Book(b) for b in given.value]
        for part, x in _blocks(batches, PARTS * width):
            code, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
            for k, book in enumerate(own):
                code[:, k], distance, _ = book.nearest(np.ascontiguousarray(x[:, k * width : (k + 1) * width]))
                error += distance
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return in_batches(rows.select("vec_id", "label", "x"), run, f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long")


def decode(code: str, books: np.ndarray) -> list[int]:
    """The components that a code stands for."""
    return [int(v) for k in range(PARTS) for v in books[k, int(code[2 * k : 2 * k + 2], 16)]]


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(table: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each row of `components`.

    Null ids come last in the order that the books start with, and rows of one id go by their components. Fewer rows than entries
    make smaller books; an empty table gives no rows. A vector whose width is no multiple of four, or below the widest, counts as filled up
    with zeros; components beyond 2**26 count as 2**26. Columns other than the three are not read.

    Books are all that the driver holds. A task sums up its own parts by entry, so a round shuffles a fixed number of rows a task.
    """
    rows = shared(components(table, id_, vector, label))
    books = train(rows)
    found = shared(encode(rows, books), rows)
    labels = found.groupBy("label").agg(F.sum("error").alias("label_error"))
    labels = labels.withColumnRenamed("label", "__label")
    out = found.join(small(labels, labels.count()), found["label"].eqNullSafe(F.col("__label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
