"""What several operators share: size-checked broadcasts and vectorised hashing of words."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scratch import drop, shared  # noqa: F401  for the operators

#: Words of a text: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

U = np.uint64
#: Odd multipliers for polynomial hashes modulo 2**64.
BYTE_BASE, SEQ_BASE = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of rows in a batch that goes to Python, about, and Spark's setting of it.
BATCH, _BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of BATCH bytes where the session names no size, so that neither a worker nor the memory beside an executor's heap holds thousands of texts."""
    spark = df.sparkSession
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH))
    return df.mapInArrow(run, schema)


#: Bytes of rows that are broadcast, at most, and what a value of a type that has no fixed size is taken to have.
BROADCAST, VALUE = 32 << 20, 40


def small(df: DataFrame, rows: int) -> DataFrame:
    """Mark df for a broadcast if its counted rows hold BROADCAST bytes at most; else leave the choice of a shuffled join to Spark."""
    fixed = {"int": 8, "bigint": 8, "double": 8, "float": 8, "boolean": 8, "smallint": 8, "tinyint": 8, "date": 8, "timestamp": 8}
    width = 16 + sum(fixed.get(kind, VALUE) for _, kind in df.dtypes)
    return F.broadcast(df) if rows * width <= BROADCAST else df


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (a bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), U)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full(len(out) - 1, base, U), out=out[1:]) if len(out) > 1 else None
    return out


_BYTE_CODE = mix64(np.arange(1, 257, dtype=U))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Words:
    """Words of some texts: byte offsets into one buffer, and where each text's words begin (one more entry than texts)."""

    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def split_words(texts: Iterable[str | None]) -> Words:
    data = [encode(t) for t in texts]
    buffer = np.frombuffer(b"\n" + b"\n".join(data) + b"\n", np.uint8)
    space = _IS_SPACE[buffer]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    at = 1 + np.concatenate([[0], np.cumsum([len(d) + 1 for d in data])]).astype(np.int64)
    return Words(buffer, starts, ends, np.searchsorted(starts, at))


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(w.starts):
        return np.zeros(0, U)
    code = _BYTE_CODE[w.buffer]
    code[_IS_SPACE[w.buffer]] = 0
    code, begin = code[w.starts[0] :], w.starts - w.starts[0]
    at = np.arange(len(code)) - np.repeat(begin, np.diff(np.append(begin, len(code))))
    with np.errstate(over="ignore"):
        return mix64(np.add.reduceat(code * _powers(BYTE_BASE, int(at.max()) + 1)[at], begin))


def sliding_hash(x: np.ndarray, k: int, base: np.uint64 = SEQ_BASE) -> np.ndarray:
    """Hash of x[i:i+k] for each i, from hashes of runs that double in length."""
    if len(x) < k:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        out, done, part, length, power, bits = None, 0, x, 1, base, k
        while bits:
            if bits & 1:
                n = len(x) - done - length + 1
                out = part[:n] if out is None else out[:n] * power + part[done : done + n]
                done += length
            bits >>= 1
            if bits:
                part = part[:-length] * power + part[length:]
                length, power = 2 * length, power * power
        return out[: len(x) - k + 1]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i:i+w] for each i."""
    if len(x) < w:
        return x[:0]
    length = 1
    while 2 * length <= w:
        x = np.minimum(x[:-length], x[length:])
        length *= 2
    return x if length == w else np.minimum(x[: len(x) - (w - length)], x[w - length :])


def starts_within(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of k items that stay within one text: their first item, and how many each text has."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    total = np.concatenate([[0], np.cumsum(n)])
    return np.arange(total[-1]) + np.repeat(first[:-1] - total[:-1], n), n


def pieces(rows: list, sizes: list[int], most: int = 2_000_000) -> Iterator[list]:
    """Cut rows into lists of about `most` bytes, so that work memory doesn't follow the batch size."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield rows[begin:i]
            begin, total = i, 0
        total += n
    if begin < len(rows):
        yield rows[begin:]
