"""Vector codes against brute force in whole numbers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, rounds=codes.ROUNDS, entries=codes.ENTRIES):
    """rows: (vec_id, vector, label) -> {(vec_id, code, error, label_error, sha256)} as a sorted list"""
    whole = [(i, [math.floor(1024 * np.float32(v).item()) for v in x], k) for i, x, k in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    width = -(-max((len(x) for _, x, _ in whole), default=0) // 4)
    whole = [(i, x + [0] * (4 * width - len(x)), k) for i, x, k in whole]
    first = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[x[k * width : (k + 1) * width] for _, x, _ in first] for k in range(4)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for k in range(4):
            held = {}
            for _, x, _ in whole:
                part = x[k * width : (k + 1) * width]
                held.setdefault(nearest(part, books[k])[1], []).append(part)
            books[k] = [[sum(c) // len(held[j]) for c in zip(*held[j], strict=True)] if j in held else e for j, e in enumerate(books[k])]
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out = []
    for i, x, label in whole:
        near = [nearest(x[k * width : (k + 1) * width], books[k]) for k in range(4)]
        out.append((i, "".join(f"{j:02x}" for _, j in near), sum(d for d, _ in near), label))
    total = {}
    for r in out:
        total[r[3]] = total.get(r[3], 0) + r[2]
    return sorted(((i, c, e, total[k], sha) for i, c, e, k in out), key=repr)


def got(df):
    return sorted((tuple(r) for r in codes.compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


@pytest.mark.parametrize("n, width", [(400, 16), (300, 4), (120, 12)])
def test_against_brute_force(spark, n, width):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(9, width))
    rows = [(int(i), [float(v) for v in np.round(centres[i % 9] + 0.2 * rng.normal(size=width), 2).astype(np.float32)], int(i % 3) if i % 4 else None) for i in rng.permutation(n)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(v) for v in rng.integers(-3, 4, 6) / 2], i % 2) for i in range(40)]
    rows += [(3, rows[3][1], 1), (3, rows[4][1], None), (None, rows[5][1], 0), (None, rows[6][1], 0)]  # repeated rows and ids, no ids
    rows += [(50, None, 1), (51, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (52, [float("nan")] * 6, 1), (53, [float("-inf")] * 6, 1), (54, [1.0, 2.0], 1), (55, [], None)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("extra").alias(c) for c in ("x", "code", "error", "label_error", "__label", "entry", "n", "sums")])
    assert got(df) == brute(rows)
    assert codes.compress(df.limit(0)).count() == 0
    assert got(df.where("vec_id = 55")) == brute([(55, [], None)])
    assert [r["error"] for r in codes.compress(spark.createDataFrame([(1, [3e38, -3e38], 1)], SCHEMA)).collect()] == [0]


@pytest.mark.parametrize("width", [1, 2, 3, 5, 16, 33])
def test_bounds_drop_no_nearest(width):
    """Ties, equal entries, far and near values: always the lowest of the nearest entries."""
    rng = np.random.default_rng(width)
    for most in (2, 50, 10_000, codes.MOST // 8):
        entries = rng.integers(-most, most + 1, (70, width))
        entries[40:60] = entries[:20]
        x = np.concatenate([rng.integers(-most, most + 1, (150, width)), entries, entries + rng.integers(-1, 2, entries.shape)])
        distance = ((x[:, None] - entries[None]) ** 2).sum(2)
        entry, low, left = codes.Book(entries).nearest(x)
        assert entry.tolist() == distance.argmin(1).tolist() and low.tolist() == distance.min(1).tolist()
        assert left[-1] >= len(x) and (np.diff(left) <= 0).all()


def test_bounds_leave_few_of_clustered_parts():
    rng = np.random.default_rng(0)
    entries = rng.integers(-1000, 1000, (256, 16))
    _, _, left = codes.Book(entries).nearest(entries[rng.integers(0, 256, 2000)] + rng.integers(-30, 31, (2000, 16)))
    assert left[-1] < 0.02 * left[0]


def test_decode(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=8)], 0) for i in range(30)]
    table = codes.components(spark.createDataFrame(rows, SCHEMA))
    books = codes.train(table)
    for r in codes.encode(table, books).collect():  # fewer rows than entries: each is its own
        x = [math.floor(1024 * np.float32(v).item()) for v in rows[r["vec_id"]][1]]
        assert sum((a - b) ** 2 for a, b in zip(codes.decode(r["code"], books), x, strict=True)) == r["error"] == 0
