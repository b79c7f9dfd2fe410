"""Groups that would fill one task, and ids that lie far apart."""

import random

import numpy as np
import pytest

from palimpsest.llm import fingerprints, suffix_array, topk

from .test_operators import brute_bytes


def spans_of(df):
    return {r["d"]: sorted((p["s"], p["e"]) for p in r["parts"]) for r in df.collect()}


@pytest.mark.parametrize("shard", [400, 1 << 20])
def test_a_passage_in_other_surroundings(spark, shard):
    """Stretches of one path that all differ, cut into windows where they are too many for a shard."""
    rng = random.Random(11)
    fresh = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage, near = fresh(260), fresh(60)
    texts = [(i, fresh(rng.randint(0, 90)) + (near if i % 3 else "") + passage + (near if i % 2 else "") + fresh(rng.randint(0, 90))) for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = spans_of(suffix_array.repeated_bytes(df, shard=shard))
    want = brute_bytes(texts)
    for i, _ in texts:
        own = found.get(i, [])
        assert (sum(e - s for s, e in own), len(own)) == want[i][1:3]


def test_sparse_ids_follow_each_other(spark):
    rng = random.Random(2)
    ids = sorted({rng.randrange(-(1 << 63), 1 << 63) for _ in range(300)} | set(range(50)) | {256 * 4096 * i for i in range(20)} | {-(1 << 63), (1 << 63) - 1})
    df = spark.createDataFrame([(i, f"{i} " * 12) for i in ids], "doc_id long, text string").repartition(3)
    rows = fingerprints.with_next(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r["span"], []).append((r["extra"], r["doc_id"]))
    after = {a: b for own in by.values() for (_, a), (_, b) in zip(sorted(own), sorted(own)[1:], strict=False)}
    assert sum(not r["extra"] for r in rows) == len(ids)
    assert {i: after[i] for i in ids} == dict(zip(ids, ids[1:] + ids[:1], strict=True))


def test_error_of_the_estimate(spark):
    """Containment of texts of 300 shingles or more is estimated within what 1/8 of the hashes allow."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5_000)]
    off = []
    rows, truth = [], []
    for _ in range(40):
        a = rng.choices(words, k=600)
        cut = rng.randint(50, 550)
        b = a[:cut] + rng.choices(words, k=600 - cut)
        grams = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b)]
        truth.append(len(grams[0] & grams[1]) / min(map(len, grams)))
        rows.append((" ".join(a), " ".join(b)))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(fingerprints.likeness(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b")))).collect()]
    off = np.abs(np.array(got) - truth)
    # the standard deviation of a share of about 75 hashes is 0.06 at most
    assert off.mean() < 0.06 and off.max() < 0.25


def test_topk_of_more_queries_than_a_group(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP", 16)
    monkeypatch.setattr(topk, "CHUNK", 32)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(12, 40))
    x = (centre[rng.integers(0, 12, 500)] + 0.1 * rng.normal(size=(500, 40))) * rng.uniform(0.2, 2, size=(500, 1))
    whole = np.floor(x * 256)
    ids = np.arange(500)
    best = topk.Best(ids[::3], whole[::3], 5)
    for i in range(0, 500, 170):
        best.offer(ids[i : i + 170], whole[i : i + 170])
    for at, q in enumerate(best.ids):
        own = sorted((-float(whole[q] @ whole[j]), j) for j in ids if j != q)[:5]
        assert [(-s, j) for s, j in own] == list(zip(best.score[at], best.found[at], strict=True))
    # near queries in one group, and the bounds, leave most pairs' last dimensions alone
    assert best.survivors[-2] < 0.5 * best.survivors[-1]


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_windows_of_long_texts_come_in_chunks(spark, monkeypatch, chunk):
    """A path's stretches beyond what sorting takes, in long texts: windows are hashed a chunk at a time."""
    import hashlib

    monkeypatch.setattr(suffix_array, "CHUNK", chunk)
    data = bytes(random.Random(4).choices(range(32, 127), k=3_000))
    got = list(suffix_array.window_rows(data, 20, 2_800, 100))
    assert max(len(x) for x, _, _ in got) <= chunk and [i for _, _, s in got for i in s] == list(range(20, 2_801))
    digests = [hashlib.blake2b(data[i : i + 100], digest_size=16).digest() for i in range(20, 2_801)]
    assert [a.tobytes() + b.tobytes() for x, y, _ in got for a, b in zip(x, y, strict=True)] == digests

    rng = random.Random(12)
    fresh = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    body = fresh(4_000)
    texts = [(i, fresh(30 + i) + body[: 3_000 + 90 * i] + fresh(5) + body[500:] + fresh(40)) for i in range(9)] + [(20, None), (21, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found, want = spans_of(suffix_array.repeated_bytes(df, shard=300)), brute_bytes(texts)
    for i, _ in texts:
        own = found.get(i, [])
        assert (sum(e - s for s, e in own), len(own)) == want[i][1:3]
