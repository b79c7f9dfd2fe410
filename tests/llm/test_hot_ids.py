"""Fingerprints of tables in which ids are null, or repeat, many times."""

import hashlib
import random
from collections import Counter

import pytest
import xxhash

from palimpsest.llm import fingerprints


def slot(text, n, span):
    slots = -(-n // span)
    return ((xxhash.xxh64_intdigest(text.encode(), 42) >> 33) * slots) >> 31


@pytest.mark.parametrize("low", [0, -(2**62), 2**63 - 40])
def test_ids_of_many_rows(spark, monkeypatch, low):
    monkeypatch.setattr(fingerprints, "SPAN", 8)
    rng = random.Random(5)
    text = lambda: " ".join(rng.choices("abcdefghijklmnop", k=rng.randint(0, 30)))
    rows = [(None, text()) for _ in range(90)] + [(None, "a b c d e f g")] * 50 + [(None, None)] * 3
    rows += [(low + 11, text()) for _ in range(60)] + [(low + 11, "x y z x y z")] * 30 + [(low + i, text()) for i in range(40)] + [(low + 30, text())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = fingerprints.fingerprints(df).collect()

    n = Counter(i for i, _ in rows)
    base = lambda i: -(2**70) if i is None else i
    in_span = Counter(base(i) // 8 for i, _ in rows)
    place = lambda i, t: (base(i), slot(t, n[i], 8) if in_span[base(i) // 8] > 16 else 0, t)
    order = sorted((place(i, t or ""), i, t or "") for i, t in rows)
    want = Counter()
    for (_, i, t), (_, _, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    # no span holds more than its slot's different rows
    own = df.fillna({"text": ""})
    sizes = [r["count"] for r in fingerprints.with_next(own).groupBy("span").count().collect()]
    assert max(sizes) <= 24 and len(sizes) > 20


def test_only_null_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "SPAN", 4)
    got = fingerprints.fingerprints(spark.createDataFrame([(None, "a b c d e f")] * 30, "doc_id long, text string")).collect()
    assert len(got) == 30 and all(r["near_next"] == 1 and r["n_chars"] == 11 for r in got)
