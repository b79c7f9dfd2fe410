"""The sample of ordinary words is as large as asked, or as the vocabulary is."""

import zlib
from itertools import product

from palimpsest.llm import secrets


def sampled(docs, n):
    return sorted(v for k, v in secrets._labelled(docs, n) if k == "word")


def test_sample_of_words(spark):
    words = ["".join(w) for w in product("abcdefghijklmnopqr", repeat=3)]
    assert len(words) == 5_832
    texts = [(" ".join(words[i : i + 40] + ["x9", "ab"]),) for i in range(0, len(words), 30)]
    lowest = sorted(sorted(words, key=lambda w: (zlib.crc32(w.encode()), w))[:4_000])
    for parts in (1, 7):
        assert sampled(spark.createDataFrame(texts, "text string").repartition(parts), 4_000) == lowest
    few = spark.createDataFrame([("the quick brown fox jumps",), (None,)], "text string")
    assert sampled(few, 4_000) == ["brown", "fox", "jumps", "quick", "the"]
    assert sampled(few, 2) == sorted(sorted(sampled(few, 9), key=lambda w: zlib.crc32(w.encode()))[:2])
