"""Many seeds at once against a regex each; NEAR against brute force; quantiles against numpy."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import dictionary, evaluate, graph, index
from palimpsest.plans.match import parse


def test_seeds_are_the_regexes(spark):
    """On words that hold one another, marks, case in other scripts, edges and signs."""
    rng = random.Random(4)
    bits = ["Acme", "acme corp", "corp", "éa", "É", "Straße", "ΣΑΣ", "a.b", "(x)", "日本", "本", "İ", "K9", "_u", "a"]
    names = bits + [f"{x} {y}" for x in bits[:6] for y in bits[6:9]]
    texts = ["".join(rng.choices([*bits, " ", " ", "-", "_", "é", "́", ".", "ACME", "Corp", "σας"], k=rng.randint(0, 25))) for _ in range(300)] + [None, ""]
    drawers = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "drawer_uid string, content string").repartition(5)
    seeds = [(n, "t", ["alias " + n] if i % 2 else []) for i, n in enumerate(names)]
    want = {tuple(r) for r in graph.link(drawers, seeds).collect()}
    table = spark.createDataFrame([(n, t, a or None) for n, t, a in seeds], "name string, type string, aliases array<string>")
    got = [tuple(r) for r in graph.link_all(drawers, table).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 200


def test_entries_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([("x", "one two three"), ("y", "Two"), ("z", None)], "key string, text string")
    entries = spark.createDataFrame([(1, "one"), (2, "two"), (2, "two"), (3, "two three"), (4, ""), (5, None)], "entry long, words string")
    want = [("x", 1), ("x", 2), ("x", 3), ("y", 2)]
    assert sorted(map(tuple, dictionary.find(rows, "key", "text", entries).collect())) == want
    monkeypatch.setattr(dictionary, "BYTES", 25)
    assert sorted(map(tuple, dictionary.find(rows, "key", "text", entries.distinct()).collect())) == want
    assert dictionary.find(rows, "key", "text", entries.limit(0)).count() == 0


def test_a_hundred_thousand_seeds():
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("abcdefgh", k=rng.randint(4, 9))) for _ in range(100_000)})
    found = dictionary.Automaton(list(enumerate(words)))
    text = " ".join(rng.choices(words, k=2_000) + ["zzzz", "abc"])
    assert [words[n] for n in found.numbers(text)] == sorted(set(re.findall(r"\w+", text)) & set(words))


def near(text, phrases, within):
    """Occurrences by phrase that lie in a full span."""
    words = text.split()
    every = [(s, s + len(p), i) for i, p in enumerate(phrases) for s in range(len(words) - len(p) + 1) if words[s : s + len(p)] == p]
    hits = set()
    for a in every:
        own = [x for x in every if a[0] <= x[0] <= a[1] + within]
        if {x[2] for x in own} == set(range(len(phrases))):
            hits.update(own)
    return [sum(x[2] == i for x in hits) for i in range(len(phrases))]


def test_near_is_a_sweep(spark):
    rng = random.Random(2)
    texts = {f"d{i}": " ".join(rng.choices("a b c d e f".split(), k=rng.randint(1, 40))) for i in range(60)}
    built = index.build(spark.createDataFrame(list(texts.items()), "drawer_uid string, content string"))
    for query, phrases, within in (("NEAR(a b, 1)", [["a"], ["b"]], 1), ('NEAR("a b" c d, 2)', [["a", "b"], ["c"], ["d"]], 2)):
        got = {r["uid"]: r["score"] for r in built.match(parse(query)).collect()}
        assert set(got) == {u for u, t in texts.items() if sum(near(t, phrases, within))}


def test_near_over_a_long_text(spark):
    """As many occurrences as a sixth of 600,000 words each, in the time of a sort."""
    rng = np.random.default_rng(0)
    text = " ".join(rng.choice(["the", "of", "w", "x", "y", "z"], 600_000))
    built = index.build(spark.createDataFrame([("d", text), ("e", "the of")], "drawer_uid string, content string"))
    assert {r["uid"] for r in built.match(parse("NEAR(the of, 3)")).collect()} == {"d", "e"}


@pytest.mark.parametrize("values", [[], [5.0], [1.0, 2.0], [3.0] * 50 + [7.0], list(np.random.default_rng(1).normal(size=2_001))])
def test_quantiles(spark, values):
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5)
    got = evaluate.latency(rows, "v").first()
    assert tuple(got) == (tuple(round(float(np.quantile(values, p)), 9) for p in (0.5, 0.95, 0.99)) if values else (None,) * 3)
    assert rows.agg(F.count("*")).first()[0] == len(values) + 1
