"""Source divergence against SQL and brute force."""

import re
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import divergence

from .test_operators import docs, none, odd  # noqa: F401

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(rows, least=30, top=50):
    """rows: (text, lang, source)"""
    rows = [(t or "", lang or "", s or "") for t, lang, s in rows]
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for t, lang, s in rows:
        terms = TERM.findall(t.translate(LOWER))
        counts[lang, s].update(terms)
        held[lang].update(set(terms))
    out = set()
    for lang in {r[1] for r in rows}:
        kept = [t for t, n in held[lang].items() if n >= least]
        own = sorted(s for x, s in counts if x == lang)

        def share(c, kept=kept):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        p = {s: share(counts[lang, s]) for s in own}
        q = share(sum((counts[lang, s] for s in own), Counter()))
        for s in own:
            found = {"pair": [(x, sum(abs(p[s][t] - p[x][t]) for t in kept)) for x in own if x != s], "term": [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]}
            for part, items in found.items():
                items.sort(key=lambda e: (-e[1], e[0].encode()))
                out |= {(lang, s, part, x, v, i) for i, (x, v) in enumerate(items[: top if part == "term" else None], 1)}
    return out


def got(df, **how):
    return {tuple(r) for r in divergence.audit(df, **how).collect()}


@pytest.mark.parametrize("cells, strip", [(divergence.CELLS, divergence.STRIP), (50, 1), (200, 3)])
def test_blocks_and_strips(spark, docs, monkeypatch, cells, strip):  # noqa: F811
    """However terms are blocked and sources are cut into strips; rows' functions are sent to Python with the module's values."""
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "STRIP", strip)
    rows = docs.select("text", "lang", "source").collect()
    assert got(docs, least=20 if cells == 50 else 30) == brute(rows, 20 if cells == 50 else 30)


def test_odd_rows(odd, none, docs):  # noqa: F811
    assert got(none) == set()
    for least in (1, 2, 30):
        own = odd.where("doc_id is null or doc_id <> 4") if least == 1 else odd
        assert got(own, least=least) == brute([(r["text"], r["lang"], r["source"]) for r in own.collect()], least)
    nothing = docs.withColumn("text", F.lit("12 -- "))
    assert {r[4] for r in got(nothing)} == {0} and {r[2] for r in got(nothing)} == {"pair"}


def test_one_source_and_word_in_most_rows(spark):
    rows = [(f"the {'The ' * (i % 5)} w{chr(97 + i % 11)} é{'x' if i % 2 else 'É'}", "en", "hot" if i % 3 else f"s{i % 7}") for i in range(900)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(6)
    assert got(df, top=4) == brute(rows, top=4)


def test_slices_that_clash():
    x, starts, ends, doc = divergence.slices(["The cat the Cat a b c d e f été", None, "cat 日本 x1y", ""])
    words = [x[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert words == "the cat the cat a b c d e f été cat 日本 x y".split() and doc.tolist() == [0] * 11 + [2] * 4
    for hash_ in (divergence.xxh64_intdigest, lambda b, seed: 7 if seed < 3 else divergence.xxh64_intdigest(b, seed), lambda b, seed: divergence.xxh64_intdigest(b, seed) % 3):
        number, first = divergence.group(x, starts, ends, hash_)
        assert [words[first[k]] for k in number] == words and len(set(number.tolist())) == len(set(words))


def test_comparison_in_pieces(monkeypatch):
    x, starts, ends, _ = divergence.slices(["abc abd abc abcd " * 9])
    monkeypatch.setattr(divergence, "COMPARED", 5)
    number, _ = divergence.group(x, starts, ends)
    assert len(set(number.tolist())) == 3 and number[0] == number[2] != number[1]


def test_distances_of_sparse_rows():
    rng = np.random.default_rng(1)
    p, zero = rng.integers(0, 50, (6, 9)), rng.integers(0, 9, 6)
    held = rng.random((6, 9)) < 0.4
    held[2], held[:, 0] = False, held[:, 0] | (np.arange(6) == 5)
    used = held.any(0)
    dense = np.where(held, p, zero[:, None])[:, used]
    source, term = np.nonzero(held[:, used])
    a, b, value = divergence.distances(source, term, p[:, used][source, term], zero, range(0, 6))
    assert [(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True)] == [(i, j) for i in range(6) for j in range(i + 1, 6)]
    assert value.tolist() == [int(np.abs(dense[i] - dense[j]).sum()) for i, j in zip(a, b, strict=True)] and all(x <= y for x, y in pairwise(a.tolist()))
