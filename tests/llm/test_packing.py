"""Packing against the tokenizers library and brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import packing, queries

from ..conftest import SF
from .test_operators import docs, none, odd  # noqa: F401


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.MODEL)


ODD = ["", " ", "Don't STOP'S 'll l'Été naïve ÀÉ× 1234 a1b2 <|endoftext|> x<|startoftext|>y <|ENDOFTEXT|> ", "日本語 текст ΟΔΟΣ a̸= ≠ \x00\x01a\x1cb", "'s", "''s a'", "<|", "a<|b|>c", "½ ² ٣ ǅ İ ŉ ẞ", "\x85a\x0bb\x0cc"]


def test_ids_are_the_librarys(library):
    rng = random.Random(0)
    texts = [None, *ODD, *("".join(rng.choices("aB1.'<|>é×÷ŉİßЖ日̸́ \n\x00\x1c«»ºª²½ǅ-_", k=rng.randint(1, 40))) for _ in range(2000))]
    for few in (3, packing.KEPT):  # also where units are forgotten
        own = packing.Tokens(packing.MODEL)
        packing.KEPT, old = few, packing.KEPT
        try:
            got = [own.encode(texts[i : i + 300]) for i in range(0, len(texts), 300)]
        finally:
            packing.KEPT = old
        assert [x.tolist() for g in got for x in g] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def check(rows, texts, library, room, end=packing.END):
    """Each id in one piece, sequences gapless and within their room; returns the tokens and the sequences."""
    left, sequences = {}, {}
    for r in rows:
        left.setdefault(r["doc_id"], []).append((r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert left.keys() == texts.keys()
    for i, t in texts.items():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, end], "<u4").tobytes()
        own = sorted(left[i])
        assert b"".join(x[2] for x in own) == ids and {x[3] for x in own} == {len(ids) // 4}
        assert [x[0] for x in own] == [sum(y[1] for y in own[:k]) for k in range(len(own))] and all(4 * x[1] == len(x[2]) for x in own)
    full = 0
    for own in map(sorted, sequences.values()):
        assert [x[0] for x in own] == [sum(y[1] for y in own[:k]) for k in range(len(own))]
        n = sum(x[1] for x in own)
        assert 0 < n <= room
        full += n
    return full, len(sequences)


def test_whole_table(spark, docs, library):  # noqa: F811
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = packing.pack(docs).collect()
    full, n = check(rows, texts, library, packing.ROOM)
    assert n <= 1.005 * full / packing.ROOM + 1  # besides the last sequence
    got = {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in queries.op11_packing(spark, SF).collect()}
    assert got == {(r["doc_id"], r["start"], r["length"], zlib.crc32(bytes(r["ids"]))) for r in rows}


@pytest.mark.parametrize("room", [1, 7, 64, 1000])
def test_rooms(spark, library, room):
    rng = random.Random(room)
    texts = {i: " ".join(rng.choices(["a", "of", "Zürich", "x1"], k=int(rng.lognormvariate(3, 1)))) for i in range(150)} | {900: None, 901: "", 902: ODD[3]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)  # noqa: F811
    check(packing.pack(docs, room=room).collect(), texts, library, room)


def test_odd_rows(odd, none, library):  # noqa: F811
    assert packing.pack(none).count() == 0 and none.sparkSession.sql("select 1").count() == 1
    rows = packing.pack(odd).collect()
    data = odd.select("doc_id", "text").collect()
    assert sum(r["length"] for r in rows) == sum(len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in data)
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert sum(r["doc_id"] is None and r["start"] == 0 for r in rows) == 2


def test_one_length_holds_most_rows(spark):
    """A third of all rows, and more, of one length are dealt out over their places one by one."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "a b c").otherwise(F.repeat(F.lit("of "), (F.col("id") % 900).cast("int"))).alias("text"))  # noqa: F811
    rows = packing.pack(docs.repartition(7)).toPandas()
    per = rows.groupby("sequence_id")["length"].sum()
    assert per.max() <= packing.ROOM and len(rows) == 3000 and per.sum() == rows["length"].sum()
    assert per.sum() / (packing.ROOM * len(per)) > 0.98


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_the_demand(seed):
    rng = np.random.default_rng(seed)
    room = (100, 100, 1000, 4096)[seed]
    sizes = np.unique(rng.integers(1, room + 1, 40))
    demand = rng.integers(1, 10 ** (seed + 1), len(sizes))
    base, x = packing.generate(sizes, demand, room)
    assert (sizes @ base <= room + 1e-6).all() and np.allclose(base @ x, demand)
    found = packing.plan(sizes, demand, room)
    assert all(sizes @ p <= room and n > 0 for p, n in found) and (sum(p * n for p, n in found) == demand).all()
    assert x.sum() >= sizes @ demand / room - 1e-6 and sum(n for _, n in found) <= x.sum() + len(sizes)


def test_program_finds_what_filling_up_misses():
    """Halves and thirds of a room: filling up from the longest wastes a tenth, the program nothing."""
    sizes, demand = np.array([28, 33, 39, 50]), np.array([300, 300, 300, 200])
    _, x = packing.generate(sizes, demand, 100)
    assert x.sum() == pytest.approx(sizes @ demand / 100, rel=1e-6)
    assert sum(n for _, n in packing.plan(sizes, demand, 100)) <= 402


def test_classes():
    n = np.arange(1, 4097)
    kind = packing.class_of(n)
    assert (kind >= n).all() and (kind - n <= np.maximum(0, n / 128)).all() and (np.diff(kind) >= 0).all()
    assert len(np.unique(kind)) <= packing.EXACT * 3 and kind[-1] == 4096
