"""Language ID, secrets, licences and mixing: what their models must do beyond the operators' tests."""

import base64
import hashlib
import math
import random
import string
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import language, licenses, mixing, secrets

from ..conftest import SF


def grams(text):
    found, at = language._grams([text], language.ORDERS, language.BITS)
    assert at.tolist() == [0, len(text)]
    return [int(x) for g in found for x in g]


def test_language_is_naive_bayes(spark, monkeypatch):
    """Against counts and logarithms taken one by one; scored a few n-grams at a time."""
    monkeypatch.setattr(language, "GRAMS", 7)
    rng = random.Random(1)
    kinds = {"x": "abcde ", "y": "cdefgh ", "z": "aeiou lmn"}
    rows = [(i, "".join(rng.choices(kinds[k], k=rng.randint(1, 80))), k) for i, k in enumerate(rng.choices(list(kinds), k=90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    own = docs.where(~language.held_out(F.col("doc_id")))
    learnt = {r["doc_id"] for r in own.collect()}
    model = language.train(own.repartition(3))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, model, ("doc_id",)).collect()}
    size = 1 << language.BITS
    counts = {k: Counter(g for i, t, lang in rows if i in learnt and lang == k for g in grams(t)) for k in kinds}
    prior = Counter(lang for i, _, lang in rows if i in learnt)
    for i, t, _ in rows:
        if not any(map(str.isalpha, t)):
            assert got[i] == ("und", 0)
            continue
        total = {k: math.log(prior[k] / len(learnt)) + sum(math.log((counts[k][g] + 0.5) / (sum(counts[k].values()) + 0.5 * size)) for g in grams(t)) for k in kinds}
        top = max(total.values())
        best = max(sorted(total), key=lambda k: total[k])
        assert got[i][0] == best and got[i][1] == pytest.approx(1 / sum(math.exp(v - top) for v in total.values()), abs=1e-3)


def test_sums_by_blocks(monkeypatch):
    rng = np.random.default_rng(0)
    table, g = rng.normal(size=(50, 3)), rng.integers(0, 50, 400)
    at = np.array([0, 1, 1 + 99, 250, 251, 400])
    want = np.array([table[g[a:b]].sum(0) for a, b in zip(at, at[1:], strict=False)])
    for block in (1, 3, 50, 400, 1000):
        monkeypatch.setattr(language, "GRAMS", block)
        assert np.allclose(language._text_sums(table, g, at), want)


def test_credentials_that_were_not_fitted_on(spark):
    """Half of each kind's samples are fitted on. Of the other half most are found, and hardly any ordinary long token is."""
    samples = secrets.format_samples(200)
    rng = random.Random(6)
    words = ["".join(rng.choices("etaoinshrdlucmfwypvbgk", k=rng.randint(3, 10))) for _ in range(800)]
    model = {k: secrets.Automaton(sorted(v[:100])).table() for k, v in samples.items()}, secrets.ordinary(words[:400])
    found = sum(bool(secrets.learned_spans(f"see {s} here", [], model)) for v in samples.values() for s in v[100:])
    # joined words with a number, as in paths and names of files
    plain = ["-".join(rng.choices(words[400:], k=3)) + f"-{rng.randrange(100)}" for _ in range(400)]
    wrong = sum(bool(secrets.learned_spans(f"see {s} here", [], model)) for s in plain)
    assert found >= 0.7 * 400 and wrong <= 0.01 * 400


def test_long_labels_are_not_fitted_on(spark):
    long = "password=" + "Ab1" * 400
    docs = spark.createDataFrame([(1, long), (2, "password=abcdef123")], "doc_id long, text string")
    assert [v for k, v in secrets._labelled(docs, 10) if k == "assign"] == ["abcdef123"]
    assert {r["doc_id"]: r["n_assign"] for r in secrets.scan(docs).collect()} == {1: 1, 2: 1}


def test_licences_are_whole_texts(spark):
    text, name = licenses.TEXTS["MIT"], "MIT"
    rows = [(1, text), (2, text + "\n\nИ ещё один абзац"), (3, "Copyright (c) 2020 A B\n\n" + text.upper()), (4, "x" + text), (5, "Eine Lizenz für Bären, Ähnliches"), (6, "Eine Lizenz f r B ren  hnliches"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(docs).collect()}
    assert got == {1: name, 2: None, 3: name, 4: None, 5: None, 6: None, 7: None}
    known = licenses.known_digests(spark.createDataFrame([("own", "eine LICENCE fur"), ("Bären", "Eine Lizenz für Bären; ähnliches.")], "license string, text string"))
    got = {r["doc_id"]: r["license"] for r in licenses.scan(docs, known).collect()}
    assert got[5] == "Bären" and got[6] is None and got[1] is None


def test_rows_without_an_id_draw_for_themselves(spark):
    rows = [(None, f"text {i} " * 5, "a") for i in range(200)] + [(None, "one more " * 400, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, weights=(1, 5)).where("source = 'a'").groupBy("text").count().collect()
    rate = mixing.mix_report(docs, weights=(1, 5)).where("source_size = 2000").first()["rate"]
    # of 2,800 words a sixth is for a, which has 2,000
    assert rate == pytest.approx(7 / 30)
    assert 25 <= len(mixed) <= 70 and {r["count"] for r in mixed} == {1}


def test_other_scripts_are_rejected(spark):
    rng = random.Random(12)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(2, 8)))
    rows = [(i, " ".join(word("abcdefgh" if i % 2 else "mnopqrst") for _ in range(rng.randint(5, 200))), "ab"[i % 2]) for i in range(200)]
    rows += [(1000, " ".join(word("абвгдежз") for _ in range(100)), None), (1001, "漢字仮名交文 " * 50, None), (1002, None, None), (1003, "12 34", None)]
    kept = {r["doc_id"] for r in language.accept(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert kept == set(range(200))


def ordinary_tokens(rng, words):
    """Six and more kinds of long tokens that are no secrets, by kind."""
    raw = lambda n: bytes(rng.randrange(256) for _ in range(n))
    letters = string.ascii_letters + string.digits
    return {
        "uuid": lambda: str(uuid.UUID(bytes=raw(16))), "digest": lambda: hashlib.sha1(raw(9)).hexdigest()[: rng.choice([16, 20, 23])].upper(), "base64": lambda: base64.b64encode(raw(rng.randint(12, 40))).decode(),
        "url": lambda: base64.urlsafe_b64encode(raw(rng.randint(12, 40))).decode().rstrip("="), "time": lambda: f"20{rng.randrange(10, 30)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}T{rng.randrange(10, 24)}.{rng.randrange(10, 60)}Z",
        "camel": lambda: "".join(w.capitalize() for w in rng.choices(words, k=3)) + str(rng.randrange(1000)), "path": lambda: "/".join(rng.choices(words, k=4)) + str(rng.randrange(100)),
        "snake": lambda: "_".join(rng.choices(words, k=4)) + f"_v{rng.randrange(100)}", "number": lambda: "id-" + "".join(rng.choices(string.digits, k=24)), "chance": lambda: "".join(rng.choices(letters, k=rng.choice([32, 39, 40]))),
    }


def test_ordinary_tokens_are_no_secrets(spark, tmp_path):
    """Fitted as a scan fits, on the smallest table: each kind of credential that wasn't fitted on is found, and no kind of ordinary token."""
    rng = random.Random(6)
    model = secrets.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    words = ["".join(rng.choices("etaoinshrdlucmfwypvbgk", k=rng.randint(3, 10))) for _ in range(400)]
    found = lambda s: bool(secrets.learned_spans(f"see {s} here", [], model))
    for kind, made in secrets.format_samples(500).items():
        assert sum(map(found, made[200:])) >= 0.9 * 300, kind
    wrong = {kind: sum(found(make()) for _ in range(300)) for kind, make in ordinary_tokens(rng, words).items()}
    assert max(wrong.values()) <= 0.01 * 300, wrong


def test_one_state_has_no_format():
    rng = random.Random(1)
    table = secrets.Automaton(["".join(rng.choices("0123456789abcdef", k=rng.randint(20, 50))) for _ in range(300)]).table()
    assert len(table) == 2 and not secrets.learned_spans("x 1234567890abcdef1234567890abcdefAA y", [], ({"hex": table}, {}))
