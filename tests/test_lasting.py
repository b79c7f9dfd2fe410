"""What must last in a store: an index that is fresh, locks, extraction runs, migrations, and what a crash leaves."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from palimpsest import cli, tools
from palimpsest.functions.text import decode_bytes, tokens
from palimpsest.operators import extraction, graph, index, rerank
from palimpsest.operators.ranges import running_sum
from palimpsest.plans.bm25 import Index
from palimpsest.plans.match import literal
from palimpsest.schemas import empty
from palimpsest.sources.common import Extracted
from palimpsest.store import Locked, Store

LONG = "and enough further words to be worth a record of its own"


def note(folder, name, text):
    (folder / f"{name}.md").write_text(f"{text} {LONG}")


@pytest.fixture
def notes(spark, tmp_path):
    folder = tmp_path / "notes"
    folder.mkdir()
    note(folder, "one", "zebra crossing")
    store = Store(spark, str(tmp_path / "store"), clock=lambda: 5)
    source = {"name": "notes", "type": "markdown", "path": str(folder)}
    assert store.index_all([source]) == {"notes": 1}
    return store, source, folder


def hits(store, query):
    return [h["snippet"].split()[0] for h in tools.search(store, query)["hits"]]


def test_search_sees_what_was_indexed_last(notes, spark):
    store, source, folder = notes
    assert hits(store, "zebra") == ["zebra"]
    store.reindex()
    note(folder, "two", "quagga crossing")
    assert store.index_all([source]) == {"notes": 1}
    assert hits(store, "quagga") == ["quagga"] and len(hits(store, "crossing")) == 2
    # scores are those of one index over all drawers
    want = index.build(store.read("drawers")).match(literal("crossing")).collect()
    got = store.index().match(literal("crossing")).collect()
    assert {(r["uid"], round(r["score"], 9)) for r in got} == {(r["uid"], round(r["score"], 9)) for r in want}
    store.reindex(2)
    assert len(hits(store, "crossing")) == 2
    assert store.read("index_state").agg(F.sum("drawer_count")).first()[0] == 2


def test_drawers_without_a_part_of_the_index(notes):
    """A driver that died between storing drawers and marking their part."""
    store, source, folder = notes
    note(folder, "two", "quagga crossing")
    store.index_all([source])
    marks = store._fs.globStatus(store._file(f"{store.path}/index/v*/*/_DONE"))
    assert len(marks) == 2
    store._fs.delete(marks[1].getPath(), False)
    assert sorted(hits(store, "crossing")) == ["quagga", "zebra"] and store.index().stats.first()["n"] == 2


def test_locks_that_were_left(notes):
    store, *_ = notes
    store._fs.createNewFile(store._file(f"{store.path}/_lock"))
    with pytest.raises(Locked), store.writing():
        pass
    with pytest.raises(Locked), store.writing(wait=0.2):
        pass
    store.stale = 0
    with store.writing():
        pass


def test_errors_are_noted_once(notes, spark):
    store, *_ = notes
    found = Extracted(empty(spark, "drawers"), spark.createDataFrame([("/p", "bad")], "source_path string, reason string"))
    for once, n in (("c#1", 1), ("c#1", 1), ("c#2", 2), (None, 3)):
        store.add(found, "s", once=once)
        assert store.read("ingest_errors").count() == n


class Fake:
    def complete(self, prompt):
        return extraction.Answer(json.dumps({"entities": [prompt[:5]]}), 10, 10)


def test_extraction_runs_last(notes, spark):
    store, source, folder = notes
    note(folder, "two", "quagga crossing")
    store.index_all([source], enqueue=True)
    assert store.read("extract_pending").count() == 1
    runner = extraction.Runner(spark, "gpt-4o", Fake(), clock=lambda: 9)
    uid = store.read("drawers").where("content LIKE 'zebra%'").first()["drawer_uid"]
    assert store.extract(runner, uid)[0]["entities"] == ["zebra"]
    with pytest.raises(LookupError):
        store.extract(runner, "nobody")
    assert [r["status"] for r in store.extract(runner)] == ["success"] and store.extract(runner) == []
    assert sorted(r["id"] for r in store.read("extraction_runs").collect()) == [1, 2] and store.read("extract_pending").count() == 0


def test_migrations(notes, spark):
    store, *_ = notes
    versions = store.read("schema_version")
    store.replace("schema_version", versions.withColumn("version", F.lit(1)))
    store.create()
    assert {(r["version"], r["status"]) for r in store.read("schema_version").collect()} == {(1, "applied"), (2, "applied")}
    store.replace("schema_version", spark.createDataFrame([(2, 1, "x", "in_progress")], versions.schema))
    with pytest.raises(RuntimeError, match="did not finish"):
        store.create()
    store.baseline()
    store.create()


def test_broken_tables_come_back(notes, tmp_path):
    store, source, _ = notes
    store.snapshot(str(tmp_path / "copy"))
    n = store._version("drawers")
    for f in (tmp_path / "store" / "drawers" / f"v{n}").glob("*.parquet"):
        f.write_bytes(b"PAR1 broken")
    for f in (tmp_path / "store" / "drawers" / f"v{n}").glob(".*.crc"):
        f.unlink()
    assert list(store.check()) == ["drawers"]
    assert list(store.rebuild(str(tmp_path / "copy"))) == ["drawers"] and not store.check()
    assert hits(store, "zebra") == ["zebra"]


def test_cli_open(notes, spark, capsys, monkeypatch):
    store, _, folder = notes
    uid = store.read("drawers").first()["drawer_uid"]
    run = lambda *a: cli.main(["--db", store.path, *a], spark)
    assert run("search", "--open", uid) == 0 and capsys.readouterr().out.strip() == str(folder / "one.md")
    assert run("search", "--open", "nobody") == 2 and run("migrate", "--baseline-from-existing") == 0 and run("migrate", "--status") == 0
    with pytest.raises(SystemExit) as e:
        cli.main(["--version"])
    assert e.value.code == 0
    begun = []
    monkeypatch.setattr(cli.subprocess, "Popen", lambda command, **_: begun.append(command) or type("P", (), {"pid": 7}))
    monkeypatch.setattr(cli.sys, "argv", ["palimpsest", "--db", store.path, "index", "--bg"])
    assert cli.main(None, spark) == 0 and "--bg" not in begun[0] and begun[0][-1] == "index"


def test_decoding():
    text = "“naïve” café"
    assert decode_bytes(text.encode("utf-16")) == text and decode_bytes(b"\xfe\xff" + text.encode("utf-16-be")) == text
    assert decode_bytes(text.encode("cp1252")) == text and decode_bytes("café".encode("latin-1")) == "café"
    assert decode_bytes(b"\xff\xfea") is not None


def test_names_are_composed(spark):
    seen = spark.createDataFrame([(unicodedata.normalize(f, "Café"), "place", None, "s", i) for i, f in enumerate(("NFC", "NFD"))], "name string, type string, metadata string, source string, at long")
    assert [(r["name"], r["last_seen"]) for r in graph.upsert_entities(empty(spark, "entities"), seen).collect()] == [("Café", 1)]
    rows = spark.createDataFrame([('{"a": 1, "b": "x"}',), ("[1]",), ("{",), ("3",), (None,)], "m string")
    assert [r[0] for r in rows.select(graph.decoded_metadata(F.col("m"))).collect()] == [{"a": "1", "b": "x"}, {}, {}, {}, {}]
    mentions = graph.link_entity_in_drawer(empty(spark, "drawer_entity_mentions"), "d", 3, predicate="USES", valid_from=1)
    assert [tuple(r) for r in mentions.collect()] == [("d", 3, 1.0, "manual", 0)]


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(20), f"u{i}", float(rng.randrange(9))) for i in range(300)]
    got = running_sum(spark.createDataFrame(rows, "a long, u string, v double").repartition(5), ["a", "u"], F.col("v"), "s").collect()
    total, want = 0.0, {}
    for a, u, v in sorted(rows):
        total += v
        want[u] = total
    assert {r["u"]: r["s"] for r in got} == want
    assert running_sum(spark.createDataFrame([], "a long, u string, v double"), ["a", "u"], F.col("v"), "s").count() == 0


def test_batch_is_the_single_query(spark):
    rng = random.Random(7)
    words = "a b c d e f the the the the".split()
    docs = spark.createDataFrame([(f"d{i}", " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(80)], "drawer_uid string, content string")
    built = index.build(docs)
    kept = Index(built.postings.persist(), built.lengths.persist(), built.stats)
    queries = ["the", "the the", "a the the", "the a the a", "f e", "b b b", "zzz", "the zzz the"]
    table = spark.createDataFrame(list(enumerate(queries)), "qid long, q string").select("qid", tokens(F.col("q")).alias("terms"))
    got = {}
    for r in kept.match_all(table).collect():
        got.setdefault(r["qid"], {})[r["uid"]] = round(r["score"], 9)
    for i, q in enumerate(queries):
        assert got.get(i, {}) == {r["uid"]: round(r["score"], 9) for r in kept.match(literal(f'"{q}"')).collect()}, q


def test_probe_of_the_model(monkeypatch):
    monkeypatch.setattr(rerank.importlib.util, "find_spec", lambda name: None)
    assert rerank.default_scorer() is None
    monkeypatch.setattr(rerank.importlib.util, "find_spec", lambda name: object())
    assert callable(rerank.default_scorer("m"))


def test_tools_have_their_own_signature(notes):
    store, *_ = notes
    found = tools.bound(store, tools.search)
    assert list(__import__("inspect").signature(found).parameters)[:2] == ["query", "top_k"] and found("zebra")["hit_count"] == 1
