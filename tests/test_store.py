"""Ingest, the store, its tools and the command line, over small trees."""

import json
import os

import pytest
from pyspark.sql import functions as F

from palimpsest import cli, streaming, tools
from palimpsest.operators import extraction, graph, ops
from palimpsest.plans.match import MatchError
from palimpsest.schemas import empty, seeds
from palimpsest.sources import assigned, config, export_json, markdown, reader, session_jsonl
from palimpsest.store import Locked, Store

A, B, C = "7d3e2a1b-0000-4000-8000-00000000000A", "badd1ad0-0000-4000-8000-00000000000b", "3a8f5c1e-0000-4000-8000-00000000000c"
LONG = "this is a message that is long enough to keep, number "


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    logs = root / "logs"
    (logs / C / "subagents").mkdir(parents=True)
    line = lambda **x: json.dumps(x)
    (logs / f"{A}.jsonl").write_text("\n".join([
        line(role="user", content=LONG + "1", timestamp="2024-01-01T00:00:00Z", uuid="u1"), line(role="assistant", content=[{"type": "text", "text": LONG}, {"type": "tool_use", "text": "no"}, "2"], ts=1_700_000_000_000),
        line(role="user", content="ok"), line(role="user", content="/clear"), line(role="system", content=LONG), line(role="human", content=LONG + "3", created_at=1_700_000_001.9), "",
    ]))
    (logs / f"{B}.jsonl").write_text("\n".join([line(role="user", content=LONG + "4"), "{not json", "[1]", line(type="assistant", message={"role": "model", "content": LONG + "5", "model": "m"}), line(type="tool_result", message={"role": "user", "content": LONG})]))
    (logs / C / "main.jsonl").write_text(line(type="user", message={"role": "user", "content": LONG + "6"}))
    (logs / C / "subagents" / "agent-1.jsonl").write_text(line(sender="human", content=LONG + "7"))
    (logs / "stray.jsonl").write_text(line(role="user", content=LONG))
    (root / "export").mkdir()
    message = lambda n, **x: {"uuid": f"m{n}", "sender": "human", "text": LONG + str(n), "created_at": "2024-01-01T00:00:00+00:00"} | x
    (root / "export" / "conversations.json").write_text(json.dumps([
        {"uuid": "alpha", "chat_messages": [message(1), message(2, text="hi"), message(3, sender="assistant")], "messages": [message(9)]},
        {"id": "beta", "messages": [message(4, text=" ", content=[{"type": "text", "text": LONG}, {"type": "x", "content": "inner"}]), 5, message(6, sender="system")]},
        {"name": "no id"}, {"uuid": "gamma"}, "odd",
    ]))
    notes = root / "notes"
    (notes / "memory").mkdir(parents=True)
    (notes / "wiki").mkdir()
    (notes / "memory" / "s.md").write_text("﻿# Session\n" + LONG)
    (notes / "wiki" / "long.markdown").write_text("\n".join(f"line {i} of a long file" for i in range(121)))
    (notes / "latin.md").write_bytes(("caf\xe9 " + LONG).encode("latin-1"))
    (notes / "skip.txt").write_text(LONG)
    return root


def test_session_logs(spark, tree):
    found = session_jsonl.extract(spark, str(tree / "logs"))
    rows = {(r["source_id"], r["content"][-1]): r for r in found.drawers.collect()}
    assert len(rows) == 7
    a = A.lower()
    assert [rows[f"{a}:{i}", str(i + 1)]["created_at"] for i in range(3)] == [1_704_067_200, 1_700_000_000, 1_700_000_001]
    assert rows[f"{a}:1", "2"]["content"] == LONG + "\n2" and rows[f"{a}:1", "2"]["parent_uid"] == rows[f"{a}:0", "1"]["drawer_uid"]
    assert rows[f"{B}:1", "5"]["role"] == "assistant" and rows[f"{B}:1", "5"]["metadata"]["model"] == "m"
    assert rows[f"{C}:0", "7"]["thread_id"] == rows[f"{C}:0", "6"]["thread_id"] == C and rows[f"{C}:0", "7"]["metadata"]["subagent_file"] == "agent-1"
    reasons = sorted(r["reason"] for r in found.errors.collect())
    assert reasons == ["bad JSONL at line 2", "cannot determine session UUID", "non-object JSONL record at line 3"]


def test_exports(spark, tree, tmp_path):
    found = export_json.extract(spark, str(tree / "export"))
    rows = {r["source_id"]: r for r in found.drawers.collect()}
    assert set(rows) == {"alpha:0", "alpha:2", "beta:0"}
    assert rows["alpha:2"]["parent_uid"] == rows["alpha:0"]["drawer_uid"] and rows["alpha:2"]["position_in_thread"] == 1
    assert rows["beta:0"]["content"] == LONG + "\ninner"
    assert sorted(r["reason"] for r in found.errors.collect()) == ["conversation gamma has no message array", "conversation without uuid", "non-object conversation", "non-object message in conversation beta index 1"]
    for text, reason in (("{", "invalid JSON"), ("{}", "expected top-level JSON array")):
        (tmp_path / "conversations.json").write_text(text)
        assert [r["reason"] for r in export_json.extract(spark, str(tmp_path)).errors.collect()] == [reason]
    (tmp_path / "conversations.json").write_text("[]")
    found = export_json.extract(spark, str(tmp_path))
    assert found.drawers.count() == found.errors.count() == 0


def test_markdown(spark, tree):
    rows = {r["source_id"]: r for r in markdown.extract(spark, str(tree / "notes"), root=str(tree / "notes"), whole=10).drawers.collect()}
    assert set(rows) == {"memory/s.md:1", "latin.md:1", "wiki/long.markdown:1", "wiki/long.markdown:46", "wiki/long.markdown:91"}
    assert rows["memory/s.md:1"]["role"] == "memory" and rows["latin.md:1"]["role"] == "wiki"
    assert rows["memory/s.md:1"]["content"].startswith("# Session") and rows["latin.md:1"]["content"].startswith("caf\xe9")
    assert rows["wiki/long.markdown:91"]["content"].splitlines()[0] == "line 90 of a long file"
    for bad in ({"size": 0}, {"size": 5, "overlap": 5}):
        with pytest.raises(ValueError):
            markdown.extract(spark, str(tree / "notes"), **bad)


def test_first_reader_wins(spark):
    files = spark.createDataFrame([(f"/x/{A}.jsonl",), ("/x/Conversations.JSON",), ("/x/a.MD",), ("/x/a.jsonl",), ("/x/a.txt",)], "path string")
    assert {r["path"]: r["type"] for r in assigned(files).collect()} == {f"/x/{A}.jsonl": "claude_code", "/x/Conversations.JSON": "claude_ai", "/x/a.MD": "markdown"}
    with pytest.raises(ValueError):
        reader("chatgpt")


def sources(tree):
    return [
        {"name": "logs", "type": "claude_code", "path": str(tree / "logs"), "include": [], "exclude": ["*stray*"]},
        {"name": "export", "type": "claude_ai", "path": str(tree / "export")},
        {"name": "notes", "type": "markdown", "path": str(tree / "notes"), "exclude": ["wiki/*"]},
        {"name": "bad", "type": "capture", "path": "/nowhere"},
        {"name": "off", "type": "markdown", "path": "/nowhere", "enabled": False},
    ]


@pytest.fixture(scope="module")
def store(spark, tree, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")), clock=lambda: 2_000_000_000)
    done = store.index_all(sources(tree), enqueue=True, scan_risk=True)
    assert done["logs"] == 7 and done["export"] == 3 and done["notes"] == 2 and "capture" in done["bad"] and "off" not in done
    return store


def test_index_again_adds_nothing(store, tree):
    assert store.index_all(sources(tree)[:3]) == {"logs": 0, "export": 0, "notes": 0}
    assert store.index_all(sources(tree)[:3], quick=True) == {"logs": 0, "export": 0, "notes": 0}
    assert store.read("drawers").count() == store.read("extract_pending").count() == 12
    assert store.read("index_state").count() == 7
    os.utime(tree / "notes" / "latin.md", (2_100_000_000, 2_100_000_000))
    (tree / "notes" / "new.md").write_text("a new note, " + LONG)
    assert store.index_all(sources(tree)[2:3], quick=True) == {"notes": 1}


def test_tools(store):
    found = tools.search(store, "long enough", top_k=3)
    assert found["ok"] and found["hit_count"] == 3 and [h["rank"] for h in found["hits"]] == [1, 2, 3]
    assert tools.search(store, "AND", raw=True)["error"] == "fts5_query_error"
    uid = found["hits"][0]["drawer_uid"]
    assert tools.drawer(store, uid)["drawer"]["drawer_uid"] == uid and tools.drawer(store, "x")["error"] == "drawer_not_found"
    status = tools.status(store)
    assert status["drawer_count"] == sum(status["by_source"].values()) and status["schema_version"] == 2 and status["error_count"] > 0
    assert all(e["fix_hint"] for e in tools.errors(store) if "JSONL" in e["reason"])
    assert tools.graph_query(store, "nobody")["error"] == "entities_unavailable"
    assert tools.status(Store(store.spark, store.path + "-none"))["error"] == "db_not_found"


def test_forget(store):
    uid = tools.search(store, "number 6")["hits"][0]["drawer_uid"]
    assert tools.forget(store, uid[-12:], dry_run=True)["drawer_uid"] == uid and store.read("hidden_drawers").count() == 0
    assert tools.forget(store, uid, reason="test")["ok"]
    assert tools.search(store, "number 6")["hit_count"] == 0 and tools.drawer(store, uid)["ok"]
    assert tools.forget(store, "zzz")["error"] == "drawer_not_found"
    assert tools.forget(store, "claude")["error"] == "ambiguous_prefix" and len(tools.forget(store, "claude")["candidates"]) == 5


def test_one_writer(store):
    with store.writing(), pytest.raises(Locked), store.writing():
        pass
    with store.writing():
        pass


def test_verify_and_snapshot(store, spark, tmp_path):
    drawers = store.read("drawers")
    assert ops.verify(drawers, store.index().lengths, {"drawers": drawers}).where("n > 0").count() == 0
    twice = drawers.union(drawers.limit(1)).withColumn("content_hash", F.lit("x"))
    found = {r["check"]: r["n"] for r in ops.verify(twice, store.index().lengths).collect()}
    assert found["duplicate_uid"] == 1 and found["bad_hash"] == drawers.count() + 1
    bad = {"drawers": drawers.withColumn("risk_score", F.lit(101)), "entities": spark.createDataFrame([(1, "null", "t")], "id long, name string, type string")}
    assert {r["table"] for r in ops.broken_rules(bad).collect()} == {"drawers", "entities"}
    store.reindex(2)
    assert tools.search(store, "long enough")["hit_count"] > 3
    store.snapshot(str(tmp_path / "copy"))
    assert Store(spark, str(tmp_path / "copy")).read("drawers").count() == drawers.count()


def test_stream(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for expected in (2, 2):
        streaming.ingest(store, "markdown", str(tree / "notes" / "memory"), str(tmp_path / "c")).awaitTermination()
        assert store.read("drawers").count() == expected - 1
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet("/root/testdata/sf0.001/events.parquet*")
    q = streaming.event_counts(events).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM counted").first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_cli(store, spark, tree, tmp_path, capsys):
    run = lambda *a: cli.main(["--db", store.path, *a], spark)
    assert run("long enough", "--json", "--limit", "2") == 0 and len(json.loads(capsys.readouterr().out)) == 2
    assert run("search", "nothinglikethis") == 1 and run("search", "AND", "--raw") == 2 and run("search", " ") == 2
    assert run("search", "long enough", "--since", "yesterday") == 1
    assert run("status", "--json") == run("errors") == run("types", "list") == run("verify") == run("migrate") == 0
    assert run("graph", "entity", "nobody") == 1 and run("forget", "zzz") == 2
    assert cli.main(["--db", str(tmp_path / "no"), "status"], spark) == 1 and cli.main(["--db", str(tmp_path / "no"), "x y"], spark) == 2
    assert cli.main([], spark) == 0
    assert cli.main(["--config", str(tmp_path / "none.toml"), "index"], spark) == 2
    out = tmp_path / "sources.toml"
    assert cli.main(["--db", "d", "init", "--out", str(out), "--non-interactive"]) == 0 and cli.main(["init", "--out", str(out)]) == 1
    assert config.parse(out.read_text())["database"] == "d"
    out.write_text(config.render(str(tmp_path / "db"), [s for s in sources(tree)[2:3]]))
    assert cli.main(["--config", str(out), "index"], spark) == 0
    assert cli.human_bytes(1536) == "1.5 KB" and cli.epoch("1970-01-02") == 86400
    assert cli.with_command(["--db", "x", "hello"]) == ["--db", "x", "search", "hello"] and cli.with_command(["status"]) == ["status"]


@pytest.mark.parametrize(
    "text,why",
    [("x = [", "TOML"), ("schema_version = 2", "newer"), ('[[sources]]\ntype = "markdown"\npath = "p"', "name"), ('[[sources]]\nname = "a"\ntype = "odd"\npath = "p"', "type"), ('[[sources]]\nname = "a"\ntype = "markdown"', "path"), ('[[sources]]\nname="a"\ntype="markdown"\npath="p"\n[[sources]]\nname="a"\ntype="markdown"\npath="p"', "twice"), ("sources = 3", "array")],
)
def test_bad_config(text, why):
    with pytest.raises(config.ConfigError, match=why):
        config.parse(text)


def test_config(spark, tmp_path, monkeypatch):
    parsed = config.parse('[database]\npath = "d"\n[[sources]]\nname = "n"\ntype = "markdown"\npath = "/p"\nexclude = ["*.tmp"]\ndepth = 3\n')
    row = config.as_table(spark, parsed).first()
    assert row["exclude"] == ["*.tmp"] and row["options"] == {"depth": "3"} and row["enabled"]
    assert config.slug("My Notes/2024-x") == "my_notes_2024-x" and config.slug("//") == "source"
    monkeypatch.chdir(tmp_path)
    assert config.discover(env={"XDG_CONFIG_HOME": str(tmp_path / "u")}) is None
    (tmp_path / "e.toml").write_text("")
    assert config.discover(env={"PALIMPSEST_CONFIG": str(tmp_path / "e.toml"), "XDG_CONFIG_HOME": "/no"}) == tmp_path / "e.toml"
    (tmp_path / "sources.toml").write_text("")
    assert str(config.discover(env={})) == "sources.toml"
    (tmp_path / "Notes").mkdir()
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "CLAUDE.md").write_text("x")
    assert [s["name"] for s in config.suggestions(tmp_path, tmp_path)] == ["notes", "claude_md_p"]


def test_graph(spark):
    types = seeds(spark, 0)["entity_types"]
    assert types.count() == 7 and seeds(spark, 0)["predicates"].where("symmetric").count() == 2
    seen = spark.createDataFrame([("Acme", "project", "{}", "seed", 5), ("ACME", "project", None, "x", 9), ("Acme", "tool", None, "seed", 7), ("none", "tool", None, "seed", 1)], "name string, type string, metadata string, source string, at long")
    entities = graph.upsert_entities(empty(spark, "entities"), seen)
    assert sorted((r["id"], r["name"], r["type"], r["first_seen"], r["last_seen"]) for r in entities.collect()) == [(1, "Acme", "project", 5, 9), (2, "Acme", "tool", 7, 7)]
    entities = graph.upsert_entities(entities, spark.createDataFrame([("acme", "tool", None, "seed", 3)], seen.schema))
    assert sorted((r["id"], r["first_seen"], r["last_seen"]) for r in entities.collect()) == [(1, 5, 9), (2, 7, 3)]
    assert graph.find_entity(entities, "aCME").count() == 2 and graph.find_entity(entities, "acme", "tool").count() == 1
    mentions = empty(spark, "drawer_entity_mentions")
    new = spark.createDataFrame([("d", 1, 1.0, "linker", 1), ("d", 1, 0.5, "manual", 2), ("e", 1, 2.0, "linker", 1), ("f", 1, 1.0, "odd", 1), ("g", 1, 1.0, "manual", 9)], mentions.schema)
    mentions = graph.add_mentions(mentions, new)
    assert {r["drawer_uid"] for r in mentions.collect()} == {"d", "g"} and graph.add_mentions(mentions, new).count() == 2
    assert [r[0] for r in graph.drawers_of(1, mentions).collect()] == ["g", "d"] and [r["name"] for r in graph.entities_of("d", entities, mentions).collect()] == ["Acme"]


class Fake:
    def __init__(self, *answers):
        self.answers = list(answers)

    def complete(self, prompt):
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return extraction.Answer(answer, 1000, 100)


def test_extraction(spark):
    drawers = spark.createDataFrame([(f"d{i}", "text " * i) for i in range(1, 6)], "drawer_uid string, content string")
    pending = empty(spark, "extract_pending")
    new = spark.createDataFrame([(f"d{i}", i, "Q: {content}" if i == 1 else None, None) for i in range(1, 6)], pending.schema)
    pending = extraction.enqueue(extraction.enqueue(pending, new), new)
    assert pending.count() == 5
    runner = extraction.Runner(spark, "gpt-4o", Fake('{"entities": ["a"]}', RuntimeError("down"), "prose", '{"entities": []}'), budget_usd=0.0155, clock=lambda: 7)
    results, left = runner.run_pending(pending, drawers)
    assert [r["status"] for r in results] == ["success", "failed", "partial", "success", "budget_exhausted"]
    assert sorted(r["drawer_uid"] for r in left.collect()) == ["d2", "d5"]
    status = {r["drawer_uid"]: r for r in extraction.run_status(runner.runs()).collect()}
    assert status["d2"]["status"] == "failed" and status["d2"]["total_cost_usd"] == 0 and status["d1"]["total_cost_usd"] == pytest.approx(extraction.cost_of("gpt-4o", 1000, 100))
    assert runner.runs().where("error_message LIKE 'RuntimeError%'").count() == 1
    for bad in ({"budget_usd": -1}, {"model": ""}, {"prompt_version": ""}):
        with pytest.raises(ValueError):
            extraction.Runner(**{"spark": spark, "model": "m", "provider": Fake()} | bad)
    assert extraction.provider_of("claude-x") == "anthropic" and extraction.provider_of("gpt") == "openai"


def test_errors_are_named():
    assert MatchError("q", "w").query == "q"
