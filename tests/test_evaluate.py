import json

import pytest

from palimpsest import tools
from palimpsest.functions.validate import file_path, query_string
from palimpsest.operators import evaluate


def test_known_items(spark, tmp_path):
    drawers, queries = evaluate.known_item_corpus(spark)
    again, _ = evaluate.known_item_corpus(spark)
    assert 400 <= drawers.count() <= 800 and drawers.select("drawer_uid").exceptAll(again.select("drawer_uid")).count() == 0 and queries.count() == 50
    drawers.select("content", "created_at", "position_in_thread", "role", "source", "source_id", "thread_id").write.json(str(tmp_path / "d"))
    queries.write.json(str(tmp_path / "q"))
    report = evaluate.run(*evaluate.read_corpus(spark, str(tmp_path / "d"), str(tmp_path / "q")))
    assert report["recall_at_k"] == report["mrr"] == 1 and report["precision_at_k"] == pytest.approx(0.1) and report["drawers_per_second"] > 0 and report["p50"] <= report["p99"]
    files = evaluate.write_report(report, str(tmp_path / "out"))
    assert len(files) == 2 and json.loads(open(files[0]).read())["n_queries"] == 50
    assert len(evaluate.write_report(report, str(tmp_path / "out"), "md")) == 1


def test_values():
    assert str(file_path("a/con.txt", windows=False)) == "a/con.txt"
    for bad, windows in (("a\0b", False), ("a/con.txt", True), ("LPT1", True)):
        with pytest.raises(ValueError):
            file_path(bad, windows)
    assert query_string('say "x"') == '"say ""x"""' and query_string("a OR b", "raw") == "a OR b"
    for bad in ((5, "literal"), ("x", "odd")):
        with pytest.raises(ValueError):
            query_string(*bad)


def test_tools_register():
    class Server(dict):
        def tool(self, name):
            return lambda f: self.setdefault(name, f)

    server = Server()
    tools.register(server, None)
    assert sorted(server) == ["recall_drawer", "recall_forget", "recall_graph_query", "recall_search", "recall_status"]
