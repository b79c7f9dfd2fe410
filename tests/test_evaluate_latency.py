"""The report's percentiles are of all queries."""

from palimpsest.operators import evaluate


def test_every_query_is_timed(spark, monkeypatch):
    timed = []
    latency = evaluate.latency
    monkeypatch.setattr(evaluate, "latency", lambda samples, column: timed.append(samples.count()) or latency(samples, column))
    report = evaluate.run(*evaluate.known_item_corpus(spark, threads=10, queries=7))
    assert timed == [7] and report["n_queries"] == 7
