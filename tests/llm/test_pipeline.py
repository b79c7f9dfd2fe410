"""The pipeline, each stage on all that the one before kept."""

import corpus_pipeline
from palimpsest.llm import sentencepiece

from ..conftest import SF
from .test_operators import brute_links, odd, plain_spans, words  # noqa: F401


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        a, b = before.collect(), after.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        if name == "language":
            assert len(b) >= 0.95 * len(a)
        if name == "near duplicates":
            _, _, root = brute_links([(r["doc_id"], r["text"]) for r in a])
            assert sorted(r["doc_id"] for r in b) == sorted(i for i in root if root[i] == i)
        if name == "secrets":
            assert len(a) == len(b) and not any(plain_spans(r["text"]) for r in b)
            text = {r["doc_id"]: r["text"] for r in b}
            assert all(text[r["doc_id"]] == r["text"] for r in a if "like_" not in r["text"] and not plain_spans(r["text"]))
        if name == "mixing":
            assert {r["doc_id"] for r in b} <= {r["doc_id"] for r in a} and max(map(len, (words(r["text"]) for r in b))) > 0
        before = after
    assert sentencepiece.decode(before).count() == len(a) and before.where("NOT round_trip").count() == 0


def test_empty_and_odd(spark, odd, tmp_path):  # noqa: F811
    for k, table in enumerate((odd.limit(0), odd)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, table, SF).write.parquet(str(tmp_path / f"{k}{i}"))
            table = spark.read.parquet(str(tmp_path / f"{k}{i}"))
        assert (table.count() == 0) == (k == 0)
