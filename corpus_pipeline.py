"""A corpus pipeline in stages; each takes (spark, docs, sf_dir) and gives the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import language, mixing, ngram_join, secrets, sentencepiece

STAGES = [
    ("language", lambda spark, docs, sf_dir: language.accept(docs)),
    ("near duplicates", lambda spark, docs, sf_dir: ngram_join.deduplicate(docs)),
    ("secrets", lambda spark, docs, sf_dir: secrets.mask(docs)),
    ("mixing", lambda spark, docs, sf_dir: mixing.mix(docs)),
    ("sentencepiece", lambda spark, docs, sf_dir: sentencepiece.encode(docs)),
]
#: The stages learn models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
