"""Retrieval quality and latency figures."""

from __future__ import annotations

import json
import random
import time
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..plans.bm25 import Index, top_per_query
from ..plans.match import literal
from .index import completed, lengths, postings, statistics, with_identity
from .ranges import running_sum


def quality(expected: DataFrame, hits: DataFrame, k: int = 10) -> DataFrame:
    """Means over the queries (qid, uid), one relevant drawer each, of precision@k, recall@k and reciprocal rank of hits (qid, uid, rank)."""
    found = expected.join(hits.where(F.col("rank") <= k), ["qid", "uid"], "left")
    hit = F.col("rank").isNotNull().cast("double")
    return found.agg(
        F.count("*").alias("n_queries"),
        (F.sum(hit) / F.count("*") / k).alias("precision_at_k"),
        (F.sum(hit) / F.count("*")).alias("recall_at_k"),
        (F.sum(F.coalesce(1 / F.col("rank"), F.lit(0.0))) / F.count("*")).alias("mrr"),
    )


def latency(samples: DataFrame, column: str) -> DataFrame:
    """p50, p95 and p99, by linear interpolation; null where there are no values.

    Equal values are counted first. The counts are summed up along the values, in ranges, and of each rank only the value that
    reaches it is taken: no task holds all values.
    """
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    counts = samples.select(F.col(column).alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
    along = running_sum(counts, ["value"], F.col("n"), "upto")
    along = along.crossJoin(F.broadcast(along.agg((F.max("upto") - 1).alias("last"))))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n")), F.col("value")))

    ranks = {name: F.col("last") * p for name, p in shares.items()}
    ends = [c for name, r in ranks.items() for c in (at(F.floor(r)).alias(f"{name}_low"), at(F.ceil(r)).alias(f"{name}_high"), F.max(r - F.floor(r)).alias(f"{name}_rest"))]
    found = along.agg(*ends)
    return found.select(*[F.round((1 - F.col(f"{n}_rest")) * F.col(f"{n}_low") + F.col(f"{n}_rest") * F.col(f"{n}_high"), 9).alias(n) for n in shares])


DRAWERS = "content string, created_at long, position_in_thread int, role string, source string, source_id string, thread_id string"
QUERIES = "anchor string, expected_drawer_uid string, query string"


def known_item_corpus(spark: SparkSession, threads: int = 100, queries: int = 50, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Chat threads of made-up words, each with a word of its own in one message, and queries for those words; the same at each run."""
    draw = random.Random(seed)
    syllables = [a + b for a in "bdfgklmnprstv" for b in "aeiou"]
    word = lambda n: "".join(draw.choices(syllables, k=n))
    common = [word(2) for _ in range(400)]
    records, wanted = [], []
    for t in range(threads):
        turns, anchor = draw.randint(4, 8), f"{word(4)}{t:03d}"
        holder = draw.randrange(turns)
        for i in range(turns):
            words = draw.choices(common, k=draw.randint(12, 40))
            if i == holder:
                words.insert(draw.randrange(len(words)), anchor)
            role = "assistant" if i % 2 else "human"
            records.append((" ".join(words), 1_700_000_000 + t * 86_400 + i * 60, i, role, "synthetic_chat", f"thread-{t}:{i}", f"thread-{t}"))
        wanted.append((anchor, f"thread-{t}:{holder}"))
    drawers = completed(with_identity(spark.createDataFrame(records, DRAWERS).withColumn("source_path", F.lit(None).cast("string")).withColumn("parent_uid", F.lit(None).cast("string"))))
    anchors = spark.createDataFrame(draw.sample(wanted, queries), "anchor string, source_id string")
    found = anchors.join(drawers.select("source_id", F.col("drawer_uid").alias("expected_drawer_uid")), "source_id")
    return drawers, found.select("anchor", "expected_drawer_uid", F.col("anchor").alias("query"))


def read_corpus(spark: SparkSession, drawers: str, queries: str) -> tuple[DataFrame, DataFrame]:
    """Drawers and queries from JSON lines."""
    rows = spark.read.schema(DRAWERS).json(drawers).withColumn("source_path", F.lit(None).cast("string")).withColumn("parent_uid", F.lit(None).cast("string"))
    return completed(with_identity(rows)), spark.read.schema(QUERIES).json(queries)


def run(drawers: DataFrame, queries: DataFrame, k: int = 10, dataset: str = "synthetic_chat") -> dict:
    """A report: quality over all queries in one pass, the time of a batch and of single queries, and how fast drawers were indexed."""
    begun = time.perf_counter()
    posts, n = postings(drawers).persist(), lengths(drawers).persist()
    count = n.count()
    posts.count()
    indexed = time.perf_counter() - begun
    index = Index(posts, n, statistics(n))
    numbered = queries.withColumn("qid", F.xxhash64("query")).persist()
    begun = time.perf_counter()
    hits = top_per_query(index.match_all(numbered.select("qid", tokens(F.col("query")).alias("terms"))), k).persist()
    hits.count()
    batch = time.perf_counter() - begun
    report = quality(numbered.select("qid", F.col("expected_drawer_uid").alias("uid")), hits, k).first().asDict()
    samples = []
    for row in numbered.select("query").toLocalIterator():
        begun = time.perf_counter()
        index.match(literal(row["query"])).orderBy(F.desc("score")).limit(k).collect()
        samples.append(((time.perf_counter() - begun) * 1000,))
    report |= latency(drawers.sparkSession.createDataFrame(samples, "ms double"), "ms").first().asDict()
    for df in (posts, n, numbered, hits):
        df.unpersist()
    return {"dataset": dataset, "k": k, "n_drawers": count, "drawers_per_second": count / indexed, "batch_seconds": batch, **report}


def write_report(report: dict, folder: str, kind: str = "both") -> list[str]:
    """Write a report as JSON, as a Markdown table, or both; the files' names."""
    texts = {"json": json.dumps(report, indent=1), "md": "\n".join(["| Measure | Value |", "|-|-|", *(f"| {k} | {v} |" for k, v in report.items())]) + "\n"}
    out = []
    for suffix, text in texts.items():
        if kind in (suffix, "both"):
            path = Path(folder) / f"{report['dataset']}.{suffix}"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text, "utf-8")
            out.append(str(path))
    return out
