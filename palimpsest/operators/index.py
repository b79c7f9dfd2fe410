"""From records to a searchable store: dedup, positional postings, statistics and incremental state."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..commits import Files
from ..functions import risk
from ..functions.text import content_hash, drawer_uid, fix_hint, keeps, role_map, tokens
from ..plans.best import BROADCAST, cell, sums
from ..plans.bm25 import Index
from ..scratch import put, shared

#: Tokens of a range of the index, about.
TOKENS = 2_000_000


def with_identity(records: DataFrame) -> DataFrame:
    """Add content_hash and drawer_uid from role, content, source and source_id."""
    records = records.withColumn("content_hash", content_hash(F.col("role"), F.col("content")))
    return records.withColumn("drawer_uid", drawer_uid(F.col("source"), F.col("source_id"), F.col("content_hash")))


def threaded(records: DataFrame, thread: str, order: str) -> DataFrame:
    """Add position_in_thread, from 0, and parent_uid, the record before in the thread."""
    w = Window.partitionBy(thread).orderBy(order)
    return records.withColumn("position_in_thread", (F.row_number().over(w) - 1).cast("int")).withColumn("parent_uid", F.lag("drawer_uid").over(w))


def first_of_each(records: DataFrame, order: list[Column]) -> DataFrame:
    """One record, the first, of each (content_hash, source, source_id) and of each uid."""
    for keys in (["content_hash", "source", "source_id"], ["drawer_uid"]):
        w = Window.partitionBy(*keys).orderBy(*order)
        records = records.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return records


def new_records(records: DataFrame, existing: DataFrame) -> DataFrame:
    """Records of which the store has neither the uid nor (content_hash, source, source_id)."""
    keys = ["content_hash", "source", "source_id"]
    return records.join(existing.select("drawer_uid"), "drawer_uid", "left_anti").join(existing.select(*keys), keys, "left_anti")


def completed(records: DataFrame, scan_risk: bool = False) -> DataFrame:
    """Fill in the columns that a stored drawer has besides; risk is 0 unless it is scanned."""
    score = risk.total(risk.counts(F.col("content"))) if scan_risk else F.lit(0)
    defaults = {"rowid": F.xxhash64("drawer_uid"), "register": F.lit(None).cast("string"), "branch_count": F.lit(0), "risk_score_version": F.lit(risk.VERSION), "hash_input_version": F.lit(1)}
    for name, value in defaults.items():
        if name not in records.columns:
            records = records.withColumn(name, value)
    return records.withColumn("risk_score", score.cast("int"))


def branch_counts(drawers: DataFrame) -> DataFrame:
    """(drawer_uid, branch_count): how many name each drawer as their parent."""
    named = drawers.where("parent_uid IS NOT NULL").groupBy(F.col("parent_uid").alias("drawer_uid")).agg(F.count("*").alias("branch_count"))
    return drawers.select("drawer_uid").join(named, "drawer_uid", "left").select("drawer_uid", F.coalesce("branch_count", F.lit(0)).cast("long").alias("branch_count"))


def postings(drawers: DataFrame) -> DataFrame:
    """(uid, pos, term) of every token of every drawer."""
    return drawers.select(F.col("drawer_uid").alias("uid"), F.posexplode(tokens(F.col("content"))).alias("pos", "term"))


def lengths(drawers: DataFrame) -> DataFrame:
    """(uid, length): tokens of each drawer."""
    return drawers.select(F.col("drawer_uid").alias("uid"), F.size(tokens(F.col("content"))).cast("long").alias("length"))


def statistics(doc_lengths: DataFrame) -> DataFrame:
    return doc_lengths.agg(F.count("*").alias("n"), (F.sum("length") / F.count("*")).alias("average"))


def vocabulary(drawers: DataFrame) -> DataFrame:
    """(term, df, tf) of drawers; df counts uids, which few drawers share.

    A task sums its texts up by term before any shuffle, and only a uid's further drawers go by (term, uid).
    """
    texts = drawers.select(F.col("drawer_uid").alias("uid"), tokens(F.col("content")).alias("tokens"))
    # each text gives its terms once, for df, and all its tokens, for tf
    kinds = texts.select(F.posexplode(F.array(F.array_distinct("tokens"), F.col("tokens"))).alias("every", "terms"))
    counted = kinds.select("every", F.explode("terms").alias("term")).groupBy("term").agg(F.sum(1 - F.col("every")).alias("df"), F.sum("every").alias("tf"))
    again = shared(drawers.groupBy(F.col("drawer_uid").alias("uid")).count().where("count > 1").select("uid"))
    n = again.count()
    if not n:
        return counted
    own = texts.join(F.broadcast(again) if n <= BROADCAST else again, "uid", "left_semi")
    more = own.select("uid", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term", "uid").agg((1 - F.count("*")).alias("df")).groupBy("term").agg(F.sum("df").alias("df"), F.lit(0).cast("long").alias("tf"))
    return counted.union(more).groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def build(drawers: DataFrame) -> Index:
    """The index of drawers, computed where it is used; a stored one reads faster."""
    n = lengths(drawers)
    return Index(postings(drawers), n, statistics(n))


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, tokens) -> (uid, term, tf, length, positions), a row for each term of a text."""
    for batch in batches:
        uid, texts = batch.column(0), batch.column(1)
        sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = int(sizes.sum())
        coded = texts.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        pos = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = row * len(coded.dictionary) + codes
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        ends, own = np.append(first, total), order[first]
        positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pos[order], pa.int32()))
        arrays = [uid.take(pa.array(row[own])), coded.dictionary.take(pa.array(codes[own])), pa.array(np.diff(ends), pa.int64()), pa.array(sizes[row[own]], pa.int64()), positions]
        yield pa.RecordBatch.from_arrays(arrays, ["uid", "term", "tf", "length", "positions"])


def write_index(drawers: DataFrame, path: str, parts: int | None = None) -> None:
    """Store each drawer's tokens, and from them, in ranges of terms and cells, a row for each term of a drawer with its count and
    positions, so that a lookup of a term, or of its cells, prunes row groups; also lengths with their sums, and the cells' sums.

    Texts are tokenized once, and what a text holds of a term is shuffled once, as one row. A range has TOKENS tokens, about.
    """
    read = drawers.sparkSession.read.parquet
    put(drawers.select(F.col("drawer_uid").alias("uid"), tokens(F.col("content")).alias("tokens")), f"{path}/texts")
    texts = read(f"{path}/texts")
    put(texts.select("uid", F.size("tokens").cast("long").alias("length")), f"{path}/lengths")
    put(read(f"{path}/lengths").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")), f"{path}/sums")
    ranges = parts or 1 + read(f"{path}/sums").first()["total"] // TOKENS
    terms = texts.mapInArrow(_terms_of, "uid string, term string, tf long, length long, positions array<int>").withColumn("cell", cell(F.col("tf"), F.col("length")))
    ranged = terms.drop("tf").repartitionByRange(ranges, "term", "cell", "uid").sortWithinPartitions("term", "cell")
    put(ranged.withColumn("tf", F.size("positions").cast("long")), f"{path}/terms")
    put(sums(read(f"{path}/terms")).coalesce(parts or 8).sortWithinPartitions("term"), f"{path}/cells")


def read_index(spark, *paths: str, missing: DataFrame | None = None) -> Index:
    """The index whose parts lie at some paths; drawers that are missing there are indexed as they are used.

    It has texts, terms and cells if all parts have, and none is missing; parts of earlier versions have rows for positions only.
    """
    at = lambda name, own=paths: spark.read.parquet(*[f"{p}/{name}" for p in own])
    whole = [p for p in paths if Files(spark, p).exists(f"{p}/terms/_SUCCESS")]
    old = [p for p in paths if p not in whole]
    found = [at("terms", whole).select("uid", F.explode("positions").alias("pos"), "term")] if whole else []
    posts = reduce(DataFrame.union, found + ([at("postings", old).select("uid", "pos", "term")] if old else []))
    n, totals = at("lengths"), at("sums")
    if missing is not None:
        more = lengths(missing)
        posts, n, totals = posts.union(postings(missing)), n.union(more), totals.union(more.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))))
    stats = totals.agg(F.sum("n").alias("n"), F.try_divide(F.sum("total"), F.sum("n")).alias("average"))
    if missing is not None or old or not all(Files(spark, p).exists(f"{p}/cells/_SUCCESS") for p in paths):
        return Index(posts, n, stats)
    return Index(posts, n, stats, at("terms"), at("cells"), at("texts"))


def needs_index(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files (source, source_path, mtime) without a recorded state, or changed since, in whole seconds."""
    known = state.select("source", "source_path", "last_indexed_mtime")
    return files.join(known, ["source", "source_path"], "left").where(F.col("last_indexed_mtime").isNull() | (F.col("mtime") > F.col("last_indexed_mtime"))).drop("last_indexed_mtime")


def updated_state(state: DataFrame, seen: DataFrame) -> DataFrame:
    """State after files (source, source_path, last_indexed_mtime, last_indexed_size, drawer_count) were read: the latest times and sizes, counts added up."""
    both = state.withColumn("__new", F.lit(0)).unionByName(seen.withColumn("__new", F.lit(1)))
    latest = lambda c: F.max_by(c, F.struct("__new", "last_indexed_mtime")).alias(c)
    return both.groupBy("source", "source_path").agg(latest("last_indexed_mtime"), latest("last_indexed_size"), F.sum("drawer_count").alias("drawer_count"))


def error_rows(errors: DataFrame, now: int) -> DataFrame:
    """(source, source_path, reason) as rows of ingest_errors, with hints."""
    return errors.select(F.lit(None).cast("long").alias("id"), "source", "source_path", "reason", fix_hint(F.col("reason")).alias("fix_hint"), F.lit(now).cast("long").alias("occurred_at"), F.lit(0).alias("retry_count"))


def conversation_drawers(conversations: DataFrame) -> DataFrame:
    """Drawers from a conversations table (conv_id, turn, role, text); created_at counts days by conversation, minutes by turn."""
    records = conversations.select(
        F.lit("conversations").alias("source"),
        F.concat_ws(":", "conv_id", "turn").alias("source_id"),
        role_map(F.col("role")).alias("role"),
        F.col("text").alias("content"),
        F.col("conv_id").cast("string").alias("thread_id"),
        (F.lit(1_700_000_000) + F.col("conv_id") * 86_400 + F.col("turn") * 60).cast("long").alias("created_at"),
        (F.col("conv_id") * 100_000 + F.col("turn")).cast("long").alias("rowid"),
        F.lit(None).cast("string").alias("source_path"),
    ).where(F.col("role").isNotNull() & keeps(F.col("content")))
    return completed(threaded(with_identity(records), "thread_id", "rowid"))


def document_drawers(documents: DataFrame) -> DataFrame:
    """Drawers from a documents table (doc_id, text, source): one wiki page each."""
    records = documents.select(
        "source", F.concat(F.col("doc_id").cast("string"), F.lit(":1")).alias("source_id"), F.lit("wiki").alias("role"), F.col("text").alias("content"),
        F.col("doc_id").cast("string").alias("thread_id"), (F.lit(1_700_000_000) + F.col("doc_id") * 60).cast("long").alias("created_at"), F.col("doc_id").alias("rowid"),
        F.lit(None).cast("string").alias("source_path"), F.lit(None).cast("string").alias("parent_uid"), F.lit(0).alias("position_in_thread"),
    ).where(keeps(F.col("content")))
    return completed(with_identity(records))
