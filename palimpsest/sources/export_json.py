"""Chat exports: a file `conversations.json` with an array of conversations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import role_map, strip
from ..scratch import shared
from .common import LARGE, Extracted, finished, flattened, get, kind, large_files, read_files, read_pieces, seconds, string
from .json_array import SEPARATOR, array_elements

NAME = "claude_ai"


def handles(path: Column) -> Column:
    return F.lower(path).rlike("(^|/)conversations\\.json$")


def parse(files: DataFrame) -> Extracted:
    files = files.withColumn("v", F.try_parse_json("content")).select("path", "mtime", "v", kind(F.col("v")).alias("kind"))
    unread = files.where("kind IS NULL OR NOT startswith(kind, 'ARRAY')").select(F.col("path").alias("source_path"), F.when(F.col("kind").isNull(), "invalid JSON").otherwise("expected top-level JSON array").alias("reason"))
    convs = files.where("startswith(kind, 'ARRAY')").select("path", "mtime", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("at", "c"))
    return _records(convs, unread)


def _records(convs: DataFrame, unread: DataFrame) -> Extracted:
    """Conversations (path, mtime, at, c) to drawers and errors, after those of files that could not be read."""
    c = F.col("c")
    messages = F.coalesce(*[F.when(kind(get(c, k)).startswith("ARRAY"), get(c, k, "array<variant>")) for k in ("chat_messages", "messages")])
    filled = lambda key: F.nullif(string(c, key), F.lit(""))
    convs = convs.select("path", "mtime", "at", kind(c).startswith("OBJECT").alias("object"), F.coalesce(filled("uuid"), filled("id")).alias("thread_id"), messages.alias("messages"))
    reason = F.when(~F.col("object"), "non-object conversation").when(F.col("thread_id").isNull(), "conversation without uuid").when(F.col("messages").isNull(), F.concat(F.lit("conversation "), F.col("thread_id"), F.lit(" has no message array")))
    convs = convs.withColumn("reason", reason)
    skipped = convs.where("reason IS NOT NULL").select(F.col("path").alias("source_path"), "reason")
    rows = convs.where("reason IS NULL").select("path", "mtime", "thread_id", F.posexplode("messages").alias("order", "m"))
    m = F.col("m")
    plain = ~kind(m).startswith("OBJECT")
    odd = rows.where(plain).select(F.col("path").alias("source_path"), F.concat(F.lit("non-object message in conversation "), F.col("thread_id"), F.lit(" index "), F.col("order").cast("string")).alias("reason"))
    text = flattened(get(m, "text"), True)
    content = F.when(strip(text) != "", text).otherwise(flattened(get(m, "content"), True))
    sender = F.coalesce(F.nullif(string(m, "sender"), F.lit("")), string(m, "role"))
    records = rows.where(~plain).select(
        F.col("path").alias("source_path"), "thread_id", "order", F.concat_ws(":", "thread_id", F.col("order").cast("string")).alias("source_id"),
        role_map(sender, False).alias("role"), content.alias("content"), seconds(m, ("created_at", "timestamp", "updated_at"), F.col("mtime")).alias("created_at"),
        F.map_filter(F.create_map(F.lit("array_index"), F.col("order").cast("string"), F.lit("uuid"), string(m, "uuid"), F.lit("model"), string(m, "model"), F.lit("stop_reason"), string(m, "stop_reason")), lambda _, v: v.isNotNull()).alias("metadata"),
    )
    return Extracted(finished(records, NAME), unread.union(skipped).union(odd))


def parse_pieces(pieces: DataFrame) -> Extracted:
    """Files cut at closing braces, as `read_pieces` has them, to drawers and errors; a conversation is the most that a task holds.

    What doesn't begin with an array, blanks aside, is `expected top-level JSON array`, and what breaks off or holds a bad conversation `invalid JSON`.
    """
    elements, bad = array_elements(pieces)
    elements = shared(elements.withColumn("c", F.try_parse_json("text")))
    broken = elements.where("c IS NULL").select("path").distinct().withColumn("reason", F.lit("invalid JSON"))
    bad = shared(bad.unionByName(broken.join(bad, "path", "left_anti")))
    unread = bad.select(F.col("path").alias("source_path"), "reason")
    return _records(elements.join(F.broadcast(bad), "path", "left_anti"), unread)  # a row a large file


def extract(spark: SparkSession, path: str | Sequence[str], condition: Column | None = None, large: int = LARGE) -> Extracted:
    """Of every export below a path, or of files by their names; those of `large` bytes or more are read in blocks, by as many tasks."""
    own = handles(F.col("path"))
    own = own if condition is None else own & condition
    found, cut = parse(read_files(spark, path, own, large)), large_files(spark, path, own, large)
    if not cut:
        return found
    more = parse_pieces(read_pieces(spark, cut, SEPARATOR))
    return Extracted(found.drawers.unionByName(more.drawers), found.errors.unionByName(more.errors))
