"""Session logs: one JSON record a line, bare or wrapped in a message."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import LINE_END, decoded, lines, role_map, without_bom
from ..scratch import shared
from .common import LARGE, Extracted, finished, flattened, get, kind, large_files, read_files, read_pieces, seconds, string

NAME = "claude_code"
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
MESSAGES = ("user", "assistant", "human")


def session_of(path: Column) -> Column:
    """The session's UUID, lower case: of the file's name, its folder, or the folder above `subagents`; null for none."""
    places = (f"(?:^|/)({UUID})\\.jsonl$", f"(?:^|/)({UUID})/[^/]*\\.jsonl$", f"(?:^|/)({UUID})/subagents/[^/]*\\.jsonl$")
    return F.lower(F.coalesce(*[F.nullif(F.regexp_extract(path, p, 1), F.lit("")) for p in places]))


def handles(path: Column) -> Column:
    return F.lower(path).endswith(".jsonl") & session_of(path).isNotNull()


def parse(files: DataFrame) -> Extracted:
    """Files (path, mtime, content) to drawers and errors."""
    files = files.withColumn("thread_id", session_of(F.col("path")))
    nameless = files.where("thread_id IS NULL").select(F.col("path").alias("source_path"), F.lit("cannot determine session UUID").alias("reason"))
    rows = files.where("thread_id IS NOT NULL").select("path", "mtime", "thread_id", F.posexplode(lines(F.col("content"))).alias("order", "line"))
    found = _records(rows.withColumn("number", F.col("order") + 1))
    return Extracted(found.drawers, found.errors.union(nameless))


def _records(rows: DataFrame) -> Extracted:
    """Lines (path, mtime, thread_id, order, number, line) to drawers and errors."""
    rows = rows.where(F.trim("line") != "").withColumn("v", F.try_parse_json("line"))
    object_ = kind(F.col("v")).startswith("OBJECT")
    place = F.concat(F.lit(" at line "), F.col("number").cast("string"))
    bad = rows.where(F.col("v").isNull() | ~object_).select(F.col("path").alias("source_path"), F.when(F.col("v").isNull(), F.concat(F.lit("bad JSONL"), place)).otherwise(F.concat(F.lit("non-object JSONL record"), place)).alias("reason"))
    v = F.col("v")
    inner = kind(get(v, "message")).startswith("OBJECT")
    other = string(v, "type").isNotNull() & ~string(v, "type").isin(*MESSAGES) & get(v, "message").isNotNull()
    role = F.coalesce(string(v, "message.role"), string(v, "role"), string(v, "type"), string(v, "sender"))
    content = F.when(F.coalesce(inner, F.lit(False)) & get(v, "message.content").isNotNull(), flattened(get(v, "message.content"), False)).otherwise(flattened(get(v, "content"), False))
    field = lambda *paths: F.coalesce(*[get(v, p).cast("string") for p in paths])
    meta = {"record_uuid": field("uuid"), "model": field("message.model", "model"), "schema_version": field("schema_version"), "version": field("version"), "agent_id": field("agentId"), "is_sidechain": field("isSidechain")}
    meta["subagent_file"] = F.nullif(F.regexp_extract("path", r"/subagents/([^/]*)\.[^./]*$", 1), F.lit(""))
    metadata = F.map_filter(F.create_map(*[x for k, c in meta.items() for x in (F.lit(k), c)]), lambda _, value: value.isNotNull())
    records = rows.where(object_ & ~F.coalesce(other, F.lit(False))).select(
        F.col("path").alias("source_path"), "thread_id", "order", role_map(role).alias("role"), content.alias("content"),
        seconds(v, ("timestamp", "created_at", "ts"), F.col("mtime")).alias("created_at"), metadata.alias("metadata"),
    )
    return Extracted(finished(records, NAME), bad)


def parse_pieces(pieces: DataFrame) -> Extracted:
    """Files cut at line feeds, as `read_pieces` has them, to drawers and errors.

    Text is decoded line by line. Lines are numbered by line feeds: by those in the blocks before, and by the place in the block.
    """
    blocks = shared(pieces.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("place").alias("first")))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("path", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    rows = pieces.join(F.broadcast(blocks), ["path", "block"])  # 100 bytes for each block of a file, megabytes
    number = F.col("before") + F.col("place") - F.col("first") + 1
    line = F.regexp_replace(F.when(number == 1, without_bom(F.col("line"))).otherwise(F.col("line")), r"\r$", "")
    rows = rows.select("path", "mtime", session_of(F.col("path")).alias("thread_id"), number.alias("number"), decoded(F.col("value")).alias("line"))
    rows = rows.select("path", "mtime", "thread_id", "number", F.regexp_replace(F.when(F.col("number") == 1, without_bom(F.col("line"))).otherwise(F.col("line")), r"\r$", "").alias("line"))
    nameless = rows.where("number = 1 AND thread_id IS NULL").select(F.col("path").alias("source_path"), F.lit("cannot determine session UUID").alias("reason"))
    rows = rows.where("thread_id IS NOT NULL").select("path", "mtime", "thread_id", "number", F.posexplode(F.split("line", LINE_END, -1)).alias("at", "line"))
    found = _records(rows.withColumn("order", F.struct("number", "at")))
    return Extracted(found.drawers, found.errors.union(nameless))


def extract(spark: SparkSession, path: str | Sequence[str], condition: Column | None = None, large: int = LARGE) -> Extracted:
    """Of every log below a path, or of files by their names; those of `large` bytes or more are read in blocks, by as many tasks."""
    own = F.lower("path").endswith(".jsonl")
    own = own if condition is None else own & condition
    found, cut = parse(read_files(spark, path, own, large)), large_files(spark, path, own, large)
    if not cut:
        return found
    more = parse_pieces(read_pieces(spark, cut, "\n"))
    return Extracted(found.drawers.unionByName(more.drawers), found.errors.unionByName(more.errors))
