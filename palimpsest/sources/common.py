"""What the readers share: files listed, whole or in pieces, JSON coercions, and records in their final shape."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MILLISECONDS, decoded, keeps, without_bom
from ..operators.index import completed, threaded, with_identity


#: Bytes from which a file is read in pieces, by several tasks.
LARGE = 32 << 20


@dataclass
class Extracted:
    """Records in the drawer schema, and what could not be read: (source_path, reason)."""

    drawers: DataFrame
    errors: DataFrame


def _load(spark: SparkSession, path: str | Sequence[str], format_: str, **options: str) -> DataFrame:
    """A tree by its root, or files by their names, which may hold what a pattern would read otherwise."""
    paths = [path] if isinstance(path, str) else [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in path]
    return spark.read.format(format_).options(recursiveFileLookup="true", **options).load(paths)


def _local(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def _whole_seconds(time: Column) -> Column:
    return F.floor(F.unix_micros(time) / 1_000_000).cast("long")


def listed(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, mtime, size) of every file below a path, or of the files of some names; no content is read."""
    return _load(spark, path, "binaryFile").select(_local(F.col("path")).alias("path"), _whole_seconds(F.col("modificationTime")).alias("mtime"), F.col("length").alias("size"))


def read_files(spark: SparkSession, path: str | Sequence[str], condition: Column | None = None, below: int | None = None) -> DataFrame:
    """(path, mtime, size, content) of those files; text is decoded, a byte-order mark gone.

    The condition, on `path`, holds before any content is read, and files of `below` bytes or more aren't opened.
    """
    files = _load(spark, path, "binaryFile")
    if below is not None:
        files = files.where(F.col("length") < below)
    files = files.withColumn("path", _local(F.col("path")))
    if condition is not None:
        files = files.where(condition)
    return files.select("path", _whole_seconds(F.col("modificationTime")).alias("mtime"), F.col("length").alias("size"), without_bom(decoded(F.col("content"))).alias("content"))


def large_files(spark: SparkSession, path: str | Sequence[str], condition: Column, least: int) -> list[str]:
    """Names of files of `least` bytes or more; each stands for that much content."""
    return [r["path"] for r in listed(spark, path).where(condition & (F.col("size") >= least)).select("path").collect()]


def read_pieces(spark: SparkSession, paths: Sequence[str], separator: str) -> DataFrame:
    """Files cut at a separator: (path, mtime, size, block, place, value), a task a block of a file and not a file.

    value is bytes; block is where a block of the file begins, and place ascends by one in it.
    """
    rows = _load(spark, paths, "text", lineSep=separator)
    name = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
    return rows.select(
        _local(name).alias("path"), _whole_seconds(F.col("_metadata.file_modification_time")).alias("mtime"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("value"),
    )


def kind(v: Column) -> Column:
    """The type of a variant: STRING, BIGINT, ARRAY<...>, OBJECT<...>; null for none."""
    return F.schema_of_variant(v)


def get(v: Column, path: str, type_: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}", type_)


def string(v: Column, path: str) -> Column:
    """A field that is a string, else null."""
    return F.when(kind(get(v, path)) == "STRING", get(v, path, "string"))


def flattened(v: Column, nested: bool) -> Column:
    """Content as text: a string; the text blocks and strings of a list, one a line; null as empty; other values as they print.

    With nested, a block of another type counts by its `content`, if that is a string.
    """
    block = lambda b: F.when(kind(b) == "STRING", b.cast("string")).otherwise(
        F.coalesce(F.when(string(b, "type") == "text", string(b, "text")), string(b, "content") if nested else F.lit(None).cast("string"))
    )
    items = F.try_variant_get(v, "$", "array<variant>")
    listed = F.array_join(F.array_compact(F.transform(items, block)), "\n")
    return F.when(v.isNull() | (kind(v) == "VOID"), "").when(kind(v) == "STRING", v.cast("string")).when(kind(v).startswith("ARRAY"), listed).otherwise(v.cast("string"))


def seconds(v: Column, keys: tuple[str, ...], fallback: Column) -> Column:
    """The first usable time among some fields: a number of seconds or milliseconds, or an ISO 8601 text (UTC where it names no zone)."""

    def one(key: str) -> Column:
        value, number = get(v, key), get(v, key, "double")
        plain = F.when(kind(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.when(number > MILLISECONDS, number / 1000).otherwise(number).cast("long"))
        iso = F.try_to_timestamp(F.regexp_replace(string(v, key), "Z", "+00:00"))
        return F.coalesce(plain, F.floor(F.unix_micros(iso) / 1_000_000).cast("long"))

    return F.coalesce(*[one(k) for k in keys], fallback)


def finished(records: DataFrame, source: str) -> DataFrame:
    """Records (source_path, thread_id, order, role, content, created_at[, source_id]) as drawers: filtered, numbered, hashed and chained."""
    from pyspark.sql import Window

    good = records.where(F.col("role").isNotNull() & keeps(F.col("content")))
    place = F.row_number().over(Window.partitionBy("source_path", "thread_id").orderBy("order")) - 1
    if "source_id" not in good.columns:
        good = good.withColumn("source_id", F.concat_ws(":", "thread_id", place.cast("string")))
    good = good.withColumn("chain", F.concat_ws("\x1f", "source_path", "thread_id")).withColumn("source", F.lit(source))
    return completed(threaded(with_identity(good), "chain", "order").drop("chain", "order"))
