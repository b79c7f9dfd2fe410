"""Markdown trees: a file is one record, a long one several that overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import keeps, lines, role_of_path
from ..operators.index import completed, with_identity
from .common import Extracted, read_files

NAME = "markdown"
#: Lines of a file that stays whole, of a chunk, and that two chunks share (fixed values).
WHOLE, SIZE, OVERLAP = 1000, 50, 5


def handles(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(md|markdown)$")


def chunks(rows: Column, whole: int = WHOLE, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """An array of (first_line, content) of a text's lines; the last chunk is the first that reaches the end."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("a chunk needs lines, and must share fewer than it has")
    step, n = size - overlap, F.size(rows)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int") * step, F.lit(step))
    starts = F.when(n <= whole, F.array(F.lit(0))).otherwise(starts)
    part = lambda s: F.struct((s + 1).alias("first_line"), F.array_join(F.slice(rows, s + 1, F.when(n <= whole, n).otherwise(F.lit(size))), "\n").alias("content"))
    return F.when(n > 0, F.transform(starts, part)).otherwise(F.array().cast("array<struct<first_line:int,content:string>>"))


def parse(files: DataFrame, root: str | None = None, whole: int = WHOLE, size: int = SIZE, overlap: int = OVERLAP) -> Extracted:
    path = F.col("path")
    base = root.rstrip("/") + "/" if root else None
    thread = F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path) if base else path
    # the lines come out of an explode, so that they are computed once and not for every chunk
    rows = files.select("path", "mtime", thread.alias("thread_id"), F.explode(F.array(lines(F.col("content")))).alias("lines"))
    rows = rows.select("path", "mtime", "thread_id", F.explode(chunks(F.col("lines"), whole, size, overlap)).alias("c"))
    records = rows.select(
        F.lit(NAME).alias("source"), F.col("path").alias("source_path"), "thread_id", F.concat_ws(":", "thread_id", F.col("c.first_line").cast("string")).alias("source_id"),
        role_of_path(F.col("thread_id")).alias("role"), F.col("c.content").alias("content"), F.col("mtime").alias("created_at"),
        F.lit(None).cast("string").alias("parent_uid"), F.lit(None).cast("int").alias("position_in_thread"),
    ).where(keeps(F.col("content")))
    return Extracted(completed(with_identity(records)), files.select(path.alias("source_path"), F.lit("").alias("reason")).limit(0))


def extract(spark: SparkSession, path: str | Sequence[str], condition: Column | None = None, root: str | None = None, **sizes: int) -> Extracted:
    own = handles(F.col("path"))
    return parse(read_files(spark, path, own if condition is None else own & condition), root, **sizes)
