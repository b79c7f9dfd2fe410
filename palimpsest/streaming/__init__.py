"""Incremental ingest as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import decoded, without_bom
from ..sources import HANDLES
from ..sources import export_json, markdown, session_jsonl

PARSERS = {"claude_code": session_jsonl.parse, "claude_ai": export_json.parse, "markdown": markdown.parse}
FILES = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, path: str, type_name: str, files_per_batch: int = 1000) -> DataFrame:
    """New files below a path that the type's reader takes, as (path, mtime, size, content)."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
    stream = stream.withColumn("path", F.regexp_replace("path", "^file:/+", "/")).where(HANDLES[type_name](F.col("path")))
    return stream.select("path", F.floor(F.unix_micros("modificationTime") / 1_000_000).cast("long").alias("mtime"), F.col("length").alias("size"), without_bom(decoded(F.col("content"))).alias("content"))


def ingest(store, type_name: str, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Feed new files into a store, a batch at a time; a batch that is repeated after a failure adds nothing twice. Other writers are waited for.

    The file source sees new files, not changed ones; for those the store's own index run compares times.
    """

    def take(files: DataFrame, batch: int) -> None:
        with store.writing(wait=600):
            store.add(PARSERS[type_name](files), type_name, once=f"{checkpoint}#{batch}")

    return file_stream(store.spark, path, type_name).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts by window and type of a stream (ts, event_type); rows later than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
