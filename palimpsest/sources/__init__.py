"""Readers of session logs, chat exports and markdown trees, and the configuration that names them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from . import export_json, markdown, session_jsonl
from .common import Extracted

#: Readers by type, in the order in which a file is offered to them.
READERS: dict[str, Callable[..., Extracted]] = {"claude_code": session_jsonl.extract, "claude_ai": export_json.extract, "markdown": markdown.extract}
HANDLES = {"claude_code": session_jsonl.handles, "claude_ai": export_json.handles, "markdown": markdown.handles}


def reader(type_name: str) -> Callable[..., Extracted]:
    if type_name not in READERS:
        raise ValueError(f"no reader for source type {type_name!r}; there are {sorted(READERS)}")
    return READERS[type_name]


def assigned(files: DataFrame) -> DataFrame:
    """files(path, ...) with `type`, the first reader that takes each; files that none takes are left out."""
    from pyspark.sql import functions as F

    kind = F.coalesce(*[F.when(h(F.col("path")), t) for t, h in HANDLES.items()])
    return files.withColumn("type", kind).where("type IS NOT NULL")
