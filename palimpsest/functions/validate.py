"""Checks of single values on the driver."""

from __future__ import annotations

import sys
from pathlib import Path, PurePath

#: Device names that Windows keeps for itself, as names or with any suffix (fixed values).
DEVICES = {"CON", "NUL", "AUX", "PRN", *(f"{d}{n}" for d in ("COM", "LPT") for n in range(1, 10))}


def file_path(path: str | PurePath, windows: bool | None = None) -> Path:
    """The path, if it holds no NUL and, on Windows, no device name."""
    if "\0" in str(path):
        raise ValueError("the path holds a NUL")
    windows = sys.platform == "win32" if windows is None else windows
    bad = [p for p in PurePath(path).parts if p.partition(".")[0].upper() in DEVICES]
    if windows and bad:
        raise ValueError(f"{bad[0]!r} is a device")
    return Path(path)


def query_string(query: str, mode: str = "literal") -> str:
    """MATCH text of a query: one quoted phrase, or as it is in mode `raw`."""
    if not isinstance(query, str):
        raise ValueError(f"a query is a str, not {type(query).__name__}")
    if mode not in ("literal", "raw"):
        raise ValueError(f"no such mode: {mode!r}")
    return query if mode == "raw" else '"' + query.replace('"', '""') + '"'
