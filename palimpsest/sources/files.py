"""Include and exclude globs as conditions on paths."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _regex(pattern: str) -> str:
    """A glob as a Java pattern: * and ? also match a slash."""
    body = fnmatch.translate(pattern)
    return body.replace("(?s:", "(?s)^(?:", 1).replace(r")\z", ")$").replace(r")\Z", ")$")


def relative(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def glob_condition(path: Column, rel: Column, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Column:
    """Whether a file passes: no exclude matches, and some include does if there are any.

    A pattern is held against the whole path, the path below the root, and the name.
    """
    name = F.element_at(F.split(path, "/"), -1)

    def hit(patterns: Iterable[str]) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | path.rlike(_regex(p)) | rel.rlike(_regex(p)) | name.rlike(_regex(p))
        return out

    include = list(include)
    return ~hit(exclude) & (hit(include) if include else F.lit(True))
