"""Status, integrity, uid prefixes and hiding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FOREIGN_KEYS


class NotFound(LookupError):
    """No drawer has the prefix."""


class Ambiguous(LookupError):
    """Several drawers have the prefix; some of them are in `found`."""

    def __init__(self, prefix: str, found: list[str]):
        super().__init__(f"{prefix!r} fits {', '.join(found)}")
        self.found = found


def by_source(drawers: DataFrame) -> DataFrame:
    return drawers.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


def summary(drawers: DataFrame, versions: DataFrame, state: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: drawers, sources, schema version and when it came, the last indexed time, errors."""
    parts = [
        drawers.agg(F.count("*").alias("drawer_count"), F.countDistinct("source").alias("source_count")),
        versions.where("status = 'applied'").agg(F.max("version").alias("schema_version"), F.max("applied_at").alias("applied_at")),
        state.agg(F.max("last_indexed_mtime").alias("last_indexed")),
        errors.agg(F.count("*").alias("error_count")),
    ]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)


def latest_errors(errors: DataFrame, limit: int = 50) -> DataFrame:
    return errors.orderBy(F.desc("occurred_at"), F.desc("id")).limit(limit)


def duplicate_uids(drawers: DataFrame) -> DataFrame:
    return drawers.groupBy("drawer_uid").agg(F.count("*").alias("n")).where("n > 1")


def orphans(tables: dict[str, DataFrame], keys=FOREIGN_KEYS) -> DataFrame:
    """(child, column, value) of every reference that leads nowhere."""
    found = []
    for table, column, parent, key in keys:
        if table in tables and parent in tables:
            own = tables[table].where(F.col(column).isNotNull()).select(F.col(column).alias("value"))
            lost = own.join(tables[parent].select(F.col(key).alias("value")).distinct(), "value", "left_anti")
            found.append(lost.select(F.lit(table).alias("child"), F.lit(column).alias("column"), F.col("value").cast("string").alias("value")))
    return reduce(DataFrame.union, found)


def verify(drawers: DataFrame, lengths: DataFrame, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """(check, n): what is wrong, by kind; n is 0 where nothing is."""
    own = drawers.agg(F.count_if(F.coalesce(F.length("drawer_uid"), F.lit(0)) == 0).alias("empty_uid"), F.count_if(F.coalesce(F.length("content_hash"), F.lit(0)) != 64).alias("bad_hash")).selectExpr("stack(2, 'empty_uid', empty_uid, 'bad_hash', bad_hash) AS (check, n)")
    more = {"duplicate_uid": duplicate_uids(drawers), "index_without_drawer": lengths.join(drawers, lengths["uid"] == drawers["drawer_uid"], "left_anti")}
    if tables:
        more["orphan"] = orphans(tables)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("check"), "n") for k, df in more.items()]
    return reduce(DataFrame.union, [own, *counts])


def prefix_matches(drawers: DataFrame, prefix: str) -> DataFrame:
    """Drawers whose uid, or a part of it after a colon, begins with the prefix, ignoring ASCII case."""
    low = F.lower("drawer_uid")
    return drawers.where(low.startswith(prefix.lower()) | low.contains(":" + prefix.lower()))


def resolve(drawers: DataFrame, prefix: str) -> str:
    """The uid that a prefix means: an exact one, else the only one that fits."""
    exact = drawers.where(F.col("drawer_uid") == prefix).select("drawer_uid").limit(1).collect()
    found = [r[0] for r in exact or prefix_matches(drawers, prefix).select("drawer_uid").orderBy("drawer_uid").limit(6).collect()]
    if not found:
        raise NotFound(prefix)
    if len(found) > 1:
        raise Ambiguous(prefix, found[:5])
    return found[0]


def hide(hidden: DataFrame, requests: DataFrame) -> DataFrame:
    """The hidden table after requests (drawer_uid, hidden_at, reason): the latest for each drawer, hidden again if it was shown."""
    new = requests.select("drawer_uid", "hidden_at", F.lit(None).cast("long").alias("unhidden_at"), "reason", F.lit(1).alias("__new"))
    latest = Window.partitionBy("drawer_uid").orderBy(F.desc("__new"), F.desc("hidden_at"), "reason")
    both = hidden.withColumn("__new", F.lit(0)).unionByName(new)
    return both.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n", "__new")


def broken_rules(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rule, n) of the rules on single rows and keys that a table breaks."""
    rules = {
        ("drawers", "uid and role are not empty"): "length(drawer_uid) = 0 OR length(role) = 0",
        ("drawers", "risk is 0 to 100"): "risk_score NOT BETWEEN 0 AND 100",
        ("entities", "names are names"): "lower(trim(name)) IN ('', 'null', 'none', 'undefined')",
        ("relationships", "no self loops"): "subject_id = object_id",
        ("drawer_entity_mentions", "confidence is 0 to 1"): "confidence NOT BETWEEN 0 AND 1",
        ("extraction_runs", "tokens and cost are not negative"): "tokens_input < 0 OR tokens_output < 0 OR cost_usd < 0",
    }
    found = [tables[t].where(c).agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), F.lit(r).alias("rule"), "n") for (t, r), c in rules.items() if t in tables]
    return reduce(DataFrame.union, found).where("n > 0")
