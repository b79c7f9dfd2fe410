"""Entities, mentions and relationships, and the linker of known names."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..scratch import shared
from . import dictionary
from .ranges import running_sum

#: Names that would read as no value (fixed values).
SENTINELS = ("null", "none", "undefined")


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def entity_name(name: str) -> str:
    """A valid name, stripped and composed; ValueError for none."""
    if not isinstance(name, str) or not name.strip() or name.strip().lower() in SENTINELS:
        raise ValueError(f"not an entity name: {name!r}")
    return unicodedata.normalize("NFC", name.strip())


def predicate_name(name: str) -> str:
    if not isinstance(name, str) or not re.fullmatch("[A-Z][A-Z0-9_]*", name):
        raise ValueError(f"not a predicate name: {name!r}")
    return name


def composed(c: Column) -> Column:
    """Unicode's composed form; no built-in function has it, and names in ASCII don't need it."""

    @F.pandas_udf("string")
    def compose(names: pd.Series) -> pd.Series:
        return names.map(lambda n: n if n is None or n.isascii() else unicodedata.normalize("NFC", n))

    return compose(c)


def decoded_metadata(c: Column) -> Column:
    """Metadata as a map; an empty one for null and for what is no JSON object."""
    return F.coalesce(F.from_json(F.when(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), c), "map<string,string>"), F.create_map().cast("map<string,string>"))


def valid_names(c: Column) -> Column:
    """Whether a name can be stored, for tables of names."""
    return (F.length(strip(c)) > 0) & ~F.lower(strip(c)).isin(*SENTINELS)


def upsert_entities(existing: DataFrame, observed: DataFrame) -> DataFrame:
    """Entities after observations (name, type, metadata, source, at).

    One for each name, ignoring ASCII case, and type: the first observation's name, metadata, source and first_seen, the
    last one's last_seen. New ids follow the highest one in order of first appearance.
    """
    key = [_ascii_lower(F.col("name")).alias("__key"), F.col("type")]
    seen = observed.where(valid_names(F.col("name"))).withColumn("name", composed(strip(F.col("name"))))
    first = lambda c: F.min_by(c, F.struct("at", "name")).alias(c)
    new = seen.groupBy(*key).agg(first("name"), first("metadata"), first("source"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))
    old = existing.withColumn("__key", _ascii_lower(F.col("name")))
    both = old.alias("o").join(new.alias("n"), ["__key", "type"], "full")
    both = both.select(
        F.col("o.id").alias("id"), F.coalesce("o.name", "n.name").alias("name"), "type",
        *[F.when(F.col("o.id").isNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ("metadata", "source", "first_seen")],
        F.coalesce("n.last_seen", "o.last_seen").alias("last_seen"),
    )
    highest = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__most"))
    fresh = running_sum(both.where("id IS NULL"), ["first_seen", "name", "type"], F.lit(1), "__n")
    fresh = fresh.crossJoin(F.broadcast(highest)).withColumn("id", F.col("__most") + F.col("__n")).drop("__n", "__most")
    return both.where("id IS NOT NULL").unionByName(fresh)


def find_entity(entities: DataFrame, name: str, type_: str | None = None) -> DataFrame:
    found = entities.where(_ascii_lower(F.col("name")) == _ascii_lower(F.lit(name)))
    return found if type_ is None else found.where(F.col("type") == type_)


def add_mentions(mentions: DataFrame, new: DataFrame) -> DataFrame:
    """Mentions with new ones (same columns) that pass the rules; a pair that is there stays as it is."""
    good = new.where("confidence BETWEEN 0 AND 1 AND detected_by IN ('linker', 'extractor', 'manual')").dropDuplicates(["drawer_uid", "entity_id"])
    return mentions.unionByName(good.join(mentions, ["drawer_uid", "entity_id"], "left_anti").select(*mentions.columns))


def link_entity_in_drawer(mentions: DataFrame, drawer_uid: str, entity_id: int, confidence: float = 1.0, detected_by: str = "manual", at: int = 0, **_ignored) -> DataFrame:
    """Mentions with one more; other particulars of the link are ignored."""
    return add_mentions(mentions, mentions.sparkSession.createDataFrame([(drawer_uid, entity_id, float(confidence), detected_by, at)], mentions.schema))


def seed_pattern(name: str, aliases: Iterable[str] = ()) -> str:
    """A pattern for the name or an alias as a whole word in any case, longer ones first."""
    words = sorted({w for w in (name, *aliases) if w}, key=lambda w: (-len(w), w))
    quoted = "|".join(re.sub(r"([^\w])", r"\\\1", w) for w in words)
    return rf"(?iU)(?<!\w)(?:{quoted})(?!\w)"


def link(drawers: DataFrame, seeds: list[tuple[str, str, list[str]]]) -> DataFrame:
    """(drawer_uid, name, type) for each seed found in a drawer.

    The seeds, a configured list, become one array of flags over each row, so that a drawer is scanned where it lies.
    """
    if not seeds:
        return drawers.select("drawer_uid", F.lit("").alias("name"), F.lit("").alias("type")).limit(0)
    flags = [F.when(F.col("content").rlike(seed_pattern(n, a)), F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"))) for n, t, a in seeds]
    return drawers.select("drawer_uid", F.explode(F.array_compact(F.array(*flags))).alias("x")).select("drawer_uid", "x.name", "x.type")


def link_all(drawers: DataFrame, seeds: DataFrame) -> DataFrame:
    """As `link`, for a table of seeds (name, type, aliases) of any size: all names and aliases are one dictionary, and a drawer is read once for it."""
    numbered = shared(seeds.select("name", "type", F.xxhash64("name", "type").alias("entry"), F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("words")))
    found = dictionary.find(drawers, "drawer_uid", "content", numbered.select("entry", "words"))
    return found.join(numbered.select("entry", "name", "type").distinct(), "entry").select("drawer_uid", "name", "type")


def entities_of(drawer_uid: str, entities: DataFrame, mentions: DataFrame) -> DataFrame:
    return mentions.where(F.col("drawer_uid") == drawer_uid).join(entities, F.col("entity_id") == F.col("id")).select(*entities.columns).orderBy("name", "id")


def drawers_of(entity_id: int, mentions: DataFrame, limit: int | None = None) -> DataFrame:
    found = mentions.where(F.col("entity_id") == entity_id).orderBy(F.desc("detected_at"), "drawer_uid").select("drawer_uid")
    return found if limit is None else found.limit(limit)


def relations(entities: DataFrame, relationships: DataFrame, predicate: str | None = None, as_of: int | None = None) -> DataFrame:
    """Edges with the name and type of what they lead to, as object and object_type: of one predicate, and valid at a time, if asked."""
    edges = relationships if predicate is None else relationships.where(F.col("predicate") == predicate_name(predicate))
    if as_of is not None:
        edges = edges.where((F.coalesce("valid_from", F.lit(as_of)) <= as_of) & (F.coalesce("valid_to", F.lit(as_of)) >= as_of))
    ends = entities.select(F.col("id").alias("object_id"), F.col("name").alias("object"), F.col("type").alias("object_type"))
    return edges.join(ends, "object_id")


def neighbourhood(name: str, entities: DataFrame, mentions: DataFrame, relationships: DataFrame, drawers: DataFrame, limit: int = 20, predicate: str | None = None, as_of: int | None = None) -> DataFrame:
    """Each entity of a name with its latest mentions, `limit` at most, and its outgoing edges, nested.

    Expired edges are listed too, unless as_of asks for those valid at a time.
    """
    own = find_entity(entities, name)
    latest = Window.partitionBy("entity_id").orderBy(F.desc("detected_at"), "drawer_uid")
    seen = mentions.join(F.broadcast(own.select(F.col("id").alias("entity_id"))), "entity_id").join(drawers.select("drawer_uid", "source", "created_at"), "drawer_uid")
    seen = seen.withColumn("n", F.row_number().over(latest)).where(F.col("n") <= limit)
    seen = seen.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("n", "drawer_uid", "source", "created_at", "confidence", "detected_at"))).alias("mentions"))
    edges = relations(entities, relationships.join(F.broadcast(own.select(F.col("id").alias("subject_id"))), "subject_id", "left_semi"), predicate, as_of)
    edges = edges.groupBy(F.col("subject_id").alias("entity_id")).agg(F.array_sort(F.collect_list(F.struct("predicate", "object", "object_type", "valid_from", "valid_to", "drawer_uid"))).alias("relationships"))
    out = own.withColumn("entity_id", F.col("id")).join(seen, "entity_id", "left").join(edges, "entity_id", "left")
    return out.select("id", "name", "type", "mentions", "relationships")
