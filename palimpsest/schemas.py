"""Table schemas, seed rows and the rules that rows keep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

VERSION = 2


def _table(spec: str) -> T.StructType:
    """A struct type from lines of `name kind`, `!` after the kind for a required column."""
    kinds = {"s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType(), "b": T.BooleanType(), "m": T.MapType(T.StringType(), T.StringType()), "a": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(n, kinds[k[0]], not k.endswith("!")) for n, k in (x.split() for x in spec.split(","))])


DRAWERS = _table(
    "drawer_uid s!,rowid l,source s!,source_id s!,source_path s,role s!,register s,thread_id s,parent_uid s,position_in_thread i,"
    "branch_count i,created_at l!,content_hash s!,risk_score i,risk_score_version i,hash_input_version i,content s!"
)
ENTITY_TYPES = _table("name s!,description s,parent_type s,added_at l,added_by s,status s")
TYPE_ALIASES = _table("alias s!,canonical s!")
ENTITIES = _table("id l!,name s!,type s!,metadata s,first_seen l,last_seen l,source s")
PREDICATES = _table("name s!,description s,domain_type s,range_type s,symmetric b,added_at l,added_by s,status s")
RELATIONSHIPS = _table("id l!,subject_id l!,predicate s!,object_id l!,valid_from l,valid_to l,drawer_uid s,metadata s")
MENTIONS = _table("drawer_uid s!,entity_id l!,confidence d,detected_by s,detected_at l")
SCHEMA_VERSION = _table("version i!,applied_at l!,description s,status s!")
INDEX_STATE = _table("source s!,source_path s!,last_indexed_mtime l,last_indexed_size l,drawer_count l")
INGEST_ERRORS = _table("id l,source s!,source_path s,reason s!,fix_hint s,occurred_at l!,retry_count i")
HIDDEN = _table("drawer_uid s!,hidden_at l!,unhidden_at l,reason s")
PENDING = _table("drawer_uid s!,enqueued_at l!,prompt_template s,prompt_version s")
RUNS = _table(
    "id l!,drawer_uid s!,started_at l!,ended_at l,status s!,model s!,prompt_version s!,tokens_input l,tokens_output l,cost_usd d,entities_json s,error_message s"
)
SEEDS = _table("name s!,type_ s!,aliases a")
SOURCES = _table("name s!,type s!,path s!,enabled b!,include a,exclude a,options m")
TABLES = {
    "drawers": DRAWERS, "entity_types": ENTITY_TYPES, "type_aliases": TYPE_ALIASES, "entities": ENTITIES, "predicates": PREDICATES,
    "relationships": RELATIONSHIPS, "drawer_entity_mentions": MENTIONS, "schema_version": SCHEMA_VERSION, "index_state": INDEX_STATE,
    "ingest_errors": INGEST_ERRORS, "hidden_drawers": HIDDEN, "extract_pending": PENDING, "extraction_runs": RUNS,
}

#: Seeded taxonomy (fixed values).
TYPE_NAMES = ("person", "project", "concept", "event", "tool", "methodology", "place")
PREDICATE_NAMES = ("MENTIONS", "AUTHORED_BY", "PART_OF", "USES", "RELATED_TO", "LOCATED_IN", "OCCURRED_AT", "COLLABORATES_WITH", "DEPENDS_ON", "SUCCEEDED_BY")
SYMMETRIC = ("RELATED_TO", "COLLABORATES_WITH")
#: Values that columns are held to (fixed values).
STATUSES = {"extraction_runs": ("success", "partial", "failed", "budget_exhausted"), "schema_version": ("in_progress", "applied", "failed"), "drawer_entity_mentions": ("linker", "extractor", "manual")}
#: Foreign keys: (table, column, table referred to, column).
FOREIGN_KEYS = (
    ("drawers", "parent_uid", "drawers", "drawer_uid"),
    ("entities", "type", "entity_types", "name"),
    ("relationships", "subject_id", "entities", "id"),
    ("relationships", "object_id", "entities", "id"),
    ("relationships", "predicate", "predicates", "name"),
    ("relationships", "drawer_uid", "drawers", "drawer_uid"),
    ("drawer_entity_mentions", "drawer_uid", "drawers", "drawer_uid"),
    ("drawer_entity_mentions", "entity_id", "entities", "id"),
    ("extract_pending", "drawer_uid", "drawers", "drawer_uid"),
    ("extraction_runs", "drawer_uid", "drawers", "drawer_uid"),
)


#: By version: what a migration to it is, and the function of a store that does it. Version 2 has the tables of version 1.
STEPS: dict[int, tuple[str, Callable | None]] = {2: ("records carry their hash input's version", None)}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def seeds(spark: SparkSession, now: int) -> dict[str, DataFrame]:
    """The tables that a new store starts with rows in."""
    types = [(n, None, None, now, "seed", "active") for n in TYPE_NAMES]
    predicates = [(n, None, None, None, n in SYMMETRIC, now, "seed", "active") for n in PREDICATE_NAMES]
    return {"entity_types": spark.createDataFrame(types, ENTITY_TYPES), "predicates": spark.createDataFrame(predicates, PREDICATES), "schema_version": spark.createDataFrame([(VERSION, now, "initial", "applied")], SCHEMA_VERSION)}
