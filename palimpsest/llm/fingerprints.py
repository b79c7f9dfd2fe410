"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so sketches of parts merge by union, and the
share of one sketch that another holds estimates containment however unequal the documents are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared, small

WORDS, FRACTION = 5, 1 / 8
#: Ids that share a window; the first document of the next span joins them.
SPAN = 256
#: Spans that share a window; levels of windows, so that any two spans' numbers agree above them; slots of one id, and levels for ids with slots.
WIDTH, LEVELS = 4_096, 5
SLOTS, DEEP = 2**31, 8


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once per row rather than at each mention inside a lambda."""
    return F.transform(F.array(value), use)[0]


def sketch(text: Column, k: int = WORDS, fraction: float = FRACTION) -> Column:
    """Sorted distinct hashes of the k-word shingles of a text, those below `fraction` of the range.

    A text of fewer words than k, but one, has one shingle of them all. A text none of whose hashes is low enough keeps
    its lowest one, so that only texts without a word have an empty sketch; null counts as empty.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    low = F.lit(int(-(2**63) + fraction * 2**64))

    def hashes(w: Column) -> Column:
        at = lambda i, j: F.get(w, i + j)
        runs = F.transform(F.slice(w, 1, F.greatest(F.size(w) - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[at(i, j) for j in range(1, k)]))
        return F.when(F.size(w) >= k, runs).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    def keep(h: Column) -> Column:
        return _let(F.filter(h, lambda x: x < low), lambda few: F.when(F.size(few) > 0, F.array_sort(F.array_distinct(few))).when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(few))

    return _let(_let(F.transform(words, lambda w: F.xxhash64(w)), hashes), keep)


def likeness(a: Column, b: Column) -> Column:
    """Estimated containment of the one with fewer hashes in the other, 0 to 1; 1 if both sketches are empty, 0 if one is.

    A sketch of one hash that isn't low can't share it with one of low hashes: 0 then says nothing of the texts.
    """
    both, fewer = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    return F.when(fewer > 0, both / fewer).when(F.size(a) == F.size(b), F.lit(1.0)).otherwise(F.lit(0.0))


def as_text(s: Column) -> Column:
    """A sketch as a string: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def _next_keys(keys: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(key, first) of whole-number keys -> also next: the first of the next higher key, null for the highest.

    A window sees the keys that agree but for their lowest WIDTH; what lies beyond it comes from the lowest key of each
    such group, found in the same way, until all keys agree. So no task sees more than WIDTH rows, however sparse the ids.
    """
    if not levels:
        return keys.withColumn("next", F.lead("first").over(Window.orderBy("key")))
    keys = keys.withColumn("up", F.floor(F.col("key") / WIDTH))
    above = _next_keys(keys.groupBy("up").agg(F.min_by("first", "key").alias("first")).withColumnRenamed("up", "key"), levels - 1)
    own = keys.withColumn("own", F.lead("first").over(Window.partitionBy("up").orderBy("key")))
    return own.join(above.select(F.col("key").alias("up"), "next"), "up").select("key", "first", F.coalesce("own", "next").alias("next"))


def _spans(docs: DataFrame) -> DataFrame:
    """(key, first, n): the lowest id and the number of rows of each span, with the key."""
    spans = docs.groupBy(F.col("span").alias("key")).agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    return shared(spans.select("key", F.struct("id", "key").alias("first"), "n"))


def _split(docs: DataFrame, crowded: DataFrame, spans: int) -> DataFrame:
    """docs with each id of a crowded span as a span of its own, or as many as it has SPAN rows, and with copies."""
    ids = shared(docs.join(small(crowded, spans), "span", "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")))
    docs = docs.join(small(ids, ids.count()), F.col("doc_id").eqNullSafe(F.col("id")), "left")
    # a hash's share of its range, to 31 bits, times the slots
    slots = F.ceil(F.col("n") / SPAN)
    slot = F.floor(F.shiftrightunsigned(F.xxhash64("text"), 33) * slots / SLOTS)
    first = F.col("span").cast("decimal(32,0)") * SPAN
    key = F.when(F.col("n").isNull(), first * SLOTS).otherwise(F.coalesce(F.col("doc_id").cast("decimal(32,0)"), first) * SLOTS + slot)
    docs = docs.withColumn("span", key.cast("decimal(32,0)"))
    apart = docs.where("n IS NOT NULL").groupBy("doc_id", "text", "span").agg(F.count("*").alias("copies"))
    return docs.where("n IS NULL").select("doc_id", "text", "span", F.lit(1).cast("long").alias("copies")).unionByName(apart)


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> also span and extra, and more rows: with extra 1, a span's copy of the row that follows its last.

    Rows follow each other by doc_id, text, and the first follows the last. Ids are cut into spans of SPAN; each span also holds a copy of the next span's first row, so every text is shuffled
    once and no task sees more than a span and a row. A null id comes first.

    Where a span has more than twice SPAN rows, as ids repeat or are null, each id of it is a span, and one of more than SPAN rows is dealt
    into as many as it needs by its texts' hashes: its rows follow each other by these and then by text. Equal rows are one there,
    and `copies`, a column only then, counts them.
    """
    docs = docs.withColumn("span", F.coalesce(F.floor(F.col("doc_id") / SPAN), F.lit(-(2**62))))
    keys, levels = _spans(docs), LEVELS
    crowded = keys.where(F.col("n") > 2 * SPAN).select(F.col("key").alias("span"))
    if many := crowded.count():
        docs = _split(docs, crowded, many)
        keys, levels = _spans(docs), DEEP
    spans = shared(_next_keys(keys.drop("n"), levels), keys)
    n = spans.count()
    ends = spans.agg(F.min_by("first", "key").alias("first"))
    # only the highest key has no next
    links = spans.crossJoin(F.broadcast(ends.withColumnRenamed("first", "lowest"))).select(F.col("key").alias("to"), F.coalesce("next", "lowest").alias("of"))
    links = links.select("to", F.col("of.id").alias("of"), F.col("of.key").alias("at"))
    extra = docs.join(small(links, n), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("span") == F.col("at"))).select("to", "doc_id", "text")
    extra = extra.groupBy(F.col("to").alias("span")).agg(F.min(F.struct("doc_id", "text")).alias("x")).select("x.*", "span", F.lit(1).alias("extra"))
    return docs.withColumn("extra", F.lit(0)).unionByName(extra, allowMissingColumns=True)


def fingerprints(docs: DataFrame, k: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs.

    The edited text has its last floor(n_chars / 2) code points replaced by as many of the next document's first, or by
    all of them. A null text counts as empty; rows of one doc_id follow each other by text, those of an id with more than SPAN
    of them as `with_next` says, and a table of one row is its own next. Extra columns are not read.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = with_next(own).withColumn("sketch", sketch(F.col("text"), k, fraction))
    order = Window.partitionBy("span").orderBy("extra", F.col("doc_id").asc_nulls_first(), "text")
    df = df.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order)).where("extra = 0")
    if "copies" in df.columns:
        df = df.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        for own, following in (("text", "next_text"), ("sketch", "next_sketch")):
            df = df.withColumn(following, F.when(F.col("copy") < F.col("copies"), F.col(own)).otherwise(F.col(following)))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    df = df.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    df = df.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("edited_sketch", sketch(F.col("edited"), k, fraction))
    return df.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
