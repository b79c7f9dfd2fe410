"""N-gram Jaccard join: MinHash bands choose the candidates, full n-gram sets decide.

Texts with one n-gram set form a copy class, so copies are never paired. Each class has a home, the fullest band bucket
that it is in; the classes of a home are dealt into chunks of bounded size. Two chunks that meet in any bucket are
compared as one task, once, by products of incidence matrices, and the task returns one row for each linked class.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import U, in_batches, mix64, pieces, shared, sliding_hash, small, split_words, word_hashes
from .components import components

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Hashes of a signature, at most: more rows in a band leave fewer candidates, and need more bands.
HASHES = 96
#: Characters of texts that are hashed at once, if they are not one text's: few, so that a processor's cache holds their hashes.
PIECE = 200_000
#: Classes and n-grams in a chunk, at most on average.
CHUNK_CLASSES, CHUNK_GRAMS = 4_000, 1_500_000


def banding(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which as many bands as a pair at the threshold needs, to meet with the target recall, take `hashes` hashes at most."""
    for rows in range(16, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= hashes or rows == 1:
            return bands, rows
    raise AssertionError


def shingles(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and where each text's begin; a text of fewer words, but one, has one run of them all."""
    w = split_words(texts)
    words, n = word_hashes(w), np.diff(w.first)
    if not len(words):
        return np.zeros(0, U), np.zeros(len(texts) + 1, np.int64)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(at[-1], U)
    full = np.repeat(n >= k, count)
    begin = np.arange(at[-1]) + np.repeat(w.first[:-1] - at[:-1], count)
    out[full] = sliding_hash(words, k)[begin[full]]
    for i in np.flatnonzero((n > 0) & (n < k)):
        out[at[i]] = sliding_hash(words[w.first[i] : w.first[i + 1]], int(n[i]))[0] + U(n[i])
    return mix64(out), at


def _class(grams: np.ndarray) -> bytes:
    """A 128-bit hash of a set of n-grams."""
    with np.errstate(over="ignore"):
        return b"".join(int(mix64(grams ^ c).sum(dtype=U)).to_bytes(8, "big") for c in (U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)))


def _signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, class, n, bands) of each row; class null, no bands, where there is no word."""
    seeds = mix64(np.arange(1, 2 * bands * rows + 1, dtype=U))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            keys, sizes, out = [], [], []
            for part in pieces(texts, [len(t or "") for t in texts], PIECE):
                grams, at = shingles(part, k)
                some = np.flatnonzero(np.diff(at))
                low = np.zeros((len(part), bands * rows), U)
                with np.errstate(over="ignore"):
                    for j in range(bands * rows if len(some) else 0):
                        low[some, j] = np.minimum.reduceat((grams ^ seeds[j]) * (seeds[bands * rows + j] | U(1)), at[:-1][some])
                    found = sum(mix64(low[:, r::rows] + seeds[r]) for r in range(rows))
                    found = mix64(found + np.arange(bands, dtype=U)).view(np.int64)
                for i in range(len(part)):
                    own = np.unique(grams[at[i] : at[i + 1]])
                    sizes.append(len(own))
                    keys.append(_class(own) if len(own) else None)
                    out.append(found[i] if len(own) else None)
            lists = pa.array(out, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), lists], ["doc_id", "class", "n", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, class binary, n long, bands array<long>")


def _sets(candidates: DataFrame, k: int) -> DataFrame:
    """(class, chunk, size, text) -> (class, chunk, size, grams), for rows whose text has that class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            keep, values = [], []
            for part in pieces(list(range(len(texts))), [len(t or "") for t in texts], PIECE):
                grams, at = shingles([texts[i] for i in part], k)
                for j, i in enumerate(part):
                    own = np.unique(grams[at[j] : at[j + 1]])
                    if len(own) and _class(own) == keys[i]:
                        keep.append(i)
                        values.append(own.view(np.int64))
            lists = pa.array(values, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(keep, pa.int64())) for c in range(3)], lists], ["class", "chunk", "size", "grams"])

    return in_batches(candidates.select("class", "chunk", "size", "text"), run, "class binary, chunk long, size long, grams array<long>")


def _overlaps(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Common n-grams of each of the first `left` sets with each of the rest, or of all with all if left is 0."""
    na, nb, cut = (left, len(sets) - left, left) if left else (len(sets), len(sets), 0)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    new = np.concatenate([[True], value[1:] != value[:-1]])
    kind = np.cumsum(new) - 1
    often = np.bincount(kind)
    out = np.zeros((na, nb), np.float32)
    common = np.flatnonzero(often >= 48)
    number = np.full(len(often), -1)
    number[common] = np.arange(len(common))
    for begin in range(0, len(common), 1024):
        own = (number[kind] >= begin) & (number[kind] < begin + 1024)
        x = np.zeros((len(sets), min(1024, len(common) - begin)), np.float32)
        x[row[own], number[kind[own]] - begin] = 1
        out += x[:left] @ x[left:].T if left else x @ x.T
    rare = (often[kind] > 1) & (often[kind] < 48)
    kind, row = kind[rare], row[rare]
    cells = []
    for d in range(1, 48):
        same = np.flatnonzero(kind[d:] == kind[:-d])
        if not len(same):
            break
        a, b = row[same], row[same + d]
        if left:
            a, b = np.minimum(a, b), np.maximum(a, b)
            cross = (a < left) & (b >= left)
            cells.append(a[cross] * nb + b[cross] - cut)
        else:
            cells += [a * nb + b, b * nb + a]
    for c in cells:
        np.add.at(out.reshape(-1), c, 1)
    return out


def _linked(sets: list[np.ndarray], weight: np.ndarray, left: int, at_least: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one task's sets: documents and classes that each is linked to, and the lowest set of its connected part."""
    n = np.array([len(s) for s in sets])
    a, b = (np.arange(left), np.arange(left, len(n))) if left else (np.arange(len(n)),) * 2
    both = _overlaps(sets, left)
    link = np.zeros(both.shape, bool)
    blocks = [slice(i, i + 512) for i in range(0, len(a), 512)]
    for rows in blocks:
        common = both[rows].astype(np.int64)
        link[rows] = common * at_least.denominator >= (n[a[rows]][:, None] + n[b][None] - common) * at_least.numerator
    del both
    if not left:
        np.fill_diagonal(link, False)
    docs, classes, label = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.arange(len(n), dtype=np.int32)
    classes[a] = link.sum(1)
    classes[b] = link.sum(0)
    for rows in blocks:
        docs[a[rows]] += link[rows] @ weight[b]
        if left:
            docs[b] += weight[a[rows]] @ link[rows]
    while True:
        old = label.copy()
        for rows in blocks:
            own = np.where(link[rows], label[b][None], np.int32(len(n)))
            label[a[rows]] = np.minimum(label[a[rows]], own.min(1))
            label[b] = np.minimum(label[b], np.where(link[rows], label[a[rows]][:, None], np.int32(len(n))).min(0))
        label = label[label]
        if (label == old).all():
            return docs, classes, label


def _verify(tasks: DataFrame, threshold: float) -> DataFrame:
    """Rows of a task, (one, two, chunk, class, size, grams) sorted by task, -> (class, root, docs, classes) of linked classes."""
    at_least = Fraction(threshold).limit_denominator(1000)

    def solve(rows: dict[bytes, tuple], two: int) -> list[tuple]:
        own = sorted(rows.items(), key=lambda x: (x[1][0] == two, x[0]))
        left = sum(x[0] != two for _, x in own)
        if len(own) < 2:
            return []
        sets = [x[2] for _, x in own]
        found = _linked(sets, np.array([x[1] for _, x in own], np.int64), left, at_least)
        keys = [k for k, _ in own]
        return [(keys[i], keys[found[2][i]], int(found[0][i]), int(found[1][i])) for i in np.flatnonzero(found[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows, out = None, {}, []

        def give() -> pa.RecordBatch:
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["class", "root", "docs", "classes"])

        for batch in batches:
            one, two, chunk, keys, sizes = (batch.column(i).to_pylist() for i in range(5))
            lists = batch.column(5)
            values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i in range(batch.num_rows):
                if task != (one[i], two[i]):
                    if task:
                        out += solve(rows, task[1])
                    task, rows = (one[i], two[i]), {}
                rows[keys[i]] = (chunk[i], sizes[i], values[at[i] : at[i + 1]].copy())
            if len(out) >= 10_000:
                yield give()
                out = []
        if task:
            out += solve(rows, task[1])
        yield give()

    return in_batches(tasks.select("one", "two", "chunk", "class", "size", "grams"), run, "class binary, root binary, docs long, classes long")


def _placed(member: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class, n, bucket, members) -> (class, chunk), and the written table that it is read from.

    A class's home is its fullest bucket. A home too large for a chunk is dealt into several. Smaller homes that meet the
    same largest home in a bucket share chunks, each whole in one, so that a large group meets few chunks besides its own.
    """
    parts = F.greatest(F.ceil(F.count("*") / CHUNK_CLASSES), F.ceil(F.sum("n") / CHUNK_GRAMS))
    home = member.groupBy("class", "n").agg(F.max(F.struct("members", "bucket")).alias("home")).select("class", "n", F.col("home.bucket").alias("home"))
    home = shared(home.join(home.groupBy("home").agg(F.count("*").alias("size"), parts.alias("parts")), "home"))
    largest = member.select("class", "bucket").join(home, "class").groupBy("bucket").agg(F.max(F.struct("size", "home")).alias("largest"))
    host = member.select("class", "bucket").join(largest, "bucket").groupBy("class").agg(F.max("largest").alias("largest")).select("class", F.col("largest.home").alias("host"))
    written, home = home, home.join(host, "class")
    guests = home.where("parts = 1").groupBy("host").agg(parts.alias("guest_parts"))
    own = F.xxhash64("home", F.pmod(F.xxhash64("class"), F.col("parts")))
    return home.join(guests, "host", "left").select("class", F.when(F.col("parts") > 1, own).otherwise(F.xxhash64("host", F.pmod(F.xxhash64("home"), F.col("guest_parts")), F.lit("guests"))).alias("chunk")), written


def _grouped(docs: DataFrame, threshold: float, k: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class, n, bands) of each row, and (class, root, class_id, copy_id, size, docs) of classes of several rows or with links; root names the group."""
    sig = shared(_signatures(docs, k, *banding(threshold, recall)))
    classes = sig.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = shared(classes)
    member = classes.select("class", "n", F.explode("bands").alias("bucket"))
    full = member.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    member = shared(member.join(full, "bucket"))
    placed, home = _placed(member)
    placed = shared(placed, home)
    meet = member.join(placed, "class").select("bucket", "chunk").distinct()
    pairs = meet.select("bucket", F.col("chunk").alias("one")).join(meet.select("bucket", F.col("chunk").alias("two")), "bucket").where("one <= two").select("one", "two").distinct()
    alone = placed.groupBy("chunk").count().where("count = 1").select(F.col("chunk").alias("one"))
    pairs = pairs.where("one < two").union(pairs.where("one = two").join(alone, "one", "left_anti").select("one", "two"))
    sides = pairs.select(F.explode(F.array_distinct(F.array("one", "two"))).alias("chunk"), "one", "two")
    sides = shared(sides)
    candidates = shared(placed.join(classes.select("class", "copy_id", "size"), "class"))
    n = candidates.count()
    texts = docs.select("doc_id", "text").join(small(candidates, n), F.col("doc_id").eqNullSafe(F.col("copy_id")))
    tasks = _sets(texts, k).join(small(sides, sides.count()), "chunk").repartition("one", "two").sortWithinPartitions("one", "two")
    links = shared(_verify(tasks, threshold), member, placed, sides, candidates)
    root = components(links.select(F.col("class").alias("a"), F.col("root").alias("b")))
    degree = links.groupBy("class").agg(F.sum("docs").alias("docs"))
    info = classes.select("class", "copy_id", "size").join(degree, "class", "left").where("size > 1 or docs is not null")
    info = info.join(root.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    lowest = info.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    info = shared(info.join(lowest, "root").select("class", "root", "class_id", "copy_id", "size", F.coalesce("docs", F.lit(0)).alias("docs")), classes, links)
    return sig, info


def _with_class(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """docs and each row's class, as __class."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column(at).to_pylist(), []
            for part in pieces(texts, [len(t or "") for t in texts], PIECE):
                grams, first = shingles(part, k)
                sets = (np.unique(grams[a:b]) for a, b in zip(first[:-1], first[1:], strict=True))
                keys += [_class(own) if len(own) else None for own in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, "__class"])

    return in_batches(docs, run, StructType([*docs.schema.fields, StructField("__class", BinaryType())]))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, k: int = WORDS, recall: float = RECALL) -> DataFrame:
    """One row per row of docs: doc_id, class_id, copy_id, n_copies, n_links.

    n_links counts the other documents whose set of k-word runs has a Jaccard similarity of `threshold` or more; copy_id
    is the smallest doc_id with the same set, n_copies how many rows have it; class_id is the smallest doc_id that a
    chain of links leads to. Words are runs of non-blank characters, unchanged. A text of fewer than k words has one run
    of them all. Null, empty and blank texts have no links and form classes of their own. Repeated rows are copies.
    Candidates are the pairs of sets that share a band, which a pair at the threshold does with probability `recall`,
    and a likelier pair more often. Extra columns are not read.
    """
    sig, info = _grouped(docs, threshold, k, recall)
    df = sig.select("doc_id", "class").join(small(info.drop("root"), info.count()), "class", "left")
    return df.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("copy_id", "doc_id").alias("copy_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce(F.col("size") - 1 + F.col("docs"), F.lit(0)).cast("long").alias("n_links"),
    )


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class of linked texts: that of the smallest doc_id, where null is the largest. Texts without a word all stay.

    Rows are judged by their own text, whatever other rows have their doc_id; of several with the smallest one, one stays.
    """
    sig, info = _grouped(docs, threshold, WORDS, RECALL)
    classes = small(info.select(F.col("class").alias("__class"), F.col("root").alias("__root"), F.col("class_id").alias("__id")), info.count())
    found = sig.select("doc_id", F.col("class").alias("__class")).join(classes, "__class")
    gone = shared(found.where("doc_id <> __id").select(F.col("doc_id").alias("__gone")).distinct())
    gone = small(gone, gone.count())
    again = shared(sig.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("__again")))
    if not (n := again.count()):
        return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    # an id tells rows apart only where one row has it
    again, same = small(again.where("__again is not null"), n), F.col("doc_id") == F.col("__again")
    named = docs.where("doc_id is not null")
    kept = named.join(again, same, "left_anti").join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    rest = _with_class(docs.where("doc_id is null").union(named.join(again, same, "left_semi"))).join(classes, "__class", "left")
    row = F.struct(*docs.columns)
    first = rest.where(F.col("doc_id").eqNullSafe(F.col("__id"))).where("__root is not null").groupBy("__root").agg(F.min_by(row, F.struct("__class", "text")).alias("__row"))
    return kept.union(rest.where("__root is null").select(*docs.columns)).union(first.select("__row.*"))
