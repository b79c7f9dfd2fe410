"""Suffix-array dedup of bytes: arrays of shards by induced sorting, and permuted common prefixes.

Equal windows share a path of repeated minimizers, so the stretch of text around each occurrence of a path goes to the
shard of that path. Equal stretches are summed up first: only the earliest of each is sorted. In a shard, suffixes are
classified, the leftmost-smaller (LMS) substrings sorted and named, their suffixes ordered, and the rest induced bucket by
bucket, a bucket's whole front at a time. The LMS suffixes are ordered by recursion where their names are 2,048 at most, else
by prefix doubling, as a pass over so many buckets would be slow. The order is exact to well over a window's length, which is all that is asked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encode, in_batches, pieces, shared
from .repeats import by_text, byte_items, ids_repeat, joined_spans, occurrences, with_parts

WINDOW, K = 100, 32
#: Bytes of stretches in a shard, on average at most; shards in a task; shards that one path may fill.
SHARD, SHARDS, PATH = 250_000, 8, 8
#: Windows that a task holds at a time.
CHUNK = 65_536


def classify(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (S); the end is smaller than all."""
    turn = np.flatnonzero(t[1:] != t[:-1])
    begin = np.concatenate([[0], turn + 1])
    smaller = np.append(t[turn] < t[turn + 1], False)
    return np.repeat(smaller, np.diff(np.append(begin, len(t))))


def _deal(bins: list[list[np.ndarray]], at: np.ndarray, keys: np.ndarray) -> None:
    """Append positions to the bins of their keys, in order."""
    if not len(at):
        return
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    for key, part in zip(keys[np.concatenate([[0], cut])].tolist(), np.split(at[order], cut), strict=True):
        bins[key].append(part)


def induce(t: np.ndarray, small_: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in the order that follows from the given order of the LMS ones; keys of t are below size."""
    none = np.zeros(0, np.int64)
    starts: list[list[np.ndarray]] = [[] for _ in range(size)]
    _deal(starts, lms, t[lms])
    seeds = [np.concatenate(x) if x else none for x in starts]
    larger: list[list[np.ndarray]] = [[] for _ in range(size)]
    fronts: list[np.ndarray] = []
    larger[int(t[-1])].append(np.array([len(t) - 1]))
    for c in range(size):
        front, done = np.concatenate(larger[c]) if larger[c] else none, []
        while len(front):
            done.append(front)
            p = front[front > 0] - 1
            p = p[~small_[p]]
            same = t[p] == c
            _deal(larger, p[~same], t[p[~same]])
            front = p[same]
        fronts.append(np.concatenate(done) if done else none)
        p = seeds[c]
        p = p[p > 0] - 1
        _deal(larger, p, t[p])
    smaller: list[list[np.ndarray]] = [[] for _ in range(size)]
    backs: list[np.ndarray] = [none] * size
    for c in reversed(range(size)):
        front, done = np.concatenate(smaller[c]) if smaller[c] else none, []
        while len(front):
            done.append(front)
            p = front[front > 0] - 1
            p = p[small_[p]]
            same = t[p] == c
            _deal(smaller, p[~same], t[p[~same]])
            front = p[same]
        backs[c] = (np.concatenate(done) if done else none)[::-1]
        p = fronts[c][::-1]
        p = p[p > 0] - 1
        p = p[small_[p]]
        _deal(smaller, p, t[p])
    return np.concatenate([x for pair in zip(fronts, backs, strict=True) for x in pair])


def _named(t: np.ndarray, small_: np.ndarray, place: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the LMS substrings, by text order: equal ones share a name, and names follow the sorted order; and that order, by number."""
    until = np.append(place[1:], len(t) - 1)
    number = np.zeros(len(t), np.int64)
    number[place] = np.arange(len(place))
    own = number[order]
    a, b = own[:-1], own[1:]
    size = until - place
    same = (size[a] == size[b]) & (until[a] != len(t) - 1) & (until[b] != len(t) - 1)
    live = np.flatnonzero(same)
    step = 0
    while len(live):
        x, y = place[a[live]] + step, place[b[live]] + step
        equal = (t[x] == t[y]) & (small_[x] == small_[y])
        same[live[~equal]] = False
        live = live[equal & (step < size[a[live]])]
        step += 1
    names = np.zeros(len(place), np.int64)
    names[own] = np.concatenate([[0], np.cumsum(~same)])
    return names, own


def _doubled(names: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of a string of names, to `depth` names, from that of the names, by doubling what is compared of equals."""
    n, k = len(names), 1
    sorted_ = names[order]
    begin = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    live, order = np.arange(n), order.copy()
    rank = np.zeros(n, np.int64)
    while True:
        # a rank is the place of a group's first in the order; groups of one are settled
        start = live[np.flatnonzero(begin)]
        size = np.diff(np.append(np.flatnonzero(begin), len(live)))
        rank[order[live]] = np.repeat(start, size)
        live = live[np.repeat(size > 1, size)]
        if not len(live) or k >= depth:
            return order
        own = order[live]
        after = np.where(own + k < n, rank[np.minimum(own + k, n - 1)] + 1, 0)
        key = rank[own] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        order[live] = own[by]
        key = key[by]
        begin = np.concatenate([[True], key[1:] != key[:-1]])
        k *= 2


def suffix_array(t: np.ndarray, size: int, depth: int) -> np.ndarray:
    """Suffixes of t (keys below size) in order, exact to `depth` items at least."""
    if not len(t):
        return np.zeros(0, np.int64)
    small_ = classify(t)
    place = np.flatnonzero(small_[1:] & ~small_[:-1]) + 1
    if not len(place):
        return induce(t, small_, place, size)
    first = induce(t, small_, place, size)
    is_lms = np.zeros(len(t), bool)
    is_lms[place] = True
    names, by_name = _named(t, small_, place, first[is_lms[first]])
    count = int(names.max()) + 1
    if count == len(place):
        order = np.argsort(names)
    elif count <= 2_048:
        order = suffix_array(names.astype(np.int16), count, -(-depth // 2) + 1)
    else:
        order = _doubled(names, by_name, -(-depth // 2) + 1)
    return induce(t, small_, place[order], size)


def permuted_prefixes(t: np.ndarray, order: np.ndarray, most: int, least: int = 0) -> np.ndarray:
    """By position: the common prefix, up to `most`, of its suffix and the one before it in the order; keys of t below 2**15.

    Four keys are compared at once while they agree, then one by one. Prefixes shorter than `least` may come out as 0: the
    last four keys of such a one are looked at first.
    """
    # what lies beyond the end is unlike any key, and differs from place to place in neither of the two: an end is met first
    padded = np.concatenate([t.astype(np.uint64) + np.uint64(1), np.zeros(most + 8, np.uint64)])
    four = padded[:-3] | padded[1:-2] << np.uint64(16) | padded[2:-1] << np.uint64(32) | padded[3:] << np.uint64(48)
    out = np.zeros(len(t), np.int64)
    live, before, length = order[1:], order[:-1], 0
    if least >= 4:
        far = four[live + (least - 4)] == four[before + (least - 4)]
        live, before = live[far], before[far]
    rest = []
    while len(live) and length + 4 <= most:
        same = four[live + length] == four[before + length]
        rest.append((live[~same], before[~same], length))
        live, before = live[same], before[same]
        length += 4
    rest.append((live, before, length))
    for live, before, length in rest:
        out[live] = length
        while len(live) and length < most:
            same = (padded[live + length] == padded[before + length]) & (padded[live + length] > 0)
            live, before = live[same], before[same]
            length += 1
            out[live] = length
            if length % 4 == 0 and length + 4 <= most:
                break
    return out


def repeats_of(stretches: list[tuple[tuple, bytes]], window: int) -> list[tuple[tuple, int, int]]:
    """(key, from, to) of starts, from a stretch's first byte, whose window also starts in a stretch of a lower key."""
    stretches = sorted(stretches, key=lambda x: x[0])
    data = np.frombuffer(b"".join(s + b"\0" for _, s in stretches), np.uint8).astype(np.int16) + 1
    size = np.array([len(s) + 1 for _, s in stretches])
    end = np.cumsum(size)
    data[end - 1] = 0
    order = suffix_array(data, 257, window + 30)
    common = permuted_prefixes(data, order, window, window)
    owner = np.repeat(np.arange(len(size)), size)
    whole = np.arange(len(data)) + window < end[owner]
    joined = (common[order[1:]] >= window) & whole[order[1:]] & whole[order[:-1]]
    group = np.concatenate([[0], np.cumsum(~joined)])
    lowest = np.minimum.reduceat(order, np.flatnonzero(np.concatenate([[True], ~joined])))
    gone = np.zeros(len(data) + 1, bool)
    gone[order[lowest[group] < order]] = True
    gone[:-1] &= whole
    out = []
    edge = np.flatnonzero(gone[1:] != gone[:-1]) + 1
    edge = np.concatenate([[0], edge]) if gone[0] else edge
    # a run of starts may go from one stretch's last window... never into the next: the starts before an end are not whole
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        i = int(owner[a])
        out.append((stretches[i][0], a - int(end[i] - size[i]), b - int(end[i] - size[i])))
    return out


def _stretches(texts: DataFrame, window: int, with_bytes: bool) -> DataFrame:
    """(d, mark, text, parts) -> a row for each part: (path, x, y, d, mark, lo, size), with the bytes or without."""
    names = ["path", "x", "y", "d", "mark", "lo", "size"] + ["bytes"] * with_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, mark, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            at = lists.offsets.to_numpy().astype(np.int64)
            path, lo, hi = (lists.values.field(i).to_numpy() for i in range(3))
            texts = batch.column(2).to_pylist()
            for rows in pieces(list(range(len(texts))), [len(t or "") for t in texts], 4_000_000):
                cut = []
                for i in rows:
                    data = encode(texts[i])
                    cut += [data[a : b + window] for a, b in zip(lo[at[i] : at[i + 1]].tolist(), hi[at[i] : at[i + 1]].tolist(), strict=True)]
                digest = np.frombuffer(b"".join(hashlib.blake2b(s, digest_size=16).digest() for s in cut), np.int64)
                own, of = slice(at[rows[0]], at[rows[-1] + 1]), np.repeat(rows, np.diff(at)[rows])
                columns = [path[own], digest[::2], digest[1::2], d[of], mark[of], lo[own].astype(np.int32), np.array([len(s) for s in cut], np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns] + [pa.array(cut, pa.binary())] * with_bytes, names)

    schema = "path long, x long, y long, d long, mark long, lo int, size int" + ", bytes binary" * with_bytes
    return in_batches(texts.select("d", "mark", "text", "parts"), run, schema)


def window_rows(data: bytes, lo: int, hi: int, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, start) of the windows that start at lo to hi, CHUNK at a time; x and y are halves of a window's digest."""
    for a in range(lo, hi + 1, CHUNK):
        starts = range(a, min(a + CHUNK, hi + 1))
        # a slice goes when its digest is there, so a chunk takes some bytes a window whatever the windows' length
        digest = np.frombuffer(b"".join(hashlib.blake2b(data[i : i + window], digest_size=16).digest() for i in starts), np.int64)
        yield digest[::2], digest[1::2], np.arange(starts.start, starts.stop, dtype=np.int32)


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """(d, mark, text, parts) -> a row for each window of the parts, as `_stretches` has them without bytes.

    Windows are told apart in the task, so that a text's list holds its parts and not its windows.
    """
    names = ["path", "x", "y", "d", "mark", "lo", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0

        def together() -> pa.RecordBatch:
            nonlocal rows
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)
            held.clear()
            rows = 0
            return out

        for batch in batches:
            for i in range(batch.num_rows):
                d, mark, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), encode(batch.column(2)[i].as_py())
                for part in batch.column(3)[i]:
                    path, lo, hi = (part[f].as_py() for f in ("path", "lo", "hi"))
                    for x, y, start in window_rows(data, lo, hi, window):
                        same = lambda v, n=len(x), kind=np.int64: np.full(n, v, kind)
                        held.append([same(path), x, y, same(d), same(mark), start, same(window, kind=np.int32)])
                        rows += len(x)
                        if rows >= CHUNK:
                            yield together()
        if held:
            yield together()

    return in_batches(texts.select("d", "mark", "text", "parts"), run, "path long, x long, y long, d long, mark long, lo int, size int")


def _sorted_shards(rows: DataFrame, window: int) -> DataFrame:
    """Rows of a shard, (shard, d, mark, lo, bytes) sorted by shard, -> (d, mark, lo, s, e): repeated starts from the stretch's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own = None, []

        def give() -> pa.RecordBatch:
            found = [(*key, a, b) for key, a, b in repeats_of(own, window)] if len(own) > 1 else []
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], ["d", "mark", "lo", "s", "e"])

        for batch in batches:
            for s, d, mark, lo, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if s != shard and own:
                    yield give()
                    own = []
                shard = s
                own.append(((d, mark, lo), data))
        if own:
            yield give()

    return in_batches(rows.select("shard", "d", "mark", "lo", "bytes"), run, "d long, mark long, lo int, s int, e int")


def _summed(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of stretches: the earliest of each kind as f, and where the others are."""
    first = shared(seen.groupBy("path", "x", "y").agg(F.min(F.struct("d", "mark", "lo")).alias("f"), F.min("size").alias("size")))
    again = seen.join(first.drop("size"), ["path", "x", "y"]).where(F.struct("d", "mark", "lo") != F.col("f"))
    return first, again.select("d", "mark", F.col("lo").alias("s"), (F.col("lo") + F.col("size")).alias("e"))


def repeated_bytes(docs: DataFrame, window: int = WINDOW, k: int = K, shard: int = SHARD, repeat: bool = True) -> DataFrame:
    """(d, mark, parts): by text, the byte spans (s, e) of windows that also start earlier.

    A path whose differing stretches hold more than PATH shards would fill a task however many there are: its stretches
    are cut into their windows, which are summed up in the same way as stretches are and need no sorting.
    """
    paths = occurrences(docs, byte_items, k, window, False, repeat)
    lists = shared(by_text(paths, "path", "lo", "hi"), paths)
    seen = shared(_stretches(with_parts(docs, lists, repeat), window, False), lists)
    first, again = _summed(seen)
    again = shared(again, seen)
    several = first.groupBy("path").agg(F.count("*").alias("kinds"), F.sum("size").alias("bytes")).where("kinds > 1")
    # written first, so that a path of very many stretches can be split in the join
    several = shared(several)
    chosen = first.join(several, "path").select("path", F.col("f.d").alias("d"), F.col("f.mark").alias("mark"), F.col("f.lo").alias("lo"), (F.col("f.lo") + F.col("size") - window).alias("hi"), "bytes")
    chosen = shared(chosen, first, several)
    one, many = (chosen.where(c).drop("bytes") for c in (F.col("bytes") <= PATH * shard, F.col("bytes") > PATH * shard))
    total = one.agg(F.sum(F.col("hi") - F.col("lo") + window)).first()[0] or 0
    shards = max(1, -(-total // shard))
    lists = shared(by_text(one, "path", "lo", "hi"))
    rows = _stretches(with_parts(docs, lists, repeat), window, True)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("path"), F.lit(shards)))
    rows = rows.repartition(-(-shards // SHARDS), "shard").sortWithinPartitions("shard")
    starts = _sorted_shards(rows, window)
    partly = shared(starts.select("d", "mark", (F.col("lo") + F.col("s")).alias("s"), (F.col("lo") + F.col("e") - 1 + window).alias("e")), lists)
    windows = shared(_windows(with_parts(docs, by_text(many, "path", "lo", "hi"), repeat), window), chosen)
    alone, hot = _summed(windows)
    hot = shared(hot, alone, windows)
    return shared(joined_spans(again.union(partly).union(hot)), again, partly, hot)


def strip_repeats(docs: DataFrame, window: int = WINDOW, k: int = K, kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with kept, kept of each row of docs; kept is the bytes that stay.

    A byte goes if a string of `window` bytes that covers it also starts earlier: in a document with a smaller doc_id, or
    before it in the same one; overlaps count, and strings are judged on the input. Null, empty and shorter texts lose
    nothing. A null doc_id is the smallest; different texts of one doc_id follow a hash of theirs, and equal ones lose
    the same. Extra columns are not read.
    """
    repeat = ids_repeat(docs)
    spans = repeated_bytes(docs, window, k, repeat=repeat)
    joined = with_parts(docs, spans, repeat, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, runs, digest, rest = [], [], [], [], []
            for text, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = encode(text)
                n.append(len(data))
                count = 0
                if parts:
                    edge = np.zeros(len(data) + 1, np.int64)
                    np.add.at(edge, [p["s"] for p in parts], 1)
                    np.add.at(edge, [p["e"] for p in parts], -1)
                    stay = np.cumsum(edge)[:-1] == 0
                    count = int((~stay & np.concatenate([[True], stay[:-1]])).sum())
                    data = np.frombuffer(data, np.uint8)[stay].tobytes()
                gone.append(n[-1] - len(data))
                runs.append(count)
                digest.append(hashlib.sha256(data).hexdigest())
                if kept:
                    rest.append(data)
            columns = [batch.column(0), *[pa.array(x, pa.int64()) for x in (n, gone, runs)], pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(rest, pa.binary())] * kept, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * kept)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(joined.select("doc_id", "text", "parts"), run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept)
