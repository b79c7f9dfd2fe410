"""Many words and phrases at once: an Aho-Corasick automaton over each text where it lies."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import shared

#: Bytes of entries that are broadcast and matched in one pass over the texts, about.
BYTES = 16 << 20


@lru_cache(1 << 16)
def _folded(c: str) -> str:
    """A character in the case that two are compared in; always one."""
    upper = c.upper() if len(c.upper()) == 1 else c
    return upper.lower() if len(upper.lower()) == 1 else upper


def fold(text: str) -> str:
    return text.lower() if text.isascii() else "".join(map(_folded, text))


@lru_cache(1 << 16)
def is_word(c: str) -> bool:
    return c.isalpha() or unicodedata.category(c) in ("Mn", "Mc", "Me", "Nd", "Nl", "Pc") or c in "‌‍"


class Automaton:
    """Finds entries (number, words) as whole words in any case."""

    def __init__(self, entries: list[tuple[int, str]]):
        import ahocorasick

        self.found, of = ahocorasick.Automaton(), {}
        for n, words in entries:
            if words:
                of.setdefault(fold(words), []).append(n)
        for words, numbers in of.items():
            self.found.add_word(words, (len(words), numbers))
        self.empty = not of
        if of:
            self.found.make_automaton()

    def numbers(self, text: str | None) -> list[int]:
        """The entries that a text holds, ascending."""
        if self.empty or not text:
            return []
        text, out = fold(text), set()
        for last, (size, numbers) in self.found.iter(text):
            begin = last + 1 - size
            if (not begin or not is_word(text[begin - 1])) and (last + 1 == len(text) or not is_word(text[last + 1])):
                out.update(numbers)
        return sorted(out)


#: The automaton that this worker has built last, by its broadcast.
_BUILT: dict[str, Automaton] = {}


def find(rows: DataFrame, key: str, text: str, entries: DataFrame) -> DataFrame:
    """(key, entry) for each entry (entry, words) that stands in a row's text as whole words, in any case, once a row.

    The rows are read once for each BYTES of entries, a block of them by a hash; neither a row nor a pair is shuffled. Empty
    entries and null texts have none.
    """
    spark = rows.sparkSession
    entries = shared(entries.select(F.col("entry").cast("long").alias("entry"), "words").where(F.octet_length("words") > 0))
    size = entries.agg(F.sum(F.octet_length("words") + 16)).first()[0] or 0
    blocks, out = max(1, -(-size // BYTES)), None
    kind = rows.schema[key].dataType.simpleString()
    for b in range(blocks):
        own = [tuple(r) for r in entries.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b).collect()]
        given = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], given=given, id_=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            if id_ not in _BUILT:
                _BUILT.clear()
                _BUILT[id_] = Automaton(given.value)
            for batch in batches:
                found = [_BUILT[id_].numbers(t) for t in batch.column(1).to_pylist()]
                at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([n for f in found for n in f], pa.int64())], [key, "entry"])

        own_rows = rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, entry long")
        out = own_rows if out is None else out.union(own_rows)
    return out
