"""Language ID: multinomial naive Bayes over hashed character n-grams of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, pieces

ORDERS, BITS, TABLE_BYTES = (1, 2, 3), 16, 64 << 20
UNKNOWN = "und"
#: Tasks that add up the others' counts; n-grams that are scored at once.
SUMS, GRAMS = 16, 1 << 18


def held_out(doc_id):
    """Whether crc32 of the id's text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _grams(texts: list[str | None], orders: tuple[int, ...], bits: int) -> tuple[Iterator[np.ndarray], np.ndarray]:
    """For each n the bucket of the n-gram that ends at each lower-case code point of all texts, and where each text begins.

    Zeros stand before a text, so that an n-gram holds nothing of the text before it.
    """
    pad = max(orders) - 1
    lower = [(t or "").lower() for t in texts]
    size = np.array([len(t) for t in lower], np.int64)
    x = np.frombuffer("".join("\0" * pad + t for t in lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.ones(len(x), bool)
    own[(np.cumsum(size + pad) - size - pad)[:, None] + np.arange(pad)] = False

    def each() -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            h = np.zeros_like(x)
            for n in range(1, max(orders) + 1):
                back = np.zeros_like(x)
                back[n - 1 :] = x[: len(x) - n + 1]
                h = h * np.uint32(0x01000193) + (back + np.uint32(n)) * np.uint32(0x9E3779B1)
                if n in orders:
                    yield (((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits))[own]

    return each(), np.concatenate([[0], np.cumsum(size)])


def _text_sums(table: np.ndarray, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the table's rows of each text's n-grams, GRAMS at a time however long a text is; at has one more entry than texts."""
    out = np.zeros((len(at) - 1, table.shape[1]))
    for a in range(0, len(grams), GRAMS):
        b = min(a + GRAMS, len(grams))
        first, last = np.searchsorted(at, a, "right") - 1, np.searchsorted(at, b)
        out[first:last] += np.add.reduceat(table[grams[a:b]], np.maximum(at[first:last] - a, 0), axis=0, dtype=np.float64)
    return out


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in batches:
        for i, n, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            x = np.frombuffer(counts, np.int64)
            sums[i] = [sums[i][0] + n, sums[i][1] + x] if i in sums else [n, x]
    yield _tables(sums)


def _tables(sums: dict[int, list]) -> pa.RecordBatch:
    names, kinds = ("i", "n", "counts"), (pa.int32(), pa.int64(), pa.binary())
    columns = [list(sums), [int(x[0]) for x in sums.values()], [x[1].tobytes() for x in sums.values()]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def train(docs: DataFrame, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> tuple[list[str], np.ndarray]:
    """Learn from all rows of docs with a lang: the languages, and log-probabilities by bucket and language, the log-priors last.

    Each task sums the n-gram counts of its own texts; SUMS tasks add those up, a table at a time, and the driver gets
    theirs. A table is held to TABLE_BYTES: above 128 languages there are fewer buckets, and above 8,192 it raises.
    """
    docs = docs.where("lang is not null").select("text", "lang")
    langs = sorted(r[0] for r in docs.select("lang").distinct().limit(8193).collect())
    if len(langs) > 8192:
        raise ValueError("more than 8192 languages")
    while bits > 8 and len(langs) << (bits + 3) > TABLE_BYTES:
        bits -= 1
    index, size = {x: i for i, x in enumerate(langs)}, 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {i: [0, np.zeros(size, np.int64)] for i in range(len(langs))}
        for batch in batches:
            texts, own = batch.column(0).to_pylist(), [index[x] for x in batch.column(1).to_pylist()]
            for part in pieces(list(zip(texts, own, strict=True)), [len(t or "") for t in texts]):
                grams, at = _grams([t for t, _ in part], orders, bits)
                used, lang = np.unique([i for _, i in part], return_inverse=True)
                cell = np.repeat(lang * size, np.diff(at))
                found = sum(np.bincount(cell + g, minlength=len(used) * size) for g in grams)
                for k, i in enumerate(used.tolist()):
                    sums[i] = [sums[i][0] + int((lang == k).sum()), sums[i][1] + found[k * size : (k + 1) * size]]
        yield _tables(sums)

    schema = "i int, n long, counts binary"
    tables = in_batches(in_batches(docs, count, schema).repartition(SUMS), _add_up, schema)
    counts, priors = np.zeros((len(langs), size)), np.zeros(len(langs))
    for row in tables.toLocalIterator():
        counts[row["i"]] += np.frombuffer(row["counts"], np.int64)
        priors[row["i"]] += row["n"]
    log = np.log((counts + 0.5) / (counts + 0.5).sum(1, keepdims=True))
    return langs, np.vstack([log.T, np.log(priors / max(priors.sum(), 1))[None]]).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: tuple[str, ...], orders: tuple[int, ...] = ORDERS, names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """The columns named in keep, then the language and its posterior, under the names, for each row, from its whole text.

    A third name gets the mean log-probability of the text's n-grams in that language, which a text's length doesn't change.
    A null text, or one without a letter, gets `und`, score 0 and no mean; so does every text if no language was learned.
    """
    langs, log = model
    bits = (len(log) - 1).bit_length() - 1
    shared_log = docs.sparkSession.sparkContext.broadcast(log)
    columns = docs.select(*keep, docs["text"].alias("__text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared_log.value
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            pred, best, mean = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), -np.inf)
            known = [i for i, t in enumerate(texts) if langs and _has_letter(t)]
            for part in pieces(known, [len(texts[i]) for i in known], 200_000):
                grams, at = _grams([texts[i] for i in part], orders, bits)
                total = np.tile(table[-1].astype(float), (len(part), 1))
                for g in grams:
                    total += _text_sums(table, g, at)
                top = total.argmax(1)
                share = np.exp(total - total.max(1, keepdims=True))
                best[part] = 1 / share.sum(1)
                mean[part] = (total.max(1) - table[-1][top]) / (len(orders) * np.diff(at))
                for i, k in zip(part, top.tolist(), strict=True):
                    pred[i] = langs[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(pred, pa.string()), pa.array(best), pa.array(mean)][: len(names)]], [*keep, *names])

    kinds = [f"`{c}` {columns.schema[c].dataType.simpleString()}" for c in keep]
    return in_batches(columns, score, ", ".join([*kinds, *[f"{n} {k}" for n, k in zip(names, ("string", "double", "double"), strict=False)]]))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, and predict every row: doc_id, held_out, lang_pred, score.

    Neither lang, source nor doc_id reaches a prediction; an empty table gives no rows; extra columns are not read.
    """
    own = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    return predict(own, train(own.where("not held_out")), ("doc_id", "held_out"))


def accept(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, unchanged, whose language is recognised with a posterior of `least` or more.

    Their n-grams must also be likelier in that language than by chance, one bucket in all: what is written in another
    script than any learned language, or is no writing, is not, however sure the posterior is.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))))
    names = ("__accept_lang", "__accept_score", "__accept_mean")
    found = predict(docs, model, tuple(docs.columns), names=names)
    chance = -float(np.log(max(1, len(model[1]) - 1)))
    return found.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least) & (F.col(names[2]) >= chance)).drop(*names)
