"""Substring dedup of a text with more items than a minimizer's place has bits for."""

import numpy as np
import pytest

from palimpsest.llm import passages, suffix_array
from palimpsest.llm.common import mix64, sliding_hash
from palimpsest.llm.repeats import PLACE_BITS, minimizers

LONG = (1 << 24) + 5_000


@pytest.mark.parametrize("module", [suffix_array, passages])
def test_minimizers_of_long_texts(module):
    k, window = module.K, module.WINDOW
    items = np.random.default_rng(1).integers(0, 1 << 63, LONG).astype(np.uint64)
    assert len(items) > 1 << PLACE_BITS
    text, place, value, lo, hi = minimizers(items, np.array([0, LONG]), k, window)
    assert (text == 0).all() and (np.diff(place) > 0).all() and (lo[1:] == hi[:-1] + 1).all()
    assert lo[0] == 0 and hi[-1] == LONG - window
    assert ((place >= hi) & (place <= lo + window - k)).all()
    assert (value == mix64(sliding_hash(items, k))[place]).all()
    # the same windows have the same minimizers wherever they are in a text
    for cut in ((1 << 24) - 2_000, 1 << 24):
        _, own, own_value, own_lo, own_hi = minimizers(items[cut:], np.array([0, LONG - cut]), k, window)
        at = np.searchsorted(hi, cut)
        for got, want in ((own + cut, place), (own_value, value), (own_hi + cut, hi)):
            assert (got == want[at:]).all()
        assert (own_lo[1:] + cut == lo[at + 1 :]).all()


def test_repeats_beyond_the_places_of_one_turn(spark):
    text = np.random.default_rng(2).integers(33, 127, LONG).astype(np.uint8).tobytes().decode()
    tail = text[-300:]
    table = spark.createDataFrame([(1, text), (2, tail), (3, "unlike any other " * 2)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_array.strip_repeats(table).select("doc_id", "n_bytes", "n_removed").collect()}
    assert got == {1: (LONG, 0), 2: (300, 300), 3: (34, 0)}
