"""Near duplicates are dropped by row, whatever ids the rows have."""

import pytest

from palimpsest.llm import ngram_join

SCHEMA = "doc_id long, text string, lang string"


def text(name, changed=False):
    w = [f"{name}{i}" for i in range(100)]
    if changed:
        w[-1] = "other"
    return " ".join(w)


A, B, C = text("a"), text("b"), text("c")
NEAR_A, NEAR_C = text("a", True), text("c", True)


@pytest.mark.parametrize(
    "rows, kept",
    [
        # the copy of A under 7 goes, B under 7 stays
        ([(3, A), (7, A), (7, B)], [(3, A), (7, B)]),
        ([(3, A), (7, A), (7, B), (9, B)], [(3, A), (7, B)]),
        # both groups have 7 as the smallest id
        ([(7, A), (7, B), (8, NEAR_A), (9, B)], [(7, A), (7, B)]),
        # null ids: copies and near copies go, the last one of a group stays
        ([(None, A), (None, NEAR_A), (5, A), (None, B), (None, B)], [(5, A), (None, B)]),
        ([(None, C), (None, NEAR_C), (None, C)], [(None, {C, NEAR_C})]),
        # two near copies under one id, and texts without a word
        ([(4, C), (4, NEAR_C), (4, None), (4, " "), (None, None), (None, None)], [(4, {C, NEAR_C}), (4, None), (4, " "), (None, None), (None, None)]),
    ],
)
def test_rows_are_judged_by_their_own_text(spark, rows, kept):
    got = ngram_join.deduplicate(spark.createDataFrame([(*r, "en") for r in rows], SCHEMA))
    assert got.columns == ["doc_id", "text", "lang"]
    left = [(r["doc_id"], r["text"]) for r in got.collect()]
    for i, want in kept:
        match = next(r for r in left if r[0] == i and (r[1] in want if isinstance(want, set) else r[1] == want))
        left.remove(match)
    assert not left
