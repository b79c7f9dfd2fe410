"""SentencePiece on long words, and with caches that overflow."""

import random

import pytest

from palimpsest.llm import sentencepiece


@pytest.fixture(scope="module")
def coder():
    return sentencepiece.Coder(sentencepiece.load())


@pytest.fixture(scope="module")
def lib():
    import sentencepiece as library

    return library.SentencePieceProcessor(model_file=sentencepiece.MODEL)


@pytest.mark.parametrize("letters", ["a", "=", "aab", "etaoinshrdlu", "abcdefghijklmnopqrstuvwxyz", "äöüéßабвгд日本語中国xyz", "0123456789abcdef", "-=_"])
def test_words_without_blanks(coder, lib, letters):
    rng = random.Random(len(letters))
    for n in (sentencepiece.LONG - 1, sentencepiece.LONG, sentencepiece.LONG + 1, 3 * sentencepiece.LONG + 17, 20_000):
        word = "".join(rng.choices(letters, k=n))
        for text in (word, f"the {word} end", f"{'=' * 700}{word}{'a' * 900}"):
            assert coder.encode([text])[0].tolist() == lib.encode(text)


def test_windows_that_share_no_piece(coder, lib, monkeypatch):
    """With hardly any overlap, windows are shifted or become one."""
    monkeypatch.setattr(sentencepiece, "LONG", 24)
    monkeypatch.setattr(sentencepiece, "OVERLAP", 4)
    rng = random.Random(3)
    for letters in ("a", "ab", "etaoin", "the quick"):
        word = "".join(rng.choices(letters.replace(" ", ""), k=400))
        assert coder.encode([word])[0].tolist() == lib.encode(word)


def test_small_cache(coder, lib, monkeypatch):
    monkeypatch.setattr(sentencepiece, "KEPT", 20_000)
    rng = random.Random(5)
    encoder = sentencepiece.Encoder(coder)
    for _ in range(30):
        texts = [" ".join("".join(rng.choices("etaoin", k=rng.randint(1, 5))) for _ in range(40)) for _ in range(5)]
        ids, first = encoder.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == lib.encode(texts)
        assert encoder.bytes < 200_000
