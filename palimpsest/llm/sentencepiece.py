"""SentencePiece encoding and decoding with a given vocabulary, as a batched numpy Viterbi search.

Texts are cut into words where no piece can reach across: between two characters that no piece holds side by side. The
distinct words of a batch advance together with those of equal length: at each position the substrings that end there are
hashed and probed in the sorted hashes of the pieces, and back pointers keep the best. For a unigram vocabulary the best is the highest sum
of scores. A byte-pair vocabulary defines its segmentation by merges, not by a sum, and a sum of its scores gives other
pieces; there a step is open only if the last piece so far and the new one, joined, would be merged into just these two.
That leaves one way to each position, which is the merges' own.

A long word is searched in overlapping windows that advance together. Two segmentations whose steps are all open and that share a piece can be joined
at it, and the result has only open steps too, so it is the merges' own for the whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BYTE_BASE, SEQ_BASE, U, in_batches, mix64, pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Bytes that the kept words of one partition take, about, at most, and a word's own beside its pieces.
KEPT, WORD_BYTES = 48 << 20, 40
#: Code points whose neighbours are looked up in a table; the last of them stands for the blank.
TABLE = 2_048
#: Characters of a word beyond which it is searched in windows, how far windows overlap; a multiple of a piece's usual length.
LONG, OVERLAP = 384, 128
#: Characters of texts that are encoded at once, if they are not one text's.
PIECE = 1_000_000
#: Stands for no way to a position.
NONE = np.iinfo(np.int32).min


@dataclass
class Vocabulary:
    """Pieces by id. kind: "bpe" or "unigram"."""

    text: list[str]
    score: np.ndarray
    usable: np.ndarray
    byte: np.ndarray
    unknown: int
    kind: str
    prefix: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialised message; 32-bit values as bytes."""
    i = 0

    def number() -> int:
        nonlocal i
        out = shift = 0
        while True:
            out |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return out

    while i < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = number() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            yield key >> 3, data[i : i + size]
            i += size


def load(path: str = MODEL) -> Vocabulary:
    """Read a model file: pieces (1: text, 2: score, 3: type), trainer (2: 3 is the model type), normaliser (3: 3 is the dummy prefix)."""
    with open(path, "rb") as f:
        data = f.read()
    text, score, types, kind, prefix = [], [], [], 1, True
    for n, value in _fields(data):
        if n == 1:
            own = dict(_fields(value))
            text.append(own[1].decode("utf-8"))
            score.append(np.frombuffer(own.get(2, b"\0\0\0\0"), np.float32)[0])
            types.append(own.get(3, 1))
        elif n == 2:
            kind = dict(_fields(value)).get(3, 1)
        elif n == 3:
            prefix = bool(dict(_fields(value)).get(3, 1))
    types = np.array(types)
    byte = np.full(256, -1, np.int32)
    for i in np.flatnonzero(types == 6):
        byte[int(text[i][3:5], 16)] = i
    return Vocabulary(text, np.array(score, np.float64), (types == 1) | (types == 4), byte, int(np.flatnonzero(types == 2)[0]), {1: "unigram", 2: "bpe"}[kind], prefix)


class Coder:
    """Encodes and decodes; holds only what follows from the vocabulary, so that it can be broadcast."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, own = v, np.flatnonzero(v.usable)
        codes = [np.array([ord(c) for c in v.text[i]], np.uint32) for i in own]
        self.longest = max(map(len, codes), default=1)
        hashes = np.zeros(len(v.text), U)
        for i, c in zip(own, codes, strict=True):
            hashes[i] = self._hash(c)
        with np.errstate(over="ignore"):
            self.powers = np.multiply.accumulate(np.concatenate([[U(1)], np.full(self.longest, SEQ_BASE)]))
        self.hash, self.power = hashes, np.ones(len(v.text), U)
        self.power[own] = self.powers[[len(c) for c in codes]]
        order = own[np.argsort(hashes[own])]
        self.keys, self.of = hashes[order], order.astype(np.int32)
        # where the sorted keys of each leading 20 bits begin, and how many they are at most
        self.begin = np.searchsorted(self.keys >> U(44), np.arange((1 << 20) + 1, dtype=U)).astype(np.int32)
        self.most = int(np.diff(self.begin).max())
        # pairs of neighbours that some piece holds; those below TABLE as a table
        pairs = np.unique(np.concatenate([np.zeros(0, U), *((c[:-1].astype(U) << U(32)) | c[1:] for c in codes)]))
        low, high = (self._slot(x.astype(np.uint32)) for x in (pairs >> U(32), pairs & U(0xFFFFFFFF)))
        self.beside, self.held = pairs, np.zeros((TABLE, TABLE), bool)
        self.held[low[(low >= 0) & (high >= 0)], high[(low >= 0) & (high >= 0)]] = True
        self.score, self.least = v.score, v.score.min() - 10
        self.width = np.array([len(t) for t in v.text])
        if v.kind == "bpe":
            self._trees()
        raw = [b"" if not u else t.replace(BLANK, " ").encode() for t, u in zip(v.text, v.usable, strict=True)]
        for value, i in enumerate(v.byte.tolist()):
            if i >= 0:
                raw[i] = bytes([value])
        raw[v.unknown] = " ⁇ ".encode()
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(r) for r in raw])
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size

    @staticmethod
    def _hash(codes: np.ndarray) -> np.uint64:
        with np.errstate(over="ignore"):
            h = U(0)
            for c in mix64(codes.astype(U) + U(1)):
                h = h * SEQ_BASE + c
        return h

    def _probe(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, or -1."""
        bucket, out = (h >> U(44)).astype(np.int64), np.full(len(h), -1, np.int32)
        at, until = self.begin[bucket], self.begin[bucket + 1]
        some = np.flatnonzero(at < until)
        at, until = at[some], until[some]
        for _ in range(self.most):
            same = self.keys[at] == h[some]
            out[some[same]] = self.of[at[same]]
            more = ~same & (at + 1 < until)
            some, at, until = some[more], at[more] + 1, until[more]
            if not len(some):
                break
        return out

    def _merge(self, text: str) -> list[str]:
        """What merges make of a text: again and again the best-scored merge, the leftmost of equals. The last entry is the text if a piece."""
        parts, last = list(text), []
        while len(parts) > 1:
            scored = [(self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank]
            if not scored:
                break
            i = min(scored)[1]
            last = parts[i : i + 2]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [*last, *parts] if len(parts) == 1 else parts

    def _trees(self) -> None:
        """For each piece its last merge, and so the parts at its right and left edge as it grows, with when each is used up."""
        v = self.v
        own = np.flatnonzero(v.usable)
        number = {v.text[i]: i for i in own}
        # scores fall with the order of merges; the place in that order is what counts
        places = np.unique(-v.score[own], return_inverse=True)[1]
        self.rank = dict(zip((v.text[i] for i in own), places.tolist(), strict=True))
        self.place = np.full(len(v.text), -1)
        halves = np.full((len(v.text), 2), -1)
        self.built = np.zeros(len(v.text), bool)
        for i in own:
            parts = self._merge(v.text[i])
            self.built[i] = parts[-1] == v.text[i]
            if self.built[i] and len(v.text[i]) > 1:
                halves[i] = [number.get(parts[0], -1), number.get(parts[1], -1)]
                self.place[i] = self.rank[v.text[i]]
        # pieces with a part that merges later than they do are told apart by merging itself
        self.odd = np.zeros(len(v.text), bool)
        for i in sorted(own, key=lambda i: len(v.text[i])):
            parts = [x for x in halves[i] if x >= 0]
            self.odd[i] = any(self.odd[x] or self.place[x] >= self.place[i] for x in parts)
        late = np.iinfo(np.int64).max
        self.edge = []
        for side in (1, 0):
            at, until = np.where(self.built, np.arange(len(v.text)), -1), np.full(len(v.text), late)
            levels = []
            while (at >= 0).any():
                levels.append((at, until))
                until = np.where(at >= 0, self.place[at], -1)
                at = np.where(at >= 0, halves[at, side], -1)
            self.edge.append(levels)

    def opens(self, last: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Whether pieces, joined, are merged into just these two: no merge across the cut comes before the parts beside it are used up."""
        out = np.ones(len(last), bool)
        odd = np.flatnonzero(self.odd[last] | self.odd[new])
        with np.errstate(over="ignore"):
            for x, x_until in self.edge[0]:
                a, au = x[last], x_until[last]
                for y, y_until in self.edge[1]:
                    b, bu = y[new], y_until[new]
                    some = np.flatnonzero(out & (a >= 0) & (b >= 0))
                    if not len(some):
                        break
                    own = self._probe(self.hash[a[some]] * self.power[b[some]] + self.hash[b[some]])
                    when = np.where(own >= 0, self.place[own], np.iinfo(np.int64).max)
                    # of equal merges the left one is first
                    out[some] = ~((own >= 0) & (when < au[some]) & (when <= bu[some]))
        for i in odd:
            a, b = self.v.text[last[i]], self.v.text[new[i]]
            out[i] = self._merge(a + b)[-2:] == [a, b] and a + b not in self.rank
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin."""
        return Encoder(self).encode(texts)

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        """Place of code points in the table; -1 for those that are not in it."""
        return np.where(codes < TABLE - 1, codes.astype(np.int32), np.where(codes == ord(BLANK), np.int32(TABLE - 1), np.int32(-1)))

    def apart(self, codes: np.ndarray) -> np.ndarray:
        """Whether no piece holds a character together with the one before it; the first has none."""
        slot = self._slot(codes)
        low, high = slot[:-1], slot[1:]
        out = np.ones(len(codes), bool)
        out[1:] = ~self.held.reshape(-1)[low * TABLE + high]
        rare = np.flatnonzero((low < 0) | (high < 0))
        if len(rare):
            pair = (codes[rare].astype(U) << U(32)) | codes[rare + 1]
            at = np.minimum(np.searchsorted(self.beside, pair), max(0, len(self.beside) - 1))
            out[rare + 1] = (self.beside[at] != pair) if len(self.beside) else True
        return out

    def final(self, found: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become their bytes' pieces, or the unknown piece where the vocabulary has no bytes."""
        rare = found < 0
        if not rare.any():
            return found, size
        if self.v.byte[0] < 0:
            return np.where(rare, self.v.unknown, found).astype(np.int32), size
        word = np.repeat(np.arange(len(size)), size)
        code = np.where(rare, -1 - found.astype(np.int64), 0)
        code[(code >= 0xD800) & (code < 0xE000)] = ord("?")
        n = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        code, of = np.repeat(code, n), np.repeat(n, n)
        bits = code >> (6 * (of - 1 - nth))
        byte = np.where(nth > 0, 0x80 | (bits & 0x3F), np.array([0, 0, 0xC0, 0xE0, 0xF0])[of] | bits)
        return np.where(np.repeat(rare, n), self.v.byte[byte * np.repeat(rare, n)], np.repeat(found, n)).astype(np.int32), np.bincount(np.repeat(word, n), minlength=len(size))

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """The texts of lists of ids; the prefix's blank goes, bytes that are no UTF-8 become U+FFFD, unknown ids give nothing."""
        ids = np.where((ids >= 0) & (ids < len(self.raw_size)), ids, 1)
        data, at = _gather(self.raw, self.raw_at, self.raw_size, ids)
        data, at = data.tobytes(), at[first]
        out = [data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]
        return [t[1:] if self.v.prefix and t.startswith(" ") else t for t in out]


class Encoder:
    """Encodes texts of one partition; keeps the pieces of its words, and which pieces may follow each other, within bounds.

    Words are known by two 64-bit hashes; if one agrees and the other doesn't, all are forgotten and hashed anew.
    """

    def __init__(self, coder: Coder):
        self.c, self.salt = coder, 0
        self.pair, self.open = np.full(1 << 19, -1, np.int64), np.zeros(1 << 19, bool)
        self._forget()

    def _forget(self) -> None:
        self.key = self.other = np.zeros(0, U)
        self.at, self.size, self.met = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    @property
    def bytes(self) -> int:
        return WORD_BYTES * len(self.key) + 4 * self.used

    def _shrink(self) -> None:
        """Keep the words that were met again; none if they are too many."""
        again = np.flatnonzero(self.met > 1)
        ids, first = _gather(self.flat, self.at, self.size, again)
        key, other, size = self.key[again], self.other[again], self.size[again]
        self._forget()
        if WORD_BYTES * len(key) + 4 * len(ids) < KEPT // 2:
            self._keep(np.zeros(len(key), np.int64), key, other, ids, size)

    def _keep(self, place: np.ndarray, key: np.ndarray, other: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Put words, in order of their keys, before those at some places."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(size) - size
        self.used += len(ids)
        self.key, self.other, self.at, self.size = (np.insert(x, place, y) for x, y in ((self.key, key), (self.other, other), (self.at, at), (self.size, size)))
        self.met = np.insert(self.met, place, 0)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(U) * SEQ_BASE) >> U(45)).astype(np.int64)

    def _opens(self, last: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Coder.opens, from a table of recent pairs where it has them."""
        key = last.astype(np.int64) * len(self.c.hash) + new
        slot = self._slot(key)
        out = self.open[slot]
        other = np.flatnonzero(self.pair[slot] != key)
        if len(other):
            own, back = np.unique(key[other], return_inverse=True)
            found = self.c.opens(own // len(self.c.hash), own % len(self.c.hash))
            out[other] = found[back]
            slot = self._slot(own)
            self.pair[slot], self.open[slot] = own, found
        return out

    def _search(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of one length, a row of code points each, -> their pieces, end to end, and how many each has; -1 - code point for a character without a piece."""
        c, bpe = self.c, self.c.v.kind == "bpe"
        n, size = codes.shape
        plain = np.ascontiguousarray(codes.T)
        before = np.zeros((size + 1, n), U)
        with np.errstate(over="ignore"):
            for i, m in enumerate(plain):
                before[i + 1] = before[i] * SEQ_BASE + mix64(m.astype(U) + U(1))
        piece, step = np.full((size + 1, n), NONE, np.int32), np.zeros((size + 1, n), np.int16)
        best = np.full((size + 1, 1 if bpe else n), -np.inf)
        ways = np.zeros((size + 1, n), bool)
        best[0], ways[0] = 0, True
        for end in range(1, size + 1):
            most = min(end, c.longest)
            length, word = np.nonzero(ways[end - most : end][::-1])
            begin = end - 1 - length
            with np.errstate(over="ignore"):
                found = c._probe(before[end, word] - before[begin, word] * c.powers[length + 1])
            bare = np.flatnonzero((found < 0) & (length == 0))
            found[bare] = -1 - plain[end - 1, word[bare]].astype(np.int32)
            real = found >= 0
            fit = real | (length == 0)
            if bpe:
                fit &= ~real | c.built[np.maximum(found, 0)]
                last = piece[begin, word]
                both = np.flatnonzero(fit & real & (last >= 0))
                fit[both] = self._opens(last[both], found[both])
                # one way at most is open
                some = np.flatnonzero(fit)[::-1]
            else:
                some = np.flatnonzero(fit)
                total = best[begin[some], word[some]] + np.where(real[some], c.score[np.maximum(found[some], 0)], c.least)
                # the best comes last, of equals the shortest
                some = some[np.lexsort((-length[some], total))]
                best[end, word[some]] = np.sort(total)
            piece[end, word[some]], step[end, word[some]], ways[end, word[some]] = found[some], length[some] + 1, True
        # back from the ends, all words at once
        at, columns, every = np.full(n, size), [], np.arange(n)
        while at.any():
            columns.append(np.where(at > 0, piece[at, every], NONE))
            at = at - step[at, every]
        grid = np.array(columns[::-1]).T
        return grid[grid != NONE], (grid != NONE).sum(1)

    def _each(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """_search of rows of code points of any lengths: those of one length together."""
        by: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            by.setdefault(len(r), []).append(i)
        found: list[np.ndarray] = [np.zeros(0, np.int32)] * len(rows)
        for size, group in by.items():
            most = max(1, min(40_000, 1_000_000 // (size + 1)))
            for j in range(0, len(group), most):
                own = group[j : j + most]
                ids, sizes = self._search(np.array([rows[i] for i in own]))
                for i, x in zip(own, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                    found[i] = x
        return found

    def _windows(self, codes: np.ndarray) -> np.ndarray:
        """The pieces of code points that are searched in windows.

        Where two windows share no piece, the later one, and those that go along with it, begin again at an edge of the
        earlier one, as runs of one character want; where that doesn't help, the two become one.
        """
        parts = [(a, min(len(codes), a + LONG)) for a in range(0, max(1, len(codes) - OVERLAP), LONG - OVERLAP)]
        turn = 0
        while True:
            found = self._each([codes[a:b] for a, b in parts])
            edges = [a + np.concatenate([[0], np.cumsum(np.where(x >= 0, self.c.width[np.maximum(x, 0)], 1))]) for (a, _), x in zip(parts, found, strict=True)]
            out, begin, apart = [], 0, []
            for i in range(len(parts) - 1):
                x, y = edges[i], edges[i + 1]
                # a piece of both: two neighbouring edges of both
                common = np.intersect1d(x[x >= y[0]], y[y <= x[-1]], assume_unique=True)
                at, to = np.searchsorted(x, common), np.searchsorted(y, common)
                both = np.flatnonzero((np.diff(at) == 1) & (np.diff(to) == 1) & (at[:-1] >= begin))
                if not len(both):
                    apart.append(i)
                    continue
                j = both[len(both) // 2]
                out.append(found[i][begin : at[j]])
                begin = to[j]
            if not apart:
                return np.concatenate([*out, found[-1][begin:]])
            turn += 1
            again, shift = [parts[0]], 0
            for i, (a, b) in enumerate(parts[1:]):
                later = edges[i][edges[i] > a][:-1]
                if i in apart and turn <= 4 and len(later):
                    shift = int(later[0]) - a
                if i in apart and (turn > 4 or not len(later)):
                    again[-1] = (again[-1][0], min(len(codes), b + shift))
                elif a + shift < len(codes):
                    again.append((a + shift, min(len(codes), b + shift)))
            parts = [*again[:-1], (again[-1][0], len(codes))]

    def _learn(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of words that lie in codes, end to end, and how many each has."""
        sizes = np.zeros(len(begin), np.int64)
        order = np.argsort(size, kind="stable")
        cut = np.flatnonzero(np.diff(size[order])) + 1
        parts = []
        for group in np.split(order, cut):
            n = int(size[group[0]])
            if n > LONG and self.c.v.kind == "bpe":
                for i in group.tolist():
                    ids = self._windows(codes[begin[i] : begin[i] + n])
                    parts.append((np.array([i]), *self.c.final(ids, np.array([len(ids)]))))
                continue
            most = max(1, min(40_000, 400_000 // (n + 1)))
            for j in range(0, len(group), most):
                own = group[j : j + most]
                parts.append((own, *self.c.final(*self._search(codes[begin[own][:, None] + np.arange(n)]))))
        for own, _, n in parts:
            sizes[own] = n
        # from the order of lengths to that of the words
        of, flat, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        place = np.zeros(len(begin), np.int64)
        place[of] = np.cumsum(n) - n
        return _gather(flat, place, sizes, np.arange(len(begin)))[0], sizes

    def _codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all texts, blanks as the blank sign, and where each begins."""
        before = BLANK if self.c.v.prefix else ""
        full = [before + t if t else "" for t in texts]
        codes = np.frombuffer("".join(full).replace(" ", BLANK).encode("utf-32-le", "surrogatepass"), np.uint32)
        return codes, np.concatenate([[0], np.cumsum([len(t) for t in full])]).astype(np.int64)

    def _keys(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each word."""
        place = np.arange(len(codes)) - np.repeat(begin, size)
        most = int(size.max()) + 1
        with np.errstate(over="ignore"):
            mixed = _MIXED[np.minimum(codes, len(_MIXED) - 1)]
            rare = np.flatnonzero(codes >= len(_MIXED) - 1)
            mixed[rare] = mix64(codes[rare].astype(U) + U(1 + self.salt))
            out = []
            for base in (SEQ_BASE, BYTE_BASE):
                powers = np.multiply.accumulate(np.concatenate([[U(1)], np.full(most, base + U(2 * self.salt))]))
                out.append(mix64(np.add.reduceat(mixed * powers[place], begin) + size.astype(U)))
        return out[0], out[1]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin."""
        if self.bytes > KEPT:
            self._shrink()
        codes, first = self._codes(texts)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        cut = self.c.apart(codes)
        cut[first[:-1][first[:-1] < first[1:]]] = True
        begin = np.flatnonzero(cut)
        size = np.diff(np.append(begin, len(codes)))
        key, other = self._keys(codes, begin, size)
        own, index, back, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.key, own)
        there = np.minimum(at, max(0, len(self.key) - 1))
        known = (self.key[there] == own) if len(self.key) else np.zeros(len(own), bool)
        if (other != other[index][back]).any() or (self.other[there[known]] != other[index[known]]).any():
            self._forget()
            self.salt += 1
            return self.encode(texts)
        new = np.flatnonzero(~known)
        if len(new):
            self._keep(at[new], own[new], other[index[new]], *self._learn(codes, begin[index[new]], size[index[new]]))
            at = np.searchsorted(self.key, own)
        self.met[at] = np.minimum(self.met[at] + times, 1 << 20)
        ids, to = _gather(self.flat, self.at, self.size, at[back])
        to = to[np.searchsorted(begin, first)]
        if self.c.v.byte[0] < 0 and len(ids):
            # neighbouring characters without a piece are one
            text = np.repeat(np.arange(len(texts)), np.diff(to))
            again = np.concatenate([[False], (ids[1:] == self.c.v.unknown) & (ids[:-1] == self.c.v.unknown) & (text[1:] == text[:-1])])
            return ids[~again], np.concatenate([[0], np.cumsum(np.bincount(text[~again], minlength=len(texts)))])
        return ids, to


#: Mixed code points below the blank sign's, and the blank sign's.
_MIXED = mix64(np.arange(1, ord(BLANK) + 3, dtype=U))


def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[begin[i] : begin[i] + size[i]] for each i of which, end to end, and where each begins."""
    first = np.concatenate([[0], np.cumsum(size[which])]).astype(np.int64)
    return flat[np.arange(first[-1]) + np.repeat(begin[which] - first[:-1], size[which])], first


def encode(docs: DataFrame, model: str = MODEL, check: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids and, with check, round_trip (whether decoding gives the text back) for each row of docs.

    The vocabulary is read on the driver and broadcast. Null and empty texts have no tokens; null gives round_trip true
    like an empty text. A text that holds the blank sign U+2581 itself, or a lone surrogate, does not come back.
    """
    given = docs.sparkSession.sparkContext.broadcast(Coder(load(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = given.value
        encoder = Encoder(coder)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            done = 0
            for part in pieces(texts, [len(t or "") for t in texts], PIECE):
                ids, first = encoder.encode(part)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
                columns = [batch.column(0).slice(done, len(part)), pa.array(np.diff(first)), lists]
                if check:
                    columns.append(pa.array([(t or "") == x for t, x in zip(part, coder.decode(ids, first), strict=True)], pa.bool_()))
                done += len(part)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "round_trip"][: len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids array<int>" + ", round_trip boolean" * check)


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text for each row of tokens (doc_id, ids); null or empty ids give an empty text."""
    given = tokens.sparkSession.sparkContext.broadcast(Coder(load(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = given.value
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
            first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            texts = coder.decode(np.concatenate([*lists, np.zeros(0, np.int64)]), first)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return in_batches(tokens.select("doc_id", "ids"), run, f"doc_id {kind}, text string")
