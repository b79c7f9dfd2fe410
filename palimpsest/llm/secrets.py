"""Secret scans: fixed patterns, and probabilistic automata inferred from labelled credentials.

The patterns give the base spans. Their values, a bounded sample, are the labels: for each kind a prefix tree of
character classes is built, and its states are merged while their futures are statistically compatible. A state also has the
characters that it met, and an automaton the lengths of its labels. Every other token that could be a credential is then scored by
how likely its format is under the automata, against a model of ordinary words and against random characters of the token's own
classes, as in UUIDs, digests and encoded bytes. An automaton of one state has no format to go by and scores nothing.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, in_batches, shared

KINDS = ("assign", "access", "hex")
#: Fixed formats. The groups before a value take either case; a failing match still uses up its text.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
WORD = re.compile(r"[A-Za-z]{3,}[.,;:!?]?")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")
#: Labelled values that the automata are fitted on, at most; the test of two states' futures; the least gain, in nats, of a
#: candidate over what is ordinary, as a whole and per character; the least length; what is added to counts of letter pairs.
SAMPLE, ALPHA, GAIN, EACH, LENGTH, SMOOTH = 4_000, 0.05, 8.0, 0.2, 16, 0.05
#: Characters of a labelled value, at most; longer ones are found and masked like others, but not fitted on.
LABEL = 200

CLASSES = {c: "0" for c in "0123456789"} | {c: "a" for c in "abcdef"} | {c: "g" for c in "ghijklmnopqrstuvwxyz"} | {c: "A" for c in "ABCDEF"} | {c: "G" for c in "GHIJKLMNOPQRSTUVWXYZ"} | {c: c for c in "+/_.=-"}
WIDTH = {k: list(CLASSES.values()).count(k) for k in set(CLASSES.values())}


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, order of the kind, kind, end), sorted."""
    found = []
    lower = text.lower()
    if any(w in lower for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Automaton:
    """A probabilistic automaton over character classes, merged from the prefix tree of samples (in breadth-first order)."""

    def __init__(self, samples: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [defaultdict(int)]
        self.met: list[dict[str, int]] = [defaultdict(int)]
        self.lengths: dict[int, int] = defaultdict(int)
        for s in samples:
            at = 0
            self.lengths[len(s)] += 1
            for x in [*s, ""]:
                c = CLASSES.get(x, "")
                self.seen[at][c] += 1
                if c:
                    self.met[at][x] += 1
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        self.seen.append(defaultdict(int))
                        self.met.append(defaultdict(int))
                    at = self.next[at][c]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        kept, fringe = [0], [(0, c) for c in sorted(self.next[0])]
        while fringe:
            parent, c = fringe.pop(0)
            state = self.next[parent][c]
            if state in kept:
                continue
            # a state that few labels reach is compatible with nearly all; it goes to where its characters are likeliest
            same = max((k for k in kept if self._compatible(k, state)), key=lambda k: (self._likely(k, state), -k), default=None)
            if same is None:
                kept.append(state)
                fringe += [(state, x) for x in sorted(self.next[state])]
            else:
                self.next[parent][c] = same
                self._fold(same, state)
                fringe += [(k, x) for k in kept for x in sorted(self.next[k]) if self.next[k][x] not in kept and (k, x) not in fringe]
        self.kept = kept

    def _differ(self, a: int, b: int) -> bool:
        n, m = sum(self.seen[a].values()), sum(self.seen[b].values())
        if not n or not m:
            return False
        most = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return any(abs(self.seen[a].get(c, 0) / n - self.seen[b].get(c, 0) / m) > most for c in {*self.seen[a], *self.seen[b]})

    def _likely(self, a: int, b: int) -> float:
        """Log-likelihood of what b met under what a met."""
        n = sum(self.met[a].values())
        return sum(k * math.log((self.met[a].get(x, 0) + SMOOTH) / (n + SMOOTH * len(CLASSES))) for x, k in self.met[b].items())

    def _compatible(self, a: int, b: int) -> bool:
        todo, met = [(a, b)], set()
        while todo:
            pair = todo.pop()
            if pair in met or pair[0] == pair[1]:
                continue
            met.add(pair)
            if self._differ(*pair):
                return False
            x, y = (self.next[s] for s in pair)
            todo += [(x[c], y[c]) for c in x.keys() & y.keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b, which no other state leads to, to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            for c, n in self.seen[b].items():
                self.seen[a][c] += n
            for x, n in self.met[b].items():
                self.met[a][x] += n
            for c, y in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], y))
                else:
                    self.next[a][c] = y

    def table(self) -> dict:
        """By state: by class the log-probability of a character of it that wasn't met and the next state, by "=" and a character what that one has; by "length" those of lengths."""
        out: dict = {}
        for s in self.kept:
            # where a token ends is left to its length, as a state that is met again and again can't know
            n = sum(k for c, k in self.seen[s].items() if c)
            share = {c: (k + 0.1) / (n + 0.1 * (len(WIDTH) + 1)) for c, k in self.seen[s].items() if c}
            out[s] = {"?": (math.log(0.1 / (n + 0.1 * (len(WIDTH) + 1)) / 26), 0)}
            for c, p in share.items():  # as if the class's characters had been met once between them
                out[s][c] = (math.log(p / WIDTH[c] / (self.seen[s][c] + 1)), self.next[s].get(c, 0))
            for x, k in self.met[s].items():
                c = CLASSES[x]
                out[s]["=" + x] = (math.log(share[c] * (k + 1 / WIDTH[c]) / (self.seen[s][c] + 1)), self.next[s].get(c, 0))
        total = sum(self.lengths.values())
        out["length"] = {n: math.log((k + 0.1) / (total + 1)) for n, k in self.lengths.items()} | {None: math.log(0.1 / (total + 1) / LABEL)}
        return out


def likelihood(table: dict, token: str) -> float:
    at = total = 0
    for x in token:
        here = table[at]
        p, at = here.get("=" + x) or here.get(CLASSES[x]) or here["?"]
        total += p
    return total + table["length"].get(len(token), table["length"][None])


def random_characters(token: str) -> float:
    """Log-probability of a token as so many characters drawn from its own classes."""
    return -len(token) * math.log(sum(WIDTH[c] for c in {CLASSES[x] for x in token}))


def ordinary(words: list[str]) -> dict[str, float]:
    """Log-probabilities of character pairs (a word's first after a blank) in ordinary words; SMOOTH is added to each count."""
    pairs: dict[str, int] = defaultdict(int)
    firsts: dict[str, int] = defaultdict(int)
    for w in words:
        for a, b in zip(" " + w, w, strict=False):
            pairs[a + b] += 1
            firsts[a] += 1
    total = lambda a: firsts[a] + SMOOTH * len(CLASSES)
    return {ab: math.log((n + SMOOTH) / total(ab[0])) for ab, n in pairs.items()} | {a: math.log(SMOOTH / total(a)) for a in firsts}


def plain(model: dict[str, float], token: str) -> float:
    rare = -math.log(len(CLASSES))
    return sum(model.get(a + b, model.get(a, rare)) for a, b in zip(" " + token, token, strict=False))


#: Formats of public credential kinds as (prefix, alphabet, length of the rest); samples of them join the labels, so that
#: an automaton exists for each even where the corpus has none. Their letters are drawn by a fixed rule.
FORMATS = {
    "github": ("ghp_", "A-Za-z0-9", 36),
    "slack": ("xoxb-", "0-9", 24),
    "google": ("AIza", "A-Za-z0-9_-", 35),
    "stripe": ("sk_live_", "A-Za-z0-9", 24),
}


def format_samples(n: int = 200) -> dict[str, list[str]]:
    import random

    out = {}
    for kind, (prefix, letters, length) in FORMATS.items():
        alphabet, draw = [c for c in CLASSES if re.fullmatch(f"[{letters}]", c)], random.Random(kind)
        out[kind] = [prefix + "".join(draw.choices(alphabet, k=length)) for _ in range(n)]
    return out


class _Lowest:
    """The `most` lowest distinct words by (hash, word) of those it has met."""

    def __init__(self, most: int):
        self.most, self.heap, self.met = most, [], set()

    def add(self, words: set[str]) -> None:
        for w in words:
            h = zlib.crc32(w.encode("utf-8", "replace"))
            # the heap's first is its highest
            if len(self.heap) == self.most and (not self.most or h > -self.heap[0][0]):
                continue
            if w in self.met or not WORD.fullmatch(w):
                continue
            self.met.add(w)
            heapq.heappush(self.heap, (-h, _Backwards(w)))
            if len(self.heap) > self.most:
                self.met.discard(heapq.heappop(self.heap)[1].word)

    def rows(self) -> list[tuple[str, str, int]]:
        return [("word", w.word, -h) for h, w in self.heap]


class _Backwards:
    """A word that sorts in reverse."""

    def __init__(self, word: str):
        self.word = word

    def __lt__(self, other: _Backwards) -> bool:
        return self.word > other.word


def _labelled(docs: DataFrame, sample: int) -> list[tuple[str, str]]:
    """(kind or "word", value): up to `sample` credentials and as many words, the lowest by a hash and so the same at each run.

    Each task gives only its own lowest words, which hold all of the table's lowest that it has.
    """
    names = ["kind", "value", "hash"]

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowest = _Lowest(sample)

        def give(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names)

        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                text = text or ""
                spans = base_spans(text)
                found += [(k, ASSIGN.match(text, a, b)[2] if k == "assign" else text[a:b], None) for a, _, k, b in spans]
                lowest.add(set(text.split()))
            yield give(found)
        yield give(lowest.rows())

    df = in_batches(docs.select("text"), values, "kind string, value string, hash long")
    df = shared(df.where(F.length("value") <= LABEL).distinct())
    lowest = lambda d, h: d.orderBy(h, "kind", "value").limit(sample).collect()
    found = lowest(df.where("kind <> 'word'"), F.xxhash64("kind", "value")) + lowest(df.where("kind = 'word'"), F.col("hash"))
    drop(df)
    return sorted((r["kind"], r["value"]) for r in found)


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[dict, dict]:
    """The automata by kind, and the model of ordinary words, fitted on at most `sample` labelled values."""
    by: dict[str, list[str]] = defaultdict(list)
    for kind, value in _labelled(docs, sample):
        by[kind].append(value)
    words = [w.rstrip(".,;:!?") for w in by.pop("word", [])]
    for kind, more in format_samples().items():
        by[kind] += more
    return {k: Automaton(sorted(v)).table() for k, v in sorted(by.items())}, ordinary(words)


def learned_spans(text: str, base: list[tuple[int, int, str, int]], model: tuple[dict, dict]) -> list[tuple[int, int, str, int]]:
    """Tokens that no base span touches, with a digit and a letter, whose format an automaton explains better than words or chance do."""
    automata, words = model
    out = []
    for m in TOKEN.finditer(text):
        token = m[0].strip("._=-/+")
        a = m.start() + m[0].find(token) if token else m.start()
        b = a + len(token)
        if len(token) < LENGTH or not any(c.isdigit() for c in token) or not any(c.isalpha() for c in token) or any(x[0] < b and a < x[3] for x in base):
            continue
        ground = max(plain(words, token), random_characters(token))
        gain, kind = max(((likelihood(t, token) - ground, k) for k, t in automata.items() if len(t) > 2), default=(-math.inf, ""))
        if gain >= max(GAIN, EACH * len(token)):
            out.append((a, 3, f"like_{kind}", b))
    return out


def _joined(spans: list[tuple[int, int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of docs, from its whole text.

    A null text counts as empty: no spans, and the digest of an empty string. Offsets are code points. Spans of the
    automata follow the base ones of the same start and never touch one. Repeated rows each give their own row.
    """
    import hashlib

    model = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            digest, spans = [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                for i, k in enumerate(KINDS):
                    counts[i].append(sum(x[2] == k for x in base))
                digest.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(sorted(base + learned_spans(text or "", base, model.value))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digest, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask(docs: DataFrame, sample: int = SAMPLE, sign: str = "[secret]") -> DataFrame:
    """docs with every found span of text (overlapping ones as one) replaced by `sign`; n_chars, where present, follows.

    Rows without a secret, null texts included, stay as they are.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))
    names = docs.columns
    at = names.index("text")

    def clean(text: str | None) -> str | None:
        base = base_spans(text or "")
        spans = sorted(base + learned_spans(text or "", base, model.value))
        if not spans:
            return text
        out, done = [], 0
        for a, _, _, b in spans:
            if a >= done:
                out += [text[done:a], sign]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [clean(t) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                n = [x if o == t else len(t) for o, t, x in zip(old, new, columns[k].to_pylist(), strict=True)]
                columns[k] = pa.array(n, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return in_batches(docs, run, docs.schema)
