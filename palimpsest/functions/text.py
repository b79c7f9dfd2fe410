"""Identity, filters, tokens and snippets as columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

try:  # an optional package
    import chardet
except ImportError:
    chardet = None

#: White space as Python's str sees it (fixed values); Java's own classes miss U+001C to U+001F.
_WIDE = "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WS = "[\\s\\x0b\\x1c-\\x1f\\x85\\xa0" + _WIDE + "]"
#: The same characters, for `btrim`, and those that are no blank as a class that tests few ranges: unions of single characters are slow.
BLANKS = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0" + _WIDE
_ODD = r"\t\n\x0b\f\r\x1c-\x1f\x85\xa0[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85" + chr(0x2028) + chr(0x2029) + "]"
#: Separates role and content in the hashed input; shortest content; uid digits of the hash; milliseconds start here (fixed values).
HASH_SEPARATOR, MIN_CONTENT, UID_DIGITS, MILLISECONDS = "\x1f", 30, 12, 32_503_680_000
SNIPPET_BEFORE, SNIPPET_AFTER, SNIPPET_MOST = 80, 120, 200
BOLD, PLAIN = "\x1b[1m", "\x1b[0m"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def normalize_ws(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    # a single blank stays as it is and is no match
    return F.trim(F.regexp_replace(c, f" [ {_ODD}]+|[{_ODD}][ {_ODD}]*", " "))


def content_hash(role: Column, content: Column) -> Column:
    return F.sha2(F.concat(role, F.lit(HASH_SEPARATOR), normalize_ws(content)), 256)


def drawer_uid(source: Column, source_id: Column, digest: Column) -> Column:
    """source:source_id:first digits of the hash; null where a part is empty or the hash too short."""
    good = (F.length(source) > 0) & (F.length(source_id) > 0) & (F.length(digest) >= UID_DIGITS)
    return F.when(good, F.concat_ws(":", source, source_id, F.substring(digest, 1, UID_DIGITS)))


def keeps(content: Column) -> Column:
    """Whether content is worth a record: long enough, and no slash command alone or with a short body."""
    text = strip(content)
    body = strip(F.regexp_replace(text, f"^[^{WS[1:-1]}]+", ""))
    command = text.startswith("/")
    return F.coalesce((F.length(text) >= MIN_CONTENT) & (~command | (F.length(body) >= MIN_CONTENT)), F.lit(False))


def lines(c: Column) -> Column:
    """Lines of a text, no empty one after a final line end; an empty text has none."""
    parts = F.split(c, LINE_END, -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(parts)


def _fold_table() -> tuple[str, str]:
    """Latin letters with marks below U+0250 and their bases, from Unicode decompositions.

    A few keep theirs, as the tokenizer's tables do: those whose base is AE, O with stroke, or reached in two steps to a
    letter that is no base itself.
    """
    kept = set("ǠǡǢǣǮǯǼǽǾǿ")
    source, target = [], []
    for code in range(0x80, 0x250):
        c = chr(code)
        base = unicodedata.normalize("NFD", c)
        if len(base) > 1 and c not in kept and base[0].isalpha():
            source.append(c)
            target.append(base[0].lower())
    return "".join([*source, "µſ"]), "".join([*target, "μs"])


FOLD = _fold_table()
TOKEN = r"[\p{L}\p{N}\p{Co}\p{Mn}]+"


def tokens(c: Column) -> Column:
    """Search terms: runs of letters, numbers, private-use characters and marks, lower case, Latin diacritics removed."""
    return F.regexp_extract_all(F.lower(F.translate(c, *FOLD)), F.lit(TOKEN), F.lit(0))


def tokens_of(text: str) -> list[str]:
    """The same for a query on the driver."""
    folded = text.translate(str.maketrans(*FOLD)).lower()
    out, run = [], []
    for c in folded:
        kind = unicodedata.category(c)
        if kind[0] in "LN" or kind in ("Co", "Mn"):
            run.append(c)
        elif run:
            out.append("".join(run))
            run = []
    return out + (["".join(run)] if run else [])


def query_terms(query: str) -> list[str]:
    """Words of a query to look for in a snippet, without operators and punctuation."""
    bare = re.sub(r'\b(?:NEAR|AND|OR|NOT)\b|[(){}\[\]"*^:]', " ", query or "")
    return re.findall(r"\w[\w\-']*", bare)


def first_match(text: Column, terms: Sequence[str]) -> Column:
    """0-based place of the first term found, ignoring case; null if none is."""
    places = [F.nullif(F.instr(F.lower(text), t.lower()), F.lit(0)) - 1 for t in terms if t]
    return F.lit(None).cast("int") if not places else places[0] if len(places) == 1 else F.least(*places)


def bold(text: Column, terms: Sequence[str], color: bool = True) -> Column:
    words = sorted({t for t in terms if t}, key=len, reverse=True)
    if not words or not color:
        return text
    pattern = "|".join(re.sub(r"([^\w])", r"\\\1", w) for w in words)
    return F.regexp_replace(text, f"(?iU)({pattern})", f"{BOLD}$1{PLAIN}")


def snippet(content: Column, terms: Sequence[str], color: bool = False) -> Column:
    """A window around the first term found, dots where it is cut; the beginning if none is."""
    flat = normalize_ws(F.coalesce(content, F.lit("")))
    at, n = first_match(flat, terms), F.length(flat)
    start = F.coalesce(F.greatest(at - SNIPPET_BEFORE, F.lit(0)), F.lit(0))
    end = F.coalesce(F.least(n, at + SNIPPET_AFTER, start + SNIPPET_MOST), F.least(n, F.lit(SNIPPET_MOST)))
    window = F.substring(flat, start + 1, end - start)
    return F.concat(F.when(start > 0, "...").otherwise(""), bold(window, terms, color), F.when(end < n, "...").otherwise(""))


def without_ansi(c: Column) -> Column:
    return F.regexp_replace(c, "\x1b\\[[0-9;]*m", "")


def without_bom(c: Column) -> Column:
    return F.regexp_replace(c, "^\ufeff", "")


def decode_bytes(data: bytes) -> str:
    """Bytes that are no UTF-8: by their byte-order mark, by chardet where it is installed and sure, else as Windows-1252 or Latin-1."""
    for mark, codec in ((b"\xff\xfe\0\0", "utf-32"), (b"\0\0\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(codec, "replace")
    if chardet and (guess := chardet.detect(data))["encoding"] and guess["confidence"] >= 0.5:
        try:
            return data.decode(guess["encoding"])
        except (LookupError, UnicodeDecodeError):
            pass
    # Latin-1 has control characters where Windows-1252 has punctuation
    if any(0x80 <= b < 0xA0 for b in data):
        try:
            return data.decode("cp1252")
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 where valid; only others go through Python."""

    @F.pandas_udf("string")
    def foreign(contents: pd.Series) -> pd.Series:
        return contents.map(lambda b: None if b is None else decode_bytes(bytes(b)))

    plain = F.try_validate_utf8(content.cast("string"))
    return F.coalesce(plain, foreign(F.when(plain.isNull(), content)))


def epoch_of_date(c: Column, last_second: bool = False) -> Column:
    """Seconds of a YYYY-MM-DD date in UTC, at its start or in its last second."""
    return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + (86399 if last_second else 0)


def date_of_epoch(c: Column) -> Column:
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(c / 86400).cast("int")), "yyyy-MM-dd")


def role_map(c: Column, extended: bool = True) -> Column:
    """human or user: human; assistant, with extended also model: assistant; others null."""
    low = F.lower(c)
    return F.when(low.isin("human", "user"), "human").when(low.isin("assistant", *(["model"] if extended else [])), "assistant")


def role_of_path(path: Column) -> Column:
    return F.when(F.array_contains(F.split(F.lower(path), "/"), "memory"), "memory").otherwise("wiki")


#: Reason contains, in this order -> hint (our words).
HINTS = (
    (("bad jsonl", "jsondecodeerror"), "malformed lines: look at the reported line for truncation or stray bytes"),
    (("non-object jsonl", "non-object message", "non-object conversation"), "a record is not an object: re-export, or skip the record"),
    (("no message array",), "a conversation has no messages: the export may be partial"),
    (("without uuid",), "a conversation has no id: the export may have been interrupted"),
    (("invalid json",), "the file is not valid JSON: re-export it, or cut what was half written"),
    (("cannot determine session uuid",), "neither the file nor its folder is named by a UUID: rename one of them"),
    (("failed to read", "permissionerror"), "the file can't be read: check its permissions"),
    (("expected top-level json array",), "the export must be an array: wrap a single conversation in brackets"),
)


def fix_hint(reason: Column) -> Column:
    low = F.lower(reason)
    out = F.lit(None).cast("string")
    for words, hint in reversed(HINTS):
        found = low.contains(words[0])
        for w in words[1:]:
            found = found | low.contains(w)
        out = F.when(found, hint).otherwise(out)
    return out
