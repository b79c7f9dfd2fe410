"""Text risk: invisible characters, injection templates and mixed-script words, scored 0 to 100."""

from __future__ import annotations

from functools import reduce
from itertools import groupby
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS

VERSION = 1
#: Code points looked for (fixed values).
BIDI = "".join(map(chr, [*range(0x202A, 0x202F), *range(0x2066, 0x206A)]))
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
CONTROL = "".join(chr(c) for c in [*range(0x20), 0x7F] if c not in (0x09, 0x0A, 0x0D))
#: Points for each finding, the most, and the least of each band (fixed values).
POINTS = {"bidi": 12, "zero_width": 4, "control": 3, "jailbreak": 12, "confusable": 5}
MOST = 100
BANDS = (("BLOCKER", 10), ("MAJOR", 5), ("MINOR", 1))


def _gap(n: int) -> str:
    return rf"\b[^.]{{0,{n}}}\b"


def _any(*words: str) -> str:
    return "(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + ")"


#: Templates by name (fixed values): parts within so many characters of each other, none of them a full stop.
TEMPLATES = {
    "ignore_prior_instructions": rf"(?iU)\b{_any('ignore', 'disregard', 'forget')}{_gap(40)}{_any('prior', 'previous', 'earlier', 'above', 'all')}{_gap(30)}{_any('instructions?', 'prompts?', 'rules?', 'guidelines?', 'directions?')}\b",
    "dan_template": r"(?U)\bDAN\b|(?iU:\b(?:do anything now|developer mode)\b)",
    "you_are_now": rf"(?iU)\b{_any('you are now', 'you will be now')}{_gap(50)}{_any('unrestricted', 'jailbroken', 'no longer', 'free from', 'unfiltered')}\b",
    "system_prompt_leak": rf"(?iU)\b{_any('reveal', 'print', 'show', 'output', 'repeat', 'leak')}{_gap(30)}{_any('your', 'the')}\s+{_any('system prompt', 'initial instructions', 'hidden instructions', 'original prompt')}\b",
    "role_play_reset": rf"(?iU)\b(?:{_any('pretend', 'act as if')}|role[\s-]*play\s+as){_gap(40)}{_any('no rules', 'no restrictions', 'no filters', 'no safety', 'unfiltered', 'unrestricted', 'jailbroken')}\b",
    "anthropic_override": rf"(?iU)\b{_any('anthropic', 'openai', 'the developers?', 'the creators?')}{_gap(40)}{_any('authorized', 'approved', 'granted', 'told you', 'told me', 'asked you', 'asked me')}{_gap(40)}{_any('override', 'bypass', 'ignore', 'disable')}\b",
    "policy_off": rf"(?iU)\b{_any('turn off', 'disable', 'deactivate', 'switch off')}{_gap(30)}{_any('safety', 'content policy', 'content policies', 'moderation', 'filters?', 'guardrails?', 'restrictions?')}\b",
}


#: Of each template, groups of lower-case pieces; a match holds one of every group.
NEEDS = {
    "ignore_prior_instructions": (("ignore", "disregard", "forget"), ("instruction", "prompt", "rule", "guideline", "direction")),
    "dan_template": (("do anything now", "developer mode"),),
    "you_are_now": (("unrestricted", "jailbroken", "longer", "free", "unfiltered"), ("you",)),
    "system_prompt_leak": (("prompt", "instructions"), ("system", "initial", "hidden", "original")),
    "role_play_reset": (("pretend", "act", "role"), ("rules", "restrictions", "filters", "safety", "unfiltered", "unrestricted", "jailbroken")),
    "anthropic_override": (("override", "bypass", "ignore", "disable"), ("anthropic", "openai", "developer", "creator")),
    "policy_off": (("safety", "content", "moderation", "filter", "guardrail", "restriction"), ("turn", "disable", "deactivate", "switch")),
}
#: What a match may hold instead, in just this case.
EXACT = {"dan_template": "DAN"}
#: Letters that a pattern takes for s, k or i in any case, but lower-casing doesn't make into them.
ODD_CASE = "\u017f\u212a\u0130\u0131"


def _lower(seen: Column) -> Column:
    """A to Z in lower case, which is all that pieces need."""
    return F.translate(seen, ascii_uppercase, ascii_lowercase)


def _may_match(seen: Column, name: str) -> Column:
    """Whether a text holds what the template needs; most hold none of it, and no pattern is run on them."""
    low = _lower(seen)
    held = F.lit(True)
    for group in NEEDS[name]:
        held = held & reduce(Column.__or__, [low.contains(piece) for piece in group])
    if name in EXACT:
        held = held | seen.contains(EXACT[name])
    # first, as all templates share it
    return _holds(seen, ODD_CASE) | held


def _holds(text: Column, letters: str) -> Column:
    """Whether a text holds any of the letters; those beyond Latin-1 are tested by ranges."""
    codes = sorted(map(ord, letters))
    runs = [list(run) for _, run in groupby(codes, lambda c: c - codes.index(c) if c > 0xFF else -c)]
    return text.rlike("[" + "".join(rf"\x{{{r[0]:x}}}" + (rf"-\x{{{r[-1]:x}}}" if len(r) > 1 else "") for r in runs) + "]")


def _count(text: Column, letters: str) -> Column:
    """How many of the letters a text holds; most hold none and are not copied."""
    return F.when(_holds(text, letters), F.length(text) - F.length(F.translate(text, letters, ""))).otherwise(0)


def visible(text: Column) -> Column:
    """The text without the characters of the first pass."""
    text, hidden = F.coalesce(text, F.lit("")), BIDI + ZERO_WIDTH + CONTROL
    return F.when(_holds(text, hidden), F.translate(text, hidden, "")).otherwise(text)


def counts(text: Column) -> dict[str, Column]:
    """Findings of each kind."""
    text = F.coalesce(text, F.lit(""))
    seen = visible(text)
    jailbreak = sum((F.when(_may_match(seen, n), F.regexp_count(seen, F.lit(p))).otherwise(0) for n, p in TEMPLATES.items()), F.lit(0))
    return {"bidi": _count(text, BIDI), "zero_width": _count(text, ZERO_WIDTH), "control": _count(text, CONTROL), "jailbreak": jailbreak, "confusable": F.size(confusables(seen))}


def confusables(seen: Column) -> Column:
    """Distinct words with letters of two scripts or more among Latin, Cyrillic and Greek, in order."""
    scripts = (r"[A-Za-z]", r"[\u0400-\u04FF]", r"[\u0370-\u03FF]")
    mixed = lambda w: sum((w.rlike(s).cast("int") for s in scripts), F.lit(0)) >= 2
    # no two of them without a Greek or Cyrillic letter: other texts are not taken apart
    words = F.array_distinct(F.filter(F.split(seen, f"{WS}+"), mixed))
    return F.when(seen.rlike(r"[\u0370-\u04FF]"), words).otherwise(F.array().cast("array<string>"))


def total(found: dict[str, Column]) -> Column:
    return F.least(F.lit(MOST), sum((found[k] * F.lit(p) for k, p in POINTS.items()), F.lit(0)))


def band(score: Column) -> Column:
    out = F.lit("CLEAN")
    for name, least in reversed(BANDS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def _offsets(text: Column, letters: str) -> Column:
    """`U+XXXX at offset i` for each of the letters, in order; texts without any are not taken apart."""
    code = lambda c: F.lpad(F.hex(F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long")), 4, "0")
    found = lambda c, i: F.when(F.lit(letters).contains(c), F.concat(F.lit("U+"), code(c), F.lit(" at offset "), i.cast("string")))
    each = F.array_compact(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), found))
    return F.when(_holds(text, letters), each).otherwise(F.array().cast("array<string>"))


def _excerpts(seen: Column) -> Column:
    """`name: 'excerpt'` for each template match, the excerpt trimmed and 80 characters at most."""
    cut = lambda x: F.when(F.length(x) > 80, F.concat(F.substring(x, 1, 77), F.lit("..."))).otherwise(x)
    shown = lambda n: lambda x: F.concat(F.lit(f"{n}: "), quoted(cut(F.trim(x))))
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(_may_match(seen, n), F.transform(F.regexp_extract_all(seen, F.lit(p), F.lit(0)), shown(n))).otherwise(none) for n, p in TEMPLATES.items()])


def quoted(text: Column) -> Column:
    """A text as Python would show it: double quotes only where it holds a single one and no double one."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(c), F.lit(shown))
    single, double = text.contains("'"), text.contains('"')
    return F.when(single & ~double, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'")))


def report(text: Column) -> Column:
    """A struct of the total, the evidence of each kind, and the version; null and empty texts are clean."""
    text = F.coalesce(text, F.lit(""))
    seen = visible(text)
    return F.struct(
        total(counts(text)).alias("total_score"),
        _offsets(text, BIDI).alias("bidi_findings"),
        _offsets(text, ZERO_WIDTH).alias("zero_width_findings"),
        _offsets(text, CONTROL).alias("control_findings"),
        _excerpts(seen).alias("jailbreak_findings"),
        confusables(seen).alias("confusable_findings"),
        F.lit(VERSION).alias("version"),
    )
