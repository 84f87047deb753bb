"""Personal data: flags, spans and replacement by one scan of a text; names and places come from providers."""

from __future__ import annotations

import re
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PII_SPANS

#: Entity type, score and pattern; boundaries are explicit so that engines agree on Unicode.
EDGE_L, EDGE_R = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
NUMERIC_ID = r"([A-Za-z]*[0-9]{5,}[A-Za-z]*|[0-9]+-[0-9]+(-[0-9]+)*)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = OCTET + r"(\." + OCTET + "){3}"
CARD = r"[0-9]([ -]?[0-9]){12,18}"
PHONE = r"\+[0-9][ ().0-9-]{6,20}[0-9]"
ID_CARD = r"[0-9]{17}[0-9Xx]"
IBAN = r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"
SSN = r"[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}"
CRYPTO = r"(bc1[0-9a-z]{25,59}|[13][1-9A-HJ-NP-Za-km-z]{25,34})"
PATTERNS = {
    "NUMERIC_ID": (0.8, NUMERIC_ID), "EMAIL_ADDRESS": (0.9, EMAIL), "ID_CARD": (0.9, ID_CARD), "IP_ADDRESS": (0.6, IPV4), "PHONE_NUMBER": (0.6, PHONE),
    "CREDIT_CARD": (0.7, CARD), "IBAN_CODE": (0.75, IBAN), "US_SSN": (0.65, SSN), "CRYPTO": (0.55, CRYPTO),
}
#: Languages with a name and place model of their own; country prefixes that Chinese texts leave out.
MODEL_LANGUAGES, FOREIGN = ("zh", "en", "es", "fr", "de"), ("US_", "UK_", "SG_", "AU_", "IN_")


def model_language(language: str) -> str:
    """The language whose name and place model a provider should take."""
    return language if language in MODEL_LANGUAGES else "en"


def entities(language: str = "en") -> tuple[str, ...]:
    """The kinds that are looked for in a language; ID_CARD is Chinese. Names and places need a provider."""
    if language == "zh":
        return tuple(k for k in PATTERNS if not k.startswith(FOREIGN))
    return tuple(k for k in PATTERNS if k != "ID_CARD")


THRESHOLD = 0.5
#: Score of a plus address; words that make a number an id, what they add to its score and the least it is then.
PLUS, BOOST, LEAST = 0.95, 0.35, 0.4
CONTEXT = {"NUMERIC_ID": ("id", "编号", "号码", "代码", "code", "number", "序号", "sequence", "identifier")}


def bounded(pattern: str) -> str:
    return EDGE_L + pattern + EDGE_R


def alone(pattern: str) -> str:
    """A pattern between edges that are looked at but not taken, so that matches may share one."""
    return r"(?<![\p{L}\p{N}_])(?:" + pattern + r")(?![\p{L}\p{N}_])"


def numeric_id(text: Column) -> Column:
    return text.rlike(bounded(NUMERIC_ID)) | text.rlike(r"\\u[0-9A-Fa-f]{4}|\\xa0")


def email(text: Column) -> Column:
    return text.contains("@") & text.rlike(EMAIL)


def ipv4(text: Column) -> Column:
    return text.rlike(bounded(IPV4))


def luhn(digits: Column) -> Column:
    """Of a string of digits."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def card(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit("(" + CARD + ")"), F.lit(1))
    return text.rlike("[0-9]") & F.exists(found, lambda x: luhn(F.regexp_replace(x, "[^0-9]", "")))


def mod97(code: Column) -> Column:
    """An IBAN's check: the moved string, letters as numbers, is 1 modulo 97."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
    at = lambda i: F.ascii(F.substring(moved, i, F.lit(1)))
    return F.aggregate(
        F.sequence(F.lit(1), F.length(moved)), F.lit(0),
        lambda a, i: F.when(at(i) >= 65, a * 100 + at(i) - 55).otherwise(a * 10 + at(i) - 48) % 97,
    ) == 1


def valid(kind: str, found: Column) -> Column:
    """The check that a match of a kind has to pass beside its form."""
    if kind == "CREDIT_CARD":
        return luhn(F.regexp_replace(found, "[^0-9]", ""))
    return mod97(found) if kind == "IBAN_CODE" else F.lit(True)


def stands(text: Column, kind: str) -> Column:
    """Whether a kind occurs: a match of its pattern that stands alone and passes its check."""
    some, pattern = text.rlike(PATTERNS[kind][1]), alone(PATTERNS[kind][1])  # most texts have none, which the bare pattern tells sooner
    if kind not in ("CREDIT_CARD", "IBAN_CODE"):
        return some & text.rlike(pattern)
    return F.when(some, F.exists(F.regexp_extract_all(text, F.lit("(" + pattern + ")"), F.lit(1)), lambda x: valid(kind, x))).otherwise(False)


def has_pii(text: Column, language: str = "zh", kinds: tuple[str, ...] | None = None, providers: tuple[SpanProvider, ...] = ()) -> Column:
    """Whether any of the kinds (by default all of the language's) or a span of a provider is in a text; null: none.

    Numbers count also as escapes, and for Chinese texts addresses also inside a word. One scan a text costs a third of a
    native pattern for each kind (``stands``).
    """
    kinds = kinds or entities(language)

    @F.pandas_udf("boolean")
    def each(x: pd.Series) -> pd.Series:
        more = [bool(s) for s in _marks(x, (), providers, THRESHOLD, False)] if providers else [False] * len(x)
        return pd.Series([m or _flagged(t or "", kinds, language) for t, m in zip(x, more, strict=True)], dtype=bool)

    return each(text)


# What follows works on one text in a task: its pieces that may hold something, the kinds in them, and the sweep over spans.

#: A piece: words with a digit or an at sign, joined over blanks; every match lies in one, and its ends are edges.
_WORD = r"(?:[^\W0-9]++|[.%+()\-]++)*+[0-9@][\w.%+@()\-]*+"
_PIECE = re.compile(rf"(?<![\w.%+@()\-]){_WORD}(?: +(?:[().\-]++ ++)*{_WORD})*")
_ALONE = {k: re.compile(rf"(?<!\w)(?:{p})(?!\w)") for k, (_, p) in PATTERNS.items()}
_ESCAPE, _ADDRESS = re.compile(r"\\u[0-9A-Fa-f]{4}|\\xa0"), re.compile(EMAIL)
_FIVE_WORDS = re.compile(r"(?:\w+\W+){0,5}$")


def _checked(kind: str, found: str) -> bool:
    if kind == "CREDIT_CARD":
        digits = [int(c) for c in reversed(found) if c.isdigit()]
        return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    if kind == "IBAN_CODE":
        return int("".join(str(int(c, 36)) for c in found[4:] + found[:4])) % 97 == 1
    return True


def _flagged(text: str, kinds: tuple[str, ...], language: str) -> bool:
    if "NUMERIC_ID" in kinds and "\\" in text and _ESCAPE.search(text):
        return True
    if language == "zh" and "EMAIL_ADDRESS" in kinds and "@" in text and _ADDRESS.search(text):
        return True
    pieces = [m.span() for m in _PIECE.finditer(text)]
    return any(_checked(k, m[0]) for k in kinds for lo, hi in pieces for m in _ALONE[k].finditer(text, lo, hi))


def _score(kind: str, text: str, start: int, end: int, context: bool) -> float:
    """The kind's score; a plus address is surer, and so is what a context word stands before."""
    score = PLUS if kind == "EMAIL_ADDRESS" and "+" in text[start:end].partition("@")[0] else PATTERNS[kind][0]
    if context and kind in CONTEXT:
        before = _FIVE_WORDS.search(text[max(0, start - 200) : start])[0].lower()
        if any(w in before for w in CONTEXT[kind]):
            return min(1.0, max(score + BOOST, LEAST))
    return score


def found(text: str | None, kinds: tuple[str, ...], context: bool = False) -> list[tuple[str, int, int, float, str]]:
    """(entity_type, start, end, score, text) of the kinds in a text, kind by kind, in one scan for the pieces that may have any."""
    if not text or not kinds:
        return []
    pieces = [m.span() for m in _PIECE.finditer(text)]
    out = []
    for kind in kinds if pieces else ():
        pattern = _ALONE[kind]
        for lo, hi in pieces:
            if kind != "EMAIL_ADDRESS" or text.find("@", lo, hi) >= 0:
                out += [(kind, *m.span(), _score(kind, text, *m.span(), context), m[0]) for m in pattern.finditer(text, lo, hi) if _checked(kind, m[0])]
    return out


def swept(text: str, marks: list[tuple[str, int, int, float]]) -> str:
    """Spans as ``<KIND>``, by a sweep from begin to begin; spans that overlap are one region, named by the surest, then the first, then by name."""
    out, at, region = [], 0, None

    def close():
        nonlocal at
        if region:
            out.extend((text[at : region[0]], "<", region[2][2], ">"))
            at = region[1]

    for start, end, doubt, kind in sorted((m[1], m[2], -m[3], m[0]) for m in marks):
        name = (doubt, start, kind)
        if region and start < region[1]:
            region = (region[0], max(region[1], end), min(region[2], name))
        else:
            close()
            region = (start, end, name)
    close()
    return "".join(out) + text[at:]


class SpanProvider(Protocol):
    """A model of names, places or ages: for each text its (entity_type, start, end, score)."""

    def __call__(self, texts: list[str]) -> list[list[tuple[str, int, int, float]]]: ...


def _marks(texts: pd.Series, kinds, providers, threshold: float, context: bool) -> list[list[tuple]]:
    texts = [t or "" for t in texts]
    out = [[s for s in found(t, kinds, context) if s[3] >= threshold] for t in texts]
    for provider in providers:
        more = provider(texts)
        if len(more) != len(texts):
            raise ValueError(f"a provider gave spans of {len(more)} texts for {len(texts)}")
        for t, own, given in zip(texts, out, more, strict=True):
            own += [(k, s, e, float(x), t[s:e]) for k, s, e, x in given if x >= threshold and 0 <= s < e <= len(t)]
    return out


def spans(text: Column, kinds: tuple[str, ...] = tuple(PATTERNS), providers: tuple[SpanProvider, ...] = (), threshold: float = THRESHOLD, context: bool = False) -> Column:
    """Every match of the kinds that stands alone and passes its check, and the providers' spans, of the threshold or above.

    context: words like "number" in the five words before a match raise its score. One pass over each text, in Arrow batches.
    """

    @F.pandas_udf(PII_SPANS)
    def each(x: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("entity_type", "start", "end", "score", "text"), s, strict=True)) for s in m] for m in _marks(x, kinds, providers, threshold, context)], dtype=object)

    return each(text)


def anonymize(text: Column, kinds: tuple[str, ...] = tuple(PATTERNS), providers: tuple[SpanProvider, ...] = (), threshold: float = THRESHOLD) -> Column:
    """Spans become ``<KIND>``; spans that overlap are one region."""

    @F.pandas_udf("string")
    def each(x: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else swept(t, m) if m else t for t, m in zip(x, _marks(x, kinds, providers, threshold, False), strict=True)], dtype=object)

    return each(text)
