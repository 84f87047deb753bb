"""Personal data by bootstrapped contextual extraction.

Base spans (email, ip, card, phone) are found by fixed patterns in linear scans, and seed the method; so do secrets, long
words of letters and digits mixed at random. Every other word of six characters or more that looks like an identifier
(with a digit, an inner ``=`` or ``:``, an inner change to upper case, or twenty letters) is a candidate instance, of any
length; of ``key=value`` the value is. A number of a card's or phone's length that the base rules turned down is refuted:
it is never found and speaks against the patterns that extract it. Instances are their values, told apart by hash, and each
has a shape (``0a9b-12`` is ``w-0``). A span's lexical patterns are its neighbours: the word before, the two before, the
word after, and the key of an assignment, also over blanks and quotes (``token = "..."``). Spark scores the
pattern-instance graph iteratively: a pattern is as sure as the instances it extracts; an instance as sure as the
patterns that extract it, by itself and over all of its shape, seeds staying at 1 and refuted numbers at 0. Patterns with
enough seeds and confidence then discover unseen identifiers among the sure candidates, as spans of kind ``id``.

The graph is summed before it is shuffled, so a pattern, instance or shape that holds a third of all spans is a
few rows; neighbours of over 40 characters are told by their beginning and a digest; candidates of a hot pattern are split by adaptive skew joins. Offsets are code points.

Defined cases: null is the empty text, without spans; very long texts and words are scanned whole; ties in a start are ordered by kind; repeated rows
and ids are scanned one by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import saved, table

KINDS = ("email", "ip", "card", "phone", "id")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What makes a word a candidate.
_TRIGGER = re.compile(r"[0-9]|[A-Za-z_][=:](?=[^\x20\x09-\x0D/])|[a-z][A-Z]|[A-Za-z]{20}")
_KEY = re.compile(r"[A-Za-z_][\w-]*[=:](?!/)[\"'(\[{<]*")
_KEY_BEFORE = re.compile(r"([A-Za-z_][\w-]*+)\s*$")
_SECRET = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_+/=-]{16,}")
_NUMBER = re.compile(r"\+?[0-9][0-9 ().-]*")
_ALNUM = re.compile(r"[^\W_]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping matches, in one pass over the @ signs."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        # the sign itself can't be part of a local part, so what stands before it is done with
        free = max(free, at + 1)
        at = text.find("@", free)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def secret(word: str) -> bool:
    """Letters and digits mixed at length, of so many different ones that no word or count looks like it."""
    return len(set(word)) >= 10 and _SECRET.fullmatch(word) is not None


def refuted(word: str) -> bool:
    """A number of a card's or a phone's length that the base rules have seen and turned down."""
    return _NUMBER.fullmatch(word) is not None and 10 <= len(_DIGIT.findall(word)) <= 19


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end), sorted."""
    out = [(s, 0, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 37:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out)


def shape(word: str) -> str:
    """Runs of letters, digits or both as a, 0 or w; other characters stand for themselves."""
    out = _ALNUM.sub(lambda m: "a" if m[0].isalpha() else "0" if m[0].isdigit() else "w", word)
    return out if len(out) <= 40 else out[:40] + digest(out)


def digest(text: str) -> str:
    return "#" + hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]


def plain(word: str) -> str:
    """A neighbour as patterns tell it: digits masked, lower-case."""
    word = re.sub("[0-9]+", "0", word.lower())
    return word if len(word) <= 40 else word[:40] + digest(word)


class Context:
    """Neighbours of spans that come in order: words of the text, each made plain once."""

    def __init__(self, text: str):
        self.text, self.words = text, [m.span() for m in _WORD.finditer(text)]
        self.at, self.last, self.known = 0, 0, {}

    def word(self, k: int) -> str:
        if not 0 <= k < len(self.words):
            return ""
        if k not in self.known:
            self.known = {i: w for i, w in self.known.items() if abs(i - k) < 4}
            self.known[k] = plain(self.text[slice(*self.words[k])])
        return self.known[k]

    def patterns(self, start: int, end: int) -> list[str]:
        while self.at + 1 < len(self.words) and self.words[self.at][1] <= start:
            self.at += 1
        k, begin = self.at, self.words[self.at][0]
        after = k
        while after + 1 < len(self.words) and self.words[after][1] < end:
            after += 1
        # inside a word, the neighbour is what stands between the span and the one before it
        inner = self.text[max(begin, min(self.last, start)) : start].strip("([{\"'<")
        self.last = end
        one, two = (plain(inner), self.word(k - 1)) if inner else (self.word(k - 1), self.word(k - 2))
        out = ["L " + one, "LL " + two + " " + one]
        if n := self.word(after + 1):
            out.append("R " + n)
        left = self.text[self.words[max(0, k - 2)][0] : start].rstrip(" \t\r\n\"'([{<")
        if left[-1:] in ("=", ":") and (m := _KEY_BEFORE.search(left, 0, len(left) - 1)):
            out.append("P " + plain(m[1]))
        return out


def scan(text: str) -> tuple[list, list]:
    """Base spans, and instances (start, end, value hash, shape, base, evidence: 1 seed, 0 open, -1 refuted, patterns)."""
    base = base_spans(text)
    taken = sorted((s, e, True) for s, _, e in base)
    spans, i, at, n = list(taken), 0, 0, len(text)
    while m := _TRIGGER.search(text, at):
        s = e = m.start()
        while s > at and not (text[s - 1] == " " or "\t" <= text[s - 1] <= "\r"):
            s -= 1
        if w := _WORD.match(text, s):
            e = w.end()
        at = max(e, m.end())
        while s < e and text[s] in "([{\"'<":
            s += 1
        while e > s and text[e - 1] in ".,;:!?)]}\"'":
            e -= 1
        if (k := _KEY.match(text, s, e)) and k.end() < e:
            s = k.end()
        if s and text[s - 1] in "\"'" and 0 < (k := text.find(text[s - 1], s, e)):  # what is quoted ends with the quote
            e = k
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if e - s >= 6 and not (i < len(taken) and taken[i][0] < e):
            spans.append((s, e, False))
    found = []
    if spans:
        context = Context(text)
        for s, e, seed in sorted(spans):
            word = text[s:e]
            value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
            kind = 1 if seed or secret(word) else -1 if refuted(word) else 0
            found.append((s, e, value, shape(word), seed, kind, context.patterns(s, e)))
    return base, found


def scanned(docs: DataFrame) -> DataFrame:
    """One row a document: row, doc_id, counts, base_sha256, base spans and instances."""
    # ids pass pandas as text: beside a null, pandas would make floating point of them
    schema = (
        "row long, doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:int,rank:int,end:int>>, "
        "instances array<struct<start:int,end:int,value:long,shape:string,known:boolean,evidence:int,patterns:array<string>>>"
    )

    def run(batches):
        for x in batches:
            rows = []
            for n, i, text in x.itertuples(index=False):
                base, found = scan(text) if isinstance(text, str) else ([], [])
                said = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
                rows.append((n, i, *[sum(k == j for _, k, _ in base) for j in range(4)], hashlib.sha256(said.encode()).hexdigest(), base, found))
            yield pd.DataFrame(rows, columns=["row", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "instances"])

    out = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string"), "text").mapInPandas(run, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def bootstrap(edges: DataFrame, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(pattern, confidence, seeds) and (value, confidence) from the summed graph (pattern, value, shape, n, seeds)."""
    mean = lambda x: F.sum(F.col("n") * F.col(x)) / F.sum("n")
    share = F.sum("seeds") / F.sum("n")
    kinds = edges.groupBy("shape").agg(share.alias("shaped"))
    seeded = saved(edges.groupBy("value", "shape").agg(share.alias("own"), F.max("refuted").alias("refuted")).join(kinds, "shape").select("value", "shape", "refuted", F.when(F.col("refuted") == 1, 0.0).otherwise(F.greatest("own", "shaped")).alias("seeded")), "instances")
    instances = seeded.select("value", "shape", F.col("seeded").alias("confidence"))
    for _ in range(rounds):
        known = (
            edges.join(instances, ["value", "shape"]).groupBy("pattern")
            # one virtual miss: a pattern seen once proves little
            .agg((F.sum(F.col("n") * F.col("confidence")) / (F.sum("n") + 1)).alias("confidence"), F.sum("seeds").alias("seeds"))
        )
        known = saved(known, "patterns")
        told = saved(edges.join(known.select("pattern", "confidence"), "pattern").groupBy("value", "shape").agg(mean("confidence").alias("own"), F.sum("n").alias("n")), "told")
        kinds = told.groupBy("shape").agg(mean("own").alias("shaped"))
        both = told.join(kinds, "shape").join(seeded, ["value", "shape"])
        # an instance met often speaks for itself, a rare one as its shape does
        weight = F.col("n") / (F.col("n") + 2)
        own = weight * F.col("own") + (1 - weight) * F.col("shaped")
        instances = saved(both.select("value", "shape", F.when(F.col("refuted") == 1, 0.0).otherwise(F.greatest("seeded", own)).alias("confidence")), "instances")
    return known, instances


def extract(docs: DataFrame, confidence: float = 0.6, least_seeds: int = 5, rounds: int = 3) -> DataFrame:
    """doc_id, base counts, base_sha256, spans (all), n_id."""
    rows = saved(scanned(docs), "scanned")
    spans = rows.select("row", F.explode("instances").alias("i")).select("row", "i.*")
    each = spans.select("row", "start", "end", "value", "shape", "known", "evidence", F.explode(F.array_distinct("patterns")).alias("pattern"))
    edges = saved(each.groupBy("pattern", "value", "shape").agg(F.count("*").alias("n"), F.sum((F.col("evidence") > 0).cast("int")).alias("seeds"), F.max((F.col("evidence") < 0).cast("int")).alias("refuted")), "graph")
    known, instances = bootstrap(edges, rounds)
    sure = known.where((F.col("confidence") >= confidence) & (F.col("seeds") >= least_seeds)).select("pattern")
    likely = instances.where(F.col("confidence") >= confidence / 2).select("value", "shape")
    new = each.where("not known and evidence >= 0").join(sure, "pattern", "left_semi").join(likely, ["value", "shape"], "left_semi").select("row", "start", "end").distinct()
    new = new.groupBy("row").agg(F.collect_list(F.struct(F.col("start"), F.lit(4).alias("rank"), F.col("end"))).alias("added"))
    name = F.array(*map(F.lit, KINDS))
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,rank:int,end:int>>"))))
    said = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.get(name, s["rank"]), s["start"], s["end"])), ",")
    return rows.join(new, "row", "left").select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", said.alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_id")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "documents"))
