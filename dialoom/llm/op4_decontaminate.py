"""Benchmark decontamination by template canonicalisation.

Texts become sequences of template tokens: a number with its separators and decimals (``1,200``, ``7.50``), or a run of
number words, is one number; a run of capitalised words, in letters of any script that has capitals, is one name; a unit after a number, also when
attached to it (``5km``), is one unit; every other word is itself, lower-cased. Windows of ``WINDOW`` tokens are hashed,
and a document's windows are hash-joined with the benchmark's. Matches of one document and item are lined up by offset
in tokens, whatever the length of their values; an alignment counts if its slots are consistent: equal item values map to
equal document values and different ones to different ones, as in a re-parameterised question. A document is
contaminated by an item if consistent alignments cover ``least`` of the item's windows.

The documents' windows stay in the task that makes them: a sorted array of the benchmark's window hashes
goes to the tasks when it has at most ``MOST`` entries, and only windows found there reach the join; a
larger benchmark is joined through a shuffle of all windows, with the same result. Windows of fewer than ``LITERAL`` literal
words are left out, unless an item has no others. Items shorter than a window match as a whole. Where an item's windows
have too few literal words, its values must be the document's own, as a list of names or a lone number is like many others;
and an item of fewer than ``LITERAL`` tokens matches only a document that is nothing else.

Defined cases: null and empty texts match nothing; very long texts are read whole; items without a word are ignored; repeated rows of a
document or an item give one result a pair of ids; null ids match nothing; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import saved, table, without
from .words import Block, blocks, mix

WINDOW, LITERAL, MOST = 8, 4, 2_000_000
_OUT = np.ones(256, bool)
_OUT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: Words that count as numbers, and units.
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million billion".split()
UNITS = "kg g mg km m cm mm mi ft in lb oz l ml s ms min h hr hours hour minutes minute seconds second days day weeks week months month years year dollars dollar euros euro cents cent percent miles mile meters meter metres metre kilometers kilometres kilograms grams liters litres pounds inches feet degrees usd eur".split()
#: Endings of ordinal numbers.
ORDINALS = ["st", "nd", "rd", "th"]
NUM, NAME, UNIT = (np.uint64(x) for x in (0x4E554D, 0x4E414D45, 0x554E4954))


def _hashes(words: list[str]) -> np.ndarray:
    return np.sort(Block([" ".join(words).encode()], separators=_OUT).h)


def _member(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(h), bool)
    return keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h


_NUMBER_WORDS, _UNITS, _ORDINALS = _hashes(NUMBER_WORDS), _hashes(UNITS), _hashes(ORDINALS)
_IN_NUMBER, _IN_RUN = np.zeros(256, bool), np.zeros(256, bool)
_IN_NUMBER[[*b".,:/-"]] = True
_IN_RUN[[*b" -'"]] = True


#: Code points of capitals; those of four bytes have none that text uses.
_CAPITAL = np.array([chr(c).isupper() or chr(c).istitle() for c in range(1 << 16)])


def _first_letter(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point (0 past 16 bits or where the word is cut) and bytes of the first letter of each word."""
    a, b, c = (buf[np.minimum(start + k, end - 1)].astype(np.int64) for k in range(3))
    size = np.select([a < 0xC0, a < 0xE0, a < 0xF0], [1, 2, 3], 4)
    point = np.select([size == 1, size == 2, size == 3], [a, (a & 31) << 6 | b & 63, (a & 15) << 12 | (b & 63) << 6 | c & 63], 0)
    return np.where(start + size <= end, point, 0), size


@dataclass
class Templates:
    """Template tokens of a block: text in the block, template hash, value hash, whether a placeholder; and each text's tokens."""

    n: int
    doc: np.ndarray
    t: np.ndarray
    value: np.ndarray
    slot: np.ndarray

    def __post_init__(self):
        self.begin, self.end = (np.searchsorted(self.doc, np.arange(self.n), side) for side in ("left", "right"))


def templates(block: list[bytes]) -> Templates:
    b = Block(block, lower=True, separators=_OUT)
    start, end = b.start, b.end
    if not len(start):
        return Templates(b.n, b.doc, b.h, b.h, np.zeros(0, bool))
    # a word of leading digits and something else is cut behind the digits
    other = np.flatnonzero(~_DIGIT[b.buf])
    cut = other[np.minimum(np.searchsorted(other, start), len(other) - 1)]
    cut = cut[(cut > start) & (cut < end)]
    start, end = np.sort(np.r_[start, cut]), np.sort(np.r_[end, cut])
    h, doc = b.hash(start, end), np.searchsorted(b.doc_end, start, "right")
    gap = np.r_[1 << 30, start[1:] - end[:-1]]
    gap[np.r_[True, doc[1:] != doc[:-1]]] = 1 << 30
    before = b.buf[np.maximum(start - 1, 0)]
    digits, said = _DIGIT[b.buf[start]], _member(_NUMBER_WORDS, h)
    number = digits | said
    last = lambda x: np.r_[False, x[:-1]]
    head, size = _first_letter(b.buf, start, end)
    after = b.buf[np.minimum(start + size, end - 1)]
    name = _CAPITAL[head] & (end - start > size) & ((after >= 97) & (after <= 122) | (after >= 0xC3)) & ~number
    ordinal = (gap == 0) & last(digits) & _member(_ORDINALS, h)
    joined = (gap == 1) & (
        (digits & last(digits) & _IN_NUMBER[before]) | (number & last(number) & (said | last(said)) & _IN_RUN[before]) | (name & last(name) & _IN_RUN[before])
    ) | ordinal
    unit = _member(_UNITS, h) & last(number) & (gap < 1 << 30) & ~number & ~ordinal
    first = np.flatnonzero(~joined)
    final = np.r_[first[1:], len(start)] - 1
    t = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, h)))[first]
    return Templates(b.n, doc[first], t, b.hash(start[first], end[final]), (number | name | unit)[first])


def windows(x: Templates, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first token, hash) of all windows inside texts."""
    m = max(0, len(x.t) - size + 1)
    acc = np.full(m, size, np.uint64)
    for k in range(size):
        acc = mix(acc + x.t[k : k + m] + np.uint64(k + 1))
    at = np.flatnonzero(x.doc[:m] == x.doc[size - 1 : size - 1 + m])
    return at, acc[at]


def _values(x: Templates, at: np.ndarray, size: int) -> list[np.ndarray]:
    return [x.value[p + np.flatnonzero(x.slot[p : p + size])].view(np.int64) for p in at]


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, h, item_pos, size, n_windows, strict, item_slots: slot values of the window, in order).

    strict: the item's windows have too few literal words, so its values must be met as they are.
    """
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches):
        for x in batches:
            for first, block in blocks(x.text):
                y = templates(block)
                many = y.end - y.begin
                slots = np.r_[0, np.cumsum(y.slot)]
                for size in np.unique(np.minimum(many[many > 0], window)):
                    at, h = windows(y, size)
                    d = y.doc[at]
                    own = np.minimum(many[d], window) == size
                    plain = size - (slots[at + size] - slots[at]) >= LITERAL
                    # windows of few literal words count only where an item has no others
                    use = own & (plain | ~np.isin(d, d[own & plain]))
                    at, h, d, strict = at[use], h[use], d[use], ~plain[use]
                    if not len(at):
                        continue
                    n = np.bincount(d, minlength=y.n)
                    yield pd.DataFrame({
                        "item_id": x.item_id.to_numpy()[first + d], "h": h.view(np.int64), "item_pos": at - y.begin[d], "size": int(size), "n_windows": n[d], "strict": strict,
                        "item_slots": _values(y, at, size),
                    })

    items = items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    return items.mapInPandas(run, f"item_id {kind}, h long, item_pos long, size long, n_windows long, strict boolean, item_slots array<long>")


def document_windows(docs: DataFrame, sizes: list[int], wanted: np.ndarray | None) -> DataFrame:
    """(doc_id, h, doc_pos, whole, doc_slots) of windows whose hash is wanted; of all windows if wanted is None. whole: the text has nothing else."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for x in batches:
            for first, block in blocks(x.text):
                y = templates(block)
                ids = x.doc_id.to_numpy()[first : first + y.n]
                for size in sizes:
                    at, h = windows(y, size)
                    if held.value is not None:
                        hit = _member(held.value, h)
                        at, h = at[hit], h[hit]
                    for k in range(0, len(at), 1 << 16):
                        p = at[k : k + (1 << 16)]
                        d = y.doc[p]
                        yield pd.DataFrame({"doc_id": ids[d], "h": h[k : k + len(p)].view(np.int64), "doc_pos": p - y.begin[d], "whole": (y.end - y.begin)[d] == size, "doc_slots": _values(y, p, size)})

    return docs.where("doc_id is not null").select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, h long, doc_pos long, whole boolean, doc_slots array<long>")


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, least: float = 0.8, most: int = MOST) -> DataFrame:
    """(doc_id, item_id, coverage, n_slots, verbatim): pairs whose consistent alignments cover ``least`` of the item."""
    bench = saved(benchmark_windows(items, window), "benchmark")
    sizes = [r["size"] for r in bench.select("size").distinct().collect()]  # at most WINDOW numbers
    few = bench.select("h").distinct().limit(most + 1)
    wanted = None
    if few.count() <= most:
        wanted = np.sort(few.toPandas().h.to_numpy(np.int64).view(np.uint64))
    met = document_windows(docs, sizes, wanted).join(bench, "h").withColumn("offset", F.col("doc_pos") - F.col("item_pos"))
    met = met.where((F.col("size") >= LITERAL) | F.col("whole"))
    met = met.select("doc_id", "item_id", "offset", "item_pos", "n_windows", "strict", F.arrays_zip("item_slots", "doc_slots").alias("slots"))
    met = saved(met, "matches").distinct()  # read twice
    # a hot item's matches are aggregated before they meet: one row an alignment, one an alignment and slot pair
    key = ["doc_id", "item_id", "offset"]
    slots = met.select(*key, F.explode("slots").alias("s")).select(*key, "s.item_slots", "s.doc_slots").distinct()
    broken = slots.groupBy(*key).agg(
        F.count("*").alias("n_slots"), F.count_distinct("item_slots").alias("a"), F.count_distinct("doc_slots").alias("b"),
        F.sum((F.col("item_slots") != F.col("doc_slots")).cast("int")).alias("changed"),
    )
    lines = met.join(broken, key, "left").where("n_slots is null or (n_slots = a and n_slots = b and (not strict or changed = 0))")
    return (
        lines.groupBy("doc_id", "item_id").agg(
            (F.count_distinct("item_pos") / F.max("n_windows")).alias("coverage"),
            F.coalesce(F.max("n_slots"), F.lit(0)).alias("n_slots"), (F.coalesce(F.min("changed"), F.lit(0)) == 0).alias("verbatim"),
        ).where(F.col("coverage") >= least)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Of a repeated id all rows go if one holds an item; null ids, null and empty texts stay; without benchmark items all
    documents stay; the columns of docs, whatever their names, are kept.
    """
    gone = saved(contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "gone")
    return without(docs, gone).select([f"`{c}`" for c in docs.columns])
