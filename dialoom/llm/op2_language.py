"""Language identification by prediction by partial matching over bytes.

For every language a context tree of byte contexts up to ``order`` is counted on a bounded sample of
labelled texts. Statistics are then frozen, and a text's exact code length in bits is the sum over its
bytes of -log2 p(byte | longest seen context), escapes included: in a context seen ``t`` times with
``d`` distinct successors a known byte has n/(t+d), an escape d/(t+d), and below order 0 every byte has
1/256. Because nothing adapts, a context's code lengths are constants: the trees of all languages are
flattened to one table (context node x byte x language), and a block of texts is scored by gathers.

ASCII and other letters are lower-cased first. Prior to scoring, Spark counts the n-grams of the sample
(partial sums in the tasks, then one small shuffle). Only text is read for a prediction.

Defined cases: a text that is null or has no letter is ``und`` with score 0; ties go to the language
first in order; null languages teach nothing; without labelled rows everything is ``und``. Repeated
rows and null ids are scored like any other; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import crc_fold, table
from .words import blocks

ORDER = 3


def _bytes(texts) -> list[bytes]:
    return [t.lower().encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def sample(docs: DataFrame, per_language: int = 300) -> DataFrame:
    """Training texts: of each language, ``per_language`` with the smallest id hash, whole."""
    rows = (
        docs.where("lang is not null and text is not null and doc_id is not null").where(crc_fold() != 2)
        .select("lang", "doc_id", F.xxhash64("doc_id").alias("hash"))
    )
    # only ids under a hash that four times the wanted rows of their language fall below compete
    size = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    share = F.pmod("hash", F.lit(1 << 30)) / float(1 << 30)
    rows = rows.join(size, "lang").where(share * F.col("rows") <= 4.0 * per_language).drop("rows")
    rows = rows.withColumn("hash", F.pmod("hash", F.lit(1 << 30)))
    # bounded top-k without sorting a language in one task: each task keeps its own smallest, then they merge
    k = per_language

    def least(batches):
        kept = None
        for x in batches:
            kept = x if kept is None else pd.concat([kept, x])
            kept = kept.sort_values(["hash", "doc_id"]).groupby("lang", sort=False).head(k)
        if kept is not None:
            yield kept

    few = rows.mapInPandas(least, rows.schema).groupBy("lang").applyInPandas(
        lambda x: x.sort_values(["hash", "doc_id"]).head(k), rows.schema
    )
    return docs.select("doc_id", "lang", "text").join(F.broadcast(few.select("doc_id").distinct()), "doc_id")


def count(texts: DataFrame, order: int = ORDER) -> pd.DataFrame:
    """(lang, gram, n): occurrences of all byte strings of 1 to order+1 bytes in the sample, counted by Spark."""

    def run(batches):
        for x in batches:
            for lang, group in x.groupby("lang", sort=False):
                for _, block in blocks(_bytes(group.text), 1 << 19):
                    out = []
                    data = np.frombuffer(b"\x00".join([b"", *block, b""]), np.uint8).astype(np.uint64)
                    for k in range(min(order + 1, len(data))):
                        gram = np.zeros(len(data) - k, np.uint64)
                        for j in range(k + 1):
                            gram = gram << np.uint64(8) | data[j : len(data) - k + j]
                        # a gram that crosses or predicts a text's border is not counted
                        ok = np.ones(len(gram), bool)
                        for j in range(k + 1):
                            ok &= data[j : len(data) - k + j] != 0
                        v, n = np.unique(gram[ok], return_counts=True)
                        out.append(pd.DataFrame({"lang": lang, "size": k + 1, "gram": v.astype(np.int64), "n": n}))
                    yield pd.concat(out)

    grams = texts.mapInPandas(run, "lang string, size int, gram long, n long")
    return grams.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")).toPandas()


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray  # byte -> symbol; the last symbol stands for bytes that no sample holds
    node: np.ndarray  # code of the last three symbols -> context node
    cost: np.ndarray  # [node, symbol, language] bits
    order: int = ORDER

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language."""
        out, a = np.zeros((len(texts), len(self.languages))), np.int32(self.cost.shape[1])
        flat, at, edge = self.cost.reshape(-1, len(self.languages)), 0, int(a) - 1
        for _, block in blocks(texts, 1 << 19):
            gap = bytes([0])  # a byte of no sample: contexts never reach across texts
            data = self.symbol[np.frombuffer(b"".join(gap * self.order + t for t in block), np.uint8)].astype(np.int32)
            code = np.full(len(data), edge, np.int32)
            code[3:] = (data[:-3] * a + data[1:-2]) * a + data[2:-1]
            rows = flat[self.node[code] * a + data]
            sizes = np.array([len(t) + self.order for t in block])
            ends = np.cumsum(sizes)
            total = np.r_[np.zeros((1, rows.shape[1])), np.cumsum(rows, 0, np.float64)]
            out[at : at + len(block)] = total[ends] - total[ends - sizes + self.order]
            at += len(block)
        return out


def flatten(counts: pd.DataFrame, least: int = 4) -> Model:
    """One table of code lengths from the counts. A context of two or three bytes needs ``least`` occurrences to be a node."""
    languages = sorted(counts.lang.unique())
    seen = np.sort(counts.gram[counts["size"] == 1].unique())
    symbol = np.full(256, len(seen), np.uint8 if len(seen) < 255 else np.int16)
    symbol[seen] = np.arange(len(seen))
    a = len(seen) + 1
    nodes: list[tuple[int, ...]] = [()]
    trees = []
    for lang in languages:
        tree: dict[tuple[int, ...], dict[int, int]] = {}
        own = counts[counts.lang == lang]
        for size, gram, n in zip(own["size"], own.gram, own.n, strict=True):
            s = tuple(int(symbol[(int(gram) >> 8 * (size - 1 - j)) & 255]) for j in range(size))
            tree.setdefault(s[:-1], {})[s[-1]] = int(n)
        trees.append({c: t for c, t in tree.items() if len(c) < 2 or sum(t.values()) >= least})
    index = {(): 0}
    for depth in range(1, ORDER + 1):
        for c in sorted({c for t in trees for c in t if len(c) == depth}):
            index[c] = len(nodes)
            nodes.append(c)
    cost = np.zeros((len(nodes), a, len(languages)), np.float32)
    for k, tree in enumerate(trees):
        rows = np.zeros((len(nodes), a))
        for i, c in enumerate(nodes):  # shorter contexts come first
            lower = rows[_parent(index, c)] if c else np.full(a, 1 / 256)
            known = tree.get(c)
            if not known:
                rows[i] = lower
                continue
            t, d = sum(known.values()), len(known)
            p = lower * d / (t + d)
            at = np.fromiter(known, int)
            p[at] = np.fromiter(known.values(), float) / (t + d)
            rows[i] = p
        cost[:, :, k] = -np.log2(rows)
    # every string of three symbols to its longest suffix that is a node
    node = np.zeros(a**3, np.int32)
    one = np.zeros(a, np.int32)
    for c, i in index.items():
        if len(c) == 1:
            one[c[0]] = i
    two = np.tile(one, a)
    for c, i in index.items():
        if len(c) == 2:
            two[c[0] * a + c[1]] = i
    node[:] = np.tile(two, a)
    for c, i in index.items():
        if len(c) == 3:
            node[(c[0] * a + c[1]) * a + c[2]] = i
    return Model(languages, symbol, node, cost)


def _parent(index: dict, c: tuple[int, ...]) -> int:
    for k in range(1, len(c) + 1):
        if c[k:] in index:
            return index[c[k:]]
    return 0


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (posterior of the language under equal priors), bits_per_byte."""
    # ids pass pandas as text: beside a null, pandas would make floating point of them
    base = docs.select(F.col("doc_id").cast("string"), "text")
    schema = T.StructType([base.schema["doc_id"], *(T.StructField(n, t) for n, t in (
        ("lang_pred", T.StringType()), ("score", T.DoubleType()), ("bits_per_byte", T.DoubleType()), ("lettered", T.BooleanType())))])
    held = base.sparkSession.sparkContext.broadcast(model)  # a table bounded by the sample bound

    def run(batches):
        for x in batches:
            texts = _bytes(x.text)
            lettered = np.array([isinstance(t, str) and any(map(str.isalpha, t)) for t in x.text], bool)
            lang, score, rate = np.full(len(x), "und", object), np.zeros(len(x)), np.zeros(len(x))
            if held.value is not None:
                bits = held.value.bits(texts)
                low = bits.min(1, keepdims=True)
                p = np.exp2(np.maximum(low - bits, -1000))
                score = 1 / p.sum(1)
                lang = np.array(held.value.languages, object)[bits.argmin(1)]
                rate = low[:, 0] / np.maximum(1, [len(t) for t in texts])
            bad = ~lettered
            lang[bad], score[bad] = "und", 0.0
            yield pd.DataFrame({"doc_id": x.doc_id, "lang_pred": lang, "score": score, "bits_per_byte": rate, "lettered": lettered})

    out = base.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    return out.select("doc_id", F.coalesce(crc_fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def fit(docs: DataFrame, **options) -> Model | None:
    counts = count(sample(docs, **options))
    return flatten(counts) if len(counts) else None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
