"""Quality rules: gradient-boosted trees over document statistics, flattened to numpy node arrays.

``statistics`` computes counts of whole texts in vectorised blocks inside ``mapInPandas`` (no shuffle).
``fit`` grows histogram trees on a bounded sample of labelled documents (``sample_rows``, smallest
hashes of the id), with monotonic constraints: more symbols, repeated words or repeated lines never
raise a score. ``score`` walks all rows of a batch through the flattened trees at once.

Defined cases: a null or empty text has zero counts, so it fails the base rule; rows with a null id or
repeated rows are scored one by one and all returned; an empty table gives an empty result; without
labels of both classes the model is constant and only the base rule decides. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import crc_fold, table
from .words import Block, blocks, mix

SYMBOLS = b"#*$%&|<>"
#: The base rule (least words, most percent of repeated words) and the quality from which a text is kept.
LEAST_WORDS, MOST_REPEATED, THRESHOLD = 50, 50, 0.3
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "symbols_per_word", "repeat_share", "dup_line_share", "log_words", "mean_word", "upper_share", "digit_share",
    "mark_share", "pipe_share", "distinct_share", "words_per_line", "high_share", "capital_words",
]
#: Sign of the allowed direction of the quality score along each feature.
MONOTONE = {"symbols_per_word": -1, "repeat_share": -1, "dup_line_share": -1, "pipe_share": -1}
COLUMNS = BASE + FEATURES


def _flag(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _PIPE = _flag(SYMBOLS), _flag(b"|")
_UPPER, _DIGIT = _flag(bytes(range(65, 91))), _flag(b"0123456789")
_MARK = _flag(b"!?.,;:")
_SALT = np.uint64(0xD6E8FEB86659FD93)


def text_statistics(texts) -> pd.DataFrame:
    parts = []
    for _, block in blocks(texts):
        b = Block(block)
        n = b.word_end - b.word_start
        inside = np.zeros(len(b.buf) + 1, np.int8)
        np.add.at(inside, b.start, 1)
        np.add.at(inside, b.end, -1)
        inside = np.cumsum(inside[:-1]).astype(bool)
        chars = b.per_doc(inside & ((b.buf & 0xC0) != 0x80))
        symbols = b.per_doc(_SYMBOL[b.buf])
        # lines: every newline of the buffer ends one; the last of a text is the joining newline
        stop = np.flatnonzero(b.buf == 10)
        start = np.r_[0, stop[:-1] + 1]
        line_doc = np.searchsorted(b.doc_end, start, "right")
        has = np.searchsorted(b.start, stop) > np.searchsorted(b.start, start)
        key = mix(b.hash(start[has], stop[has]) + line_doc[has].astype(np.uint64) * _SALT)
        _, first = np.unique(key, return_index=True)
        lines = np.bincount(line_doc[has], minlength=b.n)
        dup = lines - np.bincount(line_doc[has][first], minlength=b.n)
        # words under 3-word windows that occur twice
        doc, at, h = b.shingles(3, whole_if_short=False)
        key = mix(h + doc.astype(np.uint64) * _SALT)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(b.h) + 2, bool)
        for k in range(3):
            cover[at[twice] + k] = True
        repeat = np.bincount(b.doc, weights=cover[: len(b.h)], minlength=b.n).astype(np.int64)
        words = mix(b.h + b.doc.astype(np.uint64) * _SALT)
        _, first = np.unique(words, return_index=True)
        kinds = np.bincount(b.doc[first], minlength=b.n)
        capital = np.bincount(b.doc, weights=_UPPER[b.buf[b.start]], minlength=b.n)
        size, w = np.maximum(1, b.doc_end - b.doc_start - 1), np.maximum(1, n)
        c = np.maximum(1, chars)
        parts.append(np.c_[
            n, chars, symbols, dup, repeat,
            symbols / w, repeat / w, dup / np.maximum(1, lines), np.log1p(n), chars / w, b.per_doc(_UPPER[b.buf]) / c,
            b.per_doc(_DIGIT[b.buf]) / c, b.per_doc(_MARK[b.buf]) / w, b.per_doc(_PIPE[b.buf]) / w, kinds / w,
            n / np.maximum(1, lines), b.per_doc(b.buf >= 128) / size, capital / w,
        ])
    out = pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, len(COLUMNS))), columns=COLUMNS)
    return out.astype({x: np.int64 for x in BASE})


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    kept = [docs.schema[k] for k in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{c} long" for c in BASE] + [f"{c} double" for c in FEATURES])

    def run(batches):
        for x in batches:
            s = text_statistics(x.pop("text"))
            yield pd.concat([x.reset_index(drop=True), s], axis=1)

    return docs.select(*keep, "text").mapInPandas(run, schema)


@dataclass
class Trees:
    """Flattened boosted trees: for node i, go to left[i] if x[feature[i]] <= cut[i], else to left[i]+1; feature -1 is a leaf."""

    bias: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                f = np.maximum(self.feature[at], 0)
                at = np.where(inner, self.left[at] + (x[rows, f] > self.cut[at]), at)
            out += self.value[at]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(x, y, sign, rounds=40, depth=3, rate=0.2, bins=48, ridge=1.0, least=10) -> Trees:
    """Second-order logistic boosting; a split must order its children as ``sign`` says, and their bounds pass down."""
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    feature, cut, left, value, roots = [], [], [], [], []
    margin = np.full(len(y), bias)
    if len(y) and y.min() < y.max():
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)

        def node():
            for a, v in ((feature, -1), (cut, 0.0), (left, 0), (value, 0.0)):
                a.append(v)
            return len(feature) - 1

        def grow(i, rows, g, h, level, low, high):
            total_g, total_h = g[rows].sum(), h[rows].sum()
            value[i] = rate * float(np.clip(-total_g / (total_h + ridge), low, high))
            best = (1e-6,)
            if level and len(rows) >= 2 * least:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gs = np.cumsum(np.bincount(binned[rows, j], g[rows], len(c) + 1))[:-1]
                    hs = np.cumsum(np.bincount(binned[rows, j], h[rows], len(c) + 1))[:-1]
                    ns = np.cumsum(np.bincount(binned[rows, j], minlength=len(c) + 1))[:-1]
                    lv, rv = (np.clip(-a / (b + ridge), low, high) for a, b in ((gs, hs), (total_g - gs, total_h - hs)))
                    gain = gs**2 / (hs + ridge) + (total_g - gs) ** 2 / (total_h - hs + ridge) - total_g**2 / (total_h + ridge)
                    ok = (ns >= least) & (len(rows) - ns >= least) & (sign[j] * (rv - lv) >= 0)
                    gain = np.where(ok, gain, -1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k, float(lv[k]), float(rv[k]))
            if len(best) > 1:
                _, j, k, lv, rv = best
                a, b = node(), node()
                feature[i], cut[i], left[i] = j, float(cuts[j][k]), a
                mid = (lv + rv) / 2
                go = binned[rows, j] <= k
                bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[sign[j]]
                grow(a, rows[go], g, h, level - 1, *bounds[0])
                grow(b, rows[~go], g, h, level - 1, *bounds[1])

        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            root = node()
            roots.append(root)
            grow(root, np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-6), depth, -6.0, 6.0)
            one = Trees(0.0, np.array([root]), *map(np.array, (feature, cut, left, value)))
            margin = margin + one.margin(x)
    return Trees(bias, np.array(roots, np.int64), *(np.array(a) for a in (feature, cut, left, value)))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, **options) -> Trees:
    """Fit on at most ``sample_rows`` labelled documents outside the held-out fold; labels that repeat count once (the lowest)."""
    chosen = (
        labels.where("doc_id is not null and quality is not null").where(crc_fold() != 2)
        .groupBy("doc_id").agg(F.min("quality").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), ("doc_id", "y")).toPandas()
    rows = rows.sort_values(["doc_id", "n_words", "word_chars"], kind="stable")
    sign = [MONOTONE.get(f, 0) for f in FEATURES]
    return fit_trees(rows[FEATURES].to_numpy(float), rows["y"].to_numpy(float), sign, **options)


def base_failed(n_words, n_repeat_words):
    """Of columns or arrays alike."""
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def score(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, quality (0 to 1), base_failed and kept of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers, whatever the corpus
    schema = "doc_id string, {}, quality double".format(", ".join(f"{c} long" for c in BASE))

    def run(batches):
        for x in batches:
            s = text_statistics(x["text"])
            quality = held.value.predict(s[FEATURES].to_numpy(float))
            yield pd.concat([x[["doc_id"]].reset_index(drop=True), s[BASE]], axis=1).assign(quality=quality)

    # ids pass pandas as text: beside a null, pandas would make floating point of them
    out = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, schema)
    out = out.withColumns({"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "base_failed": base_failed(F.col("n_words"), F.col("n_repeat_words"))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with all their columns.

    A null, empty or word-less text goes, as its base rule fails; a very long text is judged whole; repeated rows and
    null ids are judged one by one; an empty table stays empty. The text alone passes the scoring function, so nothing
    is joined or shuffled, and other columns may have any name and type.
    """
    held = spark.sparkContext.broadcast(fit(docs, table(spark, sf_dir, "labels")))

    @F.pandas_udf("boolean")
    def kept(text: pd.Series) -> pd.Series:
        s = text_statistics(text)
        return pd.Series(~base_failed(s.n_words, s.n_repeat_words).to_numpy() & (held.value.predict(s[FEATURES].to_numpy(float)) >= THRESHOLD))

    return docs.where(kept("text"))
