"""Toxicity: a two-state linear-chain conditional random field over words.

Labels mark documents, so token labels are derived first: in a bounded sample of labelled documents,
Spark counts in how many toxic and other documents each word and each four-byte prefix occurs; tokens
whose word or prefix is far likelier in toxic documents are labelled 1 there, all others 0. The field
is trained on these labelled sequences by gradient ascent on the exact log-likelihood (forward-backward),
with features of the word, its prefix and suffix, and its neighbours. Training sequences are windows of ``CHAIN``
words of one text. A text is tagged as one chain, however long: pieces of ``CHAIN`` words run side by side, and each
gets the exact messages of the text before and after it. Marginals of state 1 give spans, and their evidence gives the
document's score by a logistic calibration on the same sample.

Words are maximal runs of letters, digits and non-ASCII bytes, ASCII-lower-cased. Only text is scored.

Defined cases: null and empty texts have no words and get the score of zero evidence; without labels
of both classes every score is 0; a word of any length is one token; repeated rows are scored one by
one; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import crc_fold, saved, table
from .words import Block, blocks, mix

CHAIN = 64
_OUT = np.ones(256, bool)
_OUT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
KINDS = 3  # of features of a token: word, prefix, suffix


def tokens(block: list[bytes]) -> tuple[Block, list[np.ndarray]]:
    """Words of a block and, for each kind of feature, a hash a word."""
    b = Block(block, lower=True, separators=_OUT)
    head = b.hash(b.start, np.minimum(b.end, b.start + 4))
    tail = b.hash(np.maximum(b.start, b.end - 4), b.end)
    return b, [mix(h ^ np.uint64(0x51ED270B * (k + 1))) for k, h in enumerate((b.h, head, tail))]


def _lookup(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of h in sorted keys, len(keys) where absent."""
    if not len(keys):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, len(keys))


def _log_add(a, b):
    m = np.maximum(a, b)
    return m + np.log1p(np.exp(-np.abs(a - b)))


def forward(unary: np.ndarray, used: np.ndarray, trans: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Log messages [step, chain, state] of chains; start: the message of what comes before each chain."""
    n, m = unary.shape
    alpha = np.zeros((m, n, 2))
    if start is None:
        alpha[0, :, 1] = unary[:, 0]
    else:
        alpha[0, :, 0] = _log_add(start[:, 0] + trans[0, 0], start[:, 1] + trans[1, 0])
        alpha[0, :, 1] = _log_add(start[:, 0] + trans[0, 1], start[:, 1] + trans[1, 1]) + unary[:, 0]
    for t in range(1, m):
        a0 = _log_add(alpha[t - 1, :, 0] + trans[0, 0], alpha[t - 1, :, 1] + trans[1, 0])
        a1 = _log_add(alpha[t - 1, :, 0] + trans[0, 1], alpha[t - 1, :, 1] + trans[1, 1]) + unary[:, t]
        on = used[:, t]
        alpha[t, :, 0] = np.where(on, a0, alpha[t - 1, :, 0])
        alpha[t, :, 1] = np.where(on, a1, alpha[t - 1, :, 1])
    return alpha


def forward_backward(unary: np.ndarray, used: np.ndarray, trans: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None):
    """Marginals of chains. unary: [chain, step] score of state 1 over state 0; used: which steps exist (a prefix of each row).

    start and end: messages of what comes before and after each chain; nothing if None. Returns p(state 1), the expected
    counts of the four transitions inside the chains, and the log-partition of each chain.
    """
    n, m = unary.shape
    alpha, beta = forward(unary, used, trans, start), np.zeros((m, n, 2))
    if end is not None:
        beta[-1] = end
    for t in range(m - 2, -1, -1):
        x0, x1 = beta[t + 1, :, 0], beta[t + 1, :, 1] + unary[:, t + 1]
        on = used[:, t + 1]
        beta[t, :, 0] = np.where(on, _log_add(x0 + trans[0, 0], x1 + trans[0, 1]), beta[t + 1, :, 0])
        beta[t, :, 1] = np.where(on, _log_add(x0 + trans[1, 0], x1 + trans[1, 1]), beta[t + 1, :, 1])
    last = alpha[-1] + beta[-1]
    z = _log_add(last[:, 0], last[:, 1])
    score = alpha + beta
    p = 1 / (1 + np.exp(np.clip(score[:, :, 0] - score[:, :, 1], -500, 500)))
    p = np.where(used, p.T, 0.0)
    counts = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            x = alpha[:-1, :, i] + trans[i, j] + (unary.T[1:] if j else 0) + beta[1:, :, j] - z
            counts[i, j] = np.exp(np.minimum(x, 0))[used.T[1:]].sum()
    return p, counts, z


def messages(unary: np.ndarray, used: np.ndarray, trans: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) messages of pieces that follow each other in texts; place: a piece's number in its text."""
    n = len(unary)
    start, end = np.zeros((n, 2)), np.zeros((n, 2))
    inner = np.flatnonzero(place > 0)
    if len(inner):
        none = -1e30
        through = np.zeros((n, 2, 2))  # from the state before a piece to the state at its end
        for i in (0, 1):
            before = np.full((len(inner), 2), none)
            before[:, i] = 0
            through[inner, i] = forward(unary[inner], used[inner], trans, before)[-1]
        head = np.flatnonzero((place == 0) & np.r_[place[1:] > 0, False])
        out = np.zeros((n, 2))
        out[head] = forward(unary[head], used[head], trans)[-1]
        order = np.argsort(place, kind="stable")
        edge = np.searchsorted(place[order], np.arange(place.max() + 2))
        for k in range(1, len(edge) - 1):
            at = order[edge[k] : edge[k + 1]]
            start[at] = out[at - 1] - out[at - 1].max(1, keepdims=True)
            out[at] = _log_add(start[at, :1] + through[at, 0], start[at, 1:] + through[at, 1])
        for k in range(len(edge) - 2, 0, -1):
            at = order[edge[k] : edge[k + 1]]
            x = through[at] + end[at, None, :]
            got = _log_add(x[:, :, 0], x[:, :, 1])
            end[at - 1] = got - got.max(1, keepdims=True)
    return start, end


def chains(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lay a value per word out as [piece, step]; pieces never cross texts. Also the used cells, where each word went, and a piece's number in its text."""
    n = len(text)
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if n else np.zeros(0, np.int64)
    inside = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    step = inside % CHAIN
    row = np.cumsum(step == 0) - 1
    shape = (int(row[-1]) + 1 if n else 0, CHAIN)
    out, used = np.zeros(shape), np.zeros(shape, bool)
    at = row * CHAIN + step
    out.flat[at], used.flat[at] = value, True
    return out, used, at, inside[step == 0] // CHAIN


@dataclass
class Field:
    keys: list[np.ndarray]  # sorted hashes with a weight, for each kind of feature
    weights: list[np.ndarray]  # [key or none] x (here, before, after)
    bias: float
    trans: np.ndarray
    scale: tuple[float, float] = (0.0, 0.0)

    def unary(self, doc: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(doc), self.bias)
        same = doc[1:] == doc[:-1]
        for keys, w, h in zip(self.keys, self.weights, hashes, strict=True):
            at = _lookup(keys, h)
            out += w[at, 0]
            out[1:] += np.where(same, w[at[:-1], 1], 0)
            out[:-1] += np.where(same, w[at[1:], 2], 0)
        return out

    def tag(self, doc: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
        """Marginal of state 1 of every word."""
        p = np.zeros(len(doc))
        u = self.unary(doc, hashes)
        laid, used, at, place = chains(doc, u)
        start, end = messages(laid, used, self.trans, place)
        # first pieces have no text before them
        opens = place == 0
        for rows in (np.flatnonzero(opens), np.flatnonzero(~opens)):
            for k in range(0, len(rows), 4096):
                own = rows[k : k + 4096]
                got, _, _ = forward_backward(laid[own], used[own], self.trans, None if opens[own[0]] else start[own], end[own])
                laid[own] = got
        p[:] = laid.flat[at]
        return p

    def document_score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale[0] + self.scale[1] * evidence)))


def sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """Up to ``sample_rows`` toxic and four times as many other labelled documents, smallest id hashes, outside the held-out fold."""
    known = (
        labels.where("doc_id is not null and toxic is not null").where(crc_fold() != 2)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    pick = lambda y: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows * (1 if y else 4))
    return docs.select("doc_id", "text").join(F.broadcast(pick(1).union(pick(0))), "doc_id")


def evidence_words(rows: DataFrame, least: int, precision: float, sigma: float) -> list[np.ndarray]:
    """Hashes of words, prefixes and suffixes that mark toxic documents, counted by document in Spark.

    A feature needs ``least`` toxic documents, ``precision`` of its documents toxic, and ``sigma``
    standard deviations above the sample's share of toxic documents (1.4 times that for word parts).
    """

    def run(batches):
        for x in batches:
            for first, block in blocks(x.text):
                b, hashes = tokens(block)
                y = x.toxic.to_numpy()[first : first + len(block)]
                for kind, h in enumerate(hashes):
                    if len(h):
                        pair = np.unique(np.stack([b.doc.astype(np.uint64), h]), axis=1)
                        key, back = np.unique(pair[1], return_inverse=True)
                        toxic = np.bincount(back, y[pair[0].astype(np.int64)]).astype(np.int64)
                        yield pd.DataFrame({"kind": kind, "h": key.view(np.int64), "toxic": toxic, "n": np.bincount(back)})

    total = rows.groupBy().agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).first()
    if not total["n"] or not total["p"] or total["p"] == total["n"]:
        return [np.zeros(0, np.uint64)] * KINDS
    counts = rows.mapInPandas(run, "kind int, h long, toxic long, n long").groupBy("kind", "h").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    share = total["p"] / total["n"]
    z = (F.col("toxic") - share * F.col("n")) / F.sqrt(F.col("n") * (share * (1 - share)))
    got = counts.where((F.col("toxic") >= least) & (F.col("toxic") >= precision * F.col("n")) & (z >= F.when(F.col("kind") == 0, sigma).otherwise(1.4 * sigma))).select("kind", "h").toPandas()
    return [np.sort(got.h[got.kind == k].to_numpy(np.int64).view(np.uint64)) for k in range(KINDS)]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 1200, least: int = 6, precision: float = 0.85, sigma: float = 7.0, steps: int = 60, clean_share: int = 32) -> Field:
    """Train on at most 5 x ``sample_rows`` documents, whole texts for the evidence words and the calibration.

    The sequences of the field are their windows of ``CHAIN`` words with a derived token, and one in ``clean_share`` of the others.
    """
    # ids pass pandas as text; the sample is read four times
    rows = saved(sample(docs, labels, sample_rows).select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("toxic").cast("long").alias("toxic")), "sample")
    keys = evidence_words(rows, least, precision, sigma)
    field = Field(keys, [np.zeros((len(k) + 1, 3)) for k in keys], 0.0, np.zeros((2, 2)))
    if not any(map(len, keys)):
        return field
    held = rows.sparkSession.sparkContext.broadcast(keys)

    def derive(batches):
        for x in batches:
            for first, block in blocks(x.text):
                b, hashes = tokens(block)
                at = [_lookup(k, h) for k, h in zip(held.value, hashes, strict=True)]
                toxic = x.toxic.to_numpy()[first : first + len(block)]
                # a word, or a prefix that is no whole known word, is evidence; suffixes only support it
                mark = ((at[0] < len(held.value[0])) | (at[1] < len(held.value[1]))) & (toxic[b.doc] == 1)
                pos = np.arange(len(b.doc)) - b.word_start[b.doc]
                window = (b.doc << 32) + pos // CHAIN
                kept = mix((pos // CHAIN).astype(np.uint64) + b.hash(b.doc_start, b.doc_end)[b.doc]) % np.uint64(clean_share) == 0
                keep = np.isin(window, window[mark]) | kept
                yield pd.DataFrame({
                    "doc": x.doc_id.to_numpy()[first : first + len(block)][b.doc[keep]], "window": pos[keep] // CHAIN, "pos": pos[keep],
                    "y": mark[keep].astype(np.int64), "a": at[0][keep], "b": at[1][keep], "c": at[2][keep],
                })

    data = rows.mapInPandas(derive, "doc string, window long, pos long, y long, a long, b long, c long").toPandas().sort_values(["doc", "window", "pos"], kind="stable")
    _train(field, data, steps)
    seen = rows.select("doc_id", "text", "toxic").mapInPandas(_evidence(rows.sparkSession, field), "doc_id string, evidence double, spans string, toxic long").toPandas()
    field.scale = _logistic(seen.evidence.to_numpy(), seen.toxic.to_numpy(float))
    return field


def _train(field: Field, data: pd.DataFrame, steps: int) -> None:
    """Full-batch adaptive gradient ascent on the log-likelihood of the chains."""
    doc = data.groupby(["doc", "window"], sort=False).ngroup().to_numpy()  # a window is a sequence of its own
    y, at = data.y.to_numpy(float), [data[c].to_numpy() for c in "abc"]
    same = doc[1:] == doc[:-1]
    truth, used, cell, _ = chains(doc, y)
    joined = used[:, 1:]
    state = truth.astype(int)
    seen = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            seen[i, j] = ((state[:, :-1] == i) & (state[:, 1:] == j) & joined).sum()
    parts = [*field.weights, np.zeros(1), field.trans]
    speed = [np.full(p.shape, 1e-6) for p in parts]
    for _ in range(steps):
        u = np.full(len(doc), parts[KINDS][0])
        for w, a in zip(field.weights, at, strict=True):
            u += w[a, 0]
            u[1:] += np.where(same, w[a[:-1], 1], 0)
            u[:-1] += np.where(same, w[a[1:], 2], 0)
        p, counts, _ = forward_backward(chains(doc, u)[0], used, field.trans)
        d = y - p.flat[cell]
        grads = []
        for w, a in zip(field.weights, at, strict=True):
            g = np.zeros_like(w)
            g[:, 0] = np.bincount(a, d, len(w))
            g[:, 1] = np.bincount(a[:-1], d[1:] * same, len(w))
            g[:, 2] = np.bincount(a[1:], d[:-1] * same, len(w))
            g[-1] = 0  # a word without a weight speaks through the bias alone
            grads.append(g - 0.05 * w)
        grads += [np.array([d.sum()]), seen - counts]
        for part, g, s in zip(parts, grads, speed, strict=True):
            s += g * g
            part += 0.7 * g / np.sqrt(s)
    field.bias = float(parts[KINDS][0])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Two-parameter logistic fit, a little ridge so that a clean separation stays finite."""
    w, z = np.zeros(2), np.c_[np.ones(len(x)), x]
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2), z.T @ (y - p) - 0.1 * w)
    return float(w[0]), float(w[1])


def _evidence(spark: SparkSession, field: Field, extra: str | None = "toxic"):
    held = spark.sparkContext.broadcast(field)  # bounded by the sample bound

    def run(batches):
        for x in batches:
            evidence, spans = np.zeros(len(x)), np.full(len(x), "", object)
            for first, block in blocks(x.text):
                b, hashes = tokens(block)
                p = held.value.tag(b.doc, hashes)
                # log-odds of "at least one toxic word", bounded; the floor keeps long clean texts from adding up
                none = np.bincount(b.doc, np.where(p >= 0.2, np.log1p(-np.clip(p, 0, 1 - 1e-6)), 0), b.n)
                evidence[first : first + b.n] = np.clip(np.log(np.maximum(-np.expm1(none), 1e-6)) - none, -12, 12)
                points = np.r_[0, np.cumsum((b.buf & 0xC0) != 0x80)]  # code points before each byte
                hit = np.flatnonzero(p >= 0.5)
                base = points[b.doc_start[b.doc[hit]]]
                said = [f"{s}:{e}" for s, e in zip(points[b.start[hit]] - base, points[b.end[hit]] - base, strict=True)]
                edge = np.searchsorted(b.doc[hit], np.arange(b.n + 1))
                spans[first : first + b.n] = [",".join(said[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)]
            out = pd.DataFrame({"doc_id": x.doc_id, "evidence": evidence, "spans": spans})
            yield out.assign(toxic=x.toxic.astype("int64")) if extra else out

    return run


def score(docs: DataFrame, field: Field, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, n_spans and spans (start:end in code points, comma-joined)."""
    base = docs.select(F.col("doc_id").cast("string"), "text")
    out = base.mapInPandas(_evidence(docs.sparkSession, field, None), "doc_id string, evidence double, spans string")
    out = out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    a, b = field.scale
    value = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("evidence")))) if (a, b) != (0.0, 0.0) else F.lit(0.0)
    return out.select(
        "doc_id", F.coalesce(crc_fold() == 2, F.lit(False)).alias("held_out"), value.alias("score"),
        (value >= threshold).cast("int").alias("predicted"),
        F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).alias("n_spans"), "spans",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
