"""LM scoring by cross-entropy difference.

A target and a background bigram model share one vocabulary: every word of the corpus. Background counts
come from every document, target counts from every document labelled good and not toxic. Both are
Dirichlet-smoothed with their unigrams. A document's score is the mean over its tokens of
-log2 p_target + log2 p_background: the lower, the more like the target.

Documents are written once as compressed blocks. A block sends each distinct word and pair once,
as a 64-bit hash with its counts, packed by hash bucket; a bucket sums the counts of all blocks and
sends the sums back to the blocks that asked, where the texts are read again and scored. So a frequent pair
costs a row a block, buckets grow in number with the blocks and not in size, and no table of the models is
gathered in one place. Target documents are marked by a join of the blocks' ids.

Words are maximal runs of letters, digits and non-ASCII bytes, ASCII-lower-cased.

Defined cases: null, empty and word-less texts have 0 tokens and score 0; without target documents the
target model is its prior; repeated rows and null ids count and score like others; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import packed, press, saved, table, unpacked, unpress
from .words import Block, mix

_OUT = np.ones(256, bool)
_OUT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
START = np.uint64(0)
WORD, BEGIN, PAIR = range(3)
#: At least 2**LEAST_BITS buckets, and one for each BLOCKS_A_BUCKET blocks.
LEAST_BITS, BLOCKS_A_BUCKET = 6, 4


def keys(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the block's words, start and pairs (the kind in the last two bits), and each word's, context's and pair's place."""
    if not len(b.h):
        return b.h, *[np.zeros(0, np.int64)] * 3
    m, first = len(b.h), b.word_start[b.word_end > b.word_start]
    before = np.r_[START, b.h[:-1]]
    before[first] = START
    of = lambda kind, x: (mix(x) & ~np.uint64(3)) | np.uint64(kind)
    key, back = np.unique(np.concatenate([of(WORD, b.h), of(BEGIN, np.array([START])), of(PAIR, mix(before + np.uint64(1)) + b.h)]), return_inverse=True)
    context = np.r_[back[m], back[: m - 1]]
    context[first] = back[m]
    return key, back[:m], context, back[m + 1 :]


def tallies(marked: DataFrame, bits: int) -> DataFrame:
    """(bucket, block, keys, counts) of blocks with the places of their target documents.

    Counts are four to a key: background and target, and how often of these the word ends a document and is no context.
    """

    def run(batches):
        for x in batches:
            for r in x.itertuples(index=False):
                b = Block(unpacked(r.sizes, r.blob), lower=True, separators=_OUT)
                key, word, context, pair = keys(b)
                flag = np.zeros(b.n, bool)
                if r.good is not None:
                    flag[np.asarray(r.good, np.int64)] = True
                full = b.word_end > b.word_start
                at = np.r_[word, pair, context[b.word_start[full]]]
                target = np.r_[flag[b.doc], flag[b.doc], flag[full]]
                last = word[b.word_end[full] - 1]
                n = np.stack([np.bincount(i, w, len(key)) for i, w in ((at, None), (at, target), (last, None), (last, flag[full]))]).astype(np.int64)
                bucket, edge = np.unique(key >> np.uint64(64 - bits), return_index=True)
                edge = np.r_[edge, len(key)]
                out = [
                    (int(k), r.block, press(np.r_[key[i : i + 1], np.diff(key[i:j])].view(np.int64)), press(n[:, i:j].ravel()))
                    for k, i, j in zip(bucket, edge[:-1], edge[1:], strict=True)
                ]
                yield pd.DataFrame(out, columns=["bucket", "block", "keys", "counts"])

    return marked.select("block", "sizes", "blob", "good").mapInPandas(run, "bucket int, block long, keys binary, counts binary")


def summed(tally: DataFrame) -> DataFrame:
    """(bucket, block, sums, words, background, target): each block's keys in all blocks; the last three tell of a bucket's words, once."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        own = [np.cumsum(unpress(k).view(np.uint64)) for k in x["keys"]]
        counts = [unpress(c).reshape(4, -1) for c in x.counts]
        key, back = np.unique(np.concatenate(own), return_inverse=True)
        n = np.stack([np.bincount(back, c, len(key)) for c in np.concatenate(counts, 1)]).astype(np.int64)
        word = (key & np.uint64(3)) == WORD
        edge = np.cumsum([0, *map(len, own)])
        told = np.zeros((3, len(x)), np.int64)
        told[:, 0] = word.sum(), *n[:2, word].sum(1)
        sums = [press(n[:, back[i:j]].ravel()) for i, j in zip(edge[:-1], edge[1:], strict=True)]
        return pd.DataFrame({"bucket": x.bucket, "block": x.block, "sums": sums, "words": told[0], "background": told[1], "target": told[2]})

    return tally.groupBy("bucket").applyInPandas(run, "bucket int, block long, sums binary, words long, background long, target long")


def score(docs: DataFrame, labels: DataFrame, prior: float = 50.0) -> DataFrame:
    """doc_id, n_tokens, score: mean cross-entropy difference in bits a token."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0")
    good = good.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).cast("string").alias("id"))
    parts = saved(packed(docs), "blocks")
    places = parts.select("block", F.posexplode("ids").alias("at", "id")).join(good, "id").groupBy("block").agg(F.collect_list("at").alias("good"))
    places = saved(places, "places")  # with its size known, the texts move only if it is large
    bits = max(LEAST_BITS, (parts.count() // BLOCKS_A_BUCKET).bit_length())
    sums = saved(summed(tallies(parts.join(places, "block", "left"), bits)), "sums")
    told = sums.agg(F.sum("words"), F.sum("background"), F.sum("target")).first()
    words, *total = (x or 0 for x in told)

    def run(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(texts):
            raise ValueError("sums of a block without texts")
        ids, sizes, blob = texts[["ids", "sizes", "blob"]].iloc[0]
        b = Block(unpacked(sizes, blob), lower=True, separators=_OUT)
        key, word, context, pair = keys(b)
        got = [unpress(x).reshape(4, -1) for x in known.sort_values("bucket").sums]
        n = np.concatenate(got, 1).astype(float) if got else np.zeros((4, 0))
        if n.shape[1] != len(key):
            raise ValueError("keys of a block came back without sums")
        p = []
        for k in range(2):
            unigram = (n[k, word] + 1) / (total[k] + words)
            p.append((n[k, pair] + prior * unigram) / ((n[k] - n[k + 2])[context] + prior))
        count = b.word_end - b.word_start
        mean = np.bincount(b.doc, np.log2(p[0]) - np.log2(p[1]), b.n) / np.maximum(1, count)
        return pd.DataFrame({"doc_id": list(ids), "n_tokens": count.astype(np.int64), "score": mean})

    out = parts.groupBy("block").cogroup(sums.select("bucket", "block", "sums").groupBy("block")).applyInPandas(run, "doc_id string, n_tokens long, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
