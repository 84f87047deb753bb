"""Near-duplicate passages by compact windows.

The tokens of a text are its five-word shingles. Copies of whole texts are one class and enter by its smallest id. A
shuffle of packed shingle hashes tells which shingles other texts have, too; a passage that is similar to another lies
where windows of ``LEAST`` tokens are mostly such shingles, so only these stretches of the texts, whole, go on.

For each of ``HASHES`` hash functions the Cartesian tree of a stretch's token hashes groups all subsequences of at
least ``LEAST`` tokens by the token of smallest hash: a node [l, r) with minimum c stands for every [i, j) with
l <= i <= c < j <= r. Trees of a whole block are built level by level in numpy. In each band of two functions an
interval join pairs the windows of a stretch that hold a common subsequence of ``LEAST`` tokens; the pair of minima is
the band's key. A passage of similarity s meets its copy in a band with about s**2 at least, so four bands find 98 % of
the pairs at 0.8, and all verbatim ones.

In a group of a key, stretches are compared with a representative (the one of most company in all its groups), not
with each other. A place of a key is done with where a verified passage with the representative covers it; the
others are compared where the ``LEAST`` tokens around their places are as similar as a passage, as a common line alone
doesn't make one. These places meet by their token and ``SHARED`` tokens in a row near it, as one substituted word
leaves so many. A group meets one representative, then 32, and 32 times as many each round, until none has two documents
left. Places that passages link, by however many steps, have one label and aren't compared again; those that have a
representative's label leave its group. After the first of these rounds large groups part by the tokens near: of them
the rarest, as many as places so similar must share one of.

Verification chains the runs of shared shingles, at every place they have, and takes passages of at least ``WORDS`` words
whose shingle sets have a Jaccard similarity of ``SIMILAR``.

Defined cases: null, empty and short texts have no passages; very long texts are cut to stretches like others; null ids
are ignored; rows of a repeated id count as one document, so no passage between them is given; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import packed, press, saved, table, unpacked, unpress, without
from .words import Block, blocks, distinct, mix

SHINGLE, WORDS, SIMILAR, HASHES = 5, 50, 0.8, 8
LEAST = WORDS - SHINGLE + 1
PAIRS = 1 << 16
#: Share of a window's tokens that others must have, with a margin for repeats; the widest gap that a passage bridges.
DENSE, GAP = 0.7, 4 * SHINGLE
#: Shortest run of shared shingles that a chain is made of.
RUN = 3
#: Tokens in a row that places to be compared share somewhere near, and those that a key is made of.
SHARED, PART = 20, 12
#: Places a group, from which on it parts by their other tokens.
LARGE = 128
#: Bits of a shingle's hash that are counted, at most and at least, and shingles a bucket of the count.
HASH_BITS, LEAST_BITS, BUCKET_SHINGLES, LEAST_BUCKETS = 48, 32, 2_000_000, 64
SEEDS = [np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1) for k in range(HASHES)]


def compact_windows(value: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(l, c, r) of the Cartesian tree nodes of at least ``least`` values in the ranges [lo, hi)."""
    out = []
    padded = np.r_[value, np.uint64((1 << 64) - 1)]
    while len(lo):
        big = hi - lo >= least
        lo, hi = lo[big], hi[big]
        if not len(lo):
            break
        low = np.minimum.reduceat(padded, np.stack([lo, hi], 1).ravel())[::2]
        size = hi - lo
        begin = np.cumsum(size) - size
        flat = np.arange(int(size.sum())) - np.repeat(begin - lo, size)
        hit = np.flatnonzero(value[flat] == np.repeat(low, size))
        owner = np.searchsorted(begin, hit, "right") - 1
        # of equal smallest hashes the middle one, so that a repeated passage doesn't make a tree as deep as it is long
        edge = np.searchsorted(owner, np.arange(len(lo) + 1))
        c = flat[hit[(edge[:-1] + edge[1:]) // 2]]
        out.append(np.stack([lo, c, hi], 1))
        lo, hi = np.concatenate([lo, c + 1]), np.concatenate([c, hi])
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def band_keys(a: np.ndarray, b: np.ndarray, va: np.ndarray, vb: np.ndarray, band: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) of each pair of windows of two functions that hold a common subsequence of ``least`` tokens."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    b = b[np.argsort(b[:, 1], kind="stable")]
    lo, hi = np.searchsorted(b[:, 1], a[:, 0]), np.searchsorted(b[:, 1], a[:, 2])
    many = hi - lo
    at, key = [], []
    # so many pairs at a time, that memory stays small on long texts
    edges = np.flatnonzero(np.diff(np.r_[-1, np.cumsum(many) // PAIRS]))
    for first, stop in zip(edges, [*edges[1:], len(a)], strict=True):
        n, left = many[first:stop], a[first:stop]
        i = np.repeat(np.arange(len(n)), n)
        j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - lo[first:stop], n)
        x, y = left[i], b[j]
        ok = (y[:, 0] <= x[:, 1]) & (x[:, 1] < y[:, 2]) & (np.minimum(x[:, 2], y[:, 2]) - np.maximum(x[:, 0], y[:, 0]) >= least)
        at.append(x[ok, 1])
        key.append(mix(mix(va[at[-1]] + np.uint64(band)) + vb[y[ok, 1]]))
    return np.concatenate(at), np.concatenate(key)


def placed_keys(block: list[bytes]) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block, its shingles' documents and hashes, and the place (shingle) and key of each pair of windows."""
    b = Block(block, lower=True)
    doc, _, h = b.shingles(SHINGLE, whole_if_short=False)
    lo, hi = np.searchsorted(doc, np.arange(b.n), "left"), np.searchsorted(doc, np.arange(b.n), "right")
    at, key = [], []
    for k in range(0, HASHES, 2):
        va, vb = mix(h ^ SEEDS[k]), mix(h ^ SEEDS[k + 1])
        got = band_keys(compact_windows(va, lo, hi), compact_windows(vb, lo, hi), va, vb, k)
        at.append(got[0])
        key.append(got[1])
    return b, doc, h, np.concatenate(at), np.concatenate(key)


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, c): c is a fingerprint of the sequence of words; docs without null ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for x in batches:
            for first, block in blocks(x.text):
                b = Block(block, lower=True)
                c = np.zeros(b.n, np.uint64)
                np.add.at(c, b.doc, mix(b.h ^ mix((np.arange(len(b.h)) - b.word_start[b.doc]).astype(np.uint64))))
                yield pd.DataFrame({"doc_id": x.doc_id.to_numpy()[first : first + b.n], "n_words": b.word_end - b.word_start, "c": c.view(np.int64)})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_words long, c long")


def _tokens(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return b.shingles(SHINGLE, whole_if_short=False)


def in_documents(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of ``HASH_BITS`` bits, in order, and in how many documents of a block each one is."""
    low = np.uint64(64 - HASH_BITS)
    if not len(doc) or doc[-1] >> int(low):
        return np.unique(distinct(doc, key)[1], return_counts=True)
    # both in one number, as a plain sort is several times faster
    both = np.sort(key << low | doc.astype(np.uint64))
    key = both[np.r_[True, both[1:] != both[:-1]]] >> low
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.diff(np.r_[first, len(key)])


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, each value's number among them, the places in order of value and where each number begins there (and the end)."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    number = np.empty(len(values), np.int64)
    number[order] = np.cumsum(new) - 1
    edge = np.append(np.flatnonzero(new), len(values))
    return ordered[edge[:-1]], number, order, edge


def stretches(parts: DataFrame, total: int) -> DataFrame:
    """(sid, doc_id: as text, start, text): parts of texts, by words, that may hold a similar passage; parts is a written table of blocks."""
    # ten bits more than the corpus has shingles: about one in a thousand is taken for another's
    size = min(HASH_BITS, max(LEAST_BITS, int(total).bit_length() + 10))
    shift, bits = np.uint64(64 - size), max(LEAST_BUCKETS, total // BUCKET_SHINGLES).bit_length()

    def send(batches):
        for x in batches:
            for r in x.itertuples(index=False):
                doc, _, h = _tokens(Block(unpacked(r.sizes, r.blob), lower=True))
                key, n = in_documents(doc, h >> shift)
                edge = np.searchsorted(key, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(size - bits))
                full = np.flatnonzero(np.diff(edge))
                rows = [(int(i), r.block, press(np.diff(key[edge[i] : edge[i + 1]], prepend=np.uint64(0)).view(np.int64)), np.packbits(n[edge[i] : edge[i + 1]] > 1).tobytes()) for i in full]
                yield pd.DataFrame(rows, columns=["bucket", "block", "hashes", "several"])

    def count(x: pd.DataFrame) -> pd.DataFrame:
        own = [np.cumsum(unpress(v).view(np.uint64)) for v in x.hashes]
        several = np.concatenate([np.unpackbits(np.frombuffer(v, np.uint8), count=len(k)) for v, k in zip(x.several, own, strict=True)]).view(bool)
        both = np.concatenate(own)
        order = np.argsort(both, kind="stable")  # the parts are in order, so this merges them
        both = both[order]
        first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        many = np.diff(np.r_[first, len(both)])
        met = np.empty(len(both), bool)
        met[order] = np.repeat(np.logical_or.reduceat(several[order], first) | (many > 1), many)
        edge = np.cumsum([0, *map(len, own)])
        return pd.DataFrame({"bucket": x.bucket, "block": x.block, "many": np.diff(edge), "met": [np.packbits(met[i:j]).tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)]})

    def cut(texts: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = {name: pd.Series([], dtype=object) for name in ("sid", "doc_id", "start", "text")}
        if len(texts) and len(told):
            ids, sizes, blob, block = texts[["ids", "sizes", "blob", "block"]].iloc[0]
            b = Block(unpacked(sizes, blob), lower=True)
            raw = b.buf.tobytes()
            doc, first, h = _tokens(b)
            told = told.sort_values("bucket")
            met = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(told.met, told.many, strict=True)])
            met = met[numbered(h >> shift)[1]]
            total = np.r_[0, np.cumsum(met, dtype=np.int64)]
            m = max(0, len(h) - LEAST + 1)
            begin = np.flatnonzero((total[LEAST : LEAST + m] - total[:m] >= DENSE * LEAST) & (doc[:m] == doc[LEAST - 1 : LEAST - 1 + m]))
            if len(begin):
                out = {"doc_id": [], "start": [], "text": []}
                apart = np.flatnonzero((np.diff(begin) > LEAST + GAP) | (doc[begin[1:]] != doc[begin[:-1]])) + 1
                low, high = begin[np.r_[0, apart]], begin[np.r_[apart, len(begin)] - 1] + LEAST
                out["sid"] = mix(mix(np.array([block], np.int64).view(np.uint64)) + np.arange(len(low), dtype=np.uint64)).view(np.int64)
                for i, j in zip(low, high, strict=True):
                    w, z = first[i], first[j - 1] + SHINGLE - 1
                    out["doc_id"].append(ids[doc[i]])
                    out["start"].append(int(w - b.word_start[doc[i]]))
                    out["text"].append(raw[b.start[w] : b.end[z]].decode("utf-8", "surrogatepass"))
        return pd.DataFrame(out)

    told = parts.select("block", "sizes", "blob").mapInPandas(send, "bucket int, block long, hashes binary, several binary")
    told = told.groupBy("bucket").applyInPandas(count, "bucket int, block long, many int, met binary")
    return parts.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(cut, "sid long, doc_id string, start long, text string")


def keys(pieces: DataFrame) -> DataFrame:
    """(key, sid, doc_id, at): distinct keys of each stretch and the tokens where they are."""
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for x in batches:
            for first, block in blocks(x.text, 1 << 18):
                _, doc, _, at, key = placed_keys(block)
                at, key = distinct(at, key)
                d = doc[at] + first
                if len(d):
                    begin = np.searchsorted(doc, doc[at])
                    yield pd.DataFrame({"key": key.view(np.int64), "sid": x.sid.to_numpy()[d], "doc_id": x.doc_id.to_numpy()[d], "at": at - begin})

    return pieces.select("sid", "doc_id", "text").mapInPandas(run, f"key long, sid long, doc_id {kind}, at long")


@dataclass
class Sequence:
    """Tokens with runs of one token cut to ``LEAST``; where each kept token starts and ends in the whole (the last of a cut run ends with it).

    Also the distinct tokens, each token's number among them, and the places of each distinct token.
    """

    tokens: np.ndarray

    def __post_init__(self):
        whole = self.tokens
        # a run is longer than LEAST if tokens so far apart are equal and all between them, too
        if len(whole) > LEAST and (whole[LEAST:] == whole[:-LEAST]).any():
            first = np.flatnonzero(np.r_[True, whole[1:] != whole[:-1]])
            size = np.diff(np.r_[first, len(whole)])
            inside = np.arange(len(whole)) - np.repeat(first, size)
            self.start = np.flatnonzero(inside < LEAST)
            self.end = self.start + 1
            self.end[inside[self.start] == LEAST - 1] = (first + size)[size >= LEAST]
            self.tokens = whole[self.start]
        else:
            self.start = np.arange(len(whole))
            self.end = self.start + 1
        self.kinds, self.code, self.order, self.edge = numbered(self.tokens)

    def __len__(self):
        return len(self.tokens)


def diagonals(one: Sequence, two: Sequence, least: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(start in one, start in two, length) of all longest runs of ``least`` equal tokens or more, ordered by the first; and the number in two of each distinct token of one, -1 without."""
    at = np.minimum(np.searchsorted(two.kinds, one.kinds), max(0, len(two.kinds) - 1))
    met = np.where(two.kinds[at] == one.kinds, at, -1)
    s, r, known = one.tokens, two.tokens, met[one.code]
    # so many matches at a time, that memory holds no more than the runs
    low, many = two.edge[known], np.where(known >= 0, two.edge[known + 1] - two.edge[known], 0)
    s, r, wide = np.append(s, np.uint64(1)), np.append(r, np.uint64(2)), len(s) + 1  # what is before and after differs
    first, last = [], []
    edges = np.flatnonzero(np.diff(np.r_[-1, np.cumsum(many) // PAIRS]))
    for lo, hi in zip(edges, [*edges[1:], len(many)], strict=True):
        n = many[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        j = two.order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n - low[lo:hi], n)]
        # by diagonal, then place
        both = (j - i + wide) * wide + i
        first.append(both[s[i - 1] != r[j - 1]])
        last.append(both[s[i + 1] != r[j + 1]])
    # on a diagonal the k-th start belongs to the k-th end
    first, last = (np.sort(np.concatenate(x)) for x in (first, last))
    long = last - first + 1 >= least
    first, size = first[long], (last - first + 1)[long]
    i = first % wide
    j = first // wide - wide + i
    order = np.argsort(i * (len(r) + 1) + j)
    return np.stack([i, j, size], 1)[order], met


def chains(runs: np.ndarray, most: int = GAP) -> list[list[int]]:
    """Runs that follow each other in both sequences within ``most`` tokens, as lists of row numbers; each run is in one, the heaviest it has."""
    low = np.searchsorted(np.maximum.accumulate(runs[:, 0] + runs[:, 2]), runs[:, 0] - most).tolist()  # the runs before end too early
    i, j, n = runs.T.tolist()
    weight, before, used = list(n), [-1] * len(n), [False] * len(n)
    for k, (a, b, c) in enumerate(zip(i, j, n, strict=True)):
        best, end_a, end_b = c, a + c, b + c
        for m in range(low[k], k):
            x, y = i[m] + n[m], j[m] + n[m]
            if x < end_a and y < end_b and j[m] < b and a - x <= most and -most <= b - y <= most:
                gain = weight[m] + min(c, end_a - x, end_b - y)
                if gain > best:
                    best, before[k] = gain, m
        weight[k] = best
    out = []
    for k in sorted(range(len(n)), key=lambda k: -weight[k]):
        chain = []
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append(k)
            k = before[k]
        if chain:
            out.append(chain[::-1])
    return out


def align(s: np.ndarray | Sequence, r: np.ndarray | Sequence, words: int = WORDS, similar: float = SIMILAR) -> list[tuple[int, int, int, int, float]]:
    """Passages (start, end, start, end, similarity) in words of two shingle sequences.

    Every place of a shared shingle counts, by its run of ``RUN`` at least; one word again and again counts as ``LEAST``
    shingles. A passage is given if it covers ``GAP`` words at least, of either text, that no passage of more shingles covers.
    """
    s, r = (x if isinstance(x, Sequence) else Sequence(x) for x in (s, r))
    if not len(s) or not len(r):
        return []
    runs, met = diagonals(s, r)
    if not len(runs):
        return []
    out, seen, seen_rep = [], np.zeros(len(s), bool), np.zeros(len(r), bool)
    # a chain is cut where its gap is widest until it is similar
    x, y, n = runs.T.tolist()
    for chain in chains(runs):
        open_chains = [chain]
        while open_chains:
            rows = open_chains.pop()
            head, last = rows[0], rows[-1]
            i, j, p, q = x[head], x[last] + n[last], y[head], y[last] + n[last]
            if min(j - i, q - p) + SHINGLE - 1 < words or max(j - i - np.count_nonzero(seen[i:j]), q - p - np.count_nonzero(seen_rep[p:q])) < GAP:
                continue
            in_one, in_two = np.zeros(len(s.kinds), bool), np.zeros(len(r.kinds), bool)
            in_one[s.code[i:j]], in_two[r.code[p:q]] = True, True
            both = met[in_one]
            both = np.count_nonzero(in_two[both[both >= 0]])
            score = both / (np.count_nonzero(in_one) + np.count_nonzero(in_two) - both)
            if score >= similar:
                seen[i:j] = seen_rep[p:q] = True
                out.append((int(s.start[i]), int(s.end[j - 1]) + SHINGLE - 1, int(r.start[p]), int(r.end[q - 1]) + SHINGLE - 1, float(score)))
            elif len(rows) > 1:
                gap = [max(x[k] - x[m], y[k] - y[m]) - n[m] for m, k in pairwise(rows)]
                at = gap.index(max(gap)) + 1
                open_chains += [rows[:at], rows[at:]]
    return sorted(out)


def verify(pairs: DataFrame, pieces: DataFrame) -> DataFrame:
    """(sid, rep, start, end, rep_start, rep_end, similarity) of the passages of candidate pairs (sid, rep), in words of the stretches."""
    texts = pieces.select("sid", "text")
    rows = pairs.join(texts, "sid").join(texts.select(F.col("sid").alias("rep"), F.col("text").alias("rep_text")), "rep")

    def sequences(values):
        out = []
        for _, block in blocks(values):
            b = Block(block, lower=True)
            doc, _, h = _tokens(b)
            out += np.split(h, np.searchsorted(doc, np.arange(1, b.n)))
        return out

    def run(batches):
        for x in batches:
            for i in range(0, len(x), 256):
                part = x.iloc[i : i + 256]
                back, _ = pd.factorize(part["rep"])
                reps = [Sequence(h) for h in sequences(part.drop_duplicates("rep").rep_text)]
                found = [(d, r, *p) for d, r, s, k in zip(part.sid, part.rep, sequences(part.text), back, strict=True) for p in align(s, reps[k])]
                yield pd.DataFrame(found, columns=["sid", "rep", "start", "end", "rep_start", "rep_end", "similarity"])

    return rows.mapInPandas(run, "sid long, rep long, start long, end long, rep_start long, rep_end long, similarity double")


def surroundings(rest: DataFrame, pieces: DataFrame) -> DataFrame:
    """(sid, doc_id, at, kinds, near, before, keys) of the places of keys.

    near: the tokens less than ``LEAST`` before and after the place (32-bit hashes), kinds: the number of different ones,
    before: of those before the place. keys: of any ``SHARED`` tokens in a row there one run of ``PART`` tokens at least, told by its hash and the place's own token.
    """
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for x in batches:
            for first, block in blocks(x.text, 1 << 18):
                b = Block(block, lower=True)
                doc, _, h = _tokens(b)
                edge = np.searchsorted(doc, np.arange(b.n + 1))
                short, least = (h >> np.uint64(32)).astype(np.uint32).view(np.int32), least_runs(h)
                rows = []
                for d in range(b.n):
                    for at in x.places.iloc[first + d]:
                        lo, hi = max(edge[d], edge[d] + at - LEAST + 1), min(edge[d + 1], edge[d] + at + LEAST)
                        near, keys = short[lo:hi], mix(np.unique(least[lo : hi - SHARED + 1]) + mix(h[edge[d] + at : edge[d] + at + 1]))
                        rows.append((x.sid.iloc[first + d], x.doc_id.iloc[first + d], at, len(np.unique(near)), near, edge[d] + at - lo, keys.view(np.int64)))
                if rows:
                    yield pd.DataFrame(rows, columns=["sid", "doc_id", "at", "kinds", "near", "before", "keys"])

    places = rest.groupBy("sid").agg(F.collect_set("at").alias("places"))  # no more than its tokens
    return places.join(pieces.select("sid", "doc_id", "text"), "sid").mapInPandas(run, f"sid long, doc_id {kind}, at long, kinds int, near array<int>, before int, keys array<long>")


def least_runs(h: np.ndarray) -> np.ndarray:
    """The smallest hash of the runs of ``PART`` tokens in each ``SHARED`` tokens in a row."""
    m = max(0, len(h) - PART + 1)
    acc = np.zeros(m, np.uint64)
    for k in range(PART):
        acc = mix(acc + h[k : k + m] + np.uint64(k + 1))
    wide = SHARED - PART + 1
    return np.lib.stride_tricks.sliding_window_view(acc, wide).min(1) if m >= wide else acc[:0]


def together(rows: DataFrame) -> DataFrame:
    """Rows of keys that two documents have at least."""
    shared = rows.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("many")).where("low < high")
    return saved(rows.join(shared.select("key", "many"), "key"), "groups")


def apart(rows: DataFrame) -> DataFrame:
    """Rows of keys that two documents and two labels have at least; of keys with the same places one, as the comparisons are the same."""
    marks = [F.bit_xor(F.xxhash64("sid", "at")).alias("x"), F.bit_xor(F.xxhash64("at", "sid")).alias("y")]
    ends = [f(c).alias(f"{n}_{c}") for c in ("doc_id", "label") for n, f in (("low", F.min), ("high", F.max))]
    shared = rows.groupBy("key").agg(F.count("*").alias("many"), *ends, *marks).where("low_doc_id < high_doc_id and low_label < high_label")
    return saved(rows.join(shared.groupBy("x", "y", "many").agg(F.min("key").alias("key")).select("key", "many"), "key"), "groups")


def needed(kinds) -> object:
    """Tokens that two places with so many different ones near (the fewer of the two) must share; of a text that repeats itself, few differ."""
    return F.floor(SIMILAR * F.least(kinds, F.lit(LEAST)))


def parted(near: DataFrame) -> DataFrame:
    """Places grouped by their token and one near it, rare ones first, as far as places that share ``needed`` tokens must share one.

    So a short passage that many texts hold leaves no large group, and no two places that are to be compared part.
    """
    rows = near.select("sid", "doc_id", "at", "anchor", "kinds", F.explode("near").alias("token"))
    often = rows.groupBy("anchor", "token").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("df"), F.min("kinds").alias("fewest")).where("low < high")
    rows = rows.join(often.select("anchor", "token", "df", "fewest"), ["anchor", "token"])
    # tokens of one document alone come first in the order and need no row
    own = rows.groupBy("sid", "doc_id", "at", "anchor").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"), F.min("fewest").alias("fewest"))
    own = own.withColumn("first", F.slice("tokens", F.lit(1), F.greatest(F.lit(0), F.size("tokens") - needed("fewest").cast("int") + 1)))
    return own.select("sid", "doc_id", "at", "anchor", F.explode("first.token").alias("token")).select(F.xxhash64("anchor", "token").alias("key"), "sid", "doc_id", "at")


def shared_around(one: list[np.ndarray], at: np.ndarray, two: list[np.ndarray]) -> np.ndarray:
    """For each pair of token sequences, if some ``LEAST`` tokens of one with its place ``at`` are as similar to two as a passage of that length.

    Of these tokens, or of the different ones among them, two must have ``SIMILAR``. Two substituted words cost ten
    tokens, so what is told here is told of passages with no more than two near the place.
    """
    size, other = np.array([len(x) for x in one]), np.array([len(x) for x in two])
    pair, token = np.repeat(np.arange(len(one)), size), np.concatenate(one).view(np.uint32)
    key = pair.astype(np.uint64) << np.uint64(32) | token
    theirs = np.sort(np.repeat(np.arange(len(two)), other).astype(np.uint64) << np.uint64(32) | np.concatenate(two).view(np.uint32))
    k = np.minimum(np.searchsorted(theirs, key), len(theirs) - 1)
    met = theirs[k] == key
    # the first places of windows of LEAST tokens inside one that hold its place
    end = np.cumsum(size)
    low, high = end - size + np.maximum(0, at - LEAST + 1), np.minimum(end - LEAST, end - size + at) + 1
    many = np.maximum(0, high - low)
    begin = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many - low, many)
    # a token that was there less than LEAST before counts once
    order = np.lexsort((np.arange(len(key)), key))
    again = np.zeros(len(key), np.int64)
    again[order[1:]] = np.where(key[order[1:]] == key[order[:-1]], order[:-1] + 1, 0)
    total = np.r_[0, np.cumsum(met)]
    ok = total[begin + LEAST] - total[begin] >= int(SIMILAR * LEAST)
    out = np.zeros(len(one), bool)
    out[pair[begin[ok]]] = True
    # of texts that repeat themselves, by different tokens
    for i in np.flatnonzero(~out & (np.bincount(pair, again > 0, minlength=len(one)) > 0)):
        for b in range(low[i], high[i]):
            new = again[b : b + LEAST] <= b
            if np.count_nonzero(met[b : b + LEAST] & new) >= int(SIMILAR * np.count_nonzero(new)):
                out[i] = True
                break
    return out


def alike(pairs: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose places are in as many tokens, each of the other's, as a passage has."""

    def run(batches):
        for x in batches:
            for i in range(0, len(x), 4096):
                y = x.iloc[i : i + 4096]
                y = y[shared_around(list(y.near), y.before.to_numpy(), list(y.rep_near))]
                if len(y):
                    y = y[shared_around(list(y.rep_near), y.rep_before.to_numpy(), list(y.near))]
                yield y[["a", "b"]].drop_duplicates()

    return pairs.select("a", "b", "near", "before", "rep_near", "rep_before").mapInPandas(run, "a long, b long")


def linked(labels: DataFrame, found: DataFrame) -> DataFrame:
    """(sid, at, label) with the largest label of all that a passage covers, on either side; places of one label are linked by passages."""
    found = found.withColumn("passage", F.xxhash64("sid", "rep", "start", "end", "rep_start", "rep_end"))
    sides = found.select("passage", "sid", "start", "end").union(found.select("passage", "rep", "rep_start", "rep_end"))
    hit = labels.join(sides, "sid").where((F.col("at") >= F.col("start")) & (F.col("at") <= F.col("end") - SHINGLE)).select("passage", "label").distinct()
    top = hit.groupBy("passage").agg(F.max("label").alias("top"))
    to = saved(hit.join(top, "passage").where("label < top").groupBy("label").agg(F.max("top").alias("top")), "larger")
    for _ in range(2):  # what it leads to leads further
        to = to.alias("x").join(to.toDF("y", "further").alias("y"), F.col("top") == F.col("y"), "left").select("label", F.coalesce("further", "top").alias("top"))
    return saved(labels.join(to, "label", "left").select("sid", "at", F.coalesce("top", "label").alias("label")), "labels")


def piece_passages(pieces: DataFrame) -> DataFrame | None:
    """Passages between stretches, as ``verify`` gives them; None if there are none to compare."""
    rest = together(saved(keys(pieces), "windows"))
    if rest.isEmpty():
        return None
    company = saved(rest.groupBy("sid").agg(F.sum("many").alias("company")), "company")
    rank = rest.join(company, "sid").select("key", F.struct("company", "sid", "doc_id", "at").alias("rank"))
    rep = rank.groupBy("key").agg(F.max("rank").alias("top"))
    rep = rep.select("key", F.col("top.sid").alias("rep"), F.col("top.doc_id").alias("rep_doc"))
    met = saved(rest.select("key", "sid", "doc_id", "at").join(rep, "key"), "met")
    tried = saved(met.where("doc_id <> rep_doc").select(F.greatest("sid", "rep").alias("sid"), F.least("sid", "rep").alias("rep")).distinct(), "fresh")
    found = new = saved(verify(tried, pieces), "passages")
    # a place in a passage with the representative of its group is done with; so is the representative, which has met all
    spans = new.select("sid", "rep", "start", "end").union(new.select("rep", "sid", "rep_start", "rep_end")).toDF("s", "r", "start", "end")
    inside = (F.col("sid") == F.col("s")) & (F.col("rep") == F.col("r")) & (F.col("at") >= F.col("start")) & (F.col("at") <= F.col("end") - SHINGLE)
    left = saved(met.where("sid <> rep").join(spans, inside, "left_anti").select("key", "sid", "doc_id", "at"), "left")
    near = saved(surroundings(together(left), pieces), "surroundings")
    own = near.select("sid", "at").join(company, "sid").select("sid", "at", F.struct("company", F.xxhash64("sid", "at").alias("place")).alias("label"))
    labels = linked(linked(own, new), new)
    rest = near.select("sid", "doc_id", "at", F.explode("keys").alias("key")).join(company, "sid")
    rest = apart(rest.join(labels, ["sid", "at"]))
    turn = 0
    while not rest.isEmpty():
        salt = F.pmod(F.xxhash64("sid", "at"), F.lit(32 ** min(turn, 6))).alias("salt")
        rep = rest.groupBy("key", salt).agg(F.max(F.struct("company", "sid", "at", "doc_id", "label")).alias("top"))
        rep = saved(rep.select("key", F.col("top.sid").alias("rep"), F.col("top.at").alias("rep_at"), F.col("top.doc_id").alias("rep_doc"), F.col("top.label").alias("rep_label")), "representatives")
        pairs = rest.join(rep, (rest.key == rep.key) & (F.col("label") != F.col("rep_label")) & (F.col("doc_id") != F.col("rep_doc")))
        pairs = pairs.select("sid", "at", "rep", "rep_at", F.greatest("sid", "rep").alias("a"), F.least("sid", "rep").alias("b")).distinct()
        pairs = pairs.join(tried.select(F.col("sid").alias("a"), F.col("rep").alias("b")), ["a", "b"], "left_anti")
        other = near.select(F.col("sid").alias("rep"), F.col("at").alias("rep_at"), F.col("kinds").alias("rep_kinds"), F.col("near").alias("rep_near"), F.col("before").alias("rep_before"))
        pairs = pairs.join(near.select("sid", "at", "kinds", "near", "before"), ["sid", "at"]).join(other, ["rep", "rep_at"])
        pairs = pairs.where(F.size(F.array_intersect("near", "rep_near")) >= needed(F.least("kinds", "rep_kinds")))
        fresh = saved(alike(pairs).distinct().toDF("sid", "rep"), "fresh")
        new = saved(verify(fresh, pieces), "passages")
        tried, found = tried.union(fresh), found.union(new)
        labels = linked(labels, new)
        # places that passages link with a representative of their group are done with; so is the representative
        done = rep.join(labels.toDF("rep", "rep_at", "label"), ["rep", "rep_at"]).select("key", "label").distinct()
        rest = apart(rest.drop("label", "many").join(labels, ["sid", "at"]).join(done, ["key", "label"], "left_anti"))
        if not turn:  # what is left in large groups often has no more in common than a line, and parts by other tokens
            large = near.withColumn("anchor", F.col("near")[F.col("before")]).withColumn("near", F.array_distinct("near"))
            large = parted(large.join(rest.where(F.col("many") > LARGE).select("sid", "at").distinct(), ["sid", "at"]))
            large = large.join(company, "sid").join(labels, ["sid", "at"]).select("key", "sid", "doc_id", "at", "company", "label")
            rest = apart(rest.where(F.col("many") <= LARGE).select(large.columns).union(large))
        turn += 1
    return found


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, other_id, other_start, other_end, similarity), offsets in words; both directions of a pair."""
    kind = docs.schema["doc_id"].dataType
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    base = saved(describe(docs), "described").where(F.col("n_words") >= WORDS)
    classes = base.groupBy("c").agg(F.min("doc_id").alias("rep"))
    member = saved(base.join(classes, "c").distinct(), "members")
    copies = member.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("rep")).alias("is_rep")).where("not is_rep").select("doc_id")
    whole = member.where("doc_id <> rep").select(
        "doc_id", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"), F.col("rep").alias("other_id"), F.lit(0).cast("long").alias("other_start"),
        F.col("n_words").alias("other_end"), F.lit(1.0).alias("similarity"),
    )
    parts = saved(packed(without(docs, copies)), "blocks")
    total = base.agg(F.sum("n_words")).first()[0] or 0
    pieces = saved(stretches(parts, total).withColumn("doc_id", F.col("doc_id").cast(kind)), "stretches")
    found = piece_passages(pieces)
    if found is not None:
        place = pieces.select("sid", "doc_id", F.col("start").alias("base"))
        found = found.join(place, "sid").join(place.select(F.col("sid").alias("rep"), F.col("doc_id").alias("other_id"), F.col("base").alias("other_base")), "rep")
        whole = whole.union(found.select(
            "doc_id", F.col("start") + F.col("base"), F.col("end") + F.col("base"), "other_id",
            F.col("rep_start") + F.col("other_base"), F.col("rep_end") + F.col("other_base"), "similarity",
        ))
    return whole.union(whole.select("other_id", "other_start", "other_end", "doc_id", "start", "end", "similarity"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))
