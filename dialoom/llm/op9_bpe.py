"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

Pre-tokens of whole texts are found with vectorised character classes. A partition's texts are cut into
blocks of bounded size; each block sends every distinct pre-token once, packed by hash bucket. A bucket
gathers its words from all blocks and merges each distinct word once by the rank table; buckets grow in
number with the blocks, so a bucket holds no more words than ``BLOCKS_A_BUCKET`` blocks bring. The ids are
joined back to their blocks, where texts (sent there once, compressed) are reassembled by position. Decoding
joins ids with the broadcast token-byte table. A hot word costs one entry a block, not one an occurrence.

Rows that meet are grouped by block, bounded by ``block_chars``. A text longer than a block is a block of
its own. The input must be re-readable in the same order (a table scan): both branches derive block numbers
from partition and position; if they differ, the job fails and gives no wrong ids.

Defined cases: a null or empty text has no ids; a very long text is encoded whole, as one block; repeated
rows and null ids are encoded one by one; an empty table gives an empty result; columns that are not asked
for are ignored; lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import table
from .words import mix, powers, with_long

#: Characters of a block; blocks whose words meet in one bucket; the least number of buckets.
BLOCK_CHARS, BLOCKS_A_BUCKET, LEAST_BUCKETS = 4 << 20, 32, 64
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other, as the pattern's properties say."""
    import regex

    text = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\x00" for c in range(0x110000))
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            out[m.start() : m.end()] = kind
    return out


#: The contractions of the pre-token pattern.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def split(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a text and the start of each pre-token.

    Equal to the matches of the public pattern: contractions; an optional space before a run of letters,
    numbers or other marks; white space but its last character when something follows.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if not n:
        return points, np.zeros(0, np.int64)
    kind = classes()[points]
    begin = np.r_[True, kind[1:] != kind[:-1]]
    space = kind == _SPACE
    follows = np.r_[~space[1:], False]  # something other than white space comes next
    last = space & follows
    begin |= last  # the last white space before a word stands apart ...
    glue = np.flatnonzero(last & (points == 32)) + 1
    begin[glue] = False  # ... or, as a plain space, joins the word
    quote = np.flatnonzero((points == 39) & begin)
    if len(quote):
        padded = np.r_[points, 0, 0]
        a, b = padded[quote + 1], padded[quote + 2]
        for c in CONTRACTIONS:
            size = len(c)
            hit = (a == ord(c[1])) & ((b == ord(c[2])) if size == 3 else True)
            at = quote[hit]
            begin[at + 1] = False
            if size == 3:
                begin[at + 2] = False
            rest = at[at + size < n] + size
            # what follows starts anew; a space there is left as the rules above have it
            begin[rest] = True
    return points, np.flatnonzero(begin)


class Words:
    """Distinct pre-tokens of some texts in the order (bucket, hash), and each text's sequence of them."""

    def __init__(self, texts: list[str], buckets: int, sequence: bool):
        self.texts, hashes, where, self.sizes = texts, [], [], []
        for i, text in enumerate(texts):
            points, start = split(text)
            if len(start):
                power, inverse = powers(len(points))
                prefix = np.zeros(len(points) + 1, np.uint64)
                np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[: len(points)], out=prefix[1:])
                end = np.r_[start[1:], len(points)]
                hashes.append(with_long(mix((prefix[end] - prefix[start]) * inverse[start]), points, start, end))
                if not sequence:
                    where.append(np.stack([np.full(len(start), i), start, end], 1).astype(np.int32))
            self.sizes.append(len(start))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        del hashes
        if sequence:
            own, index = np.unique(h, return_inverse=True)
        else:
            own, first = np.unique(h, return_index=True)
        bucket = ((own >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        self.bucket = bucket[order]
        if sequence:
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            self.index = place[index]
        else:
            self.where = np.concatenate(where)[first[order]] if where else np.zeros((0, 3), np.int32)

    def by_bucket(self):
        """(bucket, words)."""
        edge = np.flatnonzero(np.r_[True, self.bucket[1:] != self.bucket[:-1], True]) if len(self.bucket) else []
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            yield int(self.bucket[lo]), [self.texts[i][s:e].encode("utf-8", "surrogatepass") for i, s, e in self.where[lo:hi]]


def _pack(parts: list[bytes]) -> bytes:
    sizes = np.array([len(p) for p in parts], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(len(parts).to_bytes(4, "little") + sizes + b"".join(parts))


def _unpack(blob: bytes) -> tuple[np.ndarray, bytes]:
    """(sizes, joined parts)."""
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    return np.frombuffer(raw, "<u4", n, 4).astype(np.int64), raw[4 + 4 * n :]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: join the adjacent pair of lowest rank, leftmost first, until none is known.

    A heap of pairs over a linked list, so that a word of n bytes takes n log n steps.
    """
    if word in ranks:
        return [ranks[word]]
    import heapq

    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else n
        if j >= n or parts[i] is None or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j] = both, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(both + parts[after[i]])) is not None:
                heapq.heappush(heap, (r, i, both + parts[after[i]]))
        if (k := before[i]) >= 0 and (r := ranks.get(parts[k] + both)) is not None:
            heapq.heappush(heap, (r, k, parts[k] + both))
    return [ranks[p] for p in parts if p is not None]


def _numbered(batches, column: str, limit: int):
    """(block number, batch part): blocks of about ``limit`` characters of one partition, in its order.

    Batches may be cut anywhere; a block ends at the row that fills it.
    """
    block, size = TaskContext.get().partitionId() << 32, 0
    for x in batches:
        lengths = x[column].map(lambda t: len(t) if isinstance(t, str) else 0).to_numpy(np.int64)
        at = 0
        while at < len(x):
            total = size + np.cumsum(lengths[at:])
            stop = at + int(np.searchsorted(total, limit)) + 1
            yield block, x.iloc[at:stop]
            if stop > len(x):
                size = int(total[-1])
                break
            block, size, at = block + 1, 0, stop


def _bytes_by_id(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table as (bytes, start, size), indexed by id."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for b, i in ranks.items():
        table[i] = b
    size = np.array([len(b) for b in table], np.int64)
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(size) - size, size


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs [start, start + size) of flat, one after the other."""
    return flat[np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)]


def _from_blocks(docs: DataFrame, ranks: dict[bytes, int], block_chars: int, keep: list[str], fields: list[T.StructField], finish) -> DataFrame:
    """``keep`` columns and what ``finish`` (ids of some texts to columns) gives of every document."""
    spark = docs.sparkSession
    # ids pass pandas as text: beside a null, pandas would make floating point of them
    base = docs.select(*(F.col(f"`{k}`").cast("string").alias(k) for k in keep), "text")
    held = spark.sparkContext.broadcast(ranks)  # a vocabulary file: fixed size
    # buckets grow with the blocks, so that a bucket's words are those of BLOCKS_A_BUCKET blocks
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, int(chars) // block_chars // BLOCKS_A_BUCKET)
    width = np.uint16 if len(ranks) <= 1 << 16 else np.uint32

    def words(batches):
        def out(block, texts):
            got = [(bucket, block, _pack(words)) for bucket, words in Words(texts, buckets, False).by_bucket()]
            return pd.DataFrame(got, columns=["bucket", "block", "blob"])

        now, got = None, []
        for block, x in _numbered(batches, "text", block_chars):
            if now is not None and block != now:
                yield out(now, got)
                got = []
            now = block
            got += [t for t in x.text if isinstance(t, str)]
        if got:
            yield out(now, got)

    def encoded(x: pd.DataFrame) -> pd.DataFrame:
        known: dict[bytes, bytes] = {}
        blobs = []
        for blob in x.blob:
            sizes, raw = _unpack(blob)
            ids, at = [], 0
            for end in np.cumsum(sizes).tolist():
                w = raw[at:end]
                at = end
                if (b := known.get(w)) is None:
                    b = known[w] = np.array(merge(w, held.value), width).tobytes()
                ids.append(b)
            blobs.append(_pack(ids))
        return pd.DataFrame({"block": x.block, "bucket": x.bucket, "blob": blobs})

    def packed(batches):
        press = zstandard.ZstdCompressor(level=6)
        for block, x in _numbered(batches, "text", block_chars):
            whole = [t if isinstance(t, str) else "" for t in x.text]
            for i in range(0, len(x), 128):  # groups of texts compress better than single ones
                raw = [t.encode("utf-8", "surrogatepass") for t in whole[i : i + 128]]
                rest = x.iloc[i : i + 128][keep].astype(object)
                rows = [[None if pd.isna(v) else v for v in r] for r in rest.itertuples(index=False)]
                yield pd.DataFrame({"block": [block], "rows": [rows], "sizes": [[len(r) for r in raw]], "blob": [press.compress(b"".join(raw))]})

    by_word = base.select("text").mapInPandas(words, "bucket int, block long, blob binary")
    # equal words of all blocks meet in their bucket, so that each distinct word is merged once
    by_word = by_word.groupBy("bucket").applyInPandas(encoded, "block long, bucket int, blob binary")
    by_block = base.mapInPandas(packed, "block long, rows array<array<string>>, sizes array<int>, blob binary")

    def assemble(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        rows, part = [], []
        unpress = zstandard.ZstdDecompressor()
        for r in texts.itertuples(index=False):
            total, cut = int(sum(r.sizes)), 0
            raw = unpress.decompress(r.blob, max_output_size=total) if total else b""
            for s in r.sizes:
                part.append(raw[cut : cut + s].decode("utf-8", "surrogatepass"))
                cut += s
            rows += [list(x) for x in r.rows]
        w = Words(part, buckets, True)
        got = [_unpack(b) for b in known.sort_values("bucket").blob]
        sizes = np.concatenate([g[0] for g in got]) // width().itemsize if got else np.zeros(0, np.int64)
        if len(sizes) != len(w.bucket):
            raise ValueError("words of a block came back without ids: the input was not read alike twice")
        flat = np.frombuffer(b"".join(g[1] for g in got), width)
        begin, out, cut = np.cumsum(sizes) - sizes, [], 0
        for n in w.sizes:
            k = w.index[cut : cut + n]
            cut += n
            out.append(_gather(flat, begin[k], sizes[k]).astype(np.int32))
        return pd.DataFrame(rows, columns=keep).assign(**finish(out))

    row = [T.StructField(k, T.StringType()) for k in keep]
    out = by_block.groupBy("block").cogroup(by_word.groupBy("block")).applyInPandas(assemble, T.StructType([*row, *fields]))
    return out.withColumns({k: F.col(f"`{k}`").cast(docs.schema[k].dataType) for k in keep})


def encode(docs: DataFrame, ranks: dict[bytes, int], block_chars: int = BLOCK_CHARS, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id (and ``extra`` columns of plain types), ids array<int> of every document."""
    return _from_blocks(docs, ranks, block_chars, ["doc_id", *extra], [T.StructField("ids", T.ArrayType(T.IntegerType()))], lambda ids: {"ids": ids})


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The input with decoded (binary): the ids joined with the broadcast token-byte table, in their order."""
    held = encoded.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("binary")
    def joined(ids: pd.Series) -> pd.Series:
        flat, start, size = _bytes_by_id(held.value)
        return ids.map(lambda k: _gather(flat, start[k], size[k]).tobytes(), na_action="ignore")

    return encoded.withColumn("decoded", joined("ids"))


def digest(docs: DataFrame, ranks: dict[bytes, int], block_chars: int = BLOCK_CHARS, extra: tuple[str, ...] = (), ids: bool = False) -> DataFrame:
    """doc_id, ``extra`` columns, n_tokens, ids_sha256 and decoded_sha256 (and ids): digests are made in the task that joins a block."""
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def finish(all_ids):
        flat, start, size = _bytes_by_id(held.value)
        out = {
            "n_tokens": [len(k) for k in all_ids],
            "ids_sha256": [hashlib.sha256(k.astype("<u4").tobytes()).hexdigest() for k in all_ids],
            "decoded_sha256": [hashlib.sha256(_gather(flat, start[k], size[k]).tobytes()).hexdigest() for k in all_ids],
        }
        return out | ({"ids": all_ids} if ids else {})

    return _from_blocks(docs, ranks, block_chars, ["doc_id", *extra], fields, finish)


def vocabulary() -> dict[bytes, int]:
    import public_tokenizers

    return load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), vocabulary())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as training input: doc_id, lang, source, n_tokens, ids, and the digests of ids and of their decoded bytes.

    A null text has no ids; repeated rows and null ids are encoded one by one; other columns of docs are left out.
    """
    return digest(docs, vocabulary(), extra=("lang", "source"), ids=True)
