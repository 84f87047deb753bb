"""Source divergence audit: how far the sources of a language are apart in their words, and by which words.

Terms are counted by sorting pointers. A task takes the Arrow buffer of its texts as it is, finds where terms start, and
sorts the pointers by the bytes they point at: eight bytes at a time, each slice splitting the runs of equal terms so far,
and only runs with a longer term go on to the next slice. What is equal after the last slice is one term. In a run the
pointers lie by document, so its length is the term's count and its distinct documents are its document frequency.

Spark adds the runs of all tasks, keeps the terms of enough documents, and turns counts into smoothed shares of
1,000,000,000 by exact decimal division. Distances of sources are sums over terms: they are taken over buckets of terms,
and tiles of sources where a language has many, and then added.

Cases: null text, lang or source counts as ''; a group without terms keeps its row in part ``pair`` (value 0 for a language
without kept terms) and has none in part ``term``; a repeated row counts again; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import saved, table

#: Smoothing of a count, the whole that shares add up to (about), ranks of part ``term``; rows a bucket and sources a tile.
SMOOTH, WHOLE, TOP, ROWS, TILE = 5, 1_000_000_000, 50, 50_000, 400
#: Bytes of texts whose pointers are sorted at once (one text at least).
SHARD = 16 << 20
#: Bytes of terms: ASCII letters and everything beyond ASCII.
TERM = np.zeros(256, bool)
TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True


def pointers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the terms; none reaches over the end of its text. offsets: the texts' limits in data."""
    on = np.zeros(len(data) + 2, bool)
    on[1:-1] = TERM[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(on[1:] & (~on[:-1] | cut))
    ends = np.flatnonzero(on[:-1] & (~on[1:] | cut))
    return starts, ends - starts


def slices(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes of each pointer at a depth as one number, zeros past a term's end. data has eight bytes more."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(8 * depth, 8 * depth + 8):
        byte = data[np.minimum(starts + k, len(data) - 1)].astype(np.uint64)
        byte[lengths <= k] = 0
        out = (out << np.uint64(8)) | byte
    return out


def runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, run): pointers in the order of their terms, and the number of each one's run of equal terms."""
    key = slices(data, starts, lengths, 0)
    order = np.argsort(key)
    key = key[order]
    run = np.cumsum(np.r_[0, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    depth, open_ = 1, np.flatnonzero(lengths[order] > 8)
    while len(open_):
        longer = np.zeros(run[-1] + 1, bool)
        longer[run[open_]] = True
        at = np.flatnonzero(longer[run])  # whole runs, in their places
        own = order[at]
        key = slices(data, starts[own], lengths[own], depth)
        sub = np.lexsort((key, run[at]))
        order[at], key = own[sub], key[sub]
        fresh = np.zeros(len(order), bool)
        fresh[1:] = run[1:] != run[:-1]
        fresh[at[1:]] |= (key[1:] != key[:-1]) & (at[1:] == at[:-1] + 1)
        run, depth = np.cumsum(fresh), depth + 1
        open_ = np.flatnonzero(lengths[order] > 8 * depth)
    return order, run


def shard(text: pa.Array, group: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(terms, group, count, documents) of one Arrow array of texts without nulls; group: a number for each text."""
    wide = pa.types.is_large_string(text.type)
    offsets = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if text.buffers()[2] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    data = np.r_[raw, np.zeros(8, np.uint8)]
    data[(data >= 0x41) & (data <= 0x5A)] += 32
    starts, lengths = pointers(data[: len(raw)], offsets)
    if not len(starts):
        return [], *[np.zeros(0, np.int64)] * 3
    order, run = runs(data, starts, lengths)
    by_group = np.argsort(group, kind="stable")
    place = np.empty(len(group), np.int64)
    place[by_group] = np.arange(len(group))
    doc = place[np.searchsorted(offsets, starts[order], "right") - 1]
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    key = np.sort(run * len(group) + doc)  # in a run by group, then by document
    run, of = key // len(group), group[by_group][key % len(group)]
    new = np.r_[True, (run[1:] != run[:-1]) | (of[1:] != of[:-1])]
    heads = np.flatnonzero(new)
    counts = np.diff(np.r_[heads, len(key)])
    documents = np.add.reduceat(np.r_[True, key[1:] != key[:-1]].astype(np.int64), heads)
    body = data.tobytes()
    word = [body[s : s + n].decode() for s, n in zip(starts[order[first]].tolist(), lengths[order[first]].tolist(), strict=True)]
    return [word[r] for r in run[heads].tolist()], of[heads], counts, documents


def shards(batch: pa.RecordBatch):
    """Slices of a batch, of whole texts of about SHARD bytes together: what a task holds pointers of at once."""
    size = np.cumsum([0, *(len(t.as_buffer()) for t in batch.column("text"))])
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(size, size[at] + SHARD, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, documents) of docs (text, lang, source), added up over all tasks."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    def run(batches):
        for x in (part for batch in batches for part in shards(batch)):
            both = pd.MultiIndex.from_arrays([x.column("lang").to_pandas(), x.column("source").to_pandas()])
            group, names = pd.factorize(both, sort=False)
            terms, of, n, d = shard(x.column("text"), group.astype(np.int64))
            pick = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in names], pa.string()).take(pick), pa.array([k[1] for k in names], pa.string()).take(pick), pa.array(terms, pa.string()), pa.array(n), pa.array(d)],
                ["lang", "source", "term", "n", "documents"],
            )

    parts = docs.select(blank("text"), blank("lang"), blank("source")).mapInArrow(run, "lang string, source string, term string, n long, documents long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(WHOLE * (n + SMOOTH) / (total + SMOOTH * kept)), exactly."""
    d = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", d(F.lit(WHOLE)) * d(n + SMOOTH), d(total + SMOOTH * kept)) + 1


def distances(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, other, value): summed distances of the shares of each two sources of a language.

    rows: (lang, source, term, p), only terms that the source has; groups: (lang, source, p0, buckets, tiles), with the
    share p0 of a term that the source lacks.
    """
    tile = lambda: F.pmod(F.xxhash64("source"), F.col("tiles"))
    pairs = lambda: F.explode(F.transform(F.sequence(F.lit(0), (F.col("tiles") - 1).cast("int")), lambda u: F.struct(F.least(u, F.col("tile")).alias("a"), F.greatest(u, F.col("tile")).alias("b"))))
    sides = groups.withColumn("tile", tile().cast("int")).withColumn("t", pairs())
    sides = sides.withColumn("bucket", F.explode(F.sequence(F.lit(0), (F.col("buckets") - 1).cast("int")))).select("lang", "bucket", "t.a", "t.b", "source", "tile", "p0")
    rows = rows.withColumn("tile", tile().cast("int")).withColumn("t", pairs()).select("lang", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"), "t.a", "t.b", "source", "term", "p")

    def run(key, x: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        lang, _, a, b = key
        s = s.sort_values("source").reset_index(drop=True)
        left, right = np.flatnonzero(s.tile == a), np.flatnonzero(s.tile == b)
        total = np.zeros((len(left), len(right)), np.int64)
        code, terms = pd.factorize(x.term)
        at = pd.Series(np.arange(len(s)), s.source).reindex(x.source).to_numpy()
        order = np.argsort(code, kind="stable")
        code, at, p = code[order], at[order].astype(np.int64), x.p.to_numpy(np.int64)[order]
        for lo in range(0, len(terms), 256):
            i, j = np.searchsorted(code, [lo, lo + 256])
            dense = np.repeat(s.p0.to_numpy(np.int64)[:, None], min(256, len(terms) - lo), axis=1)
            dense[at[i:j], code[i:j] - lo] = p[i:j]
            for k, r in enumerate(left):
                total[k] += np.abs(dense[right] - dense[r]).sum(axis=1)
        name = s.source.to_numpy(object)
        i, j = np.nonzero(left[:, None] < right[None, :] if a == b else np.ones(total.shape, bool))
        return pd.DataFrame({"lang": lang, "source": name[left[i]], "other": name[right[j]], "value": total[i, j]})

    keys = ["lang", "bucket", "a", "b"]
    half = rows.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInPandas(run, "lang string, source string, other string, value long")
    half = half.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "other"), F.struct(F.col("other").alias("source"), F.col("source").alias("other"))))
    return half.select("lang", both.alias("s"), "value").select("lang", "s.source", "s.other", "value")


def audit(docs: DataFrame, least_documents: int = 30, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources, and the terms that a source overuses.

    least_documents: documents of a language that a term needs.
    """
    counts = saved(counted(docs), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("documents").alias("d")).where(F.col("d") >= least_documents).drop("d")
    rows = saved(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all_n"), "kept")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    found = docs.select(blank("lang"), blank("source")).distinct()
    sums = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    groups = found.join(sums, ["lang", "source"], "left").na.fill(0)
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_total"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("rows").alias("rows"))
    langs = langs.join(vocabulary, "lang", "left").na.fill(0).select(
        "lang", "v", "lang_total", F.greatest(F.ceil(F.col("rows") / ROWS), F.lit(1)).alias("buckets"), F.greatest(F.ceil(F.col("sources") / TILE), F.lit(1)).alias("tiles"),
    )
    groups = saved(groups.drop("rows").join(langs, "lang"), "groups")
    rows = rows.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
    none = F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.greatest("v", F.lit(1)))).otherwise(0)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = distances(rows.select("lang", "source", "term", "p", "buckets", "tiles"), groups.select("lang", "source", none.alias("p0"), "buckets", "tiles"))
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value").withColumn("rank", F.row_number().over(order))
    over = F.col("p") - share(F.col("all_n"), F.col("lang_total"), F.col("v"))
    term = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), over.alias("value")).where("value > 0")
    term = term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pair.union(term)


def query(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_SHARE = "1 + (1000000000 :: hugeint * ({n} + 5)) // ({total} + 5 * v)"
ORACLE_SQL = f"""with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), w as (
  select r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d
), c as (
  select lang, source, term, count(*) as n, count(distinct r) as df from w group by all
), k as (
  select lang, term, sum(n) as all_n from c group by all having sum(df) >= 30
), l as (
  select lang, count(*) as v, sum(all_n) as lang_total from k group by all
), g as (
  select lang, source, (select coalesce(sum(n), 0) from c join k using (lang, term) where c.lang = d.lang and c.source = d.source) as total from d group by all
), p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, {_SHARE.format(n="coalesce(c.n, 0)", total="total")} as p, {_SHARE.format(n="all_n", total="lang_total")} as q
  from g join k using (lang) join l using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term
), pair as (
  select g.lang, g.source, 'pair' as part, h.source as item, coalesce(s.value, 0) as value from g join g as h on g.lang = h.lang and g.source <> h.source
  left join (select a.lang, a.source, b.source as other, sum(abs(a.p - b.p)) as value from p as a join p as b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all) s
    on s.lang = g.lang and s.source = g.source and s.other = h.source
), x as (
  select * from pair union all select lang, source, 'term', term, p - q from p where n > 0 and p > q
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from x) where part = 'pair' or rank <= 50"""
