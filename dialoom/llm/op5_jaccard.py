"""N-gram Jaccard join in metric space: pivots, Voronoi regions, triangle-inequality windows, exact recursion.

Documents are sets of hashed word shingles under the Jaccard distance; two link within the radius r = 1 - t. Equal sets
are one class from the start. On natural text nearly all distances are 1, so most documents can have no link at all:
one must find t of its shingles in other classes. A shuffle of packed shingle hashes counts that for each document
without any pair; the rest, mostly families of near copies, enter the metric join.

Each round of the join takes pivots (of a group of documents that share a rare shingle of their prefixes, the one of
most company). All distances of at most 2r to a pivot are computed. A document within r of a pivot belongs to the
Voronoi region of its nearest one; by the triangle inequality all that it links with lies within 2r of that pivot, so
documents in this window are replicated into the region. Documents without a pivot within r go on, among themselves,
to the next round, with new pivots, if they have t of their shingles in common with each other, until none are left.

In a region every document is its symmetric difference from the centre (the pivot, moved to what most of the region
holds). Where two differences together are small enough for a link by the triangle inequality, links are counted by a
running sum over sizes and no pair is formed; other pairs are met on common elements of their differences, whose number
gives the exact distance. A document probes in its own region only, so each link is counted once for each side.

No group is gathered in one task: rows are ids, hashes and single sets. Results are exact up to collisions of 64-bit hashes.

Defined cases: null or word-less texts have no shingles, link with nothing and are their own component; a text with
fewer words than a shingle is one shingle; very long texts are sets like others; null ids are dropped from links but
returned; repeated ids count as one node, with all their sets; an empty table gives an empty result; extra columns are
ignored. The similarity must be over 1/2.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import components, press, saved, table, unpress, without
from .words import Block, blocks, distinct, mix

#: Bits of a shingle's hash that are counted, and shingles a bucket of the count.
HASH_BITS, BUCKET_SHINGLES, LEAST_BUCKETS = 48, 2_000_000, 64


def _fingerprints(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    f1, f2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    np.add.at(f1, doc, mix(h + np.uint64(1)))
    np.add.at(f2, doc, mix(h ^ np.uint64(0xA5A5A5A5)))
    return mix(f1 ^ mix(f2)).view(np.int64), f2.view(np.int64)


def describe(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, c, f2 (fingerprints of the set)."""

    def run(batches):
        for x in batches:
            for first, block in blocks(x.text):
                b = Block(block, lower=True)
                doc, h = distinct(*b.shingles(shingle)[::2])
                c, f2 = _fingerprints(doc, h, b.n)
                ids = x.doc_id.iloc[first : first + b.n]
                yield pd.DataFrame({"doc_id": ids.to_numpy(), "n_shingles": np.bincount(doc, minlength=b.n).astype(np.int64), "c": c, "f2": f2})

    # ids pass as text: beside a null, pandas would make floating point of them
    out = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, "doc_id string, n_shingles long, c long, f2 long")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def met_enough(single: DataFrame, total: int, shingle: int, num: int, den: int) -> DataFrame:
    """(doc_id) of the documents that have num/den of their shingles in common with others; single is a written table."""
    shift, bits = np.uint64(64 - HASH_BITS), max(LEAST_BUCKETS, total // BUCKET_SHINGLES).bit_length()
    kind = single.schema["doc_id"].dataType.simpleString()

    def send(batches):
        k = TaskContext.get().partitionId() << 32
        for x in batches:
            for first, block in blocks(x.text):
                b = Block(block, lower=True)
                doc, h = distinct(*b.shingles(shingle)[::2])
                order = np.argsort(h, kind="stable")
                h, doc = h[order] >> shift, doc[order]
                edge = np.searchsorted(h, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(HASH_BITS - bits))
                full = np.flatnonzero(np.diff(edge))
                if not len(full):
                    continue
                rows = [(int(i), k, b.n, press(np.diff(h[edge[i] : edge[i + 1]], prepend=np.uint64(0)).view(np.int64)), press(doc[edge[i] : edge[i + 1]])) for i in full]
                out = pd.DataFrame(rows, columns=["bucket", "block", "many", "hashes", "docs"])
                # one row of a block brings its ids and sizes
                out["ids"] = [x.doc_id.to_numpy()[first : first + b.n], *[None] * (len(out) - 1)]
                out["sizes"] = [np.bincount(doc, minlength=b.n), *[None] * (len(out) - 1)]
                yield out
                k += 1

    def count(x: pd.DataFrame) -> pd.DataFrame:
        own = [np.cumsum(unpress(v).view(np.uint64)) for v in x.hashes]
        _, back, n = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        met, edge = n[back] > 1, np.cumsum([0, *map(len, own)])
        got = [press(np.bincount(unpress(d)[met[i:j]], minlength=m)) for d, m, i, j in zip(x.docs, x.many, edge[:-1], edge[1:], strict=True)]
        return pd.DataFrame({"block": x.block, "ids": x.ids, "sizes": x.sizes, "met": got})

    def choose(x: pd.DataFrame) -> pd.DataFrame:
        met = sum(unpress(m) for m in x.met)
        head = x[x.ids.notna()]
        size = np.asarray(head["sizes"].iloc[0])
        return pd.DataFrame({"doc_id": np.asarray(head["ids"].iloc[0])[(size > 0) & (met * den >= size * num)]})

    sent = single.select("doc_id", "text").mapInPandas(send, f"bucket int, block long, many int, hashes binary, docs binary, ids array<{kind}>, sizes array<long>")
    told = sent.groupBy("bucket").applyInPandas(count, f"block long, ids array<{kind}>, sizes array<long>, met binary")
    return told.groupBy("block").applyInPandas(choose, f"doc_id {kind}")


def as_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(c, n, items): the sets of the documents, once each."""

    def run(batches):
        for x in batches:
            for _, block in blocks(x.text):
                b = Block(block, lower=True)
                doc, h = distinct(*b.shingles(shingle)[::2])
                c, _ = _fingerprints(doc, h, b.n)
                items = np.split(h.view(np.int64), np.searchsorted(doc, np.arange(1, b.n)))
                out = pd.DataFrame({"c": c, "n": [len(i) for i in items], "items": items})
                yield out[out.n > 0]

    return docs.select("text").mapInPandas(run, "c long, n long, items array<long>").dropDuplicates(["c"])


def prefixes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(h, c, n, pos, short): shingles of a set that others share, rare ones first, as far as a set within 2r must share one; short: within r."""
    rows = sets.select("c", "n", F.explode("items").alias("h"))
    often = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    rows = rows.join(often, "h")
    of = Window.partitionBy("c")
    # shingles of no one else come first in the order and need no row
    pos = F.col("n") - F.count("*").over(of) + F.row_number().over(of.orderBy("df", "h")) - 1
    reach = lambda p, q: F.col("pos") <= F.col("n") - F.ceil(F.col("n") * p / F.lit(q) - 1e-9)
    return rows.withColumn("pos", pos).where(reach(2 * num - den, den)).select("h", "c", "n", F.col("pos").cast("long").alias("pos"), reach(num, den).alias("short"))


def still_met(active: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of the rows of ``prefixes``, those of documents that have num/den of their shingles in common with others of these documents."""
    left = sets.join(active.select("c").distinct(), "c", "left_semi").select("c", "n", F.explode("items").alias("h"))
    often = left.groupBy("h").agg(F.count("*").alias("df")).where("df > 1").select("h")
    enough = left.join(often, "h").groupBy("c", "n").agg(F.count("*").alias("met")).where(F.col("met") * den >= F.col("n") * num)
    return active.join(enough.select("c"), "c", "left_semi")


def pivots(active: DataFrame, turn: int) -> DataFrame:
    """(c) of new pivots among the rows of ``prefixes``; empty if no two documents share a short prefix's shingle."""
    short = active.where("short").select("h", "c")
    group = short.groupBy("h").agg(F.count("*").alias("many")).where("many > 1")
    short = short.join(group, "h")
    short = short.join(short.groupBy("c").agg(F.sum("many").alias("company")), "c")
    rank = F.struct("company", "c")
    if not turn:  # the leaders of all their groups
        top = short.groupBy("h").agg(F.max(rank).alias("top"))
        return short.join(top, "h").groupBy("c").agg(F.min(F.col("top.c") == F.col("c")).alias("first")).where("first").select("c")
    # then the leaders of all groups, and after each round sixteen times as many of each
    salt = F.pmod(F.xxhash64("c"), F.lit(16 ** min(turn - 1, 7)))
    return short.groupBy("h", salt.alias("salt")).agg(F.max(rank).alias("top")).select(F.col("top.c").alias("c")).distinct()


def regions(active: DataFrame, pivot: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(p, x, n, gap, near, distance, delta) of all documents within 2r of a pivot."""
    wide = 2 * num - den
    a = active.select("h", F.col("c").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"))
    b = active.join(pivot, "c").select("h", F.col("c").alias("p"), F.col("n").alias("np"), F.col("pos").alias("pp"))
    fits = (
        (F.col("nx") * den >= F.col("np") * wide) & (F.col("np") * den >= F.col("nx") * wide)
        # what is left of both prefixes must suffice for the overlap
        & ((1 + F.least(F.col("nx") - F.col("px"), F.col("np") - F.col("pp")) - 1) * 2 * num >= wide * (F.col("nx") + F.col("np")))
    )
    pair = a.join(b, "h").where(fits).select("x", "p").distinct()
    sides = pair.join(sets.select(F.col("c").alias("x"), F.col("items").alias("xs")), "x").join(sets.select(F.col("c").alias("p"), F.col("items").alias("ps")), "p")

    def run(batches):
        for t in batches:
            out = []
            for p, x, xs, ps in zip(t["p"], t["x"], t["xs"], t["ps"], strict=True):
                delta = np.setxor1d(xs, ps, assume_unique=True)
                both = (len(xs) + len(ps) - len(delta)) // 2
                union = both + len(delta)
                if both * den >= union * wide:
                    out.append((p, x, len(xs), len(delta), both * den >= union * num, len(delta) / union, delta))
            yield pd.DataFrame(out, columns=["p", "x", "n", "gap", "near", "distance", "delta"])

    return sides.select("p", "x", "xs", "ps").mapInPandas(run, "p long, x long, n long, gap long, near boolean, distance double, delta array<long>")


def centred(cell: DataFrame) -> DataFrame:
    """cell with differences from a centre: the pivot, but for elements in which most of its own documents differ from it."""
    own = cell.where("kind = 'home'").select("p", "x", "delta")
    many = own.groupBy("p").agg(F.count("*").alias("members"))
    common = own.select("p", F.explode("delta").alias("e")).groupBy("p", "e").agg(F.count("*").alias("k")).where("k > 1").join(many, "p").where("2 * k > members")
    moved = common.groupBy("p").agg(F.sort_array(F.collect_list("e")).alias("moved"))  # no more than two texts have
    new = F.array_union(F.array_except("delta", "moved"), F.array_except("moved", "delta"))
    cell = cell.join(moved, "p", "left").withColumn("delta", F.when(F.col("moved").isNull(), F.col("delta")).otherwise(new)).drop("moved")
    return cell.withColumn("gap", F.size("delta").cast("long"))


def region_links(cell: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Links of a saved cell table (p, x, w: copies, kind, near, v, delta): (a, b) that connect all linked, and (c, links) numbers.

    v is what a set's size allows less what its difference takes: two sets whose v add up to 0 at least are linked.
    """
    home, outer = F.col("kind") == "home", F.col("kind") == "outer"
    # numbers of sure links: how much weight has v of at least -v, by a running sum over the values of a region
    value = cell.groupBy("p", "v").agg(F.sum("w").alias("all"), F.sum(F.when(home, F.col("w")).otherwise(0)).alias("own"))
    ask = cell.where("kind <> 'other'").select("p", "v").distinct()
    zero = F.lit(0).cast("long")
    line = value.select("p", F.col("v").alias("key"), F.lit(0).alias("late"), "all", "own", F.lit(None).cast("long").alias("v")).union(
        ask.select("p", (-F.col("v")).alias("key"), F.lit(1), zero, zero, "v")
    )
    upto = Window.partitionBy("p").orderBy(F.desc("key"), "late").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = line.withColumns({"sure": F.sum("all").over(upto), "sure_own": F.sum("own").over(upto)}).where("v is not null").select("p", "v", "sure", "sure_own")
    itself = F.when(F.col("v") >= 0, F.col("w")).otherwise(0)
    sure = cell.where("kind <> 'other'").select("p", "x", "w", "kind", "v").join(sums, ["p", "v"]).select(
        F.col("x").alias("c"), F.when(home, F.col("sure") - itself).otherwise(F.col("sure_own")).alias("links")
    )
    best = cell.where(home).groupBy("p").agg(F.max(F.struct("v", "x")).alias("top"), F.min("v").alias("low_own"))
    ends = cell.groupBy("p").agg(F.min("v").alias("low"))
    chain = cell.where("near and p <> x").select(F.col("x").alias("a"), F.col("p").alias("b")).union(
        cell.where("kind <> 'home'").join(best, "p").where("v + top.v >= 0").select("x", "top.x")
    )
    # the others meet on common elements of their differences; only where a region has a pair that isn't sure
    left = cell.where(home).join(ends, "p").where("v + low < 0").select("p", F.explode("delta").alias("e"), F.col("x").alias("a"), F.col("v").alias("va"), F.col("w").alias("wa"))
    right = cell.join(best, "p").where("v + low_own < 0").select("p", F.explode("delta").alias("e"), F.col("x").alias("b"), F.col("v").alias("vb"), F.col("w").alias("wb"), "kind")
    found = (
        left.join(right, ["p", "e"]).where("va + vb < 0 and (kind <> 'home' or a < b)").groupBy("p", "a", "b", "va", "vb", "wa", "wb", "kind").agg(F.count("*").alias("both"))
        .where(-(F.col("va") + F.col("vb")) <= 2 * (den + num) * F.col("both"))
    )
    found = saved(found.select("a", "b", "wa", "wb", "kind"), "met")
    numbers = sure.union(found.select("a", "wb")).union(found.where("kind <> 'other'").select("b", "wa"))
    return chain.union(found.select("a", "b")), numbers.groupBy("c").agg(F.sum("links").alias("links"))


def class_links(sets: DataFrame, weight: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) that connect all linked sets, and (c, links): the weight of the sets each one is linked with."""
    spark = sets.sparkSession
    edges, numbers = [], []
    active, turn = saved(prefixes(sets, num, den), "prefixes"), 0
    while True:
        pivot = saved(pivots(active, turn), "pivots")
        if pivot.isEmpty():
            break
        cell = saved(regions(active, pivot, sets, num, den), "regions")
        home = saved(cell.where("near").groupBy("x").agg(F.min(F.struct("distance", "p")).alias("at")).select("x", F.col("at.p").alias("home")), "homes")
        kind = F.when(F.col("home").isNull(), "outer").when(F.col("home") == F.col("p"), "home").otherwise("other")
        full = cell.groupBy("p").agg(F.count("*").alias("many")).where("many > 1").select("p")
        cell = cell.join(full, "p").join(home, "x", "left").withColumn("kind", kind).join(weight, F.col("x") == F.col("c"))
        v = F.col("n") * (den - num) - F.col("gap") * (den + num)
        cell = saved(centred(cell.select("p", "x", "n", "w", "kind", "near", "delta")).select("p", "x", "w", "kind", "near", v.alias("v"), "delta"), "cells")
        chain, many = region_links(cell, num, den)
        edges.append(saved(chain, "edges"))
        numbers.append(saved(many, "numbers"))
        active = saved(active.join(home.select(F.col("x").alias("c")), "c", "left_anti"), "active")
        active = saved(still_met(active, sets, num, den), "active")
        turn += 1
    if not edges:
        return spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "c long, links long")
    for more in edges[1:]:
        edges[0] = edges[0].union(more)
    for more in numbers[1:]:
        numbers[0] = numbers[0].union(more)
    return edges[0], numbers[0].groupBy("c").agg(F.sum("links").alias("links"))


def join(docs: DataFrame, shingle: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reached by links), n_links (other documents that it is linked with)."""
    base = saved(describe(docs, shingle), "shingles")
    nodes = base.where("doc_id is not null and n_shingles > 0").select("doc_id", "c", "f2", "n_shingles").distinct()
    classes = saved(nodes.groupBy("c").agg(F.min("doc_id").alias("rep"), F.count("*").alias("w"), F.first("n_shingles").alias("n")), "classes")
    member = saved(nodes.select("doc_id", "c").join(classes.select("c", "rep", "w"), "c"), "members")
    copies = member.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("rep")).alias("is_rep")).where("not is_rep").select("doc_id")
    single = saved(without(docs.where("doc_id is not null").select("doc_id", "text"), copies), "single")
    total = classes.agg(F.sum("n")).first()[0] or 0
    alive = saved(met_enough(single, total, shingle, num, den), "alive")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("slot")
    near = single.withColumn("slot", slot).join(F.broadcast(alive.select(slot).distinct()), "slot", "left_semi").drop("slot")
    sets = saved(as_sets(near.join(alive, "doc_id", "left_semi"), shingle), "sets")
    edges, numbers = class_links(sets, classes.select("c", "w"), num, den)
    rep = classes.select("c", "rep")
    linked = edges.join(rep.select(F.col("c").alias("a"), F.col("rep").alias("u")), "a").join(rep.select(F.col("c").alias("b"), F.col("rep").alias("v")), "b").select("u", "v")
    same = member.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    found = components(same.union(linked), "u", "v")
    # a repeated id has the links of all its sets
    links = member.join(numbers, "c", "left").groupBy("doc_id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    out = base.select("doc_id", "n_shingles").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").join(links, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), shingle=3, num=90, den=100)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of smallest id.

    Of repeated ids all rows of that id stay or go; rows with a null id or without words stay; an empty table stays
    empty; the columns of docs, whatever their names, are kept.
    """
    gone = join(docs.select("doc_id", "text")).where("component_id <> doc_id").select("doc_id")
    return without(docs, saved(gone.distinct(), "gone")).select([f"`{c}`" for c in docs.columns])
