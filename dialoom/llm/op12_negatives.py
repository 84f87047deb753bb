"""Hard-negative mining by exact integer inner products: Four-Russians tables of the anchors, bit planes of the rows.

Every row is a candidate for every anchor. A row's components are kept as bit planes in two's complement, eight
components a byte. An anchor has a table for each group of eight of its components: the sum of every subset, 256 of them.
The part of a score that plane b of a group adds is one look-up of the plane's byte; planes are added by doubling, the
sign plane first and negative. A look-up fetches the sums of all anchors of a block at once.

Anchors are a stated query set that grows with the table. They go to the tasks in blocks, some blocks at a time; what is
broadcast at once has at most ``BROADCAST`` bytes of components. Each task keeps the best rows of an anchor that it has
met, so an anchor gets a few rows a task.

Cases: rows without id, label or vector, or with a null or non-finite component, take no part; an empty vector has score 0
with all. A vector that is shorter than another counts as having zeros there. Repeated rows are rows of their own: a
repeated negative is returned as often as its rank allows, a repeated anchor has its results twice. An anchor's own id is
never its positive, nor a negative. Components past a long are cut to it, scores past a long are told as the nearest long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import saved, table

#: Candidates a block; bytes of a block's tables; bytes of anchor components that are broadcast at once.
BLOCK, TABLES, BROADCAST = 8192, 16 << 20, 32 << 20
SUBSETS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64).T  # component j, subset


def quantised(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, vector: array<long>) of rows (vec_id, label, embedding) that take part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).where(~bad).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), whole.alias("vector"))


def matrix(vectors) -> np.ndarray:
    """Vectors as rows of whole groups of eight components, zeros where one is short."""
    d = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), max(8, -(-d // 8) * 8)), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def planes(m: np.ndarray) -> np.ndarray:
    """(plane, row, group): bytes of the bit planes in two's complement, the sign plane last."""
    bits = 1 + max(int(m.max(initial=0)).bit_length(), (-1 - int(m.min(initial=0))).bit_length())
    return np.stack([np.packbits(((m >> b) & 1).astype(np.uint8), axis=1) for b in range(bits)])


def tables(anchors: np.ndarray, exact: bool) -> np.ndarray:
    """(group, subset, anchor): sums of the anchors' components over each subset of a group of eight."""
    a = anchors.reshape(len(anchors), -1, 8)
    kind = np.int64 if exact else object
    return np.ascontiguousarray(np.einsum("agj,js->gsa", a, SUBSETS) if exact else np.stack([np.dot(a[:, g].astype(kind), SUBSETS.astype(kind)).T for g in range(a.shape[1])]))


def scores(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """(row, anchor): inner products by look-ups, the planes added by doubling from the sign plane down."""
    out = None
    for b in range(len(p) - 1, -1, -1):
        plane = sum(t[g][p[b, :, g]] for g in range(min(p.shape[2], len(t))))
        out = -plane if out is None else out * 2 + plane
    return out


def fits(p: np.ndarray, anchors: np.ndarray) -> bool:
    """Scores of these planes and anchors, times 100, stay inside a long."""
    top = max(int(anchors.max(initial=0)), -int(anchors.min(initial=0)))
    return anchors.shape[1] * top * (1 << len(p)) * 100 < 1 << 62


def blocks(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """Candidates in blocks: ids and labels in the order of ids, and their bit planes."""

    def pack(x: pd.DataFrame) -> dict:
        x = x.sort_values("vec_id", kind="stable")
        p = planes(matrix(list(x.vector)))
        return {"n": len(x), "bits": len(p), "groups": p.shape[2], "ids": x.vec_id.to_numpy(np.int64).tobytes(), "labels": x.label.to_numpy(np.int64).tobytes(), "planes": p.tobytes()}

    def run(batches):
        held, n = [], 0
        for x in batches:
            held, n = [*held, x], n + len(x)
            if n >= size:
                x = pd.concat(held)
                yield pd.DataFrame([pack(x[i : i + size]) for i in range(0, n - n % size, size)])
                held, n = [x[n - n % size :]], n % size
        if n:
            yield pd.DataFrame([pack(pd.concat(held))])

    return vectors.mapInPandas(run, "n long, bits long, groups long, ids binary, labels binary, planes binary")


def best(found: pd.DataFrame, by: list[str], k: int) -> pd.DataFrame:
    """The first k rows of each group: higher scores first, ties by smaller id."""
    return found.sort_values(["score", "vec_id"], ascending=[False, True], kind="stable").groupby(by, sort=False).head(k)


def met(candidates: DataFrame, anchors: DataFrame, pick, by: list[str], k: int) -> DataFrame:
    """(by..., vec_id, score): the first k of what ``pick`` takes from the scores of each block, over all blocks.

    anchors: (anchor, anchor_id, label, vector, ...), written before. pick(ids, labels, block of anchors, score(rows, anchors))
    gives (by..., vec_id, score) of one block of candidates.
    """
    spark = anchors.sparkSession
    size = anchors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    width = 8 * max(1, -(-(size.d or 0) // 8))
    each = int(max(1, min(256, TABLES // (256 * width))))  # anchors a block
    n = -(-size.n // each) or 1
    chunks = -(-size.n * width * 8 // BROADCAST) or 1
    dealt = anchors.withColumn("_b", F.pmod(F.xxhash64("anchor"), F.lit(n)))
    packed = saved(dealt.groupBy("_b").agg(F.collect_list(F.struct(*anchors.columns)).alias("row")), "anchors")
    schema = ", ".join(f"{c} long" for c in [*by, "vec_id", "score"])

    def run(batches):
        held, count = [], 0
        for x in batches:
            for r in x.itertuples(index=False):
                a = pd.DataFrame(list(r.row))
                p = np.frombuffer(r.planes, np.uint8).reshape(int(r.bits), int(r.n), int(r.groups))
                m = matrix(list(a.vector))
                exact = fits(p, m)
                t = tables(m, exact)

                def score(rows, of, p=p, t=t):
                    own = np.ascontiguousarray(t[:, :, of])
                    return np.concatenate([scores(p[:, rows[i : i + 512]], own) for i in range(0, len(rows), 512)])

                got = pick(np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int64), a, score)
                held, count = [*held, got], count + len(got)
                if count > 500_000:
                    held = [best(pd.concat(held), by, k)]
                    count = len(held[0]) // 2
        if held:
            out = best(pd.concat(held), by, k)
            if out.score.dtype == object:
                out = out.assign(score=[max(min(int(s), (1 << 63) - 1), -(1 << 63)) for s in out.score])
            yield out.astype("int64")

    def part(i: int) -> DataFrame:
        some = packed.where(F.pmod("_b", F.lit(chunks)) == i).select("row")
        return candidates.crossJoin(F.broadcast(some)).mapInPandas(run, schema)

    out = part(0)
    for i in range(1, chunks):
        out = out.union(part(i))
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def frame(by: list[str], parts: list[tuple]) -> pd.DataFrame:
    """Rows (by..., vec_id, score) of tuples of arrays or numbers."""
    names = [*by, "vec_id", "score"]
    made = [pd.DataFrame(dict(zip(names, x, strict=True))) for x in parts if len(x[-1])]
    return pd.concat(made) if made else pd.DataFrame({c: np.zeros(0, np.int64) for c in names})


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vectors, anchors: (vec_id, label, vector of whole numbers). Negatives of a positive: rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    candidates = saved(blocks(vectors), "vectors")
    first = saved(anchors.select(F.monotonically_increasing_id().alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "vector"), "anchors")

    def same_label(ids, labels, a, score):
        out = []
        for label in a.label.unique():
            rows, of = np.flatnonzero(labels == label), np.flatnonzero(a.label == label)
            if len(rows):
                s = score(rows, of)
                for j, i in enumerate(of):
                    mine = np.flatnonzero(ids[rows] != a.anchor_id.iat[i])
                    top = mine[np.argsort(-s[mine, j], kind="stable")[:positives]]
                    out.append((a.anchor.iat[i], ids[rows[top]], s[top, j]))
        return frame(["anchor"], out)

    found = met(candidates, first, same_label, ["anchor"], positives)
    found = found.select("anchor", F.struct("rank", F.col("vec_id").alias("id"), "score").alias("p"))
    second = saved(first.join(found.groupBy("anchor").agg(F.array_sort(F.collect_list("p")).alias("positive")), "anchor"), "anchors")

    def other_labels(ids, labels, a, score):
        s, out = score(np.arange(len(ids)), np.arange(len(a))), []
        for j in range(len(a)):
            known = [(int(p["rank"]), int(p["score"])) for p in a.positive.iat[j]]
            own = s[:, j]
            near = (labels != a.label.iat[j]) & (ids != a.anchor_id.iat[j]) & (100 * own <= high * max(p for _, p in known)) & (100 * own >= min(low * p for _, p in known))
            rows = np.flatnonzero(near)
            rows = rows[np.argsort(-own[rows], kind="stable")]
            for k, p in known:
                fit = np.flatnonzero((100 * own[rows] <= high * p) & (100 * own[rows] >= low * p))[:negatives]
                out.append((a.anchor.iat[j], k, ids[rows[fit]], own[rows[fit]]))
        return frame(["anchor", "nth"], out)

    out = met(candidates, second, other_labels, ["anchor", "nth"], negatives)
    known = second.select("anchor", "anchor_id", F.explode("positive").alias("p")).select("anchor", "anchor_id", F.col("p.rank").cast("long").alias("nth"), F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return out.join(known, ["anchor", "nth"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(vectors: DataFrame) -> DataFrame:
    """Every seventh id with the next of ten labels: the planted wrong labels of the query."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label")))


def query(spark, sf_dir: str) -> DataFrame:
    vectors = relabelled(quantised(table(spark, sf_dir, "embeddings")))
    return hard_negatives(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE_SQL = """with v as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as vector
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.r, a.vec_id as anchor_id, a.label = b.label as same, b.vec_id as id, cast(list_sum(list_transform(list_zip(a.vector, b.vector), lambda z: z[1] * z[2])) as bigint) as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), p as (
  select *, row_number() over (partition by r order by score desc, id) as nth from s where same qualify nth <= 5
), n as (
  select p.anchor_id, p.id as positive_id, s.id as negative_id, p.score as positive_score, s.score as negative_score, row_number() over (partition by p.r, p.nth order by s.score desc, s.id) as rank
  from p join s on s.r = p.r and not s.same and 100 * s.score between 80 * p.score and 100 * p.score
)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 5"""
