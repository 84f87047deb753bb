"""Small helpers on Spark sessions: shared folder, reads, written tables, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import blocks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set (tests, local mode)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def press(values: np.ndarray) -> bytes:
    """64-bit values, compressed by byte planes."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<i8", copy=False)).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpress(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but those of ids (doc_id); a fixed number of hash buckets (2**20 rows at most) spares most texts the shuffle."""
    name = unused(docs, "slot")[0]
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias(name)
    sift = F.broadcast(ids.select(slot).distinct())
    docs = docs.withColumn(name, slot)
    clear = docs.join(sift, name, "left_anti")
    return clear.union(docs.join(sift, name, "left_semi").join(ids, "doc_id", "left_anti").select([f"`{c}`" for c in clear.columns])).drop(name)


def packed(docs: DataFrame, limit: int = 1 << 21) -> DataFrame:
    """(block, ids: as text, sizes, blob): the documents in compressed blocks of about ``limit`` bytes."""

    def run(batches):
        packer, k = zstandard.ZstdCompressor(), TaskContext.get().partitionId() << 32
        for x in batches:
            ids = [None if pd.isna(i) else i for i in x.doc_id]
            for first, block in blocks(x.text, limit):
                yield pd.DataFrame({"block": [k], "ids": [ids[first : first + len(block)]], "sizes": [[len(t) for t in block]], "blob": [packer.compress(b"".join(block))]})
                k += 1

    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, "block long, ids array<string>, sizes array<int>, blob binary")


def unpacked(sizes, blob: bytes) -> list[bytes]:
    total = int(sum(sizes))
    raw = zstandard.decompress(blob, max_output_size=total) if total else b""
    end = np.cumsum(sizes)
    return [raw[e - s : e] for s, e in zip(sizes, end, strict=True)]


def no_letters(text: str = "text"):
    return ~F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}")


def crc_fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 4: fold 2 is held out of all training."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: (id, component_id = smallest id reached).

    Alternating large-star and small-star rounds; each is a shuffle on the node, is written to the
    shared folder, and the loop ends when a round changes nothing. Only ids move, and no more than two
    rows an edge, so a component that holds a third of all documents costs what its edges cost. An
    empty edge list gives an empty result; self-loops and repeated edges are ignored.
    """
    cur = saved(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    mark = None
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        # small-star: every node points its smaller neighbours and itself to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        nxt = saved(
            pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).distinct(),
            "edges",
        )
        new = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        cur = nxt
        if tuple(new) == mark:
            break
        mark = tuple(new)
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(
        cur.select(F.col("v").alias("id"), F.col("v").alias("component_id"))
    ).distinct()
