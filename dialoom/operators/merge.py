"""Merging of consecutive messages (sessionization by gap, sender and talker) inside a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scan
from ..functions.text import count_of, within
from ..schema import IMAGE_MARK, NO_BREAK_AFTER


def mark_cuts(df: DataFrame, cut_types: list[str]) -> DataFrame:
    own_image = (F.coalesce("modality", F.lit("")) == "image") & (F.col("is_sender") == 1) if "modality" in df.columns else F.lit(False)
    return df.withColumn("is_cut", F.col("type_name").isin(cut_types) | own_image)


def groups(df: DataFrame, part: list[str], window_seconds: float, order: str = "ord") -> DataFrame:
    """Rows with their group's number gid; runs of cuts become one, leading cuts vanish. Rows with slices are scanned by them."""
    by = ["is_cut", "is_sender", "talker", "t"]
    if scan.SLICE in df.columns:
        df = scan.previous(df, part, order, by).withColumn("_prev", F.get("_prev", F.lit(0)))
    else:
        df = df.withColumn("_prev", F.lag(F.struct(*by)).over(Window.partitionBy(*part).orderBy(order)))
    prev = F.col("_prev")
    fresh = (
        F.col("is_cut") | prev.isNull() | prev["is_cut"] | (F.col("is_sender") != prev["is_sender"])
        | ~F.col("talker").eqNullSafe(prev["talker"]) | ~within(F.col("t"), prev["t"], window_seconds)
    ).cast("int")
    if scan.SLICE in df.columns:
        df = scan.running(df, part, order, {"gid": fresh})
    else:
        df = df.withColumn("gid", F.sum(fresh).over(Window.partitionBy(*part).orderBy(order)))
    return df.where(~F.col("is_cut") | (prev["is_cut"] == F.lit(False))).drop("_prev")


def joined(fragments: Column) -> Column:
    """Texts of an ordered array; a line break between, unless the text so far is empty or ends a clause."""
    stops = F.array(*[F.lit(c) for c in NO_BREAK_AFTER])
    return F.aggregate(
        F.filter(fragments, lambda x: x != ""), F.lit(""),
        lambda a, x: F.when((a == "") | F.array_contains(stops, F.right(a, F.lit(1))), F.concat(a, x)).otherwise(F.concat(a, F.lit("\n"), x)),
    )


def merge(df: DataFrame, part: list[str], window_seconds: float, max_length: int = 2048, order: str = "ord") -> DataFrame:
    """One row a group or kept cut: first row's fields, last time, merged text and images; in its first row's slice, if there are slices."""
    has_image = "modality" in df.columns
    modality = F.col("modality") if has_image else F.lit(None).cast("string")
    rows = groups(df.withColumn("modality", modality), part, window_seconds, order)
    ordered = F.array_sort(F.collect_list(F.struct(order, "msg", "src", "modality")))
    kept = [F.min(scan.SLICE).alias(scan.SLICE)] if scan.SLICE in df.columns else []
    out = rows.groupBy(*part, "gid").agg(
        *kept,
        F.min(order).alias(order), F.count("*").alias("n_rows"), F.first("is_cut").alias("is_cut"), F.first("is_sender").alias("is_sender"),
        F.first("talker").alias("talker"), F.min_by("type_name", order).alias("type_name"), F.min_by("t", order).alias("t_first"),
        F.max_by("t", order).alias("t"), ordered.alias("_rows"),
    )
    text = joined(F.transform("_rows", lambda r: r["msg"]))
    many = F.col("n_rows") > 1
    out = out.withColumn("msg", F.when(many, F.substring(text, 1, max_length)).otherwise(F.get("_rows", F.lit(0))["msg"]))
    shown = F.transform(F.filter("_rows", lambda r: r["modality"] == "image"), lambda r: r["src"])
    own = F.filter(F.transform("_rows", lambda r: r["src"]), lambda s: s != "")
    kept = count_of("msg", IMAGE_MARK)
    return out.withColumn("images", F.when(many, F.slice(shown, F.lit(1), kept)).otherwise(own)).drop("_rows")
