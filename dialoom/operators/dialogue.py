"""Pairing of questions and replies into dialogues, by lag and running sums alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scan
from ..functions.stage import staged
from ..functions.text import within
from ..schema import BEGIN


def classify(df: DataFrame, part: list[str], window_seconds: float, order: str = "ord") -> DataFrame:
    """Non-cut rows with seg, paired, dropped, boundary, conv, question and its images, last talker.

    All windows share the hash partitioning of ``part``: one exchange. Rows with slices are scanned by them instead.
    """
    if scan.SLICE in df.columns:
        return _by_slices(df, part, window_seconds, order)
    w = Window.partitionBy(*part).orderBy(order)
    df = df.withColumn("seg", F.coalesce(F.sum(F.col("is_cut").cast("int")).over(w), F.lit(0))).where("not is_cut")
    s = Window.partitionBy(*part, "seg").orderBy(order)
    no = F.lit(False)
    df = df.withColumns({"_s1": F.lag("is_sender").over(s), "_t1": F.lag("t").over(s), "_t2": F.lag("t", 2).over(s), "_m1": F.lag("msg").over(s), "_i1": F.lag("images").over(s)})
    df = df.withColumn("paired", F.coalesce((F.col("is_sender") == 1) & (F.col("_s1") == 0), no))
    df = df.withColumn("dropped", F.coalesce(F.col("paired") & ~within(F.col("t"), F.col("_t1"), window_seconds), no))
    ref = F.when(F.coalesce(F.lag("dropped").over(s), no), F.col("_t2")).otherwise(F.col("_t1"))
    df = df.withColumn("_ref", ref)
    df = df.withColumn("boundary", F.coalesce(~F.col("paired") & ~within(F.col("t"), F.col("_ref"), window_seconds), no))
    df = df.withColumns({
        "conv": F.sum(F.col("boundary").cast("int")).over(s),
        "peer": F.last(F.when(F.col("is_sender") == 0, F.col("talker")), ignorenulls=True).over(s.rowsBetween(Window.unboundedPreceding, 0)),
        "is_turn": (F.col("is_sender") == 1) & ~F.col("dropped"),
        "question": F.when(F.col("paired"), F.col("_m1")).otherwise(BEGIN),
        "question_images": F.when(F.col("paired"), F.col("_i1")),
    })
    return df.drop("_s1", "_t1", "_t2", "_m1", "_i1", "_ref")


def _by_slices(df: DataFrame, part: list[str], window_seconds: float, order: str) -> DataFrame:
    """``classify`` with what it needs of earlier rows carried from slice to slice: two rows, the number of cuts, the
    number of boundaries since the last cut, the other side's last talker."""
    df = scan.running(staged(df, "groups"), part, order, {"seg": F.col("is_cut").cast("int")}).where("not is_cut")
    part = [*part, "seg"]
    df = scan.previous(df, part, order, ["is_sender", "t", "msg", "images"], 2)
    one, two, no = F.col("_prev")[0], F.col("_prev")[1], F.lit(False)
    late = lambda a, b: F.coalesce(~within(a, b, window_seconds), no)
    pair = lambda x, y: F.coalesce((x == 1) & (y == 0), no)
    df = df.withColumn("paired", pair(F.col("is_sender"), one["is_sender"])).withColumn("dropped", F.col("paired") & late(F.col("t"), one["t"]))
    ref = F.when(pair(one["is_sender"], two["is_sender"]) & late(one["t"], two["t"]), two["t"]).otherwise(one["t"])
    df = df.withColumns({
        "boundary": ~F.col("paired") & late(F.col("t"), ref), "is_turn": (F.col("is_sender") == 1) & ~F.col("dropped"),
        "question": F.when(F.col("paired"), one["msg"]).otherwise(BEGIN), "question_images": F.when(F.col("paired"), one["images"]),
    }).drop("_prev")
    return scan.running(staged(df, "pairs"), part, order, {"conv": F.col("boundary").cast("int")}, {"peer": F.when(F.col("is_sender") == 0, F.col("talker"))})


def turns(classified: DataFrame) -> DataFrame:
    return classified.where("is_turn")


def dialogues(classified: DataFrame, part: list[str], order: str = "ord") -> DataFrame:
    """One row a dialogue of one turn at least: turns in order, images, time of the last row that counts, talker."""
    turn = F.struct(F.col(order).alias("ord"), F.col("question").alias("user"), F.col("msg").alias("assistant"), F.coalesce("question_images", F.array().cast("array<string>")).alias("images"))
    out = classified.groupBy(*part, "seg", "conv").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_turn"), turn))).alias("turns"), F.min(order).alias("first_ord"),
        F.max_by("t", F.when(~F.col("dropped"), F.col(order))).alias("time"), F.coalesce(F.max_by("peer", order), F.lit("")).alias("talker"),
    )
    return out.where(F.size("turns") > 0).withColumn("images", F.flatten(F.transform("turns", lambda t: t["images"])))


def total_length() -> Column:
    return F.aggregate("turns", F.lit(0), lambda a, t: a + F.length(t["user"]) + F.length(t["assistant"]))


def keep(df: DataFrame, max_length: int = 2048, max_images: int = 2) -> DataFrame:
    """Length, image and lone-opener filters."""
    lone = (F.size("turns") == 1) & (F.get("turns", F.lit(0))["user"] == BEGIN)
    return df.where((total_length() <= max_length) & (F.size("images") <= max_images) & ~lone)


def opened(user: Column, assistant: Column) -> Column:
    """The opener of a dialogue that the other side did not start, as a hint of what to say."""
    return F.replace(user, F.lit(BEGIN), F.concat(F.lit(BEGIN + "你应该说："), assistant, F.lit("</begin_chat>")))


def system_prompt(default: str, time: Column | None = None, relation: Column | None = None) -> Column:
    out = F.lit(default)
    if time is not None:
        out = F.concat(out, F.lit("\n 现在时间是"), F.date_format(time, "MM-dd HH:mm"))
    if relation is not None:
        out = F.concat(out, F.when(F.coalesce(relation, F.lit("")) != "", F.concat(F.lit("\n 对方是你的"), relation, F.lit("，你们正在聊天"))).otherwise(""))
    return out


def messages() -> Column:
    return F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(F.lit("user").alias("role"), opened(t["user"], t["assistant"]).alias("content")),
        F.struct(F.lit("assistant").alias("role"), t["assistant"].alias("content")),
    )))


def numbered(df: DataFrame, part: list[str]) -> DataFrame:
    """Ids from 0 in the order of part and first_ord, by the sizes of ranges; no task counts all dialogues or all chats."""
    return scan.numbered(df, [*part, "first_ord"], "id").withColumn("id", F.col("id").cast("string"))
