"""Captions in place of image marks, aligned inside each dialogue."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scan
from ..functions.text import count_of
from ..providers import VISION, Calls
from ..schema import IMAGE_MARK


MISSING, FAILED = "[图片文件不存在]", "[图片描述失败]"


def describe(images: DataFrame, captioner: Callable[[str], str], calls: Calls = Calls(retry=VISION)) -> DataFrame:
    """(image, caption): each distinct image is described once; a missing file or another error becomes a text that says so.

    Lost connections and busy servers are tried again, calls run beside each other, and captions are logged as ``calls`` says.
    """

    def lost(e: Exception) -> str:
        return MISSING if isinstance(e, FileNotFoundError) else f"{FAILED[:-1]}: {e}]"

    def run(batches):
        for x in batches:
            yield pd.DataFrame({"image": x.image, "caption": [c for g in calls.each([[i] for i in x.image], lambda g: [captioner(g[0])], lost) for c in g]})

    return calls.dealt(images.select("image").distinct()).mapInPandas(run, "image string, caption string")


def captioned(df: DataFrame, captions: DataFrame, key: str = "id") -> DataFrame:
    """Dialogues (key, turns, images) with captions in place of their image marks, in order over all turns, and no images left.

    captions: (image, caption) of ``describe``; only dialogues with images are joined.
    """
    each = df.select(F.col(key), F.posexplode("images").alias("pos", "image")).join(captions, "image", "left")
    own = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "caption"))), lambda x: x["caption"]).alias("_captions"))
    return _filled(df.join(own, key, "left").withColumn("_captions", F.coalesce("_captions", F.array().cast("array<string>"))))


def captioned_in_sequence(df: DataFrame, captions: DataFrame, order: list[str]) -> DataFrame:
    """``captioned`` by one count over all dialogues in an order: the k-th mark of all takes the k-th image of all.

    So what a dialogue has too many or too few is made up by those that follow. Marks and images before a dialogue are sums
    over ranges of the order; marks meet images by their number.
    """
    *part, end = order
    rows = scan.sliced(scan.staged(df, "talks"), part, end)  # one list: all dialogues are one part
    marks = F.aggregate("turns", F.lit(0), lambda a, t: a + count_of(t["user"], IMAGE_MARK) + count_of(t["assistant"], IMAGE_MARK))
    rows = rows.withColumns({"_at": F.struct(*order), "_marks": marks, "_pics": F.size("images")})
    rows = scan.running(rows, [], "_at", {"_mark": F.col("_marks"), "_pic": F.col("_pics")})
    rows = scan.staged(rows.withColumns({"_mark": F.col("_mark") - F.col("_marks"), "_pic": F.col("_pic") - F.col("_pics"), "_row": F.monotonically_increasing_id()}), "marks")
    pics = rows.select(F.posexplode("images").alias("pos", "image"), "_pic").select((F.col("_pic") + F.col("pos")).alias("_nth"), "image").join(captions, "image", "left").drop("image")
    asked = rows.where("_marks > 0").select("_row", F.col("_mark").alias("_first"), F.explode(F.sequence(F.col("_mark"), F.col("_mark") + F.col("_marks") - 1)).alias("_nth"))
    found = asked.join(pics, "_nth", "left").groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "caption"))), lambda x: x["caption"]).alias("_captions"))
    rows = rows.join(found, "_row", "left").withColumn("_captions", F.coalesce("_captions", F.array().cast("array<string>")))
    return _filled(rows.drop("_at", "_marks", "_pics", "_mark", "_pic", "_row", scan.SLICE))


def _filled(df: DataFrame) -> DataFrame:
    """Turns with _captions in place of their marks."""
    empty = F.array().cast("array<string>")

    def step(acc, t):
        first, second = count_of(t["user"], IMAGE_MARK), count_of(t["assistant"], IMAGE_MARK)
        take = lambda at, n: F.slice("_captions", acc["at"] + at + 1, n)
        turn = F.struct(t["ord"].alias("ord"), fill(t["user"], take(F.lit(0), first)).alias("user"), fill(t["assistant"], take(first, second)).alias("assistant"), empty.alias("images"))
        return F.struct((acc["at"] + first + second).alias("at"), F.concat(acc["out"], F.array(turn)).alias("out"))

    kind = df.schema["turns"].dataType
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    turns = F.aggregate("turns", zero, lambda acc, t: F.struct(step(acc, t)["at"].alias("at"), step(acc, t)["out"].cast(kind).alias("out")), lambda acc: acc["out"])
    return df.withColumns({"turns": turns, "images": empty}).drop("_captions")


def fill(text: Column, captions: Column) -> Column:
    """The k-th mark becomes the k-th caption; marks without one say so."""
    pieces = F.split(text, IMAGE_MARK)
    return F.array_join(
        F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(
            F.coalesce(F.concat(F.lit("\n[图片描述: "), F.get(captions, i - 1), F.lit("]\n")), F.lit("\n[图片描述缺失]\n")), p,
        ))), "",
    )
