"""Rewriting of rows that are not text; the first rule that fits wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import stem
from ..schema import IMAGE_MARK, IMAGE_TYPES
from .filters import is_text


def non_text(df: DataFrame, images: DataFrame | None, gif_type: str = "动画表情", sticker_types: tuple[str, ...] = ("动画表情", "sticker")) -> DataFrame:
    """images: (stem, image), small enough for Spark to broadcast by its own size check, else a shuffle join."""
    key = stem("src")
    if images is None:
        df = df.withColumn("_hit", F.lit(None).cast("string"))
    else:
        df = df.withColumn("_stem", F.when(F.col("src") != "", key)).join(images.select(F.col("stem").alias("_stem"), F.col("image").alias("_hit")), "_stem", "left").drop("_stem")
    rest, gif = ~is_text(), F.lower("src").endswith(".gif")
    image = F.lower("type_name").isin(*IMAGE_TYPES)
    shown = image & F.col("_hit").isNotNull() & (F.col("is_sender") == 0)
    sticker = F.col("type_name").isin(*sticker_types)
    return df.withColumns({
        "_type": F.when(rest & gif, gif_type).when(rest & shown, F.col("type_name")).when(rest & image, "Cut").otherwise(F.col("type_name")),
        "_src": F.when(rest & gif, "").when(rest & shown, F.col("_hit")).when(rest & ~image & sticker, "").otherwise(F.col("src")),
        "_msg": F.when(rest & gif, F.col("msg")).when(rest & shown, IMAGE_MARK).when(rest & image, F.col("msg")).when(rest & sticker, F.col("msg")).when(rest, "").otherwise(F.col("msg")),
        "modality": F.when(rest & ~gif & shown, "image"),
    }).drop("type_name", "src", "msg", "_hit").withColumnsRenamed({"_type": "type_name", "_src": "src", "_msg": "msg"})
