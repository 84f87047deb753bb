"""Image listing and bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, stem


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(stem, image): the first file of each stem."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.select(stem("path").alias("stem"), F.concat(F.lit("images/"), basename("path")).alias("image")).groupBy("stem").agg(F.min("image").alias("image"))


def encoded(spark: SparkSession, path: str) -> DataFrame:
    """(path, mime, base64)."""
    d = spark.read.format("binaryFile").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    return d.select("path", F.concat(F.lit("image/"), F.when(suffix == "jpg", "jpeg").otherwise(suffix)).alias("mime"), F.base64("content").alias("base64"))
