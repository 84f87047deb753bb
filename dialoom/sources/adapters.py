"""Driver tables as chat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "conversations")
    start = F.lit("2024-01-01").cast("timestamp")
    return d.select(
        F.col("conv_id").alias("chat"), F.col("turn").alias("ord"), F.when(F.col("role") == "system", "system notification").otherwise("text").alias("type_name"),
        (F.col("role") == "assistant").cast("int").alias("is_sender"), F.col("role").alias("talker"), F.coalesce("text", F.lit("")).alias("msg"), F.lit("").alias("src"),
        F.timestamp_micros(F.unix_micros(start) + (F.col("conv_id") * 86400 + F.col("turn") * 60) * 1_000_000).alias("t"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "events")
    kind = F.col("event_type")
    t = F.col("ts").cast("timestamp")
    return d.select(
        F.col("user_id").alias("chat"), F.struct(t.alias("t"), "event_id").alias("ord"),
        F.when(kind == "error", "cut").when(kind == "signup", "sticker").otherwise("text").alias("type_name"),
        F.when(kind == "click", 0).otherwise(1).alias("is_sender"), F.when(kind == "click", "peer").otherwise("me").alias("talker"),
        F.concat(kind, F.lit(":"), F.floor("value").cast("string")).alias("msg"), F.lit("").alias("src"), t.alias("t"), "event_id", "props",
        ((kind == "purchase") & (F.col("user_id") % 2 == 0)).alias("is_forward"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("msg"), F.lit("text").alias("type_name"), "lang", "source")
