"""Length histogram and cumulative distribution, token lengths, observed counts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Number of words, where no tokenizer is given."""
    return F.size(F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))


def token_length(text: Column, tokenizer: Callable[[str], list] | None = None) -> Column:
    """Length of a text in tokens, without special ones; the tokenizer works on Arrow batches in the tasks."""
    if tokenizer is None:
        return words(text)

    @F.pandas_udf("int")
    def count(x: pd.Series) -> pd.Series:
        return x.map(lambda t: len(tokenizer(t or "")))

    return count(text)


def observed(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """df, and its counts once an action has run over it: no pass of their own."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in counts.items()]), seen


def histogram(df: DataFrame, length: Column, interval: int = 512) -> DataFrame:
    return df.groupBy((F.floor(length / interval) * interval).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def cdf(df: DataFrame, length: Column, interval: int = 512) -> DataFrame:
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # a row a bucket
    run = F.sum("n").over(w)
    return histogram(df, length, interval).select(
        F.concat(F.lit("< "), (F.col("bucket") + interval).cast("string")).alias("label"), "bucket", "n", run.alias("running"),
        F.round(100 * run / F.sum("n").over(Window.partitionBy()), 2).alias("percent"),
    ).orderBy("bucket")
