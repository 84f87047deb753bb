"""Scans over long ordered parts, in parallel: slices, summaries of slices, and what is carried from one to the next.

A window over a part (a chat, or everything) is one task. Here a part is cut into slices that follow its order. What a row
needs of the rows before it is made of two pieces: what its own slice says, by a window over (part, slice), and what the
slices before say, by a window over one summary row a slice. Both compose, so results are those of the window over the part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .stage import staged

SLICE = "_slice"


def slices(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sliced(df: DataFrame, part: list[str], order: str, n: int | None = None) -> DataFrame:
    """df with ``_slice``: n ranges of (part, order); written, as another run of the ranges might cut elsewhere."""
    return staged(df.repartitionByRange(n or slices(df), *part, order).withColumn(SLICE, F.spark_partition_id()), "slices")


def _within(part: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*part, SLICE).orderBy(order)


def _over(part: list[str], first: int = Window.unboundedPreceding) -> WindowSpec:
    """Over the summary rows before a slice."""
    return Window.partitionBy(*part).orderBy(SLICE).rowsBetween(first, -1)


def attach(df: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """df left joined with side on keys that may be null."""
    side = side.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return df.join(side, on, "left").drop(*[f"_key_{k}" for k in keys])


def previous(df: DataFrame, part: list[str], order: str, fields: list[str], k: int = 1, name: str = "_prev") -> DataFrame:
    """df with an array of the fields of the k rows before each in its part, the nearest first; null where there is none."""
    w, now, keys = _within(part, order), F.struct(*fields), [*part, SLICE]
    last = df.withColumn("_back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("_back") <= k)
    tails = last.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_back", now.alias("row")))).alias("_tail"))
    rows = F.flatten(F.reverse(F.collect_list(F.transform("_tail", lambda x: x["row"])).over(_over(part, -k))))
    df = attach(df, tails.withColumn("_carry", rows).drop("_tail"), keys).withColumn("_nth", F.row_number().over(w))
    each = [F.when(F.col("_nth") > j, F.lag(now, j).over(w)).otherwise(F.get("_carry", F.lit(j) - F.col("_nth"))) for j in range(1, k + 1)]
    return df.withColumn(name, F.array(*each)).drop("_carry", "_nth")


def running(df: DataFrame, part: list[str], order: str, sums: dict[str, Column] | None = None, last: dict[str, Column] | None = None) -> DataFrame:
    """df with running sums, and the last value so far that is not null, of each row's part, the row included."""
    sums, last, keys = sums or {}, last or {}, [*part, SLICE]
    summary = df.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"_sum_{n}") for n, c in sums.items()],
        *[F.max_by(c, F.when(c.isNotNull(), F.col(order))).alias(f"_last_{n}") for n, c in last.items()],
    )
    before = summary.withColumns(
        {f"_sum_{n}": F.coalesce(F.sum(f"_sum_{n}").over(_over(part)), F.lit(0)) for n in sums} | {f"_last_{n}": F.last(f"_last_{n}", ignorenulls=True).over(_over(part)) for n in last}
    )
    w = _within(part, order).rowsBetween(Window.unboundedPreceding, 0)
    df = attach(df, before, keys)
    out = {n: F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"_sum_{n}") for n, c in sums.items()}
    out |= {n: F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_last_{n}")) for n, c in last.items()}
    return df.withColumns(out).drop(*[f"_sum_{n}" for n in sums], *[f"_last_{n}" for n in last])


def numbered(df: DataFrame, order: list[str], name: str = "nth", n: int | None = None) -> DataFrame:
    """df with its rows' positions from 0 in the order of the columns: ranges, their sizes, and the sizes before each added."""
    *part, end = order
    rows = sliced(staged(df, "rows"), part, end, n)  # ranges look at the rows twice
    sizes = rows.groupBy(SLICE).agg(F.count("*").alias("n")).agg(F.collect_list(F.struct(SLICE, "n")).alias("all"))  # one row, a size a range
    before = lambda x: F.aggregate(F.filter("all", lambda y: y[SLICE] < x[SLICE]), F.lit(0).cast("long"), lambda a, y: a + y["n"])
    starts = sizes.select(F.explode(F.transform("all", lambda x: F.struct(x[SLICE].alias(SLICE), before(x).alias("_start")))).alias("x")).select("x.*")
    rank = F.row_number().over(Window.partitionBy(SLICE).orderBy(*order))
    return rows.withColumn("_rank", rank).join(F.broadcast(starts), SLICE).withColumn(name, F.col("_start") + F.col("_rank") - 1).drop("_start", "_rank", SLICE)
