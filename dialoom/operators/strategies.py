"""What belongs to the same conversation, as strategies that can be combined."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import within


class Strategy(Protocol):
    def same(self, before: Column, now: Column) -> Column:
        """Whether a message (a struct) belongs to the conversation of the one before it."""


@dataclass(frozen=True)
class TimeWindow:
    seconds: float

    def same(self, before: Column, now: Column) -> Column:
        return within(now["t"], before["t"], self.seconds)


@dataclass(frozen=True)
class SameField:
    """Messages that agree in a column, for example the talker or the chat."""

    name: str

    def same(self, before: Column, now: Column) -> Column:
        return now[self.name].eqNullSafe(before[self.name])


@dataclass(frozen=True)
class Composite:
    parts: tuple[Strategy, ...]
    require_all: bool = True

    def same(self, before: Column, now: Column) -> Column:
        each = [p.same(before, now) for p in self.parts]
        return reduce(lambda a, b: a & b if self.require_all else a | b, each)


class HistoryStrategy(Protocol):
    """A rule over all messages of the conversation so far, told by a state that each message renews."""

    fields: tuple[str, ...]

    def begin(self, now: tuple) -> object:
        """The state of a conversation that a message (its fields) begins."""

    def goes_on(self, state: object, now: tuple) -> object | None:
        """The state with this message, or None if it begins another conversation."""


@dataclass(frozen=True)
class TotalSpan:
    """Conversations of at most so many seconds from the first message to the last."""

    seconds: float
    fields: tuple[str, ...] = ("t",)

    def begin(self, now: tuple):
        return now[0]

    def goes_on(self, state, now: tuple):
        return state if abs((now[0] - state).total_seconds()) <= self.seconds else None


@dataclass(frozen=True)
class MostMessages:
    """Conversations of at most so many messages."""

    most: int
    fields: tuple[str, ...] = ()

    def begin(self, now: tuple):
        return 1

    def goes_on(self, state, now: tuple):
        return state + 1 if state < self.most else None


def _over_history(df: DataFrame, strategy: HistoryStrategy, part: list[str], order: str) -> DataFrame:
    """Rows of a part lie in one task, in order; a state goes from row to row, so a part of any length takes the memory of one."""
    keys = [f"_k{i}" for i in range(len(part))]
    fields = [F.col(f).alias(f"_f{i}") for i, f in enumerate(strategy.fields)]
    rows = df.withColumn("_row", F.struct(*df.columns)).select("_row", *[F.to_json(F.struct(F.col(p))).alias(k) for p, k in zip(part, keys, strict=True)], *fields, F.col(order).alias("_order"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "_order").drop("_order")

    def run(batches):
        key, state, number = None, None, 0
        for x in batches:
            out, at = [], list(zip(*[x[k] for k in keys], strict=True))
            for k, now in zip(at, zip(*[x[f"_f{i}"] for i in range(len(strategy.fields))], strict=True) if strategy.fields else [()] * len(x), strict=True):
                if k != key:
                    key, number, state = k, 0, strategy.begin(now)
                else:
                    after = strategy.goes_on(state, now)
                    number, state = (number + 1, strategy.begin(now)) if after is None else (number, after)
                out.append(number)
            yield pd.DataFrame({"_row": x["_row"], "conversation": out})

    kind = T.StructType([rows.schema["_row"], T.StructField("conversation", T.LongType())])
    return rows.mapInPandas(run, kind).select("_row.*", "conversation")


def conversations(df: DataFrame, strategy: Strategy | HistoryStrategy, part: list[str], order: str = "ord") -> DataFrame:
    """df with conversation: a number in its part, from 0, that rises where the strategy says that a new one begins."""
    if hasattr(strategy, "goes_on"):
        return _over_history(df, strategy, part, order)
    w = Window.partitionBy(*part).orderBy(order)
    now = F.struct(*[c for c in df.columns if c not in part])
    df = df.withColumn("_before", F.lag(now).over(w))
    same = F.coalesce(strategy.same(F.col("_before"), now), F.lit(False)) | F.col("_before").isNull()
    return df.withColumn("_new", (~same).cast("int")).withColumn("conversation", F.sum("_new").over(w)).drop("_before", "_new")
