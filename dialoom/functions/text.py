"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_of(text: str | Column, mark: str) -> Column:
    t = col(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(mark), F.lit("")))) / len(mark)).cast("int")


def strip(text: str | Column) -> Column:
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def basename(path: str | Column) -> Column:
    return F.regexp_extract(F.replace(col(path), F.lit("\\"), F.lit("/")), "([^/]*)$", 1)


def stem(path: str | Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def safe_name(text: str | Column) -> Column:
    return F.regexp_replace(col(text), r"[^\p{L}\p{N}._-]", "")


def blank(text: str | Column) -> Column:
    """Nothing but white space of any kind."""
    return strip(text) == ""


def folder(file: str | Column) -> Column:
    """The name of the folder of a file path as Spark gives it, percent-encoding undone; a ``chat=`` prefix is a partition's."""
    name = F.regexp_extract(col(file), "([^/]+)/[^/]+$", 1)
    return F.regexp_replace(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), "^chat=", "")


def within(a: Column, b: Column, seconds: float) -> Column:
    """abs(a - b) <= seconds, inclusive, to the microsecond."""
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) <= int(seconds * 1_000_000)


def parse_time(text: str | Column) -> Column:
    t = col(text)
    forms = ("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy/M/d H:mm", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy/M/d H:mm:ss")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in forms])
