"""Message types in two languages: names of a vocabulary and their translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CUT, SKIP


def pairs() -> dict[str, str]:
    """English type name, lower-case, to the Chinese one; the vocabularies are aligned by place."""
    english, chinese = (CUT[k] + SKIP[k] for k in ("en", "zh"))
    return dict(zip((x.lower() for x in english), chinese, strict=True))


def _lookup(names: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key)


def chinese(name: str | Column) -> Column:
    """The Chinese name of an English type, whatever its case; null for none."""
    return _lookup(pairs(), F.lower(name))


def english(name: str | Column) -> Column:
    """The English name, lower-case, of a Chinese type; null for none."""
    return _lookup({v: k for k, v in pairs().items()}, F.col(name) if isinstance(name, str) else name)


def translated(df: DataFrame, name: str = "type_name") -> DataFrame:
    """df with en and zh_cn: both names of a type that the vocabularies know in either language."""
    known = F.coalesce(chinese(name), F.when(english(name).isNotNull(), F.col(name)))
    return df.withColumns({"en": F.coalesce(english(name), F.when(known.isNotNull(), F.lower(name))), "zh_cn": known})
