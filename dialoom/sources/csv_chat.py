"""Chat CSV exports with their side inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import folder, parse_time
from ..schema import CHAT_CSV


def chat_csv(spark: SparkSession, path: str) -> DataFrame:
    """All files of ``<root>/<chat>/*.csv``; file order is (start_seq, file), row order the export's own.

    Columns are found by the header's names, in any order; is_forward may be missing. A file without one of the others, or
    with columns of other names, is refused. All files have the header of the first.
    """
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}
    names = [f.name for f in CHAT_CSV.fields]
    head = spark.read.options(**options).csv(path).columns  # of one file; enforceSchema refuses the others if they differ
    missing, more = set(names) - set(head), set(head) - set(names) - {"is_forward"}
    if missing or more:
        raise ValueError(f"chat CSV: missing columns {sorted(missing)}, unknown columns {sorted(more)}")
    kind = {f.name: f.dataType for f in CHAT_CSV.fields} | {"is_forward": T.StringType()}
    raw = (
        spark.read.schema(T.StructType([T.StructField(n, kind[n]) for n in head])).options(**options).option("enforceSchema", False).csv(path)
        .select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    )
    text = {n: F.coalesce(n, F.lit("")) for n in names if n not in ("id", "is_sender", "CreateTime")}
    start = F.coalesce(F.expr("try_cast(regexp_extract(file, '_([0-9]+)_[0-9]+[.]csv$', 1) as int)"), F.lit(0))
    forward = F.coalesce(F.lower("is_forward").isin("true", "1"), F.lit(False)) if "is_forward" in head else F.lit(False)
    return raw.withColumns(text).withColumns({
        "chat": folder("file"), "start_seq": start, "t": parse_time("CreateTime"), "is_forward": forward, "modality": F.lit(None).cast("string"),
    }).withColumn("ord", F.struct("start_seq", "file", "row")).drop("row")


def relations(spark: SparkSession, path: str) -> DataFrame:
    """(chat, relation) of ``<root>/<chat>/users.json``; bad JSON gives no row."""
    raw = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return raw.select(folder("file").alias("chat"), F.get_json_object("value", "$.relation").alias("relation")).where("relation is not null")


def blocked_words(spark: SparkSession, path: str, extra: tuple[str, ...] = ()) -> list[str]:
    """Distinct words of a small JSON file and the settings; a file that can't be read adds none."""
    try:
        rows = spark.read.option("multiLine", True).schema("blocked_words array<string>").json(path).select(F.explode("blocked_words").alias("w")).distinct().collect()
    except Exception as e:  # a missing file: the setting alone holds
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = []
    return list(dict.fromkeys([*extra, *sorted(r.w for r in rows)]))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(dialogue, pos, question) of a dialogue script."""
    d = spark.read.option("multiLine", True).schema("questions array<array<string>>").json(path)
    return d.select(F.posexplode("questions").alias("dialogue", "q")).select("dialogue", F.posexplode("q").alias("pos", "question"))
