"""Writers."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scan
from .operators.dialogue import messages

CSV_COLUMNS = ["id", "MsgSvrID", "type_name", "is_sender", "talker", "room_name", "msg", "src", "CreateTime", "is_forward"]


def chat_csv(df: DataFrame, path: str) -> None:
    """Folders ``chat=<name>``, which the chat CSV source reads back as the chats that they were."""
    df.select("chat", *CSV_COLUMNS).write.partitionBy("chat").option("header", True).option("escape", '"').csv(path)


#: The columns of a stored dialogue.
SHAREGPT = "id string, time string, score int, messages array<struct<role:string,content:string>>, images array<string>, system string"


def sharegpt(df: DataFrame) -> DataFrame:
    """(id, time, score, messages, images, system), id and time as text; df: dialogues with turns, or stored ones with messages."""
    text = F.col("time") if dict(df.dtypes)["time"] == "string" else F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss")
    return df.select(
        F.col("id").cast("string").alias("id"), text.alias("time"), (F.col("score").cast("int") if "score" in df.columns else F.lit(0)).alias("score"),
        (messages() if "turns" in df.columns else F.col("messages")).alias("messages"), "images", (F.col("system") if "system" in df.columns else F.lit("")).alias("system"),
    )


def json_lines(df: DataFrame, path: str) -> None:
    sharegpt(df).write.json(path)


def json_array(df: DataFrame, path: str) -> None:
    """A folder of parts that are one JSON array if they are read one after the other, an item a line; ``joined`` makes one file.

    Items are in the order of their ids, numbers before texts. Every task writes the items of a range: what opens, parts and
    closes the array stands at the items themselves, by their number.
    """
    item = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    number = F.col("id").try_cast("decimal(38,0)")
    rows = sharegpt(df).select(F.struct(number.isNull().alias("text"), number.alias("number"), "id").alias("at"), item.alias("item"))
    rows = scan.numbered(rows, ["at"])
    size = rows.agg(F.count("*").alias("size"))  # one row
    line = F.concat(F.when(F.col("nth") == 0, "[").otherwise(","), "item", F.when(F.col("nth") == F.col("size") - 1, "]").otherwise(""))
    lines = rows.crossJoin(F.broadcast(size)).select("nth", line.alias("value"))
    lines.union(size.where("size = 0").select(F.lit(0).cast("long"), F.lit("[]"))).orderBy("nth").select("value").write.text(path)


def joined(spark: SparkSession, path: str, file: str) -> None:
    """The parts of a folder, one after the other, as one file: bytes are copied by the file system's own streams."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder, out = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(file)
    files = folder.getFileSystem(conf)
    parts = sorted((s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    target = out.getFileSystem(conf).create(out, True)
    try:
        for p in parts:
            source = files.open(p)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, target, 1 << 20, False)
            finally:
                source.close()
    finally:
        target.close()


def registry(path: str | dict[str, str]) -> dict[str, str]:
    """Dataset name to file, from a registry of datasets (name to {file_name}, a path beside the registry or a URL); a mapping is one."""
    if isinstance(path, dict):
        return path
    with open(path, encoding="utf-8") as f:
        names = {name: entry["file_name"] for name, entry in json.load(f).items()}
    return {k: v if "://" in v else os.path.join(os.path.dirname(path), v) for k, v in names.items()}


def dataset(spark: SparkSession, registry_path: str | dict[str, str], name: str) -> DataFrame:
    """A registered dataset: JSON lines or an array with an item a line, read in parallel, or any other JSON array."""
    files = registry(registry_path)
    if name not in files:
        raise KeyError(f"{name} is none of {sorted(files)}")
    item = F.regexp_replace("value", r"^\s*[\[,]|[,\]]\s*$", "")
    lines = spark.read.text(files[name]).select("value", item.alias("item")).where("trim(item) <> ''")
    first = lines.limit(1).select(F.try_parse_json("item").isNotNull().alias("parsed"), F.col("item").rlike(r"^\s*\{").alias("object"), F.col("value").rlike(r"^\s*\[.*\]\s*$").alias("whole")).first()
    if first is None or first.parsed and first.object and not first.whole:
        return lines.select(F.from_json("item", SHAREGPT).alias("x")).select("x.*")
    return spark.read.option("multiLine", True).json(files[name])


def cleaned_path(registry_path: str | dict[str, str], name: str) -> str:
    """Where the cleaned form of a dataset goes: as registered, else its file's name with -cleaned."""
    files = registry(registry_path)
    stem, suffix = os.path.splitext(files[name])
    return files.get(f"{name}-cleaned", f"{stem}-cleaned{suffix}")


def cleaned(df: DataFrame, registry_path: str | dict[str, str], name: str, least: int, array: bool = False) -> str:
    """Write the dialogues of at least this score as the cleaned form of a dataset; the name of what is to be used.

    df: dialogues, or a stored dataset. If none has the score, nothing is written and the dataset keeps its name.
    """
    good = df.where(F.coalesce("score", F.lit(0)) >= least)
    if good.isEmpty():
        return name
    (json_array if array else json_lines)(good, cleaned_path(registry_path, name))
    return f"{name}-cleaned"


def transcript(df: DataFrame, path: str) -> None:
    """One content a line, a blank line after each dialogue; df: (dialogue, pos, content)."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n")
    df.groupBy("dialogue").agg(F.concat(lines, F.lit("\n")).alias("value")).select("value").write.text(path)
