"""Objects of one array of large JSON files, read in parallel: a file is cut at each closing brace, wherever that stands.

Whether a piece begins inside a string, and how deep it lies, depends on all text before it. Both are sums: quotes so far,
and braces so far outside strings, which a piece tells for either case. Sums run over the blocks of a file by ``scan``, so
no task reads a whole file, and no value holds one. An object of the array is the pieces up to the one that ends it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scan
from ..functions.stage import staged


def _depth(text: Column) -> Column:
    """Braces and brackets that text outside of strings opens, less the brackets that it closes."""
    return F.length(F.translate(text, "]", "")) - F.length(F.translate(text, "{[", ""))


def _outside(text: Column, first: int) -> Column:
    """The text outside of strings, or inside of them (first: 1), if it begins outside."""
    plain = F.regexp_replace(text, r"(?s)\\.", "")
    return F.array_join(F.filter(F.split(plain, '"', -1), lambda x, i: i % 2 == first), "")


def pieces(spark: SparkSession, path: str, array: str) -> DataFrame:
    """(file, block, row, value, start, depth, opens): the text up to each closing brace, its depth at its begin, and
    whether it opens the array, a key of the file's object."""
    raw = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias(scan.SLICE),
        F.monotonically_increasing_id().alias("row"),
    )
    found = F.split("value", f'"{array}"\\s*:\\s*\\[', 2)
    raw = raw.withColumns({
        "quotes": F.length(F.regexp_replace("value", r"(?s)\\.", "")) - F.length(F.translate(F.regexp_replace("value", r"(?s)\\.", ""), '"', "")),
        "out": _depth(_outside(F.col("value"), 0)), "in": _depth(_outside(F.col("value"), 1)),
        "lead": F.when(F.size(found) > 1, _depth(_outside(found[0], 0))), "lead_in": F.when(F.size(found) > 1, _depth(_outside(found[0], 1))),
    })
    raw = staged(raw, "pieces")
    ends = raw.groupBy("file").agg(F.max(F.struct(scan.SLICE, "row")).alias("end"), (F.sum(F.octet_length("value") + 1) > F.max("size")).alias("open"))
    raw = scan.attach(raw, ends, ["file"]).withColumn("unended", F.col("open") & (F.struct(scan.SLICE, "row") == F.col("end"))).drop("end", "open", "size")
    rows = scan.running(raw, ["file"], "row", {"_quotes": F.col("quotes")})
    inside = (F.col("_quotes") - F.col("quotes")) % 2 == 1
    grown = F.when(inside, F.col("in")).otherwise(F.col("out"))
    closed = F.when((F.col("_quotes") % 2 == 0) & ~F.col("unended"), 1).otherwise(0)
    rows = rows.withColumns({"_grown": grown - closed, "_closed": closed, "_lead": F.when(inside, F.col("lead_in")).otherwise(F.col("lead"))})
    rows = scan.running(rows.drop("in", "out", "lead", "lead_in"), ["file"], "row", {"after": F.col("_grown")})
    rows = rows.withColumn("depth", F.col("after") - F.col("_grown")).withColumn("opens", F.coalesce(F.col("depth") + F.col("_lead") == 1, F.lit(False)))
    return staged(rows.drop("_lead", "_grown"), "pieces")


def elements(spark: SparkSession, path: str, array: str) -> tuple[DataFrame, DataFrame]:
    """(file, pos, value) of the objects of an array, pos rising in a file; (file, head, error) of all files.

    head: the file without the array's objects, as JSON text; error: why a file is no JSON, null for a good one. Objects
    of broken files are returned as far as they are whole.
    """
    rows = pieces(spark, path, array)
    rest = F.when(F.col("opens"), F.get(F.split("value", f'"{array}"\\s*:\\s*\\[', 2), F.lit(1))).otherwise(F.col("value"))
    done = (F.col("opens") | (F.col("depth") == 2)) & rest.rlike(r"^\s*\]")
    rows = scan.running(rows.withColumn("_rest", rest), ["file"], "row", {"pos": (F.col("after") == 2).cast("int")}, {"state": F.when(done, 0).when(F.col("opens"), 1)})
    rows = rows.withColumns({"within": F.coalesce(F.col("state") == 1, F.lit(False)), "ended": (F.col("after") == 2) & (F.col("_closed") == 1)})
    own = rows.where("within").withColumn("pos", F.col("pos") - F.col("ended").cast("int"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct(scan.SLICE, "row", "_rest"))), lambda x: F.concat(x["_rest"], F.lit("}")))
    items = own.groupBy("file", "pos").agg(F.max("ended").alias("whole"), F.max(scan.SLICE).alias(scan.SLICE), texts.alias("_texts")).where("whole")
    items = items.select("file", scan.SLICE, "pos", F.regexp_replace(F.array_join("_texts", ""), r"^[\s,]+", "").alias("value"))
    mark = F.lit(f'"{array}": [')
    other = F.when(F.col("opens") & F.col("within"), F.concat(F.get(F.split("value", f'"{array}"\\s*:\\s*\\[', 2), F.lit(0)), mark)).when(~F.col("within"), F.concat("value", F.when(F.col("unended"), "").otherwise("}")))
    head = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(other.isNotNull(), F.struct(scan.SLICE, "row", other.alias("text"))))), lambda x: x["text"]), "")
    heads = rows.groupBy("file").agg(head.alias("head"), F.max_by("after", F.struct(scan.SLICE, "row")).alias("_depth"), (F.sum("quotes") % 2).alias("_odd"), F.max("opens").alias("_has"), F.count_if((F.col("after") == 0) & (F.col("_closed") == 1)).alias("_roots"))
    parsed = F.try_parse_json("head")
    error = F.when(F.col("_odd") == 1, "ends inside a string").when(F.col("_depth") != 0, "brackets do not match").when(parsed.isNull() | (F.col("_roots") != 1), "no JSON").when(~F.col("_has"), f"no {array}")
    return items, heads.select("file", "head", error.alias("error"))
