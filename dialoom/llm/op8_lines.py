"""Line dedup by a log-template tree, in DataFrame functions only.

Lines are parsed as in a fixed-depth tree: the token count chooses the first node, the leading tokens
(digits masked) the next ones. In a leaf, a position is constant if one token holds at least half of its
lines there, else variable; a line that agrees with the leaf's constant tokens at ``SIMILAR`` of all its
positions takes the generalised template, another keeps its own masked text. A template recurs if ``LEAST``
documents hold it whose other lines differ, told by the smallest hash of a document's other lines, and if these
are at least ``OWN`` of its documents: so lines that recur because whole documents were copied, exactly or
nearly, don't count as boilerplate, and blocks of several recurring lines do. Lines of recurring templates are dropped.

All groups are pre-aggregated before they are shuffled: counts by leaf, by leaf, position and token, and
by template and fingerprint; the last join is salted. Leaves of fewer than ``LEAST`` lines can't recur, so only lines of the others
go on, as 64-bit hashes; tokens are exploded for their distinct masked lines. The hashes of dropped lines
return to the rows that have them, whatever their ids.

Defined cases: null text counts as no line and stays null; blank lines are kept and never counted; an
empty text stays empty; equal lines within a document are judged alike; null ids are one document,
and so are repeated ids, for the counts alone: each row keeps and loses its own lines, and all are returned; a very long text is split whole, in
its row; of equally frequent tokens at a position the greatest is the constant one; extra columns are kept, whatever
their names, but for n_lines and n_dropped, which ``dedup`` replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import saved, table, unused

LEAST, SIMILAR, LEADING, OWN, SALTS = 10, 0.8, 2, 0.25, 32


def mask(line: Column) -> Column:
    """Variable fields that show by themselves: runs of digits."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[0-9]+", "0")).otherwise(line)


def row() -> Column:
    """A row of documents: rows that agree in it lose the same lines, as a line is judged by what it says."""
    return F.xxhash64("doc_id", "text").alias("row")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, masked, n_tokens, leaf, line, rest): the lines that are not blank; row, leaf and line are hashes, rest tells of the other lines."""
    raw = F.split("text", "\n", -1)
    rows = docs.select("doc_id", row(), F.filter(F.transform(raw, lambda x: mask(F.trim(x))), lambda x: x != "").alias("a"))
    rows = rows.withColumn("least", F.slice(F.array_sort(F.array_distinct(F.transform("a", lambda x: F.md5(x)))), 1, 2))
    rows = rows.select("doc_id", "row", "least", F.explode("a").alias("masked"))
    rest = F.when(F.get("least", F.lit(0)) == F.md5("masked"), F.get("least", F.lit(1))).otherwise(F.get("least", F.lit(0)))
    rows = rows.withColumns({"n_tokens": F.size(F.split("masked", " ")), "rest": F.xxhash64(rest)}).drop("least")
    return rows.withColumns({"leaf": F.xxhash64("n_tokens", F.substring_index("masked", " ", LEADING)), "line": F.xxhash64("masked")})


def dropped_lines(docs: DataFrame, least: int = LEAST, similar: float = SIMILAR) -> DataFrame:
    """(row, gone: hashes of the lines to drop)."""
    rows = lines(docs)
    leaves = saved(rows.select("leaf").groupBy("leaf").agg(F.count("*").alias("total")).where(F.col("total") >= least), "leaves")
    # a fixed number of hash buckets (2**20 rows at most) sifts the lines before their texts are shuffled
    slot = F.pmod("leaf", F.lit(1 << 20)).alias("slot")
    rows = rows.withColumn("slot", slot).join(F.broadcast(leaves.select(slot).distinct()), "slot", "left_semi").drop("slot")
    kinds = rows.groupBy("leaf", "line", "n_tokens").agg(F.count("*").alias("n"), F.min("masked").alias("masked"))
    kinds = saved(kinds.join(leaves, "leaf"), "kinds")
    tokens = kinds.select("leaf", "n", F.posexplode(F.split("masked", " ")).alias("at", "token")).groupBy("leaf", "at", "token").agg(F.sum("n").alias("n"))
    constant = (
        tokens.groupBy("leaf", "at").agg(F.max(F.struct("n", "token")).alias("top")).join(leaves, "leaf").where(F.col("top.n") * 2 >= F.col("total"))
        .groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("at", F.col("top.token").alias("token")))).alias("shape"))
    )
    agreed = F.size(F.filter(F.split("masked", " "), lambda t, i: F.coalesce(F.try_element_at("shape", i) == t, F.lit(False))))
    template = F.when(F.coalesce(agreed, F.lit(0)) >= similar * F.col("n_tokens"), F.lit(0)).otherwise(F.col("line")).alias("template")
    named = kinds.join(constant, "leaf", "left").select("leaf", "line", template)
    judged = saved(rows.select("doc_id", "row", "leaf", "line", "rest").join(named.hint("merge"), ["leaf", "line"]), "judged")
    key = ["leaf", "template"]
    held = judged.select(*key, "doc_id", "rest").distinct().groupBy(*key, "rest").agg(F.count("*").alias("n"))
    recurs = held.groupBy(*key).agg(F.count("*").alias("own"), F.sum("n").alias("docs")).where((F.col("own") >= least) & (F.col("own") >= OWN * F.col("docs")))
    # the lines of one template may be a third of all: they are dealt to SALTS places
    recurs = recurs.select(*key, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    gone = judged.withColumn("salt", F.pmod(F.xxhash64("row", "line"), F.lit(SALTS)).cast("int")).join(recurs, [*key, "salt"], "left_semi")
    return gone.groupBy("row").agg(F.collect_set("line").alias("gone"))


def marked(docs: DataFrame, names: list[str], least: int = LEAST, similar: float = SIMILAR) -> DataFrame:
    """docs with the columns ``names``: text without recurring lines, and the numbers of lines and dropped lines that are not blank."""
    ours, theirs, mine, name = unused(docs, "gone", "gone_row", "row", "slot")
    gone = saved(dropped_lines(docs.select("doc_id", "text"), least, similar).select(F.col("gone").alias(ours), F.col("row").alias(theirs)), "gone")
    raw = F.split("text", "\n", -1)
    count = lambda x: F.size(F.filter(x, lambda y: F.trim(y) != "")).cast("long")
    n_lines = F.coalesce(count(raw), F.lit(0).cast("long"))
    kept = F.filter(raw, lambda x: ~F.array_contains(ours, F.xxhash64(mask(F.trim(x)))))
    # a fixed number of hash buckets (2**20 rows at most): only texts that may lose lines are shuffled, at every size
    slot = lambda c: F.pmod(c, F.lit(1 << 20)).alias(name)
    sift = F.broadcast(gone.select(slot(theirs)).distinct())
    docs = docs.withColumn(mine, row()).withColumn(name, slot(mine))
    whole = docs.join(sift, name, "left_anti").drop(name, mine).withColumns({names[0]: F.col("text"), names[1]: n_lines, names[2]: F.lit(0).cast("long")})
    some = docs.join(sift, name, "left_semi").drop(name).join(gone.hint("merge"), F.col(mine) == F.col(theirs), "left").withColumns({
        names[0]: F.when(F.col(ours).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")), names[1]: n_lines,
        names[2]: F.when(F.col(ours).isNull(), 0).otherwise(n_lines - count(kept)).cast("long"),
    }).drop(ours, theirs, mine)
    return whole.union(some)


def dedup(docs: DataFrame, least: int = LEAST, similar: float = SIMILAR) -> DataFrame:
    """The input with text without recurring lines, and n_lines and n_dropped (lines that are not blank)."""
    return marked(docs.drop("n_lines", "n_dropped"), ["text", "n_lines", "n_dropped"], least, similar)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; n_chars follows the text where a line went, and documents of such lines alone go.

    Null and blank texts stay as they are; a repeated or null id is one document for the counts, and all its rows stay;
    an empty table stays empty; the columns of docs, whatever their names, are kept.
    """
    text, n_lines, n_dropped = unused(docs, "cleaned", "lines", "dropped")
    out = marked(docs, [text, n_lines, n_dropped]).where((F.col(n_dropped) == 0) | (F.trim(text) != ""))
    chars = F.when(F.col(n_dropped) > 0, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select([F.col(text).alias(c) if c == "text" else chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
