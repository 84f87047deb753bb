"""Scores: prompts, replies, joins, distribution and acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prompt(turns: Column) -> Column:
    """Q and A lines of a dialogue."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("Q: "), t["user"], F.lit("\nA: "), t["assistant"])), "\n")


#: What a judge is told: the contract is a whole number from 1 to 5 for relevance, coherence and style, in JSON with the id.
TEMPLATE = """Rate the following chat as training data, from 1 (unusable) to 5 (excellent).
Ask yourself whether each answer (A) fits its question (Q), and whether the chat holds together. Only a 5 needs good style
as well. Short answers are fine: don't rate them down for being short.
Reply with JSON alone: {{"id": "{id}", "score": <1 to 5>}}

id: {id}
{chat}"""


def judge_prompt(id: Column, turns: Column) -> Column:
    """The prompt of a dialogue, with its id."""
    parts = TEMPLATE.replace("{{", "{").replace("}}", "}").split("{id}")
    head, tail = parts[-1].split("{chat}")
    out = [F.lit(parts[0])]
    for p in parts[1:-1]:
        out += [id, F.lit(p)]
    return F.concat(*out, id, F.lit(head), prompt(turns), F.lit(tail))


def parse_reply(reply: Column) -> Column:
    """Score of a judge's reply: JSON, fenced or bare; null unless a whole number from 1 to 5."""
    fenced = F.regexp_extract(reply, r"(?s)```json\s*(.*?)\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(reply)
    score = F.get_json_object(body, "$.score")
    return F.when(score.rlike("^[1-5]$"), score.cast("int"))


def reply_id(reply: Column) -> Column:
    """The id in a judge's reply, as text; null if there is none."""
    fenced = F.regexp_extract(reply, r"(?s)```json\s*(.*?)\s*```", 1)
    return F.get_json_object(F.when(fenced != "", fenced).otherwise(reply), "$.id")


def parsed(replies: DataFrame) -> DataFrame:
    """(id, score, failed) of replies (id, reply): keyed by the id that the reply names, else by the one that was asked."""
    score = parse_reply(F.col("reply"))
    return replies.select(F.coalesce(reply_id(F.col("reply")), F.col("id").cast("string")).alias("id"), score.alias("score"), score.isNull().alias("failed"))


def judged_scores(df: DataFrame, replies: DataFrame, images: str = "images", compat: bool = False) -> DataFrame:
    """df (id, images, ...) with score: 6 where a dialogue has images, else what its reply says, 0 without one.

    compat: dialogues with images are unscored, too, as an online judge leaves them.
    """
    scores = parsed(replies).where("not failed").withColumn("arrival", F.lit(0))
    out = join_scores(df.withColumn("id", F.col("id").cast("string")), scores)
    return out if compat else out.withColumn("score", F.when(F.size(images) > 0, 6).otherwise(F.col("score")))


def incomplete(df: DataFrame, replies: DataFrame, images: str = "images") -> DataFrame:
    """(id) of the dialogues without images that have no valid reply; empty if the scores are complete."""
    asked = df.where(F.size(images) == 0).select(F.col("id").cast("string").alias("id"))
    return asked.join(parsed(replies).where("not failed").select("id"), "id", "left_anti")


def join_scores(df: DataFrame, scores: DataFrame, key: str = "id", order: str = "arrival") -> DataFrame:
    """The last score of each key; a miss is 0."""
    last = scores.groupBy(key).agg(F.max_by("score", order).alias("score"))
    return df.join(last, key, "left").withColumn("score", F.coalesce("score", F.lit(0)))


def distribution(df: DataFrame, score: str = "score") -> DataFrame:
    counts = df.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"))
    share = F.bround(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2)  # a row a score
    return counts.withColumn("percent", share).orderBy("score")  # a row a score


def accept(df: DataFrame, least: int) -> DataFrame:
    """Rows of at least this score; all rows when none has it."""
    good = F.coalesce("score", F.lit(0)) >= least
    any_good = df.agg(F.max(good.cast("int")).alias("_any"))  # one row
    return df.crossJoin(F.broadcast(any_good)).where(good | (F.coalesce("_any", F.lit(0)) == 0)).drop("_any")
