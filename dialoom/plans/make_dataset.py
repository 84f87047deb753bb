"""The whole dataset plan: chat rows in, filtered dialogues out; one exchange on the chat key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..config import Config
from ..functions import scan
from ..functions.stage import staged
from ..operators import caption, dialogue, filters, merge, rewrite, score
from ..providers import ONLINE, VISION, Calls, Judge, judged


def load(rows: DataFrame, cfg: Config, images: DataFrame | None = None) -> DataFrame:
    """Type, forward, word and personal-data filters, then the rewriting of other types."""
    if cfg.strict_types:
        rows = rows.where(F.col("type_name").isin(cfg.known_types()))
    rows = filters.own_forwards(filters.skip_types(rows, cfg.skip_types()))
    rows = filters.personal_data(filters.blocked_words(rows, list(cfg.blocked_words)), cfg.language)
    gif = "动画表情" if cfg.platform == "chat" else "sticker"
    return rewrite.non_text(rows, images, gif)


def related(talks: DataFrame, relations: DataFrame, key: str = "talker") -> DataFrame:
    """Dialogues with the relation (null if unknown) of their talker."""
    return talks.join(relations.select(F.col("chat").alias(key), "relation"), key, "left")


def make_dataset(rows: DataFrame, cfg: Config, images: DataFrame | None = None, relations: DataFrame | None = None) -> DataFrame:
    part = ["chat", "file"] if "file" in rows.columns else ["chat"]
    rows = merge.mark_cuts(load(rows, cfg, images), cfg.cut_types())
    if cfg.slices:  # long chats: each is cut into slices of its order
        rows = scan.sliced(rows, part, "ord", cfg.slices)
    groups = merge.merge(rows, part, cfg.single_combine_time_window * 60, cfg.combine_msg_max_length)
    key = ["chat"]
    if cfg.scope == "global":  # as over one concatenated list, in slices of it
        groups, key = scan.sliced(groups.drop(scan.SLICE).withColumns({"_all": F.lit(0), "ord": F.struct("ord", "chat")}), ["_all"], "ord", cfg.slices or None), ["_all"]
    talks = dialogue.dialogues(dialogue.classify(groups, key, cfg.qa_match_time_window * 60), key)
    talks = dialogue.keep(talks, cfg.messages_max_length, cfg.max_image_num)
    relation = None
    if cfg.add_relation and relations is not None:
        talks = related(talks, relations)
        relation = F.col("relation")
    talks = talks.withColumn("system", dialogue.system_prompt(cfg.system_prompt, F.col("time") if cfg.add_time else None, relation))
    return dialogue.numbered(talks, key)


def finished(talks: DataFrame, cfg: Config, captioner: Callable[[str], str] | None = None, judge: Judge | None = None, calls: Calls | None = None) -> DataFrame:
    """Dialogues with captions in place of images, and with a judge's scores where the settings say so."""
    if captioner is not None:
        images = talks.select(F.explode("images").alias("image"))
        talks = caption.captioned(talks, caption.describe(images, captioner, calls or Calls(retry=VISION)))
    if not cfg.enable_clean:
        return talks
    if judge is None:
        raise ValueError("enable_clean needs a judge")
    asked = talks.where(F.size("images") == 0).select(F.col("id").cast("string").alias("id"), score.judge_prompt(F.col("id"), F.col("turns")).alias("prompt"))
    replies = staged(judged(asked, judge, cfg.clean_batch_size, ONLINE, calls), "replies")  # no prompt is asked twice for one run
    return score.judged_scores(talks, replies)


def stored(talks: DataFrame, cfg: Config, registry: str | dict[str, str], name: str, array: bool = False) -> str:
    """Write dialogues as a registered dataset, and their accepted ones as its cleaned form if the settings say so; the name to use."""
    (sinks.json_array if array else sinks.json_lines)(talks, sinks.registry(registry)[name])
    return cleaned(talks.sparkSession, cfg, registry, name, array) if cfg.enable_clean else name


def cleaned(spark: SparkSession, cfg: Config, registry: str | dict[str, str], name: str, array: bool = False) -> str:
    """Clean a stored dataset by the scores in it; the name of what is to be used."""
    return sinks.cleaned(sinks.dataset(spark, registry, name), registry, name, cfg.accept_score, array)


def run(
    rows: DataFrame, cfg: Config, registry: str | dict[str, str], name: str, images: DataFrame | None = None, relations: DataFrame | None = None,
    captioner: Callable[[str], str] | None = None, judge: Judge | None = None, calls: Calls | None = None,
) -> str:
    """The whole run: chat rows to dialogues, captions, scores, the stored dataset and its cleaned form; the name to use."""
    talks = finished(make_dataset(rows, cfg, images, relations), cfg, captioner, judge, calls)
    return stored(talks, cfg, registry, cfg.dataset_name(name))
