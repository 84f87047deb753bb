"""Registered queries of the chat engine over the driver's tables, one or more an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sinks
from ..config import Config
from ..functions import scan, stage
from ..operators import caption, dialogue, filters, merge, pii, report, rewrite, score, strategies, types
from ..providers import judged, length_judge
from ..schema import CUT, IMAGE_MARK, SKIP
from ..sources import adapters as a
from ..sources import telegram
from . import make_dataset

MERGE, MATCH = 600, 1800  # seconds
WORDS = ["tion", "GNU", "ß"]
EN_CUT, EN_SKIP = CUT["en"], SKIP["en"]


def _event_rows(spark, d):
    return merge.mark_cuts(filters.skip_types(a.events(spark, d), EN_SKIP), EN_CUT)


def _event_groups(spark, d):
    return merge.merge(_event_rows(spark, d), ["chat"], MERGE)


def _classified(spark, d):
    return dialogue.classify(_event_groups(spark, d), ["chat"], MATCH)


def _dialogues(spark, d):
    return dialogue.dialogues(_classified(spark, d), ["chat"])


def _talks(spark, d):
    rows = filters.skip_types(a.conversations(spark, d), EN_SKIP).withColumn("is_cut", F.lit(False)).withColumn("images", F.array().cast("array<string>"))
    return dialogue.dialogues(dialogue.classify(rows, ["chat"], 300), ["chat"])


def skip_type_filter(spark, d):
    return filters.skip_types(a.conversations(spark, d), EN_SKIP).groupBy("chat").agg(F.count("*").alias("n"))


def own_forward_filter(spark, d):
    return filters.own_forwards(a.events(spark, d)).groupBy("chat", "type_name").agg(F.count("*").alias("n"))


def text_predicate(spark, d):
    return a.events(spark, d).select("event_id", filters.is_text().alias("is_text"))


def blocked_word_filter(spark, d):
    return filters.blocked_words(a.documents(spark, d), WORDS).select("doc_id")


def blocked_word_list(spark, d):
    """Documents without a long word of the benchmark: a list of hundreds of words in one pass."""
    word = F.explode(F.split(F.coalesce("text", F.lit("")), " "))
    words = a.read(spark, d, "benchmark").select(word.alias("w")).where("length(w) >= 9").distinct()
    return filters.blocked_words(a.documents(spark, d), [r.w for r in words.collect()]).select("doc_id")


def _flagged(check):
    return lambda spark, d: a.documents(spark, d).where(check(F.col("msg"))).select("doc_id")


def pii_any_flag(spark, d):
    m = F.replace("msg", F.lit("\n"), F.lit(""))
    return a.documents(spark, d).select("doc_id", pii.has_pii(m, "zh").alias("has_pii"))


def pii_span_table(spark, d):
    rows = a.documents(spark, d).select("doc_id", F.explode(pii.spans(F.col("msg"))).alias("s"))
    return rows.select("doc_id", F.col("s.entity_type").alias("entity_type"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("stop"), F.col("s.text").alias("text"))


def pii_anonymize(spark, d):
    return a.documents(spark, d).select("doc_id", pii.anonymize(F.col("msg")).alias("text"))


def pii_any_flag_en(spark, d):
    return a.documents(spark, d).select("doc_id", pii.has_pii(F.col("msg"), "en").alias("has_pii"))


def cut_collapse(spark, d):
    rows = merge.groups(_event_rows(spark, d), ["chat"], MERGE)
    return rows.groupBy("chat").agg(F.sum(F.col("is_cut").cast("long")).alias("cuts"), F.count_distinct("gid").alias("items"))


def merge_consecutive(spark, d):
    return _event_groups(spark, d).select("chat", F.col("ord.event_id").alias("first_id"), F.col("n_rows").alias("n"), "is_cut", "is_sender", "talker", F.unix_micros("t").alias("last_us"), "msg")


def merge_truncate(spark, d):
    out = merge.merge(_event_rows(spark, d), ["chat"], MERGE, max_length=25)
    return out.select("chat", F.col("ord.event_id").alias("first_id"), "msg")


def qa_turns(spark, d):
    return dialogue.turns(_classified(spark, d)).select("chat", F.col("ord.event_id").alias("reply_id"), "question", F.col("msg").alias("answer"))


def _dialogue_rows(talks, *more):
    return talks.select(
        "chat", F.col("first_ord.event_id").alias("first_id"), F.size("turns").cast("long").alias("n_turns"), F.unix_micros("time").alias("time_us"), "talker",
        F.array_join(F.transform("turns", lambda t: F.concat(t["user"], F.lit(">"), t["assistant"])), "|").alias("text"), *more,
    )


def qa_dialogues(spark, d):
    return _dialogue_rows(_dialogues(spark, d))


def qa_sliced(spark, d):
    """The dialogues again, with each chat cut into slices of its order: what a chat of any length takes."""
    rows = scan.sliced(_event_rows(spark, d), ["chat"], "ord")
    return _dialogue_rows(dialogue.dialogues(dialogue.classify(merge.merge(rows, ["chat"], MERGE), ["chat"], MATCH), ["chat"]))


def qa_global(spark, d):
    """One list of all chats in time order, paired and numbered in slices."""
    groups = scan.sliced(_event_groups(spark, d).withColumns({"_all": F.lit(0), "ord": F.struct("ord", "chat")}), ["_all"], "ord")
    talks = dialogue.numbered(dialogue.dialogues(dialogue.classify(groups, ["_all"], MATCH), ["_all"]), ["_all"])
    return _dialogue_rows(talks.withColumns({"chat": F.lit(0).cast("long"), "first_ord": F.col("first_ord.ord")}), "id").drop("chat")


def qa_dropped_replies(spark, d):
    return _classified(spark, d).where("dropped").select("chat", F.col("ord.event_id").alias("reply_id"))


def qa_filters(spark, d):
    return dialogue.keep(_dialogues(spark, d), 120).select("chat", F.col("first_ord.event_id").alias("first_id"), dialogue.total_length().cast("long").alias("chars"))


def qa_system_prompt(spark, d):
    return _talks(spark, d).select("chat", dialogue.system_prompt("sys", F.col("time"), F.when(F.col("chat") % 3 == 0, "friend")).alias("system"))


def qa_begin_chat_rewrite(spark, d):
    rows = _dialogues(spark, d).select("chat", F.posexplode(dialogue.messages()).alias("pos", "m"), F.col("first_ord.event_id").alias("first_id"))
    return rows.select("chat", "first_id", F.col("pos").cast("long").alias("pos"), "m.role", "m.content")


def qa_numbered(spark, d):
    return dialogue.numbered(dialogue.keep(_dialogues(spark, d)), ["chat"]).select("id", "chat", F.col("first_ord.event_id").alias("first_id"))


def _pictured(spark, d):
    """Conversations in which every other message of the other side carries an image of its own."""
    shown = ((F.col("ord") + F.col("chat")) % 2 == 0) & (F.col("is_sender") == 0)
    rows = filters.skip_types(a.conversations(spark, d), EN_SKIP).withColumn("is_cut", F.lit(False))
    rows = rows.withColumns({
        "images": F.when(shown, F.array(F.concat(F.lit("img"), F.col("ord").cast("string")))).otherwise(F.array().cast("array<string>")),
        "msg": F.when(shown, F.concat(F.lit(IMAGE_MARK), "msg")).otherwise(F.col("msg")),
    })
    return dialogue.dialogues(dialogue.classify(rows, ["chat"], 300), ["chat"])


def image_count_filter(spark, d):
    """The image filter of the dialogues; the opener and length filters are wide open."""
    return dialogue.keep(_pictured(spark, d), 1 << 30, 1).select("chat", F.col("first_ord").alias("first_turn"), F.size("images").cast("long").alias("n"))


def caption_replace(spark, d):
    e = a.events(spark, d).select("event_id", F.concat("msg", F.repeat(F.lit(IMAGE_MARK + "b"), 2)).alias("msg"), "chat")
    return e.select("event_id", caption.fill(F.col("msg"), F.array(F.concat(F.lit("pic"), F.col("chat").cast("string")))).alias("text"))


def captioned_dialogues(spark, d):
    """Images described once each and joined back into their dialogues."""
    talks = _pictured(spark, d).withColumn("id", F.concat_ws(":", "chat", "seg", "conv"))
    images = talks.select(F.explode("images").alias("image"))
    out = caption.captioned(talks, caption.describe(images, lambda i: "seen " + i))
    return out.select("chat", F.col("first_ord").alias("first_turn"), F.array_join(F.transform("turns", lambda t: F.concat(t["user"], F.lit(">"), t["assistant"])), "|").alias("text"))


def captioned_sequence(spark, d):
    """Captions by one count over all dialogues; every fifth chat has lost its marks, so its images go to those that follow."""
    talks = _pictured(spark, d)
    unmarked = F.transform("turns", lambda t: F.struct(t["ord"].alias("ord"), F.replace(t["user"], F.lit(IMAGE_MARK), F.lit("")).alias("user"), t["assistant"].alias("assistant"), t["images"].alias("images")))
    talks = talks.withColumn("turns", F.when(F.col("chat") % 5 == 0, unmarked).otherwise(F.col("turns")))
    out = caption.captioned_in_sequence(talks, caption.describe(talks.select(F.explode("images").alias("image")), lambda i: "seen " + i), ["chat", "seg", "conv"])
    return out.select("chat", F.col("first_ord").alias("first_turn"), F.array_join(F.transform("turns", lambda t: F.concat(t["user"], F.lit(">"), t["assistant"])), "|").alias("text"))


def prompt_render(spark, d):
    return _talks(spark, d).select("chat", score.prompt(F.col("turns")).alias("prompt"))


def judge_parse(spark, d):
    e = a.events(spark, d)
    body = F.concat(F.lit('{"score": '), (F.col("event_id") % 8).cast("string"), F.lit("}"))
    reply = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("ok\n```json\n"), body, F.lit("\n```"))).otherwise(body)
    return e.select("event_id", score.parse_reply(reply).alias("score"))


def judge_flow(spark, d):
    """Prompts with ids, a judge's replies, scores keyed by the id that a reply names; images score 6, a lost reply 0."""
    talks = _pictured(spark, d).withColumn("id", F.concat_ws(":", "chat", "seg", "conv"))
    asked = talks.where(F.size("images") == 0).select("id", score.judge_prompt(F.col("id"), F.col("turns")).alias("prompt"))
    return score.judged_scores(talks, judged(asked, length_judge)).select("chat", F.col("first_ord").alias("first_turn"), F.col("score").cast("int").alias("score"))


def dataset_cleaned(spark, d):
    """The run to its end: dialogues are judged, stored as a dataset, read back, and those of score 4 and more stored and read again."""
    cfg = Config(language="en", enable_clean=True, accept_score=4)
    talks = _pictured(spark, d).withColumn("id", F.concat_ws(":", "chat", "seg", "conv"))
    names = {"talks": f"{stage.place(spark, 'datasets')}/talks.json"}
    names["talks-cleaned"] = names["talks"].replace("talks.json", "talks-cleaned.json")
    used = make_dataset.stored(make_dataset.finished(talks, cfg, judge=length_judge), cfg, names, "talks")
    return sinks.dataset(spark, names, used).select("id", "score", F.size("messages").cast("long").alias("n_messages"), F.array_join(F.transform("messages", lambda m: m["content"]), "\x1f").alias("contents"))


def array_export(spark, d):
    """The dialogues as one JSON array that many tasks write, read back item by item."""
    rows = dialogue.keep(_talks(spark, d), 1 << 30).withColumn("id", F.concat_ws(":", "chat", "seg", "conv"))
    names = {"talks": stage.place(spark, "array")}
    sinks.json_array(rows, names["talks"])
    return sinks.dataset(spark, names, "talks").select("id", "time", "score", F.size("messages").cast("long").alias("n_messages"), F.array_join(F.transform("messages", lambda m: m["content"]), "\x1f").alias("contents"), "system")


def capped_conversations(spark, d):
    """Conversations of at most six messages, by the history of each."""
    out = strategies.conversations(a.events(spark, d).select("chat", "ord"), strategies.MostMessages(6), ["chat"])
    return out.groupBy("chat", "conversation").agg(F.count("*").alias("n"), F.min("ord.event_id").alias("least_id"))


def _scored(spark, d):
    scores = a.read(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") * 2 + F.col("toxic")).alias("score"), F.lit(0).alias("arrival"))
    return score.join_scores(a.documents(spark, d).withColumnRenamed("doc_id", "id"), scores)


def score_join_default0(spark, d):
    return _scored(spark, d).select("id", "score")


def score_distribution(spark, d):
    return score.distribution(_scored(spark, d))


def accept_score(spark, d):
    return score.accept(_scored(spark, d), 2).select("id", "score")


def accept_fallback(spark, d):
    return score.accept(_scored(spark, d), 99).select("id", "score")


def length_histogram(spark, d):
    return report.histogram(a.documents(spark, d), F.length("msg"))


def length_cdf(spark, d):
    return report.cdf(a.documents(spark, d), F.length("msg"))


def token_length_cdf(spark, d):
    return report.cdf(a.documents(spark, d), report.token_length(F.col("msg")), 256)


def conversation_strategy(spark, d):
    """Sessions by a composite strategy: near in time and of one type."""
    both = strategies.Composite((strategies.TimeWindow(86400), strategies.SameField("type_name")))
    out = strategies.conversations(a.events(spark, d), both, ["chat"])
    return out.groupBy("chat").agg((F.max("conversation") + 1).cast("long").alias("conversations"), F.count("*").alias("n"))


def row_counts(spark, d):
    """Counts observed on the way of another job."""
    rows, seen = report.observed(a.events(spark, d), cuts=F.col("type_name") == "cut", own=F.col("is_sender") == 1)
    filters.own_forwards(rows).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(k, int(v)) for k, v in sorted(seen.get.items())], "name string, n long")


def type_translate(spark, d):
    return a.events(spark, d).select("event_id", types.chinese("type_name").alias("zh_cn"))


def translation_pair(spark, d):
    return types.translated(a.events(spark, d).groupBy("type_name").agg(F.count("*").alias("n"))).select("n", "en", "zh_cn")


def relation_lookup(spark, d):
    """The relation of a chat in its system prompt, looked up as the dataset plan does."""
    people = a.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("chat"), F.col("n_name").alias("relation"))
    talks = make_dataset.related(_talks(spark, d), people, "chat")
    return talks.select("chat", F.col("first_ord").alias("first_turn"), dialogue.system_prompt("sys", None, F.col("relation")).alias("system"))


def image_exists_lookup(spark, d):
    """Rows of images through the rewriting of types: those of known stems show their image, the others become cuts."""
    files = a.read(spark, d, "region").select(F.concat(F.lit("img"), F.col("r_regionkey").cast("string")).alias("stem"), F.concat(F.lit("images/img"), F.col("r_regionkey").cast("string"), F.lit(".png")).alias("image"))
    rows = a.events(spark, d).withColumns({
        "type_name": F.when(F.col("event_id") % 2 == 0, "image").otherwise("text"), "src": F.concat(F.lit("C:\\pics\\img"), (F.col("event_id") % 9).cast("string"), F.lit(".dat")),
    })
    return rewrite.non_text(rows, files).select("event_id", "type_name", "src", "msg", F.coalesce("modality", F.lit("")).alias("modality"))


def sharegpt_export(spark, d):
    rows = sinks.sharegpt(dialogue.keep(_talks(spark, d), 1 << 30).withColumn("id", F.concat_ws(":", "chat", "seg", "conv")))
    return rows.select("id", "time", "score", F.size("messages").cast("long").alias("n_messages"), F.array_join(F.transform("messages", lambda m: m["content"]), "\x1f").alias("contents"), "system")


def _export_messages(c):
    """Messages of an export from the conversations table: texts, photos with captions, stickers, files and places."""
    kind = F.col("turn") % 6
    place = F.struct(F.lit("1.5").alias("latitude"), F.lit("2.5").alias("longitude"))
    return F.struct(
        F.col("turn").alias("id"), F.lit("message").alias("type"), F.col("role").alias("from"), F.col("role").alias("from_id"),
        F.lit("2024-01-01T00:00:00.250").alias("date"), F.when(kind < 4, F.coalesce("text", F.lit(""))).otherwise("").alias("text"),
        F.when(kind == 1, "p.jpg").alias("photo"), F.when(kind == 2, "sticker").when(kind == 3, "video_file").alias("media_type"),
        F.when(kind.isin(2, 3, 4), "f.bin").alias("file"), F.when(kind == 4, "notes.txt").when(kind == 3, "v.mp4").alias("file_name"),
        F.when(kind == 5, place).alias("location_information"), F.when(kind == 5, "Here").alias("place_name"), F.when(kind == 5, "There").alias("address"),
        F.when(kind == 3, "x").alias("forwarded_from"),
    )


def _export_rows(rows):
    return rows.select("chat", F.col("id").cast("long").alias("id"), "type_name", "is_sender", "talker", "msg", "src", "is_forward", F.unix_micros("t").alias("t_us"))


def telegram_parse(spark, d):
    """Exports built from the conversations table, one text a conversation, parsed as JSON."""
    c = a.read(spark, d, "conversations")
    x = c.groupBy(F.col("conv_id").cast("string").alias("chat")).agg(F.array_sort(F.collect_list(_export_messages(c))).alias("messages"))
    x = x.select("chat", F.to_json(F.struct(F.col("chat").alias("name"), "messages")).alias("value"))
    return _export_rows(telegram.messages(x, "assistant"))


def telegram_files(spark, d):
    """The conversations table as eight export files, written by Spark line by line and read back by pieces."""
    c = a.read(spark, d, "conversations")
    line = F.to_json(_export_messages(c))
    rows = c.select(F.concat(F.lit("part "), (F.col("conv_id") % 8).cast("string")).alias("chat"), F.struct("conv_id", "turn").alias("at"), line.alias("line"))
    chats, none = rows.select("chat").distinct(), F.lit(None).cast("struct<conv_id:bigint,turn:bigint>")
    head = chats.select("chat", none.alias("at"), F.concat(F.lit('{"name": "'), F.col("chat"), F.lit('", "messages": [')).alias("line"))
    nth = F.row_number().over(Window.partitionBy("chat").orderBy("at"))  # the comma before all messages but the first
    rows = rows.withColumn("line", F.concat(F.when(nth > 1, ",").otherwise(""), "line"))
    tail = chats.select("chat", F.struct(F.lit((1 << 63) - 1).alias("conv_id"), F.lit(0).cast("long").alias("turn")).alias("at"), F.lit("]}").alias("line"))
    path = stage.place(spark, "export-files")
    (head.union(rows).union(tail).repartition(8, "chat").sortWithinPartitions("chat", F.asc_nulls_first("at")).select("chat", "line").write.partitionBy("chat").text(path))
    return _export_rows(telegram.read(spark, f"{path}/*/part-*", "assistant"))


QUERIES = {
    f.__name__: f
    for f in (
        skip_type_filter, own_forward_filter, text_predicate, blocked_word_filter, pii_any_flag, pii_span_table, pii_anonymize, cut_collapse,
        merge_consecutive, merge_truncate, qa_turns, qa_dialogues, qa_dropped_replies, qa_filters, qa_system_prompt, qa_begin_chat_rewrite,
        qa_numbered, image_count_filter, caption_replace, prompt_render, judge_parse, score_join_default0, score_distribution, accept_score,
        accept_fallback, length_histogram, length_cdf, type_translate, translation_pair, relation_lookup, image_exists_lookup, sharegpt_export,
        telegram_parse, pii_any_flag_en, captioned_dialogues, judge_flow, token_length_cdf, conversation_strategy, row_counts, qa_sliced, qa_global, telegram_files, blocked_word_list,
        dataset_cleaned, array_export, capped_conversations, captioned_sequence,
    )
} | {
    "pii_numeric_id": _flagged(pii.numeric_id), "pii_email": _flagged(pii.email), "pii_ipv4": _flagged(pii.ipv4), "pii_credit_card": _flagged(pii.card),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa_dialogues(spark, sf_dir)
