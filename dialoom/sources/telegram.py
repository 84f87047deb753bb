"""Nested JSON exports of a messenger, read with VARIANT: one row a message, captions split off, received images copied."""

from __future__ import annotations

import os
import shutil
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scan
from ..functions.stage import staged
from ..functions.text import basename, folder, parse_time, safe_name, strip
from . import json_parts

#: Media type to message type.
MEDIA = {
    "photo": "image", "video_file": "video", "animation": "video", "voice_message": "voice", "audio_file": "file", "sticker": "sticker",
    "file": "file", "location": "location", "poll": "(share) card link", "contact_information": "(share) card link",
}


def _text(v: str, path: str) -> Column:
    return F.try_variant_get(F.col(v), path, "string")


def message_text(field: Column) -> Column:
    """A string, or a list of strings and objects with text, joined; escaped quotes are removed."""
    parts = F.try_variant_get(field, "$", "array<variant>")
    one = F.coalesce(F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.try_variant_get(p, "$", "string"), F.lit(""))), ""), F.lit(""))
    plain = F.schema_of_variant(field).startswith("ARRAY")
    return F.replace(F.when(plain, one).otherwise(F.coalesce(F.try_variant_get(field, "$", "string"), F.lit(""))), F.lit('\\"'), F.lit(""))


def export_name(name: Column, kind: Column, id: Column) -> Column:
    """The folder of a chat: safe(name)-safe(type)-safe(id)."""
    return F.concat_ws("-", safe_name(F.coalesce(name, F.lit("Unknown"))), safe_name(F.coalesce(kind, F.lit("unknown"))), safe_name(F.coalesce(id, F.lit(""))))


def messages(exports: DataFrame, my_id: str, include_type: tuple[str, ...] = ("text",)) -> DataFrame:
    """exports: (chat, value: JSON text of a whole export). Rows as in a chat CSV; an export that is no JSON gives none."""
    v = exports.select("chat", F.try_parse_json("value").alias("v"))
    rows = v.select("chat", F.coalesce(_text("v", "$.name"), F.lit("Unknown Chat")).alias("room_name"), F.posexplode(F.try_variant_get("v", "$.messages", "array<variant>")).alias("pos", "m"))
    return chat_rows(rows, ["chat"], my_id, include_type)


def chat_rows(rows: DataFrame, part: list[str], my_id: str, include_type: tuple[str, ...] = ("text",)) -> DataFrame:
    """rows: (chat, room_name, pos, m: a message as VARIANT), pos in the order of a part; by slices if there are any.

    Ids run per part; a medium with a caption gives two rows. The medium's own row says its caption, else what stands for it
    (a file's name, a place, a sticker's emoji if stickers are included), else its type. Each kept message takes the next id,
    also one without text and source, which gives no row. A media type out of the list is type unknown.
    """
    rows = rows.where(_text("m", "$.type") == "message")
    media, photo, file, place = _text("m", "$.media_type"), _text("m", "$.photo"), _text("m", "$.file"), F.try_variant_get("m", "$.location_information", "variant")
    listed = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])
    kind = (
        F.when(media.isNotNull(), F.coalesce(F.try_element_at(listed, media), F.lit("unknown"))).when(photo.isNotNull(), "image").when(file.isNotNull(), "file")
        .when(place.isNotNull(), "location").otherwise("text")
    )
    number = lambda path: F.coalesce(_text("m", path), F.lit("0"))
    said = lambda path: F.coalesce(_text("m", path), F.lit(""))
    src = (
        F.when(media == "photo", photo).when(media.isNotNull(), file).when(photo.isNotNull(), photo).when(file.isNotNull(), file)
        .when(place.isNotNull(), F.concat(F.lit("lat:"), number("$.location_information.latitude"), F.lit(",lng:"), number("$.location_information.longitude")))
    )
    other = (
        F.when(media.isNotNull(), F.when((media == "sticker") & F.lit("sticker" in include_type), said("$.sticker_emoji"))).when(photo.isNotNull(), "")
        .when(file.isNotNull(), said("$.file_name")).when(place.isNotNull(), F.concat(said("$.place_name"), said("$.address")))
    )
    rows = rows.withColumns({"kind": kind, "text": message_text(F.try_variant_get("m", "$.text", "variant")), "src": F.coalesce(src, F.lit("")), "other": F.coalesce(other, F.lit(""))})
    caption = (F.col("kind") != "text") & (strip("text") != "")
    takes = 1 + caption.cast("int")
    if scan.SLICE in rows.columns:
        rows = scan.running(rows, part, "pos", {"first_id": takes}).withColumn("first_id", F.col("first_id") + 1 - takes)
    else:
        before = Window.partitionBy(*part).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("first_id", 1 + F.coalesce(F.sum(takes).over(before), F.lit(0)))
    clean = lambda c: strip(F.replace(strip(c), F.lit("\n"), F.lit(" ")))
    body = clean(F.when(strip("text") != "", F.col("text")).otherwise(F.col("other")))
    main = F.when((body != "") | (strip("src") != ""), F.struct(F.col("first_id").alias("id"), F.col("kind").alias("type_name"), F.when(body == "", F.col("kind")).otherwise(body).alias("msg"), "src"))
    second = F.when(caption, F.struct((F.col("first_id") + 1).alias("id"), F.lit("text").alias("type_name"), clean(F.col("text")).alias("msg"), F.lit("").alias("src")))
    return rows.select(
        "chat", "room_name", _text("m", "$.id").alias("MsgSvrID"), said("$.from").alias("talker"),
        F.coalesce(_text("m", "$.from_id") == my_id, F.lit(False)).cast("int").alias("is_sender"), F.replace(_text("m", "$.date"), F.lit("Z"), F.lit("")).alias("CreateTime"),
        F.try_variant_get("m", "$.forwarded_from", "variant").isNotNull().alias("is_forward"), F.explode(F.filter(F.array(main, second), lambda x: x.isNotNull())).alias("x"),
    ).select("*", "x.*").drop("x").withColumns({"t": parse_time("CreateTime"), "ord": F.col("id")})


def read(spark: SparkSession, path: str, my_id: str, include_type: tuple[str, ...] = ("text",)) -> DataFrame:
    """All ``<root>/<folder>/result.json`` of any size, in parallel also inside a file; a broken export gives no row.

    A chat is named as ``export_name`` says, by its folder if the export has no id.
    """
    rows, reports = exports(spark, path)
    good = reports.where("error is null").drop("error", "messages")
    rows = rows.join(good, "file").select("file", scan.SLICE, "chat", "room_name", "pos", F.try_parse_json("value").alias("m"))
    return chat_rows(rows, ["file"], my_id, include_type)


def exports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, pos, value) of the messages; (file, chat, room_name, messages, error) of the exports, good or broken."""
    items, heads = json_parts.elements(spark, path, "messages")
    items = staged(items, "messages")
    counts = items.groupBy("file").agg(F.count("*").alias("messages"), F.count_if(F.try_parse_json("value").isNull()).alias("bad"))
    v = scan.attach(heads, counts, ["file"]).withColumn("v", F.try_parse_json("head"))
    named = F.when(_text("v", "$.id").isNull(), folder("file")).otherwise(export_name(_text("v", "$.name"), _text("v", "$.type"), _text("v", "$.id")))
    error = F.coalesce("error", F.when(F.col("bad") > 0, F.concat(F.col("bad").cast("string"), F.lit(" messages are no JSON"))))
    reports = v.select("file", named.alias("chat"), F.coalesce(_text("v", "$.name"), F.lit("Unknown Chat")).alias("room_name"), F.coalesce("messages", F.lit(0)).alias("messages"), error.alias("error"))
    return items, staged(reports, "exports")


def received_images(df: DataFrame) -> DataFrame:
    """(src, name): files of images that the other side sent; the name each is kept under."""
    return df.where("is_sender = 0 and type_name = 'image' and src <> ''").select("src", basename("src").alias("name")).distinct()


def copy_images(df: DataFrame, base: str, target: str) -> DataFrame:
    """Copy the received images of df from ``base`` to ``target``, both folders that all executors see; (src, copied)."""

    def run(batches):
        os.makedirs(target, exist_ok=True)
        for x in batches:
            done = []
            for src, name in zip(x.src, x.name, strict=True):
                path = os.path.join(base, src.replace("\\", "/"))
                done.append(os.path.exists(path))
                if done[-1]:  # under a name of its own first, so that a repeated task leaves no half file
                    part = os.path.join(target, f".{uuid.uuid4().hex}")
                    shutil.copy2(path, part)
                    os.replace(part, os.path.join(target, name))
            yield pd.DataFrame({"src": x.src, "copied": done})

    return received_images(df).mapInPandas(run, "src string, copied boolean")
