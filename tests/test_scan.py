"""Slices of long chats: the same rows as windows over whole chats, wherever they are cut."""

import random

import pytest
from pyspark.sql import functions as F

from dialoom.config import Config
from dialoom.functions import scan
from dialoom.operators import dialogue, merge
from dialoom.plans import make_dataset

PART = ["chat"]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(5)
    out = []
    for chat, n in [*((str(c), r.randint(1, 9)) for c in range(60)), ("long", 250), (None, 40)]:
        t = 0
        for k in range(n):
            t += r.choice([0, 30, 90, 200, 500, 4000])
            cut = r.random() < (0.02 if chat == "long" else 0.2)
            out.append((chat, k * 3, "cut" if cut else "text", r.randint(0, 1), r.choice(["a", "b", None]) if r.random() < 0.3 else "a", f"m{k}" + r.choice(["", ".", "<image>"]), "", t, r.choice([None, None, "image"])))
    df = spark.createDataFrame(out, "chat string, ord long, type_name string, is_sender int, talker string, msg string, src string, s long, modality string")
    df = df.withColumn("t", F.timestamp_seconds("s")).drop("s")
    return merge.mark_cuts(df, ["cut"]).cache()


def same(a, b):
    cols = sorted(set(a.columns) - {scan.SLICE})
    assert cols == sorted(set(b.columns) - {scan.SLICE})
    key = lambda df: sorted(map(str, df.select(*cols).collect()))
    x, y = key(a), key(b)
    assert x == y and len(x) > 20


@pytest.mark.parametrize("n", [1, 9])
def test_merge_and_classify_by_slices(rows, n):
    cut = scan.sliced(rows, PART, "ord", n)
    assert cut.select(scan.SLICE).distinct().count() == n
    whole, parts = merge.merge(rows, PART, 120), merge.merge(cut, PART, 120)
    same(whole, parts)
    same(dialogue.classify(whole, PART, 600), dialogue.classify(parts, PART, 600))
    same(dialogue.dialogues(dialogue.classify(whole, PART, 600), PART), dialogue.dialogues(dialogue.classify(parts, PART, 600), PART))


def test_any_slices_of_one_row_or_more(rows):
    """Slices of one row, empty slices between them."""
    mine = rows.where("chat = 'long' and ord < 200")
    cut = mine.withColumn(scan.SLICE, (F.col("ord") * 7).cast("int"))
    same(merge.merge(mine, PART, 120), merge.merge(cut, PART, 120))
    same(dialogue.classify(merge.merge(mine, PART, 120), PART, 600), dialogue.classify(merge.merge(cut, PART, 120), PART, 600))


def test_numbers_of_ranges(spark, rows):
    got = scan.numbered(rows.where("chat is not null"), ["chat", "ord"], n=9).select("chat", "ord", "nth").collect()
    want = sorted((r.chat, r.ord) for r in got)
    assert sorted((r.nth, r.chat, r.ord) for r in got) == [(k, *x) for k, x in enumerate(want)]
    assert scan.numbered(rows.where("false"), ["chat", "ord"]).count() == 0


def test_global_scope(rows):
    """One list of all chats, in slices, equals one window over it; no exchange to a single task."""
    cfg = Config(scope="global", language="en", single_combine_time_window=2, qa_match_time_window=10, slices=5)
    got = make_dataset.make_dataset(rows.drop("is_cut"), cfg)
    groups = merge.merge(merge.mark_cuts(make_dataset.load(rows.drop("is_cut"), cfg), cfg.cut_types()), PART, 120).withColumns({"_all": F.lit(0), "ord": F.struct("ord", "chat")})
    want = dialogue.keep(dialogue.dialogues(dialogue.classify(groups, ["_all"], 600), ["_all"]))
    key = lambda df: sorted(str(r) for r in df.select("first_ord", "turns", "time", "talker").collect())
    assert key(got) == key(want) and got.count() > 20
    ids = [r.id for r in got.orderBy("first_ord").collect()]
    assert ids == [str(k) for k in range(len(ids))]
    plan = got.select("id", "turns")._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Window [" in x and x.count("], [") < 2]  # each window has a partition


def test_config_slices_change_nothing(rows):
    cfg = Config(language="en", single_combine_time_window=2, qa_match_time_window=10)
    whole = make_dataset.make_dataset(rows.drop("is_cut"), cfg)
    parts = make_dataset.make_dataset(rows.drop("is_cut"), Config(language="en", single_combine_time_window=2, qa_match_time_window=10, slices=6))
    same(whole, parts)
