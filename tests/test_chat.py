"""Sources, sinks and operators of the chat engine on small files of our own."""

import base64
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from dialoom import sinks
from dialoom.config import Config
from dialoom.operators import caption, dialogue, filters, merge, pii, report, score, strategies, types
from dialoom.plans import make_dataset
from dialoom.providers import AGGRESSIVE, API, CONSERVATIVE, Calls, Retry, judged, length_judge, scripted
from dialoom.schema import CUT
from dialoom.sources import csv_chat, media, telegram

HEAD = "id,MsgSvrID,type_name,is_sender,talker,room_name,msg,src,CreateTime"


def csv_rows(rows):
    """(type, sender, message, minute) to CSV lines."""
    out = [HEAD]
    for k, (kind, me, msg, minute) in enumerate(rows):
        said = '"' + msg.replace('"', '""') + '"'
        out.append(f"{k},00{k},{kind},{me},{'me' if me else 'pal'},room,{said},C:\\pics\\img{k}.dat,2024/1/2 {10 + minute // 60}:{minute % 60:02d}")
    return "\n".join(out) + "\n"


@pytest.fixture(scope="module")
def export(tmp_path_factory):
    root = tmp_path_factory.mktemp("csv")
    chat = root / "张 三+x"
    chat.mkdir()
    (chat / "张 三_0_730.csv").write_text(csv_rows([
        ("文本", 0, "are you there?", 0), ("文本", 0, "hello", 1), ("文本", 1, 'yes, "here"\nand now', 2), ("系统通知", 1, "left", 3), ("动画表情", 0, "[s]", 4),
        ("文本", 0, "what is new", 30), ("文本", 1, "hh nothing", 31), ("文本", 1, "all well", 32), ("视频", 0, "v", 33), ("视频", 0, "v", 34), ("文本", 1, "alone", 60),
        ("文本", 0, "call 13800138000", 70), ("文本", 0, "later", 71), ("文本", 1, "ok", 72),
    ]), encoding="utf-8")
    (chat / "users.json").write_text(json.dumps({"relation": "friend"}))
    return str(root)


def test_csv_to_dialogues(spark, export):
    """Skip types, words, personal data, cuts, merging and pairing, stage by stage."""
    rows = csv_chat.chat_csv(spark, f"{export}/*/*.csv")
    assert rows.count() == 14 and {r.chat for r in rows.select("chat").distinct().collect()} == {"张 三+x"}
    cfg = Config(blocked_words=("hh",), single_combine_time_window=2, qa_match_time_window=5, add_relation=True, system_prompt="s")
    kept = make_dataset.load(rows, cfg)
    assert kept.count() == 10  # less two of skipped types, one of a blocked word, one of a number
    people = csv_chat.relations(spark, f"{export}/*/users.json").withColumn("chat", F.lit("pal"))
    got = make_dataset.make_dataset(rows, cfg, relations=people).orderBy("id").collect()
    text = [[(t.user, t.assistant) for t in r.turns] for r in got]
    assert text == [[("are you there?hello", 'yes, "here"\nand now')], [("what is new", "all well")], [("later", "ok")]]
    assert [r.id for r in got] == ["0", "1", "2"] and all("friend" in r.system for r in got)
    assert not any("hh" in m for r in text for t in r for m in t)


def test_csv_header_is_checked(spark, tmp_path):
    def write(name, head, line):
        (tmp_path / name / "c").mkdir(parents=True)
        (tmp_path / name / "c" / "c_0_1.csv").write_text(f"{head}\n{line}\n")
        return csv_chat.chat_csv(spark, str(tmp_path / name / "*" / "*.csv"))

    swapped = HEAD.replace("id,MsgSvrID", "MsgSvrID,id") + ",is_forward"
    row = write("a", swapped, "007,5,text,1,me,r,hi,,2024-01-01 10:00:00.5,True").first()
    assert (row.id, row.MsgSvrID, row.is_forward, row.t.microsecond) == (5, "007", True, 500000)
    assert filters.own_forwards(write("b", swapped, "007,5,text,1,me,r,hi,,2024-01-01 10:00:00,True")).count() == 0
    for name, head in (("d", HEAD.replace(",msg", ",text")), ("e", HEAD.replace(",src", ""))):
        with pytest.raises(ValueError, match="columns"):
            write(name, head, "1,2,text,1,me,r,hi,,x")


def test_csv_round_trip(spark, export, tmp_path):
    rows = csv_chat.chat_csv(spark, f"{export}/*/*.csv")
    sinks.chat_csv(rows, str(tmp_path / "out"))
    again = csv_chat.chat_csv(spark, str(tmp_path / "out" / "*" / "*.csv"))
    key = ["chat", *sinks.CSV_COLUMNS]
    assert sorted(map(tuple, again.select(key).collect())) == sorted(map(tuple, rows.select(key).collect()))


def message(id, **fields):
    return {"id": id, "type": "message", "from": "Pal", "from_id": "user2", "date": "2024-01-02T03:04:05", **fields}


EXPORT = {
    "name": "P Q", "type": "personal_chat", "id": 77, "messages": [
        message(1, text="a\nb"), message(2, text=["see ", {"type": "link", "text": "x.org"}, "!"], from_id="user1"), message(3, text="look", photo="p/1.jpg"),
        message(4, text="", photo="p/2.jpg"), message(5, media_type="photo", photo="p/3.jpg"), message(6, media_type="sticker", file="s.webp", sticker_emoji=":)", text=""),
        message(7, file="doc.pdf", file_name="doc.pdf", text=""), message(8, media_type="video_file", file="v.mp4", file_name="v.mp4", text="clip"),
        message(9, location_information={"latitude": 1.5, "longitude": 2.5}, place_name="Inn", address="Road 1", text=""), message(10, text="fw", forwarded_from="Z"),
        {"id": 11, "type": "service", "text": "joined"}, message(12, text="   "), message(13, media_type="brand_new", file="n.bin", text=""),
        message(14, text="when", date="no date"), message(15, media_type="poll", text="vote"),
    ],
}


def test_messenger_export(spark, tmp_path):
    (tmp_path / "ChatExport").mkdir()
    (tmp_path / "ChatExport" / "result.json").write_text(json.dumps(EXPORT))
    rows = telegram.read(spark, str(tmp_path / "*" / "result.json"), "user1").orderBy("id").collect()
    assert {(r.chat, r.room_name) for r in rows} == {("PQ-personal_chat-77", "P Q")}
    assert [(r.id, r.MsgSvrID, r.type_name, r.is_sender, r.msg, r.src) for r in rows] == [
        (1, "1", "text", 0, "a b", ""), (2, "2", "text", 1, "see x.org!", ""), (3, "3", "image", 0, "look", "p/1.jpg"), (4, "3", "text", 0, "look", ""),
        (5, "4", "image", 0, "image", "p/2.jpg"), (6, "5", "image", 0, "image", "p/3.jpg"), (7, "6", "sticker", 0, "sticker", "s.webp"), (8, "7", "file", 0, "doc.pdf", "doc.pdf"),
        (9, "8", "video", 0, "clip", "v.mp4"), (10, "8", "text", 0, "clip", ""), (11, "9", "location", 0, "InnRoad 1", "lat:1.5,lng:2.5"), (12, "10", "text", 0, "fw", ""),
        (14, "13", "unknown", 0, "unknown", "n.bin"), (15, "14", "text", 0, "when", ""), (16, "15", "(share) card link", 0, "vote", ""), (17, "15", "text", 0, "vote", ""),
    ]
    assert [r.MsgSvrID for r in rows if r.is_forward] == ["10"] and [r.MsgSvrID for r in rows if r.t is None] == ["14"]
    shown = telegram.read(spark, str(tmp_path / "*" / "result.json"), "user1", ("text", "sticker"))
    assert shown.where("MsgSvrID = '6'").first().msg == ":)"


def test_received_images_are_copied(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1.jpg").write_bytes(b"x")
    rows = spark.createDataFrame([(0, "image", "p/1.jpg"), (0, "image", "p/gone.jpg"), (1, "image", "p/1.jpg"), (0, "text", "p/1.jpg")], "is_sender int, type_name string, src string")
    got = {(r.src, r.copied) for r in telegram.copy_images(rows, str(tmp_path), str(tmp_path / "out")).collect()}
    assert got == {("p/1.jpg", True), ("p/gone.jpg", False)} and (tmp_path / "out" / "1.jpg").read_bytes() == b"x"


def test_spans_of_every_match(spark):
    text = "a@b.co x a@b.co 11.2.3.45 1.2.3.4, 4111 1111 1111 1111 GB82WEST12345698765432 我a@b.co 123-45-6789"
    df = spark.createDataFrame([(text,)], "t string")
    got = [(s.entity_type, s.start, s.end) for s in df.select(pii.spans(F.col("t"), ("EMAIL_ADDRESS", "IP_ADDRESS", "CREDIT_CARD", "IBAN_CODE", "US_SSN")).alias("s")).first().s]
    at = lambda x, k=0: (text.index(x, k), text.index(x, k) + len(x))
    assert got == [
        ("EMAIL_ADDRESS", *at("a@b.co")), ("EMAIL_ADDRESS", *at("a@b.co", 3)), ("IP_ADDRESS", *at("11.2.3.45")), ("IP_ADDRESS", *at("1.2.3.4,")[:1], at("1.2.3.4,")[1] - 1),
        ("CREDIT_CARD", *at("4111 1111 1111 1111")), ("IBAN_CODE", *at("GB82WEST12345698765432")), ("US_SSN", *at("123-45-6789")),
    ]
    clean = df.select(pii.anonymize(F.col("t"), ("EMAIL_ADDRESS", "IP_ADDRESS", "CREDIT_CARD", "IBAN_CODE", "US_SSN")).alias("x")).first().x
    assert clean == "<EMAIL_ADDRESS> x <EMAIL_ADDRESS> <IP_ADDRESS> <IP_ADDRESS>, <CREDIT_CARD> <IBAN_CODE> 我a@b.co <US_SSN>"
    assert "US_SSN" not in pii.entities("zh") and "US_SSN" in pii.entities("en") and pii.model_language("xx") == "en"
    flags = spark.createDataFrame([("mail a@b.co",), ("host 10.0.0.1",), ("nothing",), (None,)], "t string").select(pii.has_pii(F.col("t"), "en").alias("f")).collect()
    assert [bool(r.f) for r in flags] == [True, True, False, False]


def test_judge_flow(spark):
    rows = [("1", ["i"], "q1"), ("2", [], "q2"), ("3", [], "q3"), ("4", [], "q4")]
    talks = spark.createDataFrame([(i, im, [(q, "a")]) for i, im, q in rows], "id string, images array<string>, turns array<struct<user:string,assistant:string>>")
    replies = spark.createDataFrame([("9", '{"id": "2", "score": 4}'), ("3", "no json"), ("4", '```json\n{"id": "4", "score": 7}\n```')], "id string, reply string")
    assert {r.id: r.score for r in score.judged_scores(talks, replies).collect()} == {"1": 6, "2": 4, "3": 0, "4": 0}
    assert {r.id: r.score for r in score.judged_scores(talks, replies, compat=True).collect()}["1"] == 0
    assert {r.id for r in score.incomplete(talks, replies).collect()} == {"3", "4"}
    asked = talks.select("id", score.judge_prompt(F.col("id"), F.col("turns")).alias("prompt"))
    assert asked.where("id = '2'").first().prompt == score.TEMPLATE.format(id="2", chat="Q: q2\nA: a")
    assert all(json.loads(r.reply)["id"] == r.id for r in judged(asked, length_judge).collect())


def test_captions_go_to_their_turns(spark):
    turns = [("a", "<image>x<image>", "one"), ("b", "y", "<image>two")]
    df = spark.createDataFrame([("1", ["i1", "i2", "i3"], [(o, u, s, []) for o, u, s in turns]), ("2", [], [("a", "q", "r", [])])], "id string, images array<string>, turns array<struct<ord:string,user:string,assistant:string,images:array<string>>>")

    def see(image):
        if image == "i2":
            raise FileNotFoundError(image)
        if image == "i3":
            raise ValueError("bad")
        return "seen"

    got = {r.id: [(t.user, t.assistant) for t in r.turns] for r in caption.captioned(df, caption.describe(df.select(F.explode("images").alias("image")), see)).collect()}
    box = "\n[图片描述: {}]\n".format
    assert got == {"1": [(box("seen") + "x" + box(caption.MISSING), "one"), ("y", box("[图片描述失败: bad]") + "two")], "2": [("q", "r")]}


def test_strategies(spark):
    rows = spark.createDataFrame([("c", k, t, w) for k, (t, w) in enumerate([(0, "a"), (50, "a"), (90, "b"), (400, "b"), (410, "b")])], "chat string, ord int, s long, talker string")
    rows = rows.withColumn("t", F.timestamp_seconds("s"))
    near, same = strategies.TimeWindow(60), strategies.SameField("talker")
    for strategy, want in ((near, [0, 0, 0, 1, 1]), (strategies.Composite((near, same)), [0, 0, 1, 2, 2]), (strategies.Composite((near, same), require_all=False), [0] * 5)):
        assert [r.conversation for r in strategies.conversations(rows, strategy, ["chat"]).orderBy("ord").collect()] == want


def test_retries():
    class Gone(Exception):
        status_code = 404

    calls, pauses = [], []

    def flaky(e, ok_at):
        calls.append(1)
        if len(calls) < ok_at:
            raise e
        return "ok"

    assert Retry(tries=3).call(flaky, ConnectionError(), 3, sleep=pauses.append) == "ok" and len(pauses) == 2
    calls.clear()
    with pytest.raises(Gone):
        Retry(tries=3).call(flaky, Gone(), 3, sleep=pauses.append)
    assert len(calls) == 1
    assert [(r.tries, r.base, r.factor, r.longest) for r in (AGGRESSIVE, CONSERVATIVE, API)] == [(5, 0.5, 1.5, 30), (2, 2, 2, 10), (3, 1, 2, 60)]


def test_datasets(spark, tmp_path):
    talks = spark.createDataFrame([(k, s, f"q{k}", f"a{k}") for k, s in enumerate([5, 1, 3])], "id int, score int, u string, a string").select(
        "id", "score", F.to_timestamp(F.lit("2024-01-01 10:00:00")).alias("time"), F.array(F.struct(F.lit(1).alias("ord"), F.col("u").alias("user"), F.col("a").alias("assistant"))).alias("turns"),
        F.array().cast("array<string>").alias("images"), F.lit("").alias("system"),
    )
    (tmp_path / "info.json").write_text(json.dumps({"mine": {"file_name": "mine.json"}}))
    folder, file, registry = str(tmp_path / "mine.json"), tmp_path / "one.json", str(tmp_path / "info.json")
    sinks.json_array(talks.repartition(3), folder)
    sinks.joined(spark, folder, str(file))
    got = json.loads(file.read_text())
    assert [(r["id"], r["time"], [m["content"] for m in r["messages"]]) for r in got] == [(str(k), "2024-01-01T10:00:00", [f"q{k}", f"a{k}"]) for k in range(3)]
    stored = sinks.dataset(spark, registry, "mine")
    assert sorted((r.id, r.score, r.messages[1].content) for r in stored.collect()) == [("0", 5, "a0"), ("1", 1, "a1"), ("2", 3, "a2")]
    # a stored dataset is cleaned; with nothing left it keeps its name and no file is written
    assert sinks.cleaned(stored, registry, "mine", 9) == "mine" and not (tmp_path / "mine-cleaned.json").exists()
    assert sinks.cleaned(stored, registry, "mine", 3) == "mine-cleaned"
    again = sinks.dataset(spark, {"c": str(tmp_path / "mine-cleaned.json")}, "c")
    assert sorted(r.id for r in again.collect()) == ["0", "2"]
    pretty = tmp_path / "pretty.json"
    pretty.write_text(json.dumps(got, indent=4))
    assert sorted(r.id for r in sinks.dataset(spark, {"p": str(pretty)}, "p").collect()) == ["0", "1", "2"]
    pretty.write_text(json.dumps(got))
    assert sinks.dataset(spark, {"p": str(pretty)}, "p").count() == 3
    # ids that are no numbers, many of them, and none
    many = talks.crossJoin(spark.range(40).withColumnRenamed("id", "n")).withColumn("id", F.concat_ws(":", "n", "id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts stay
    sinks.json_array(many, str(tmp_path / "many"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sinks.joined(spark, str(tmp_path / "many"), str(file))
    ids = [r["id"] for r in json.loads(file.read_text())]
    assert ids == sorted(ids) and len(ids) == 120 and len([p for p in (tmp_path / "many").iterdir() if p.name.startswith("part")]) > 1
    sinks.json_array(talks.limit(0), str(tmp_path / "none"))
    sinks.joined(spark, str(tmp_path / "none"), str(file))
    assert json.loads(file.read_text()) == [] and sinks.dataset(spark, {"n": str(tmp_path / "none")}, "n").count() == 0


def test_run_to_its_end(spark, export, tmp_path):
    """Chat rows to a stored dataset and its cleaned form, by the settings."""
    rows = csv_chat.chat_csv(spark, f"{export}/*/*.csv").withColumn("src", F.lit(""))  # a text's source would count as an image
    cfg = Config(blocked_words=("hh",), enable_clean=True, accept_score=4, clean_batch_size=2)
    names = {"sft": str(tmp_path / "sft.json")}
    with pytest.raises(ValueError, match="judge"):
        make_dataset.run(rows, cfg, names, "sft")
    grade = lambda prompts: [json.dumps({"score": 5 if "later" in p else 1}) for p in prompts]
    assert make_dataset.run(rows, cfg, names, "sft", judge=grade) == "sft-cleaned"
    assert sorted((r.id, r.score) for r in sinks.dataset(spark, names, "sft").collect()) == [("0", 1), ("1", 1), ("2", 5)]
    assert [r.messages[0].content for r in sinks.dataset(spark, {"c": sinks.cleaned_path(names, "sft")}, "c").collect()] == ["later"]
    none = {"sft": str(tmp_path / "other.json")}
    assert make_dataset.run(rows, Config(), none, "sft") == "sft" and sinks.dataset(spark, none, "sft").first().score == 0
    odd = rows.withColumn("type_name", F.when(F.col("id") == 0, "odd").otherwise(F.col("type_name")))
    assert make_dataset.load(odd, Config(strict_types=True)).count() == make_dataset.load(odd, Config()).count() - 1


def test_no_finished_prompt_is_asked_twice(spark, tmp_path):
    """A worker dies in the middle; the next run asks only what has no reply in the log. Calls overlap, order stays."""
    asked, log = str(tmp_path / "asked"), str(tmp_path / "log")
    df = spark.range(24).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("prompt "), "id").alias("prompt")).coalesce(1)

    def judge(die):
        def call(prompts):
            if die and "prompt 13" in prompts:
                time.sleep(0.5)
                os._exit(1)
            with open(asked, "a") as f:
                f.write("".join(p + "\n" for p in prompts))
            return [p.upper() for p in prompts]

        return call

    calls = Calls(workers=3, log=log, retry=Retry(0))
    with pytest.raises(Exception):  # noqa: B017, PT011
        judged(df, judge(True), 2, calls=calls).collect()
    first = open(asked).read().split("\n")[:-1]
    assert 6 <= len(first) < 24
    got = judged(df, judge(False), 2, calls=calls).collect()
    assert [(r.id, r.reply) for r in got] == [(str(k), f"PROMPT {k}") for k in range(24)]
    every = open(asked).read().split("\n")[:-1]
    assert sorted(every) == sorted(f"prompt {k}" for k in range(24))


def test_calls_of_a_model(spark):
    df = spark.range(6).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("p"), "id").alias("prompt")).coalesce(1)
    got = judged(df, lambda prompts: prompts[1:] if "p2" in prompts else prompts, 2, Retry(0)).collect()  # too few replies
    assert [r.reply for r in got] == ["p0", "p1", None, None, "p4", "p5"]
    began = time.monotonic()
    paced = judged(df, lambda prompts: prompts, 1, calls=Calls(workers=4, tasks=1, per_second=10)).collect()
    assert sorted(r.reply for r in paced) == [f"p{k}" for k in range(6)] and time.monotonic() - began >= 0.5
    images = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "image string")

    def see(image):
        if image != "a":
            raise FileNotFoundError if image == "b" else ValueError("dark")
        return "seen"

    assert {r.image: r.caption for r in caption.describe(images, see).collect()} == {"a": "seen", "b": caption.MISSING, "c": "[图片描述失败: dark]"}


def test_strategies_over_the_history(spark):
    r = random.Random(3)
    rows = [(str(c) if c else None, k, 0, r.randrange(0, 5000)) for c in range(8) for k in range(r.choice([1, 30, 200]))]
    df = spark.createDataFrame(rows, "chat string, ord long, conversation_ int, s int").withColumn("t", F.timestamp_seconds(F.col("ord") * 60 + F.col("s") % 50)).repartition(3)
    want = {}
    for c, k, _, s in sorted(rows, key=lambda x: (str(x[0]), x[1])):
        t = k * 60 + s % 50
        n, first = want.get(c, [None])[-1] or (0, t) if c in want else (0, t)
        if abs(t - first) > 600:
            n, first = n + 1, t
        want.setdefault(c, []).append((n, first))
    got = {}
    for x in strategies.conversations(df, strategies.TotalSpan(600), ["chat"]).orderBy("ord").collect():
        got.setdefault(x.chat, []).append(x.conversation)
    assert got == {c: [n for n, _ in v] for c, v in want.items()}
    most = strategies.conversations(df, strategies.MostMessages(7), ["chat"]).groupBy("chat", "conversation").count()
    assert most.agg(F.max("count")).first()[0] == 7 and strategies.conversations(df.where("false"), strategies.MostMessages(2), ["chat"]).count() == 0


def test_type_names(spark):
    df = spark.createDataFrame([("Video",), ("视频",), ("odd",), (None,)], "type_name string")
    assert [(r.en, r.zh_cn) for r in types.translated(df).collect()] == [("video", "视频"), ("video", "视频"), (None, None), (None, None)]


def test_scripts_and_transcripts(spark, tmp_path):
    """Questions of a script, asked with their history; a failed one leaves it; a transcript of each dialogue."""
    (tmp_path / "script.json").write_text(json.dumps({"questions": [["one", "two", "bad", "three"], ["only"]]}))
    questions = csv_chat.questions(spark, str(tmp_path / "script.json"))
    assert questions.count() == 5

    def answer(history):
        if history[-1]["content"] == "bad":
            raise ValueError
        return f"{len(history)}:{history[-1]['content']}"

    got = {}
    said = scripted(questions, answer)
    for r in said.orderBy("dialogue", "pos").collect():
        got.setdefault(r.dialogue, []).append((r.role[0], r.content))
    asked = [m for r in got[0] for m in [r[1]]]
    assert got[1] == [("u", "only"), ("a", "1:only")]
    assert asked[:4] == ["one", "1:one", "two", "3:two"] and asked[-1].endswith(":three") and "5:bad" not in asked
    sinks.transcript(said, str(tmp_path / "out"))
    lines = sorted("".join(p.read_text() for p in (tmp_path / "out").iterdir() if p.name.startswith("part")).split("\n\n"))
    assert "only\n1:only" in [x.strip("\n") for x in lines]


def test_images_and_their_bytes(spark, tmp_path):
    for name, body in (("a.jpg", b"1"), ("a.png", b"2"), ("b.PNG", b"\x00\xff")):
        (tmp_path / name).write_bytes(body)
    assert {(r.stem, r.image) for r in media.listing(spark, str(tmp_path)).collect()} == {("a", "images/a.jpg"), ("b", "images/b.PNG")}
    got = {r.path.rsplit("/", 1)[1]: (r.mime, base64.b64decode(r.base64)) for r in media.encoded(spark, str(tmp_path)).collect()}
    assert got == {"a.jpg": ("image/jpeg", b"1"), "a.png": ("image/png", b"2"), "b.PNG": ("image/png", b"\x00\xff")}


def test_lengths_and_counts(spark):
    df = spark.createDataFrame([("one two  three",), ("",), ("x" * 10,)], "t string")
    assert [r[0] for r in df.select(report.token_length(F.col("t"))).collect()] == [3, 0, 1]
    assert [r[0] for r in df.select(report.token_length(F.col("t"), list)).collect()] == [14, 0, 10]
    rows, seen = report.observed(df, empty=F.col("t") == "")
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 3, "empty": 1}


def plain_dialogues(rows, merge_s, match_s):
    """One chat's (sender, cut, second, text) by a loop: merge, cut, pair."""
    groups, before = [], None
    for k, (me, cut, t, text) in enumerate(rows):
        if cut:
            if before is not None and not before[1]:
                groups.append([None, t, t, ""])
        elif before is not None and not before[1] and before[0] == me and abs(t - before[2]) <= merge_s and groups and groups[-1][0] == me:
            g = groups[-1]
            g[2], g[3] = t, g[3] + ("" if not g[3] or g[3][-1] in "。.！!？?…，," else "\n") + text
        else:
            groups.append([me, t, t, text])
        before = (me, cut, t)
    out, turns, asked, last = [], [], None, None
    for me, _, t, text in [*groups, (None, 0, 0, "")]:
        if me is None:
            out, turns, asked, last = out + [turns] * bool(turns), [], None, None
        elif me == 1 and asked:
            if abs(t - asked[0]) <= match_s:
                turns.append((asked[1], text))
                last, asked = t, None
            else:
                last, asked = asked[0], None
        else:
            if last is not None and abs(t - last) > match_s:
                out, turns = out + [turns] * bool(turns), []
            if me == 0:
                asked = (t, text)
            else:
                turns.append(("<begin_chat>", text))
            last = t
    return out


def test_many_random_chats(spark):
    """10,000 short chats against a loop over messages."""
    rnd, rows, want = random.Random(9), [], {}
    for chat in range(10_000):
        t, own = 0, []
        for k in range(rnd.randrange(1, 9)):
            t += rnd.choice([5, 20, 100, 400])
            me, cut = rnd.randrange(2), rnd.random() < 0.15
            own.append((me, cut, t, f"m{k}" + rnd.choice(["", "."])))
            rows.append((chat, k, "Cut" if cut else "text", me, "me" if me else "pal", own[-1][3], "", t))
        want[chat] = plain_dialogues(own, 60, 120)
    df = spark.createDataFrame(rows, "chat long, ord int, type_name string, is_sender int, talker string, msg string, src string, s long").withColumn("t", F.timestamp_seconds("s"))
    groups = merge.merge(merge.mark_cuts(df, CUT["en"]), ["chat"], 60)
    got = {}
    for r in dialogue.dialogues(dialogue.classify(groups, ["chat"], 120), ["chat"]).orderBy("chat", "first_ord").collect():
        got.setdefault(r.chat, []).append([(t.user, t.assistant) for t in r.turns])
    assert {c: w for c, w in want.items() if w} == got




def test_many_blocked_words(spark, monkeypatch):
    """The automata of any number of parts find what the words find one by one; 100,000 words take one pass."""
    r = random.Random(7)
    text = lambda n: "".join(r.choice("ab好\nc") for _ in range(n))
    words = list({text(r.randrange(3, 8)) for _ in range(300)}) + [f"word{k}" for k in range(100_000)]
    df = spark.createDataFrame([(k, text(r.randrange(40)) + (f"word{k}x" if k % 50 == 0 else "")) for k in range(400)] + [(400, None), (401, "")], "id long, msg string").repartition(3)
    want = {x.id for x in df.collect() if any(w in (x.msg or "").replace("\n", "") for w in words)}
    assert 20 < len(want) < 380
    monkeypatch.setattr(filters, "PART", 300_000)
    assert len(filters.word_parts(words)) == 3
    rows = df.withColumn("type_name", F.lit("text"))
    assert {x.id for x in df.where(filters.blocked_by_automaton(F.col("msg"), words)).collect()} == want
    assert {x.id for x in rows.collect()} - {x.id for x in filters.blocked_words(rows, words).collect()} == want
    assert {x.id for x in df.where(filters.blocked(F.col("msg"), words[:30])).collect()} == {x.id for x in df.where(filters.blocked_by_automaton(F.col("msg"), words[:30])).collect()}
    assert filters.blocked_words(rows, ["x"] * 50 + [""]).count() == 0
    monkeypatch.setattr(filters, "MOST", 10)
    with pytest.raises(ValueError, match="bytes"):
        filters.word_parts(words)


def test_spans_share_edges_and_agree_with_flags(spark):
    """What is found in one scan is what the native patterns flag, on texts of all sorts of edges."""
    r = random.Random(11)
    bits = ["999.1.1.1.1", "1.2.3.4", "+49 (30) 123-456", "4111 1111 1111 1111", "4111111111111112", "a.b+c@d.co", "x@y.zz", "GB82WEST12345698765432", "123-45-6789", "12345", "110101199003074530", "11010119900307453X", "1BoatSLRHtKNngkdXEeobR76b53LETtpyT"]
    texts = ["".join(r.choice(bits + [" ", " ", "_", "é", "我", ".", "-", "(", "+", "\n", "x", "²", ", "]) for _ in range(r.randrange(9))) for _ in range(1500)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, t string").repartition(4)
    got = df.select("id", "t", pii.spans(F.col("t")).alias("s"), *[pii.stands(F.col("t"), k).alias(k) for k in pii.PATTERNS]).collect()
    for x in got:
        assert {s.entity_type for s in x.s} == {k for k in pii.PATTERNS if x[k]}, x.t
        assert all(x.t[s.start : s.end] == s.text for s in x.s)
    assert [(s[0], s[4]) for s in pii.found("999.1.1.1.1", ("IP_ADDRESS",))] == [("IP_ADDRESS", "1.1.1.1")]
    assert [s[4] for s in pii.found("12345 12346", ("NUMERIC_ID",))] == ["12345", "12346"]


def test_scores_of_context_and_plus_addresses(spark):
    df = spark.createDataFrame([("my code is now 12345, a+b@c.org a@c.org",)], "t string")
    score = lambda **kw: {s.text: s.score for s in df.select(pii.spans(F.col("t"), ("NUMERIC_ID", "EMAIL_ADDRESS"), **kw).alias("s")).first().s}
    assert score() == {"12345": 0.8, "a+b@c.org": 0.95, "a@c.org": 0.9}
    assert score(context=True)["12345"] == 1.0 and score(threshold=0.92) == {"a+b@c.org": 0.95}
    assert pii._score("NUMERIC_ID", "code a b c d e 12345", 15, 20, True) == 0.8  # six words before


def test_providers_and_chinese_kinds(spark):
    def names(texts):  # knows two names
        return [[("PERSON", t.find(n), t.find(n) + len(n), 0.85) for n in ("王伟", "Ada") if n in t] + [("PERSON", 0, 1, 0.2)] * bool(t) for t in texts]

    rows = ["我是王伟", "Ada 12345", "10.1.2.3 ok", "你好", "", None, "card 4111 1111 1111 1111", "+86 138 0013 8000", "GB82WEST12345698765432"]
    df = spark.createDataFrame([(k, t, "text") for k, t in enumerate(rows)], "id long, msg string, type_name string")
    left = lambda **kw: {r.id for r in filters.personal_data(df, "zh", **kw).collect()}
    assert left() == {0, 3, 4, 5} and left(providers=(names,)) == {3, 4, 5}
    s = df.select("id", pii.spans(F.col("msg"), ("NUMERIC_ID",), (names,)).alias("s"), pii.anonymize(F.col("msg"), ("NUMERIC_ID",), (names,)).alias("a")).orderBy("id").collect()
    assert [(x.entity_type, x.start, x.text) for x in s[1].s] == [("NUMERIC_ID", 4, "12345"), ("PERSON", 0, "Ada")]
    assert s[0].a == "我是<PERSON>" and s[1].a == "<PERSON> <NUMERIC_ID>" and s[5].a is None and s[3].a == "你好"
    with pytest.raises(Exception, match="a provider gave spans"):
        df.select(pii.spans(F.col("msg"), (), (lambda texts: [],))).collect()


def test_swept_regions():
    assert pii.swept("abcdefgh", [("X", 1, 3, 0.5), ("Y", 2, 5, 0.9), ("Z", 5, 6, 0.1)]) == "a<Y><Z>gh"
    assert pii.swept("abc", []) == "abc"
