"""Exports read by pieces: any JSON, cut anywhere, and broken files."""

import json
import random

import pytest

from dialoom.sources import json_parts, telegram

NASTY = ["{", "}", "[", "]", '"', "\\", ",", ":", '"messages": [', "{}", "ü", "\n", "}}", "x", '\\"', "{\"id\": 1", "你"]


def value(r, deep):
    kind = r.randrange(7 if deep else 4)
    if kind < 2:
        return "".join(r.choice(NASTY) for _ in range(r.randrange(5)))
    if kind == 2:
        return r.choice([1, -2.5, None, True])
    if kind == 3:
        return r.choice([{}, [], [[]], [1, "]"]])
    return {f"k{i}": value(r, deep - 1) for i in range(3)} if kind < 6 else [value(r, deep - 1) for _ in range(3)]


def export(r, n):
    out = {"name": value(r, 0), "about": value(r, 3), "stories": [{"id": 1, "messages": [{"a": 1}]}] * r.randrange(3)}
    messages = [{"id": k, "type": "message", "text": value(r, 0), "more": value(r, 3)} for k in range(n)]
    if r.random() < 0.5:
        return out | {"messages": messages, "after": [{"x": {}}, {"y": [{}]}]}
    return {"messages": messages} | out


@pytest.fixture
def small_blocks(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in keys}
    yield lambda n: [spark.conf.set(k, n) for k in keys]
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("block", [97, 1 << 20])
def test_elements_of_any_json(spark, tmp_path, small_blocks, block):
    r, want = random.Random(block), {}
    for k in range(8):
        doc = export(r, r.choice([0, 1, 2, 9]))
        text = json.dumps(doc, indent=r.choice([None, 1, 4]), ensure_ascii=r.random() < 0.5, separators=r.choice([None, (",", ":")])) + r.choice(["", "\n", " "])
        (tmp_path / f"{k}.json").write_text(text, encoding="utf-8")
        want[f"{k}.json"] = doc
    small_blocks(block)
    items, heads = json_parts.elements(spark, str(tmp_path), "messages")
    got = {}
    for x in sorted(items.collect(), key=lambda x: (x.file, x.pos)):
        got.setdefault(x.file.rsplit("/", 1)[1], []).append(json.loads(x.value))
    assert got == {k: d["messages"] for k, d in want.items() if d["messages"]}
    heads = {x.file.rsplit("/", 1)[1]: x for x in heads.collect()}
    assert {k: x.error for k, x in heads.items()} == dict.fromkeys(want)
    assert {k: json.loads(x.head) for k, x in heads.items()} == {k: d | {"messages": []} for k, d in want.items()}


def test_broken_exports_are_reported(spark, tmp_path, small_blocks):
    message = {"id": 1, "type": "message", "from": "P", "from_id": "u1", "date": "2024-01-02T03:04:05", "text": "a {b} \"c\""}
    good = json.dumps({"name": "good", "type": "t", "id": 5, "messages": [message, message | {"id": 2}]})
    r = random.Random(1)
    texts = {"good": good, "cut": good[:-1], "bare": good[: good.index("]") + 1], "empty": "", "list": "[1]", "none": '{"name": "n"}', "word": "messages", "comma": good.replace('"from": "P"', '"from": P', 1), "twice": good + good}
    texts |= {f"at{k}": good[: r.randrange(1, len(good) - 1)] for k in range(6)}
    for name, text in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "result.json").write_text(text)
    small_blocks(300)
    _, reports = telegram.exports(spark, f"{tmp_path}/*/result.json")
    found = {x.file.rsplit("/", 2)[1]: x for x in reports.collect()}
    assert set(found) == set(texts) - {"empty"}  # an empty file has no piece
    assert {k for k, x in found.items() if x.error is None} == {"good"}
    assert found["comma"].error == "1 messages are no JSON" and (found["good"].chat, found["good"].messages) == ("good-t-5", 2)
    rows = telegram.read(spark, f"{tmp_path}/*/result.json", "u1").collect()
    assert sorted((x.chat, x.id, x.msg, x.is_sender) for x in rows) == [("good-t-5", 1, 'a {b} "c"', 1), ("good-t-5", 2, 'a {b} "c"', 1)]
    # one broken text beside a good one, as values
    df = spark.createDataFrame([("a", good), ("b", good[:-3])], "chat string, value string")
    assert {x.chat for x in telegram.messages(df, "u1").collect()} == {"a"}
