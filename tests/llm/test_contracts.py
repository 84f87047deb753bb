"""Ids, column names, stages and brute-force versions of the training-data operators."""

import hashlib
import itertools
import random
import re
import zlib
from math import log2

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dialoom.llm import op1_lm_scoring, op2_language, op3_pii, op4_decontaminate, op5_jaccard, op6_quality, op7_passages, op8_lines, op8_sql, op9_bpe, op10_toxicity, words

BIG = 2**53 + 1
WORDS = "the of and to in is it for on with as was by at from that this have not are".split()


def prose(rnd, n, line=12):
    w = [rnd.choice(WORDS) if rnd.random() < 0.4 else "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(3, 9))) for _ in range(n)]
    return "\n".join(" ".join(w[i : i + line]) for i in range(0, n, line))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small sf folder: prose, copies, near copies, junk, a common line, a benchmark item, and null or repeated ids."""
    rnd = random.Random(5)
    texts = [prose(rnd, rnd.choice([80, 150])) for _ in range(60)]
    item = " ".join("q" + chr(97 + i) for i in range(20)) + " costs 12 coins for Maria and then some more words follow here"
    rows = [[i, t] for i, t in enumerate(texts)]
    rows += [[100 + i, texts[0]] for i in range(3)]  # copies
    near = texts[1].split(" ")
    near[40] = "changed"
    rows += [[110, " ".join(near)]]
    rows += [[120 + i, prose(rnd, 60) + "\nall rights reserved by the owner 201" + str(i % 7) + "\n" + prose(rnd, 60)] for i in range(14)]
    rows += [[140, prose(rnd, 60) + "\n" + item.replace("12", "1,300").replace("Maria", "Mary Ann") + "\n" + prose(rnd, 60)]]
    rows += [[150, "junk | junk | junk " * 40], [151, ""], [152, None], [153, "\n \n"], [None, texts[2] + " lonely"], [BIG, prose(rnd, 90)], [BIG + 2, prose(rnd, 90)]]
    rows += [[3, texts[3]], [4, prose(rnd, 100)]]  # a repeated row; a repeated id with another text
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    where = str(tmp_path_factory.mktemp("sf"))
    docs.repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    labels = [(i, int(i % 5 > 0), int(i % 5 == 0)) for i in range(60)] + [(150, 0, 1), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def read(spark, sf, name="documents"):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_ids_beside_null(spark, corpus):
    """Each query returns every id as it is, also over 2**53 in the batch of a null id."""
    docs, labels = read(spark, corpus).coalesce(1), read(spark, corpus, "labels")
    want = sorted((r.doc_id is None, r.doc_id or 0) for r in docs.select("doc_id").collect())
    outs = {
        1: op1_lm_scoring.score(docs, labels), 2: op2_language.predict(docs, op2_language.fit(docs)), 3: op3_pii.extract(docs), 5: op5_jaccard.join(docs),
        6: op6_quality.score(docs, op6_quality.fit(docs, labels)), 8: op8_lines.dedup(docs), 9: op9_bpe.digest(docs, op9_bpe.vocabulary()),
        10: op10_toxicity.score(docs, op10_toxicity.fit(docs, labels)),
    }
    for n, out in outs.items():
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.select("doc_id").collect()) == want, n


CLASH = ["gone", "gone_id", "Slot", "cleaned", "lines", "dropped", "n_lines", "n_dropped", "component_id", "c", "id", "score", "ids", "kept", "item_id", "h", "a.b"]


def test_stages_keep_columns(spark, corpus):
    """Columns named like internal ones ride along, and every kept row is the one that came."""
    docs = read(spark, corpus)
    for k, name in enumerate(CLASH):
        docs = docs.withColumn(name, F.concat(F.lit(f"{k}:"), F.substring("text", 1, 5)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, corpus)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] is None or r[c].startswith(f"{k}:") for r in rows for k, c in enumerate(CLASH)), name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, corpus)
    assert {"doc_id", "ids", "n_tokens", "decoded_sha256"} <= set(last.columns) and last.count() == docs.count()


def test_stages_on_empty_tables(spark, corpus):
    docs = read(spark, corpus).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus).count() == 0, name


def brute_line_dedup(rows):
    """(row, position) of dropped lines: leaves, shapes, templates and documents by dictionaries."""
    lines = []
    for r, (d, t) in enumerate(rows):
        m = [(k, re.sub("[0-9]+", "0", x.strip(" "))) for k, x in enumerate((t or "").split("\n"))]
        m = [(k, x) for k, x in m if x]
        hashes = sorted({hashlib.md5(x.encode()).hexdigest() for _, x in m})
        for k, x in m:
            h = hashlib.md5(x.encode()).hexdigest()
            lines.append((d, (r, k), x, (len(x.split(" ")), tuple(x.split(" ")[:2])), next((y for y in hashes if y != h), None)))
    leaf = {}
    for _, _, x, key, _ in lines:
        leaf.setdefault(key, []).append(x.split(" "))
    shape = {}
    for key, all_ in leaf.items():
        for p in range(key[0]):
            counts = {}
            for w in all_:
                counts[w[p]] = counts.get(w[p], 0) + 1
            n, token = max((n, w) for w, n in counts.items())
            if 2 * n >= len(all_):
                shape[key, p] = token
    held = {}
    for d, _, x, key, rest in lines:
        if len(leaf[key]) >= op8_lines.LEAST:
            w = x.split(" ")
            same = sum(shape.get((key, p)) == w[p] for p in range(key[0])) >= op8_lines.SIMILAR * key[0]
            held.setdefault((key, None if same else x), set()).add((d, rest))
    bad = {k for k, v in held.items() if len({r for _, r in v}) >= op8_lines.LEAST and len({r for _, r in v}) >= op8_lines.OWN * len(v)}
    gone = set()
    for _, at, x, key, _ in lines:
        w = x.split(" ")
        same = sum(shape.get((key, p)) == w[p] for p in range(key[0])) >= op8_lines.SIMILAR * key[0]
        if (key, None if same else x) in bad:
            gone.add(at)
    return gone


def test_lines_of_other_rows_stay(spark, tmp_path):
    """Rows of one id, and rows without an id, lose their own boilerplate and nothing of each other."""
    notice = "all rights reserved by the owner 2011"
    rows = [(k, f"{notice}\nown text of row {chr(97 + k)} {k}x") for k in range(14)]
    rows += [(3, "precious first line of other text\nsecond"), (None, f"{notice}\nline beside a notice"), (None, "precious null line\nmore"), (None, f"{notice}\n{notice}"), (None, None), (4, ""), (5, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, str(r.text)) for r in op8_lines.dedup(df).collect())
    gone = brute_line_dedup(rows)
    want = []
    for r, (d, t) in enumerate(rows):
        lines = (t or "").split("\n")
        kept = [x for k, x in enumerate(lines) if (r, k) not in gone]
        want.append((str(d), sum(bool(x.strip(" ")) for x in lines), len(lines) - len(kept), str(None if t is None else "\n".join(kept))))
    assert got == sorted(want) and sum(w[2] for w in want) == 17
    df.withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted((str(a), b, c_, str(t)) for a, b, c_, t in c.sql(f"select doc_id, n_lines, n_dropped, text from ({op8_sql.line_dedup()})").fetchall()) == got


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_long_words_differ():
    """A word and its complement, which a polynomial modulo 2**64 can't tell apart."""
    for n in (1024, 4096, 65536):
        a = thue_morse(n)
        b = a.translate(str.maketrans("ab", "ba"))
        assert len(set(words.Block([a.encode(), b.encode(), a.encode()]).h)) == 2
        assert len(op9_bpe.Words([f"{a} x", f"{b} x"], 1, False).where) == 3  # both words, and " x"
        doc, _, h = words.Block([f"{x} one two".encode() for x in (a, b)]).shingles(3)
        assert len(set(h)) == 2


def test_short_benchmark_items(spark):
    docs = {1: "the dog met Peter in the park", 2: "it cost 17 apples", 3: "42", 4: "Maria Silva", 5: "they said that Maria Silva came", 6: "it cost 42 apples",
            7: "Ana Lima, Rui Costa, Eva Melo, Ivo Reis met", 8: "Ana Pires, Rui Costa, Eva Melo, Ivo Reis met", 9: "how far is 12 km away", 10: "how far is 15 km away"}
    items = {1: "Maria Silva", 2: "42", 3: "Ana Lima, Rui Costa, Eva Melo, Ivo Reis", 4: "how far is 12 km away"}
    df = lambda x, n: spark.createDataFrame(list(x.items()), f"{n} long, text string")
    got = {(r.doc_id, r.item_id) for r in op4_decontaminate.contaminated(df(docs, "doc_id"), df(items, "item_id")).collect()}
    assert got == {(3, 2), (4, 1), (7, 3), (9, 4), (10, 4)}


def plain_windows(text):
    """Template tokens of a text without numbers that run on, by words: enough for the fixture of the next test."""
    out = []
    for w in re.findall(r"[0-9A-Za-zÀ-ɏͰ-ӿ]+", text):
        kind = "NUM" if w.isdigit() else "NAME" if w[0].isupper() and len(w) > 1 and not w[1].isupper() else w.lower()
        if kind == "NAME" and out and out[-1][0] == "NAME":  # a run of names is one
            out[-1] = (kind, f"{out[-1][1]} {w}")
        else:
            out.append((kind, w))
    return out


def test_contamination_by_brute_force(spark):
    """All windows of all documents against all items, one by one; names of several scripts."""
    rnd = random.Random(8)
    name = lambda: rnd.choice(["Maria", "Ωμέγα", "Жанна", "Élise", "Łukasz", "Peter"])
    word = lambda: rnd.choice("when does the train leave for town and who pays what they owe".split())
    text = lambda n: " ".join(rnd.choice([word, word, word, name, lambda: str(rnd.randrange(3))])() for _ in range(n))
    items = {k: text(rnd.randrange(9, 16)) for k in range(12)}
    docs = {}
    for d in range(120):
        item = items[rnd.randrange(12)]
        swap = dict(zip(["Maria", "Жанна", "0", "1", "2"], rnd.choice([["Peter", "Maria", "5", "6", "7"], ["Peter", "Peter", "5", "5", "7"], ["Maria", "Жанна", "0", "1", "2"]]), strict=True))
        docs[d] = text(rnd.randrange(8)) + " so " + " ".join(swap.get(w, w) for w in item.split(" ")[rnd.randrange(3) :]) + " so " + text(rnd.randrange(8))
    least, want = 0.8, set()
    for i, item in items.items():
        y = plain_windows(item)
        size = min(len(y), op4_decontaminate.WINDOW)
        at = range(len(y) - size + 1)
        plain = [p for p in at if sum(k not in ("NUM", "NAME") for k, _ in y[p : p + size]) >= op4_decontaminate.LITERAL]
        use, strict = plain or list(at), not plain
        for d, t in docs.items():
            x, lines = plain_windows(t), {}
            for p in use:
                for q in range(len(x) - size + 1):
                    if [k for k, _ in x[q : q + size]] == [k for k, _ in y[p : p + size]]:
                        lines.setdefault(q - p, []).append((p, {(a[1], b[1]) for a, b in zip(y[p : p + size], x[q : q + size]) if a[0] in ("NUM", "NAME")}))
            met = set()
            for own in lines.values():
                pairs = set().union(*(s for _, s in own))
                if len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs) and (not strict or all(a == b for a, b in pairs)):
                    met |= {p for p, _ in own}
            if len(met) >= least * len(use):
                want.add((d, i))
    df = lambda x, n: spark.createDataFrame(list(x.items()), f"{n} long, text string")
    got = {(r.doc_id, r.item_id) for r in op4_decontaminate.contaminated(df(docs, "doc_id"), df(items, "item_id")).collect()}
    assert got == want and 20 < len(want)


def brute_components(rows, n, num, den):
    sets = {}
    for d, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) if x]
        s = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        if d is not None and s:
            sets.setdefault(d, []).append(s)
    root, links = {d: d for d in sets}, dict.fromkeys(sets, 0)

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in sets}, links


def test_pipeline_against_brute_force(spark, corpus):
    """run() and a plain version of its rules: base rule and trees' verdict, lines, groups, templates, tokens."""
    import public_tokenizers
    import tiktoken

    docs, labels = read(spark, corpus), read(spark, corpus, "labels")
    verdict = {}
    for r in op6_quality.score(docs, op6_quality.fit(docs, labels)).collect():
        verdict.setdefault(r.doc_id, set()).add((r.n_words, r.kept))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(d, t) for d, t in rows if (len((t or "").split()), True) in verdict[d]]
    gone = brute_line_dedup(rows)
    assert len({d for d, _ in gone}) == 14
    cut = [(d, "\n".join(x for k, x in enumerate(t.split("\n")) if (r, k) not in gone)) for r, (d, t) in enumerate(rows)]
    rows = [(d, t) for (d, t), (_, old) in zip(cut, rows, strict=True) if t == old or t.strip(" ")]
    component, _ = brute_components(rows, 5, 8, 10)
    rows = [(d, t) for d, t in rows if component.get(d, d) == d]
    found = {r.doc_id for r in op4_decontaminate.contaminated(docs, read(spark, corpus, "benchmark")).collect()}
    assert found == {140}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=op9_bpe.vocabulary(), special_tokens={})
    want = sorted((str(d), enc.encode_ordinary(t)) for d, t in rows if d not in found)
    got = sorted((str(r.doc_id), list(r["ids"])) for r in corpus_pipeline.run(spark, corpus).collect())
    assert got == want


@pytest.mark.parametrize("n, num, den", [(5, 8, 10), (3, 90, 100), (2, 6, 10)])
def test_all_links_are_counted(spark, n, num, den):
    rnd = random.Random(n)
    vocab, docs = [f"v{i}" for i in range(200)], []
    for _ in range(6):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([8, 40, 120]))]
        for _ in range(rnd.choice([3, 20])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            docs.append((len(docs), " ".join(w)))
    docs += [(0, "another set of the first id and some words"), (900, "another set of the first id and some words"), (901, "One two"), (902, "one  two"), (None, "one two"), (BIG, "lone words")]
    component, links = brute_components(docs, n, num, den)
    got = {r.doc_id: (r.component_id, r.n_links) for r in op5_jaccard.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), n, num, den).collect()}
    assert {d: got[d] for d in component} == {d: (component[d], links[d]) for d in component}


def test_templates_of_other_lengths(spark):
    base = "Yesterday a farmer sold 12 apples to Maria for 30 dollars and drove home with her old dog before the long night began again"
    changed = [("12", "1,200"), ("30", "7.50"), ("Maria", "Mary Ann"), ("Maria", "Élodie"), ("12", "twenty five"), ("30 dollars", "5km"), ("30", "$7")]
    docs = [(i, "Some words before. " + base.replace(a, b) + ". And after") for i, (a, b) in enumerate(changed)]
    docs += [(50, base.replace("30", "12")), (51, base.replace("apples", "pears").replace("farmer", "singer").replace("dog", "cat").replace("home", "there"))]
    docs, item = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, base)], "item_id long, text string")
    want = set(range(len(changed)))
    for most in (op4_decontaminate.MOST, 0):  # hashes in the tasks, and the shuffle join
        assert {r.doc_id for r in op4_decontaminate.contaminated(docs, item, most=most).collect()} == want


def test_added_spans(spark):
    """A context that seeds have taught finds unseen identifiers of any length; others are left alone."""
    rnd = random.Random(3)
    key = lambda n: "".join(rnd.choice("abcdef0123456789") for _ in range(n))
    docs, secret = [], {}
    for i in range(80):
        docs.append((i, f"please write to mail u{i}x@mail{i % 7}.org today and thanks for the {1900 + i} apples"))
    for i in range(80, 110):
        secret[i] = "u" + key(rnd.choice([12, 40, 300])) + "@localhost"
        docs.append((i, f"please write to mail {secret[i]} today and thanks for the {1900 + i}years apples"))
    docs.append((200, "plain words with number 12345678 in them and nothing else"))
    found = {}
    for r in op3_pii.extract(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        text = dict(docs)[r.doc_id]
        found[r.doc_id] = {text[int(s) : int(e)] for k, s, e in (x.split(":") for x in r.spans.split(",") if x) if k == "id"}
    hit = sum(secret[i] in found[i] for i in secret)
    extra = sum(len(v) for v in found.values()) - hit
    assert hit >= 0.9 * len(secret) and extra <= 0.1 * len(secret) and not found[200]


def test_base_spans_against_patterns():
    rnd = random.Random(8)
    email, card, phone = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]([ -]?[0-9])+"), re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    digits = lambda t: [int(c) for c in t if c.isdigit()]
    luhn = lambda t: sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(digits(t)[::-1])) % 10 == 0
    for _ in range(3000):
        text = "".join(rnd.choice(["1", "4", "255", "300", ".", "@", "a", "b.", " ", "-", "+", "(", "4111111111111111", "x@y.z"]) for _ in range(rnd.randrange(1, 25)))
        want = [(m.start(), 0, m.end()) for m in email.finditer(text)]
        want += [(m.start(), 1, m.end()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [(m.start(), 2, m.end()) for m in card.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(m[0])]
        want += [(m.start(), 3, m.end()) for m in phone.finditer(text) if 10 <= len(digits(m[0])) <= 15]
        assert op3_pii.base_spans(text) == sorted(want), text


def test_statistics_against_plain_counts():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["a", "b", "ß", " ", "  ", "\n", "#", "a b c ", "\t"]) for _ in range(rnd.randrange(40))) for _ in range(400)] + [None, ""]
    got = op6_quality.text_statistics(texts)
    for t, r in zip(texts, got[op6_quality.BASE].itertuples(index=False), strict=True):
        w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        seen, dup = set(), 0
        for x in (t or "").split("\n"):
            if re.search("[^\x20\x09-\x0d]", x):
                dup += x in seen
                seen.add(x)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        cover = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
        assert tuple(r) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(cover))


def test_code_lengths_against_plain_escapes():
    """The flat table gives what a tree of contexts with escapes gives, symbol by symbol."""
    train = {"en": ["the cat sat on the mat the end", "that hat"], "de": ["die katze sass auf der matte", "das ende der matte"]}
    rows = []
    for lang, texts in train.items():
        counts = {}
        for t in texts:
            b = t.encode()
            for k in range(1, 5):
                for i in range(len(b) - k + 1):
                    counts[b[i : i + k]] = counts.get(b[i : i + k], 0) + 1
        rows += [(lang, len(g), int.from_bytes(g, "big"), n) for g, n in counts.items()]
        train[lang] = counts
    model = op2_language.flatten(pd.DataFrame(rows, columns=["lang", "size", "gram", "n"]))

    def p(counts, context, symbol):
        lower = p(counts, context[1:], symbol) if context else 1 / 256
        known = {g[-1]: n for g, n in counts.items() if len(g) == len(context) + 1 and g[:-1] == context}
        if not known or (len(context) > 1 and sum(known.values()) < 4):
            return lower
        # a symbol that the context knows, or an escape to the shorter one
        return (known.get(symbol) or lower * len(known)) / (sum(known.values()) + len(known))

    for text in (b"the hat", b"die matte end", b"t"):
        for k, lang in enumerate(model.languages):
            want = sum(-log2(p(train[lang], text[max(0, i - 3) : i], c)) for i, c in enumerate(text))
            assert abs(model.bits([text])[0, k] - want) < 1e-3 * max(1, want)


def test_chains_are_whole_texts(monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(op10_toxicity, "CHAIN", 4)
    text = np.repeat(np.arange(4), [1, 4, 11, 3])
    u, trans = rng.normal(size=len(text)), rng.normal(size=(2, 2))
    field = op10_toxicity.Field([], [], 0.0, trans)
    field.unary = lambda doc, hashes: u
    p = field.tag(text, [])
    for t in range(4):
        x = u[text == t]
        total, mass = 0.0, np.zeros(len(x))
        for s in itertools.product((0, 1), repeat=len(x)):
            w = np.exp(np.dot(x, s) + sum(trans[a, b] for a, b in itertools.pairwise(s)))
            total, mass = total + w, mass + w * np.array(s)
        assert np.allclose(p[text == t], mass / total)


def test_held_out_toxicity(spark):
    """Toxic words that the field has learnt are found in the held-out fold, with their offsets; clean texts are left alone."""
    rnd = random.Random(6)
    rows, toxic = [], {}
    for i in range(400):
        toxic[i] = i % 4 == 1
        w = prose(rnd, 40).split()
        if toxic[i]:
            for _ in range(4):
                w.insert(rnd.randrange(40), rnd.choice(["vilefool", "wretchscum", "nastyrat"]))
        rows.append((i, "É " + " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(y)) for i, y in toxic.items()], "doc_id long, quality int, toxic int")
    got = op10_toxicity.score(docs, op10_toxicity.fit(docs, labels)).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.held_out == (r in held) for r in got) and held
    assert sum(r.predicted == toxic[r.doc_id] for r in held) >= 0.9 * len(held)
    for r in held:
        if r.predicted and toxic[r.doc_id]:
            said = {dict(rows)[r.doc_id][int(a) : int(b)] for a, b in (x.split(":") for x in r.spans.split(","))}
            assert said & {"vilefool", "wretchscum", "nastyrat"}


def test_recall_of_passages(spark):
    """Planted passages of similarity 0.8 to 1 are connected, at least nine of ten of those that differ."""
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    docs, planted, common = [], [], [word() for _ in range(20)]
    for _ in range(50):
        base, rate, own = [word() for _ in range(rnd.choice([55, 80, 200]))], rnd.choice([0, 0.005, 0.01, 0.02, 0.03]), []
        for _ in range(rnd.choice([2, 3, 6])):
            w = [word() if rnd.random() < rate else x for x in base]
            own.append((len(docs), w))
            docs.append((len(docs), " ".join([word() for _ in range(rnd.randrange(80))] + common + w + [word() for _ in range(rnd.randrange(80))])))
        planted.append(own)
    rows = op7_passages.passages(spark.createDataFrame(docs + [(None, docs[0][1])], "doc_id long, text string").repartition(3)).collect()
    pairs = {(r.doc_id, r.other_id) for r in rows}
    assert all((b, a) in pairs for a, b in pairs)
    root = list(range(len(docs)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        root[find(a)] = find(b)
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    want = []
    for own in planted:
        for (a, x), (b, y) in itertools.combinations(own, 2):
            s, r = shingles(x), shingles(y)
            if len(s & r) >= 0.8 * len(s | r):
                want.append((len(s & r) < len(s | r), find(a) == find(b)))
    differ = [ok for d, ok in want if d]
    assert all(ok for d, ok in want if not d) and len(differ) > 20 and sum(differ) >= 0.9 * len(differ)
    family = {i: k for k, own in enumerate(planted) for i, _ in own}
    assert all(family[a] == family[b] for a, b in pairs)
