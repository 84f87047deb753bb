"""Odd inputs and brute-force checks of the training-data operators."""

import hashlib
import re

import numpy as np
import pytest

from dialoom.llm import op1_lm_scoring, op2_language, op3_pii, op4_decontaminate, op5_jaccard, op6_quality, op7_passages, op8_lines, op9_bpe, op10_toxicity

LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(30_000))
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two", "en", "a", 7), (4, "one two", "en", "a", 7), (4, "one two", "en", None, 7),
    (None, "lost words here", None, "b", 1), (5, LONG, "fr", "b", len(LONG)), (6, "\n\n \t", "de", "a", 4), (7, "ÀÉ ß 日本 'll don't  x", "de", "a", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    import pyspark.sql.functions as F

    return spark.createDataFrame(ROWS, SCHEMA).withColumn("score", F.lit(1)).withColumn("h", F.lit("x"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, 1, 0), (4, 0, 1), (5, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (3, "lost words here")], "item_id long, text string")


def runs(docs, labels, items):
    """A result for each operator; per document where it is."""
    ranks = op9_bpe.vocabulary()
    return {
        1: op1_lm_scoring.score(docs, labels), 2: op2_language.predict(docs, op2_language.fit(docs)), 3: op3_pii.extract(docs),
        4: op4_decontaminate.contaminated(docs, items), 5: op5_jaccard.join(docs), 6: op6_quality.score(docs, op6_quality.fit(docs, labels)),
        7: op7_passages.passages(docs), 8: op8_lines.dedup(docs), 9: op9_bpe.digest(docs, ranks),
        10: op10_toxicity.score(docs, op10_toxicity.fit(docs, labels)),
    }


def test_odd_inputs(odd, labels, items):
    for n, out in runs(odd, labels, items).items():
        got = out.collect()
        if n not in (4, 7):
            assert len(got) == len(ROWS), n


def test_empty_tables(spark, odd, labels, items):
    none = odd.limit(0)
    for n, out in runs(none, labels.limit(0), items.limit(0)).items():
        assert out.count() == 0, n


def test_base_spans():
    text = "a.b@c.de, 10.0.0.1 and 999.1.1.1 or 4111 1111 1111 1111 +1 (555) 555-1234 x@y"
    assert [(op3_pii.KINDS[k], text[s:e]) for s, k, e in op3_pii.base_spans(text)] == [
        ("email", "a.b@c.de"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 555-1234"),
    ]


def test_statistics_by_hand():
    s = op6_quality.text_statistics(["a b c a b c\na b c a b c\n\nß# $", None]).iloc[0]
    assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == (14, 15, 2, 1, 12)


def test_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((500, 2))
    m = op6_quality.fit_trees(x, (x[:, 0] + 0.3 * rng.random(500) < 0.6).astype(float), [-1, 0])
    grid = np.c_[np.linspace(0, 1, 50), np.full(50, 0.5)]
    assert (np.diff(m.margin(grid)) <= 1e-9).all()


def test_encoding_as_tiktoken(odd):
    import public_tokenizers
    import tiktoken

    ranks = op9_bpe.vocabulary()
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted((r.ids_sha256, r.decoded_sha256) for r in op9_bpe.digest(odd, ranks).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == sorted((sha(np.array(enc.encode_ordinary(r[1] or ""), "<u4").tobytes()), sha((r[1] or "").encode())) for r in ROWS)


def test_join_against_brute_force(spark):
    import random

    rnd = random.Random(4)
    vocab = [f"v{i}" for i in range(60)]
    docs = []
    for _ in range(4):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([12, 40, 100]))]
        for _ in range(25):
            w = list(base)
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            docs.append((len(docs), " ".join(w)))
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for _, t in docs]
    root = list(range(len(docs)))
    for _ in docs:  # settles within as many sweeps as there are documents
        old = list(root)
        for i in range(len(docs)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
        if root == old:
            break
    got = {r.doc_id: r.component_id for r in op5_jaccard.join(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == dict(enumerate(root))


def test_templates_and_slots(spark):
    item = "the farmer sold 12 apples to Maria for 30 dollars and kept the other fruit at home"
    other = item.replace("12", "47").replace("Maria", "Peter")
    wrong = "the farmer sold 12 apples to Maria for 12 dollars and kept the other fruit at home"
    docs = spark.createDataFrame([(1, f"Intro. {other}. End"), (2, wrong), (3, "nothing of the kind")], "doc_id long, text string")
    got = {r.doc_id: r.verbatim for r in op4_decontaminate.contaminated(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert got == {1: False}


def test_passages(spark):
    words = [f"p{i}" for i in range(60)]
    docs = [(i, " ".join([f"a{i}_{k}" for k in range(80)] + (words if i < 3 else []) + [f"z{i}_{k}" for k in range(80)])) for i in range(6)]
    got = {r.doc_id for r in op7_passages.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0, 1, 2}


def test_lines_are_native(odd):
    plan = op8_lines.dedup(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_window_keys_against_all_subsequences():
    rng = np.random.default_rng(3)
    for n, kinds in ((1, 3), (9, 3), (40, 2), (40, 1), (60, 1000)):
        a, b = (rng.integers(0, kinds, n).astype(np.uint64) for _ in "ab")
        lo, hi = np.array([0]), np.array([n])
        trees = [op7_passages.compact_windows(v, lo, hi, 5) for v in (a, b)]
        _, got = op7_passages.band_keys(*trees, a, b, 0, 5)
        want = {(a[i:j].min(), b[i:j].min()) for i in range(n) for j in range(i + 5, n + 1)}
        assert set(got.tolist()) == {int(op7_passages.mix(op7_passages.mix(x + np.uint64(0)) + y)) for x, y in want}


def test_passages_among_short_lines(spark):
    line = " ".join(f"line{i}" for i in range(34))
    passage = [f"p{i}" for i in range(52)]
    docs = []
    for i in range(60):
        w = [f"a{i}_{k}" for k in range(30 + i)] + line.split() + (passage if i % 20 == 7 else []) + [f"z{i}_{k}" for k in range(70)]
        docs.append((i, " ".join(w)))
    got = op7_passages.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {7, 27, 47}
    # the line stands right before the passage, so both are one stretch
    assert all(r.end - r.start == 86 and r.similarity == 1.0 for r in got)


def test_similar_places_stay_together(spark):
    """No two places that are to be compared part; near copies and a common line cost few rows, whatever their number."""
    rng = np.random.default_rng(5)
    line, text, near = list(range(6)), list(range(100, 190)), []
    for sid in range(240):
        own = 1000 * (sid + 1) + np.arange(90)
        if sid < 80:  # near copies
            tokens = np.where(rng.random(90) < rng.choice([0.1, 0.3, 0.6]), own, text)
        elif sid < 90:  # of a text that repeats itself
            tokens = np.r_[7, 8, 9, own[:1]]
        else:
            tokens = own
        tokens = np.unique(np.r_[line, tokens])
        near.append((sid, sid, 3, 0, len(tokens), [int(x) for x in tokens]))
    got = op7_passages.parted(spark.createDataFrame(near, "sid long, doc_id long, at long, anchor int, kinds int, near array<int>").repartition(3)).collect()
    held = {}
    for r in got:
        held.setdefault(r.sid, set()).add(r.key)
    many = 0
    for i, a in enumerate(near):
        for b in near[:i]:
            if len(set(a[5]) & set(b[5])) >= int(0.8 * min(a[4], b[4], op7_passages.LEAST)):
                many += 1
                assert held[a[0]] & held[b[0]]
    assert many > 1000 and len(got) < 80 * 90
    assert all(sid not in held or sum(r.sid == sid for r in got) <= 6 for sid in range(90, 240))


def test_places_as_similar_as_a_passage():
    """The places told in one pass are those found window by window; a common line alone is none, one substituted word costs none."""
    r, least = np.random.default_rng(2), op7_passages.LEAST
    one, two, at = [], [], []
    for _ in range(600):
        kinds = r.choice([5, 30, 10**9])
        a = r.integers(-kinds, kinds, r.integers(least, 2 * least)).astype(np.int32)
        b = np.where(r.random(len(a)) < r.choice([0, 0.1, 0.2, 0.25, 0.3, 0.5]), 7, a).astype(np.int32)
        one.append(a)
        two.append(b[r.integers(0, 40) if r.random() < 0.3 else 0 :])
        at.append(int(r.integers(max(0, len(a) - least), min(least, len(a)))))

    def plain(a, p, b):
        for k in range(max(0, p - least + 1), min(len(a) - least, p) + 1):
            w = a[k : k + least].tolist()
            if sum(x in b for x in w) >= int(0.8 * least) or len({*w}) < least and sum(x in b for x in {*w}) >= int(0.8 * len({*w})):
                return True
        return False

    got = op7_passages.shared_around(one, np.array(at), two)
    assert got.tolist() == [plain(a, p, set(b.tolist())) for a, p, b in zip(one, at, two)]  # noqa: B905
    assert 50 < got.sum() < 550
    text = np.arange(91, dtype=np.int32)
    line, word = np.where((text >= 30) & (text < 60), text, text + 500).astype(np.int32), np.where((text >= 48) & (text < 53), text + 500, text).astype(np.int32)
    assert op7_passages.shared_around([text, text], np.array([45, 45]), [line, word]).tolist() == [False, True]


def test_runs_that_similar_places_share():
    """Any twenty tokens in a row give the same key, wherever they stand."""
    r = np.random.default_rng(3)
    for _ in range(200):
        shared = r.integers(0, 1 << 62, op7_passages.SHARED).astype(np.uint64)
        a, b = (op7_passages.least_runs(np.r_[r.integers(0, 1 << 62, n).astype(np.uint64), shared, r.integers(0, 1 << 62, 30).astype(np.uint64)]) for n in r.integers(0, 40, 2))
        assert len(np.intersect1d(a, b)) >= 1
    assert not len(op7_passages.least_runs(shared[1:]))


def test_linked_places_have_one_label(spark):
    """Places that a chain of passages links get one label, whichever side it covers; the others keep theirs."""
    places = spark.createDataFrame([(s, 10) for s in range(1, 8)] + [(1, 200)], "sid long, at long")
    labels = places.selectExpr("sid", "at", "struct(sid, at) as label")
    found = [(5, 1, 0, 60, 5, 60), (5, 2, 0, 60, 0, 60), (3, 2, 8, 70, 8, 70), (7, 6, 11, 80, 10, 80)]
    found = spark.createDataFrame([(*x, 1.0) for x in found], "sid long, rep long, start long, end long, rep_start long, rep_end long, similarity double")
    got = {(x.sid, x.at): tuple(x.label) for x in op7_passages.linked(op7_passages.linked(labels, found), found).collect()}
    assert got == {(1, 10): (5, 10), (2, 10): (5, 10), (3, 10): (5, 10), (5, 10): (5, 10), (1, 200): (1, 200), (4, 10): (4, 10), (6, 10): (6, 10), (7, 10): (7, 10)}


def test_numbers_of_values():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 600):
        v = r.integers(0, max(1, n // 2), n).astype(np.uint64)
        kinds, number, order, edge = op7_passages.numbered(v)
        want, back = np.unique(v, return_inverse=True)
        assert kinds.tolist() == want.tolist() and number.tolist() == back.tolist() and v[order].tolist() == np.sort(v).tolist()
        assert edge.tolist() == [0, *np.cumsum(np.bincount(back, minlength=len(want)))][: len(want) + 1]


def test_documents_of_keys():
    rng = np.random.default_rng(6)
    for documents in (1, 50, 70_000):
        doc, key = np.sort(rng.integers(0, documents, 3000)), rng.integers(0, 900, 3000).astype(np.uint64) << np.uint64(30)
        for got, want in zip(op7_passages.in_documents(doc, key), np.unique(np.array(sorted(set(zip(doc, key))))[:, 1].astype(np.uint64), return_counts=True), strict=True):  # noqa: B905
            assert got.tolist() == want.tolist()


def test_scores_against_counts_of_all_words(spark):
    import random
    from collections import Counter

    rnd = random.Random(7)
    docs = [(i, " ".join(f"w{int(rnd.paretovariate(0.25)) % 6000}" for _ in range(rnd.randrange(60, 120)))) for i in range(150)] + [(None, "w1 w2 rare"), (150, None)]
    good = set(range(0, 150, 3))
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in range(150)], "doc_id long, quality int, toxic int")
    uni, ctx, pair = ([Counter(), Counter()] for _ in range(3))
    for i, t in docs:
        w = (t or "").split()
        for k in (0, 1) if i in good else (0,):
            uni[k].update(w)
            ctx[k].update([None, *w][: len(w)])
            pair[k].update(zip([None, *w], w))  # noqa: B905
    assert len(uni[0]) > 2048
    want = {}
    for i, t in docs:
        w, total = (t or "").split(), 0.0
        for c, x in zip([None, *w], w):  # noqa: B905
            p = [(pair[k][c, x] + 50 * (uni[k][x] + 1) / (uni[k].total() + len(uni[0]))) / (ctx[k][c] + 50) for k in (0, 1)]
            total += np.log2(p[0]) - np.log2(p[1])
        want[i] = (len(w), total / max(1, len(w)))
    got = {r.doc_id: (r.n_tokens, r.score) for r in op1_lm_scoring.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), labels).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9 for i in want)


def test_passage_after_its_own_fragment():
    word = lambda text: np.array([hash(tuple(text[k : k + 5])) & (1 << 63) - 1 for k in range(len(text) - 4)], np.uint64)
    a = [f"a{k}" for k in range(60)]
    rep = a[:30] + [f"x{k}" for k in range(100)] + a
    assert op7_passages.align(word(a), word(rep)) == [(0, 60, 130, 190, 1.0)]
    assert op7_passages.align(word(rep), word(a)) == [(130, 190, 0, 60, 1.0)]
    changed = a[:40] + ["new"] + a[40:]
    assert [p[:4] for p in op7_passages.align(word(a * 2), word(rep[:90] + changed * 2), similar=0.7)] == [(0, 120, 90, 212)]
    same = ["b"] * 3000
    assert op7_passages.align(word(same), word(same)) == [(0, 3000, 0, 3000, 1.0)]
