"""Operator 3: what its graph finds, against a plain version and on planted secrets."""

import hashlib
import random
from collections import defaultdict

import pytest

from dialoom.llm import op3_pii


def plain_extract(rows, confidence=0.6, least=5, rounds=3):
    """Spans by dictionaries over all instances, one by one."""
    found = [(r, *x) for r, (_, text) in enumerate(rows) for x in (op3_pii.scan(text)[1] if text else [])]
    edges = defaultdict(lambda: [0, 0, 0])
    for _, _, _, value, shape, _, evidence, patterns in found:
        for p in set(patterns):
            e = edges[p, value, shape]
            e[0] += 1
            e[1] += evidence > 0
            e[2] |= evidence < 0

    def by(key, what):
        out = defaultdict(lambda: [0.0, 0.0])
        for (p, v, s), (n, seeds, _) in edges.items():
            k = key(p, v, s)
            out[k][0] += n
            out[k][1] += seeds if what == "seeds" else n * what(p, v, s)
        return {k: b / a for k, (a, b) in out.items()}, {k: a for k, (a, _) in out.items()}

    bad = {(v, s) for (_, v, s), e in edges.items() if e[2]}
    own, shaped = by(lambda p, v, s: (v, s), "seeds")[0], by(lambda p, v, s: s, "seeds")[0]
    seeded = {k: 0.0 if k in bad else max(x, shaped[k[1]]) for k, x in own.items()}
    sure = dict(seeded)
    for _ in range(rounds):
        mean, many = by(lambda p, v, s: p, lambda p, v, s: sure[v, s])
        known = {p: m * many[p] / (many[p] + 1) for p, m in mean.items()}
        told, n = by(lambda p, v, s: (v, s), lambda p, v, s: known[p])
        total, count = defaultdict(float), defaultdict(float)
        for k, x in told.items():
            total[k[1]] += n[k] * x
            count[k[1]] += n[k]
        sure = {k: 0.0 if k in bad else max(seeded[k], n[k] / (n[k] + 2) * x + 2 / (n[k] + 2) * total[k[1]] / count[k[1]]) for k, x in told.items()}
    seeds = defaultdict(int)
    for (p, _, _), e in edges.items():
        seeds[p] += e[1]
    good = {p for p, c in known.items() if c >= confidence and seeds[p] >= least}
    out = [[(s, k, e) for s, k, e in op3_pii.base_spans(text or "")] for _, text in rows]
    for r, start, end, value, shape, base, evidence, patterns in found:
        if not base and evidence >= 0 and set(patterns) & good and sure[value, shape] >= confidence / 2:
            out[r].append((start, 4, end))
    return [",".join(f"{op3_pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(x)) for x in out]


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9)))
    hexed = lambda: hashlib.sha1(str(rnd.random()).encode()).hexdigest()
    forms = [lambda: f'token = "{hexed()}"', lambda: f"TOKEN = '{hexed().upper()}'###", lambda: f"key={hexed()},", lambda: f"write to {word()}@{word()}.org now", lambda: f"member id {rnd.randrange(10**5, 10**6)} of", lambda: "card 4111 1111 1111 1111 ok", lambda: f"order {rnd.randrange(10**15, 10**16)} of"]
    planted = [lambda: 'token = "hunter2hunter2"', lambda: "write to jane.doe/99 now", lambda: 'api_secret_of_the_longest_kind_of_name = "x1y2z3w4v5u6t7s8r9q0"']
    rows = []
    for k in range(240):
        parts = [" ".join(word() for _ in range(rnd.randrange(3, 9))), rnd.choice(forms)(), word()] + ([rnd.choice(planted)()] if k % 12 == 0 else []) + [word()]
        rows.append((k, " ".join(parts)))
    return rows + [(240, None), (241, ""), (5, rows[5][1]), (None, rows[7][1])]


def test_graph_by_brute_force(spark, corpus):
    got = op3_pii.extract(spark.createDataFrame(corpus, "doc_id long, text string").coalesce(1)).collect()
    want = plain_extract(corpus)
    assert sorted((str(r.doc_id), r.spans) for r in got) == sorted((str(d), x) for (d, _), x in zip(corpus, want, strict=True))
    assert sum("id:" in x for x in want) > 60


def test_secrets_and_numbers(spark, corpus):
    """Every secret of an assignment is found as its value alone; numbers that fail the card's check never are."""
    got = {r.doc_id: r for r in op3_pii.extract(spark.createDataFrame([r for r in corpus if r[0] is not None and r[0] < 240], "doc_id long, text string")).collect()}
    seen = 0
    for d, text in corpus[:240]:
        spans = [text[int(x.split(":")[1]) : int(x.split(":")[2])] for x in got[d].spans.split(",") if x.startswith("id:")]
        for w in text.replace('"', " ").replace("'", " ").replace(",", " ").replace("key=", " ").split():
            if len(w) == 40 and op3_pii.secret(w):
                assert w in spans
                seen += 1
        if "hunter2hunter2" in text:
            assert "hunter2hunter2" in spans
        assert not [s for s in spans if op3_pii.refuted(s)]
    assert seen > 60
