"""Operators 11 to 13: page templates, hard negatives, source divergence."""

from html.parser import HTMLParser

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from dialoom.llm import op11_html, op12_negatives, op13_divergence

SF = "/root/testdata/sf0.001"


class Plain(HTMLParser):
    """What is in <article>, by blocks: enough for the pages of the test tables."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.held, self.on = [], [], False

    def flush(self):
        text = " ".join("".join(self.held).split())
        self.held = []
        if text and self.on:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in ("h1", "p", "article"):
            self.flush()
        self.on |= tag == "article"
        self.held += [" "] * (tag == "br")

    def handle_endtag(self, tag):
        if tag in ("h1", "p", "article"):
            self.flush()
        self.on &= tag != "article"

    def handle_data(self, data):
        self.held.append(data)


def article(html: str) -> str:
    p = Plain()
    p.feed(html)
    p.close()
    p.flush()
    return "\n\n".join(p.out)


def test_pages_of_the_table(spark):
    want = {r["page_id"]: (r["url"], article(r["html"])) for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    got = op11_html.query(spark, SF).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)


PROSE = [f"{w} of a long evening by the river, told by people who had been there and seen it all number {w}." for w in "one two three four five six seven eight".split()]


def texts(spark, pages, **more):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r.page_id: r.text for r in op11_html.main_text(df, **more).collect()}


def test_template_texts_of_a_host_go(spark):
    page = "<html><body><div class='t1'><a href='/'>Home</a> <a href='/b'>Blog</a></div><div class='c7'><h1>{0}</h1><div class='x9'>Write to us and win a boat.</div><p>{1}</p><p>{2}</p></div><div class='u2'>All rights are ours.</div></body></html>"
    pages = [(i, f"http://a.example/{i}", page.format(f"Title {i}", PROSE[i], PROSE[i + 1] + "!")) for i in range(5)]
    want = {i: f"Title {i}\n\n{PROSE[i]}\n\n{PROSE[i + 1]}!" for i in range(5)}
    assert texts(spark, pages) == want
    assert texts(spark, pages, broadcast=0) == want  # the shuffle join


def test_copies_of_one_article_stay(spark):
    page = f"<body><nav><a>x</a></nav><article><h1>T</h1><p>{PROSE[0]}</p><p>{PROSE[1]}</p></article></body>"
    got = texts(spark, [(i, f"http://copies.example/{i}", page) for i in range(6)] + [(9, "http://copies.example/9", page.replace(PROSE[1], PROSE[2]))])
    assert got[0] == f"T\n\n{PROSE[0]}\n\n{PROSE[1]}" and got[9] == f"T\n\n{PROSE[0]}\n\n{PROSE[2]}"


@pytest.mark.parametrize("noise", [
    "<aside>{}</aside>", "<div class='sidebar'>{}</div>", "<form><label>{}</label><input value='x'></form>", "<section id='comments'><article>{}</article></section>",
    "<div role='alert'>{}</div>", "<div hidden>{}</div>", "<script>var a = '<p>{}</p>';</script>", "<!-- {} -->", "<div class='cookieNotice'>{}</div>", "<ul class='nav-menu'><li>{}</ul>",
])
def test_noise_in_an_article(noise):
    body = f"<html><head><title>t</title><body><header><h2>Site</h2></header><article><header><h1>T</h1>by me</header><p>A &amp; b&nbsp;c<br>d <b>e<p>{PROSE[0]}{noise.format('GONE ' + PROSE[1])}<p>End</article><footer>f</footer>"
    assert op11_html.extracted(body, op11_html.Paths(), None, ()) == ["T", "A & b c d e", PROSE[0], "End"]


def test_odd_pages(spark):
    got = texts(spark, [(1, None, None), (2, "no url", ""), (3, "http://x/", "just words"), (4, "http://x/", "<p>a<p>b</div></article>c"), (5, None, "<" * 500 + "p class='"), (None, "http://y/", "<p>t")])
    assert got[1] == got[2] == "" and got[3] == "just words" and got[4] == "a\n\nbc" and got[None] == "t"
    assert texts(spark, []) == {}
    wide = spark.createDataFrame([(1, "http://x/", "<p>a", "h", "s")], "page_id long, url string, html string, host string, slot string")
    assert op11_html.main_text(wide).first().text == "a"


def brute(rows, positives=5, negatives=5):
    v = [(i, (y + 1) % 10 if i % 7 == 0 else y, [int(np.floor(256 * float(x))) for x in e]) for i, e, y in rows if i is not None and y is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for a, y, x in v:
        if a % 100:
            continue
        s = sorted((-sum(p * q for p, q in zip(x, e)), i, z) for i, z, e in v if i != a)
        for p, i, _ in [r for r in s if r[2] == y][:positives]:
            near = [r for r in s if r[2] != y and -80 * p <= -100 * r[0] <= -100 * p][:negatives]
            out += [(a, i, k, n, -p, -q) for k, (q, n, _) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("dims, scale", [(11, 1.0), (64, 0.1), (3, 1e6)])
def test_hard_negatives_by_brute_force(spark, dims, scale, monkeypatch):
    monkeypatch.setattr(op12_negatives, "BROADCAST", 200)  # several chunks
    monkeypatch.setattr(op12_negatives, "BLOCK", 64)
    rng = np.random.default_rng(dims)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(size=dims), 1) * scale], int(rng.integers(3))) for i in range(400)]
    rows += [(400, None, 1), (500, rows[0][1], None), (None, rows[0][1], 1), (600, [float("nan")] * dims, 1), (601, [None] * dims, 1), (602, [float("inf")] * dims, 1), rows[5], (700, rows[5][1], 1), (800, [], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    v = op12_negatives.relabelled(op12_negatives.quantised(df))
    assert sorted(map(tuple, op12_negatives.hard_negatives(v, v.where("vec_id % 100 = 0")).collect())) == brute(rows)
    none = v.where("false")
    assert op12_negatives.hard_negatives(v, none).count() == op12_negatives.hard_negatives(none, none).count() == 0


def test_planes_and_tables():
    rng = np.random.default_rng(1)
    a, c = rng.integers(-300, 300, (9, 16)), rng.integers(-300, 300, (70, 16))
    assert (op12_negatives.scores(op12_negatives.planes(c), op12_negatives.tables(a, True)) == c @ a.T).all()
    big = (1 << 60) + a
    got = op12_negatives.scores(op12_negatives.planes(big), op12_negatives.tables(big, False))
    assert not op12_negatives.fits(op12_negatives.planes(big), big) and (got == big.astype(object) @ big.astype(object).T).all()


def test_runs_of_equal_terms():
    import pyarrow as pa

    rows = ["Abcdefgh abcdefghi ABCDEFGH x", "", "abcdefghijklmnopq abcdefghijklmnopq\nßx1É", "abcdefghi x", "x"]
    terms, group, n, d = op13_divergence.shard(pa.array(rows).slice(0, 5), np.array([0, 0, 1, 1, 0]))
    assert sorted(zip(terms, group.tolist(), n.tolist(), d.tolist())) == sorted([
        ("abcdefgh", 0, 2, 1), ("abcdefghi", 0, 1, 1), ("abcdefghi", 1, 1, 1), ("abcdefghijklmnopq", 1, 2, 1), ("x", 0, 2, 2), ("x", 1, 1, 1), ("ßx", 1, 1, 1), ("É", 1, 1, 1),
    ])
    assert op13_divergence.shard(pa.array(rows).slice(2, 2), np.array([0, 0]))[0] == sorted(["abcdefghi", "abcdefghijklmnopq", "x", "ßx", "É"], key=str.encode)


def test_divergence_of_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op13_divergence, "ROWS", 40)  # several buckets
    monkeypatch.setattr(op13_divergence, "TILE", 2)  # and tiles
    monkeypatch.setattr(op13_divergence, "SHARD", 100)  # and shards
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["alpha", "BETA", "gamma", "épsilon", "longer" * 3, "x1y"], 6)), str(rng.choice(["a", "b"])), f"s{rng.integers(7)}", 1) for i in range(150)]
    rows += [(1, None, None, None, 0), (None, "alpha", "c", None, 0), (2, "alpha beta", "c", "s1", 0), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = op13_divergence.query(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(op13_divergence.ORACLE_SQL).fetchall()) and got.where("part = 'term'").count() > 20
    assert op13_divergence.audit(df.where("false")).count() == 0


@pytest.mark.parametrize("op", [op12_negatives, op13_divergence])
def test_sql(spark, op):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert sorted(map(tuple, op.query(spark, SF).collect())) == sorted(c.sql(op.ORACLE_SQL).fetchall())
