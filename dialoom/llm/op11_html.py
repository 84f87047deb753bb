"""Main text of web pages by the template that pages of one host share.

Tokens of a page are its elements, each told by the path of tags and classes that leads to it, and its blocks' texts at
their paths. A token's occurrence vector says how often each page of the host has it. Spark adds the vectors up: pages,
occurrences and an exclusive or over hashes of (page, count), so that no page list is ever gathered; tokens of one host
with equal sums form an equivalence class. A class with an element that occurs once a page is valid; its elements are
where a template may have slots, nested as their paths are. Texts of a valid class that half of the host's pages have
belong to the template.

The main slot is found from the root down: ``main`` or ``article`` where there is one, else the nested element with the
larger part of the text that is neither template nor link. A page gives all blocks in that slot, in order, but those of
navigation, forms, scripts, adverts, notices and comments (told by tag, role or class) and those of the template. A page
whose host has no other page, or that lacks its host's slot, is its own template.

Cases: null or blank html gives an empty text; a null url is a host of its own; a broken page ends where it ends, open
elements are closed; a repeated page counts twice and is returned twice. A template text is kept on a page where such
texts are a fifth of the slot or more (copies of one article), and headings are always kept. A page without any block in
its slot gives what its body has.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import saved, table

#: Largest sum of template bytes that is broadcast; beyond it pages and templates meet by a shuffle, with the same result.
BROADCAST = 32 << 20
TOKEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*+>|[^>]*>?)|[!?][^>]*>?)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
words = lambda s: frozenset(s.split())
# HTML's elements without an end, with raw text, that begin a block, and that end with their next sibling.
VOID = words("area base br col embed hr img input link meta param source track wbr")
RAW = words("script style textarea title iframe noembed noframes xmp")
HEADING = words("h1 h2 h3 h4 h5 h6")
BLOCK = HEADING | words(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul"
)
SIBLING = {"li": words("ul ol menu dir"), "dt": words("dl"), "dd": words("dl"), "tr": words("table tbody thead tfoot"), "td": words("tr table"), "th": words("tr table"), "option": words("select optgroup datalist")}
ENDS = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
#: What is no article: by tag, by role, by a word of a class or id; a form or a class may be cleared by a title inside.
NOISE = words("head script style noscript template svg canvas iframe object embed applet audio video select button textarea option datalist label dialog nav aside footer menu")
ROLES = words("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar")
HINTS = words(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs masthead topbar header footer sidebar aside widget widgets ad ads adv advert adverts advertisement "
    "advertising adsense adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup comment comments commentlist disqus replies reply respond share sharing social related recommended recommendations pagination pager toolbar login search"
)
#: Elements that can hold a page's article, and those that an open paragraph doesn't reach out of.
CONTAINER = words("html body div section center table tbody tr td form main article details")
STOP = CONTAINER | words("li blockquote button")


def looks(tag: str, attributes: str) -> tuple[str, int, bool]:
    """(signature, kind of noise, is the article): kind 0 none, 1 for good, 2 until a title is met inside."""
    if tag in NOISE:
        return tag, 1, False
    kind, main, name = 2 * (tag == "form"), tag in ("main", "article"), tag
    if "=" in attributes or "hidden" in attributes:
        got = {}
        for m in ATTRIBUTE.finditer(attributes):
            got.setdefault((m[1] or m[5]).lower(), m[2] or m[3] or m[4] or "")
        named = f"{got.get('class', '')} {got.get('id', '')}"
        if named != " ":
            name = tag + "." + ".".join(re.sub(r"[0-9]+", "", x) for x in got.get("class", "").split()) + "#" * ("id" in got) + re.sub(r"[0-9]+", "", got.get("id", ""))
            if tag not in ("html", "body") and HINTS & set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower())):
                kind = 2
        if got.get("role", "").lower() in ROLES or "hidden" in got or got.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", got.get("style", "")):
            kind = 1
        main = main or got.get("role") == "main" or got.get("itemprop") == "articleBody"
    return name, kind, main and not kind


class Paths:
    """Paths of elements as small numbers, shared by the pages of a batch."""

    def __init__(self):
        self.ids, self.parent, self.text, self.tag, self.main, self.known = {}, [-1], [""], [""], [False], {}

    def child(self, parent: int, tag: str, name: str, main: bool) -> int:
        k = self.ids.get((parent, name, main))
        if k is None:
            k = self.ids[parent, name, main] = len(self.parent)
            self.parent.append(parent)
            self.text.append(f"{self.text[parent]}/{name}{'!' * main}")
            self.tag.append(tag)
            self.main.append(main)
        return k

    def looks(self, tag: str, attributes: str) -> tuple[str, int, bool]:
        if len(attributes) < 3:
            attributes = ""
        k = self.known.get((tag, attributes))
        if k is None:
            if len(self.known) > 50_000:
                self.known.clear()
            k = self.known[tag, attributes] = looks(tag, attributes)
        return k


class Page:
    """A parsed page: elements (path to count) and blocks (path, text, chars of links) in order, noise left out."""

    def __init__(self, html: str, paths: Paths, hints: bool = True):
        self.paths, self.elements, self.blocks = paths, {}, []
        made, parts, links = [], [], 0
        #: Open elements: tag, ends a block, path, path of the block, noisy elements around (-1: for good), inside a link.
        stack: list[tuple] = [("", True, 0, 0, (), False)]
        cleared, count, at, end, search = set(), 0, 0, len(html), TOKEN.search
        kept: set[int] = set()  # headers inside an article: only headings stay

        def close(depth: int):
            nonlocal parts, links
            if parts and any(s[1] for s in stack[depth:]):
                made.append((stack[-1][3], parts, links))
                parts, links = [], 0
            del stack[depth:]

        def text(s: str):
            nonlocal links
            _, _, _, _, noise, linked = stack[-1]
            if noise and noise[0] == -1:
                return
            if "&" in s:
                s = entities.unescape(s)
            if linked:
                links += len(s)
            parts.append((s, noise) if noise else s)

        while at < end:
            m = search(html, at)
            if m is None:
                text(html[at:])
                break
            if m.start() > at:
                text(html[at : m.start()])
            at, tag = m.end(), m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == tag:
                        if depth == len(stack) - 1 or tag in BLOCK or not any(s[1] for s in stack[depth + 1 :]):
                            close(depth)
                        else:  # an inline element that outlives its block's begin
                            stack[depth] = ("", *stack[depth][1:])
                        break
                continue
            if tag in VOID:
                if tag == "br":
                    text(" ")
                elif tag == "hr":
                    made.append((stack[-1][3], parts, links))
                    parts, links = [], 0
                continue
            block = tag in BLOCK
            if block:
                if parts:
                    made.append((stack[-1][3], parts, links))
                    parts, links = [], 0
                for depth in range(1, min(3, len(stack))):  # nothing that shows is in a head
                    if stack[depth][0] == "head":
                        close(depth)
                        break
                if tag in SIBLING:
                    for depth in range(len(stack) - 1, 0, -1):
                        if stack[depth][0] in ENDS.get(tag, (tag,)):
                            close(depth)
                            break
                        if stack[depth][0] in SIBLING[tag]:
                            break
                else:
                    for depth in range(len(stack) - 1, 0, -1):
                        open_ = stack[depth][0]
                        if open_ == "p" or open_ in HEADING and tag in HEADING:
                            close(depth)
                            break
                        if open_ in STOP:
                            break
            _, _, path, around, noise, linked = stack[-1]
            if not noise or noise[0] != -1:
                name, kind, main = paths.looks(tag, m[3])
                path = paths.child(path, tag, name, main)
                self.elements[path] = self.elements.get(path, 0) + 1
                if kind == 1:
                    noise = (-1,)
                elif kind and (hints or tag == "form"):
                    count += 1
                    noise = (*noise, count)
                elif tag == "header":
                    count += 1
                    if any(s[0] in ("article", "main", "section") for s in stack):
                        kept.add(count)
                        noise = (*noise, count)
                    else:
                        noise = (-1,)
                if tag == "h1" or main and tag != "article":
                    cleared.update(n for n in noise if n not in kept)
            stack.append((tag, block, path, path if block else around, noise, linked or tag == "a"))
            if tag in RAW:
                at = re.compile(rf"</{tag}[\s/>]|\Z", re.I).search(html, at).start()
        if parts:
            made.append((stack[-1][3], parts, links))

        def stays(noisy, heading: bool) -> bool:
            return all(n in cleared or heading and n in kept for n in noisy)

        for where, pieces, link in made:
            k, heading = where, False
            while k > 0 and not heading:
                k, heading = paths.parent[k], paths.tag[k] in HEADING
            body = "".join(x if isinstance(x, str) else x[0] if stays(x[1], heading) else "" for x in pieces)
            body = " ".join(body.split())
            if body:
                self.blocks.append((where, body, min(link, len(body)), heading))

    def sums(self) -> dict[int, list[int]]:
        """Path to [chars, chars of links, of headings] of all blocks below, the path's own included."""
        out = {k: [0, 0, 0] for k in self.elements}
        out[0] = [0, 0, 0]
        for k, body, link, heading in self.blocks:
            while k >= 0:
                s = out.setdefault(k, [0, 0, 0])
                s[0] += len(body)
                s[1] += link
                s[2] += len(body) * heading
                k = self.paths.parent[k]
        return out


def token(path: str, body: str = "") -> int:
    """A token's number: of an element, or of a text at its path."""
    return xxhash.xxh64_intdigest(f"{path}\0{body}") - (1 << 63)


def slot(nodes: dict[str, tuple[int, int]]) -> str:
    """The path of the main slot. nodes: path of a valid element to (text that counts, all text)."""
    below: dict[str, list[str]] = {}
    for p in nodes:
        up = p.rpartition("/")[0]
        while up and up not in nodes:
            up = up.rpartition("/")[0]
        below.setdefault(up, []).append(p)
    here, inside = "", nodes
    for _ in range(len(nodes)):
        holds = [p for p in below.get(here, []) if re.split(r"[.#!]", p.rpartition("/")[2], maxsplit=1)[0] in CONTAINER and nodes[p][1] > 0]
        named = [p for p in inside if p.endswith("!") and nodes[p][1] > 0 and (not here or p.startswith(here + "/"))]
        if named and not here.rpartition("/")[2].startswith("article"):
            here = min(named, key=lambda p: (p.count("/"), -nodes[p][1], p))
            continue
        if here.endswith("!") or not holds:
            break
        top = max(holds, key=lambda p: (nodes[p][0], nodes[p][1], p))
        if here and nodes[here][0] and 10 * nodes[top][0] < 6 * nodes[here][0]:
            break
        here = top
    return here


def tokens(pages: DataFrame) -> DataFrame:
    """(host, path, token, body, pages, times, vector, chars, links): summed occurrence vectors of all tokens of a host."""

    def run(batches):
        for x in batches:
            paths, found = Paths(), {}
            for host, doc in zip(x.host, x.html, strict=True):
                page, key = Page(doc, paths), xxhash.xxh64_intdigest(doc)
                sums, seen = page.sums(), {(0, ""): [1, 0, 0]}
                for k, n in page.elements.items():
                    seen[k, ""] = [n, sums[k][0], sums[k][1]]
                for k, body, link, heading in page.blocks:
                    if not heading:
                        s = seen.setdefault((k, body), [0, 0, 0])
                        s[0], s[1], s[2] = s[0] + 1, s[1] + len(body), s[2] + link
                for (k, body), (n, chars, links) in seen.items():
                    path = paths.text[k]
                    t = found.setdefault((host, path, token(path, body), body != ""), [0, 0, 0, 0, 0])
                    t[0] += 1
                    t[1] += n
                    t[2] ^= xxhash.xxh64_intdigest(key.to_bytes(8, "little") + n.to_bytes(4, "little"))
                    t[3] += chars
                    t[4] += links
            if found:
                rows = [(*k, v[0], v[1], v[2] - (1 << 63), v[3], v[4]) for k, v in found.items()]
                yield pd.DataFrame(rows, columns=["host", "path", "token", "body", "pages", "times", "vector", "chars", "links"])

    parts = pages.select("host", "html").mapInPandas(run, "host string, path string, token long, body boolean, pages long, times long, vector long, chars long, links long")
    return parts.groupBy("host", "path", "token", "body").agg(
        F.sum("pages").alias("pages"), F.sum("times").alias("times"), F.bit_xor("vector").alias("vector"), F.sum("chars").alias("chars"), F.sum("links").alias("links"),
    )


def templates(found: DataFrame) -> DataFrame:
    """(host, slot, texts): the main slot of each host of two pages or more, and the numbers of its template texts.

    Only tokens of an eighth of a host's pages (texts: of half of them, and three) can be of its template, so a host has a
    few times as many of them as a page has tokens, whatever its number of pages.
    """
    size = found.where("path = ''").select("host", F.col("pages").alias("all")).where("all > 1")
    often = found.join(size, "host").where("(not body and 8 * pages >= all) or (body and pages > 2 and 2 * pages >= all)")
    each = often.groupBy("host").agg(F.collect_list(F.struct("path", "token", "body", "pages", "times", F.hash("pages", "times", "vector").alias("class"), "vector", "chars", "links")).alias("token"))

    def run(batches):
        for x in batches:
            out = []
            for host, rows in zip(x.host, x.token, strict=True):
                classes: dict[tuple, list] = {}
                for r in rows:
                    classes.setdefault((r["pages"], r["times"], r["vector"]), []).append(r)
                valid = {k: c for k, c in classes.items() if k[0] == k[1] and any(not r["body"] for r in c)}
                texts = [r for c in valid.values() for r in c if r["body"]]
                nodes = {r["path"]: [r["chars"] - r["links"], r["chars"]] for c in valid.values() for r in c if not r["body"] and r["path"]}
                whole = sum(n for _, n in nodes.values())
                common = {p: sum(t["chars"] - t["links"] for t in texts if t["path"] == p or t["path"].startswith(p + "/")) for p in nodes}
                if 5 * sum(common.values()) < 4 * whole:  # else copies of one article are all there is
                    for p, n in common.items():
                        nodes[p][0] -= n
                here = slot({p: tuple(n) for p, n in nodes.items()})
                out.append((host, here, [int(t["token"]) for t in texts if t["path"].startswith(here)]))
            yield pd.DataFrame(out, columns=["host", "slot", "texts"])

    return each.mapInPandas(run, "host string, slot string, texts array<long>")


def inside(path: str, here: str) -> bool:
    return not here or path == here or path.startswith(here + "/")


def extracted(html: str, paths: Paths, here: str | None, texts) -> list[str]:
    """The blocks of a page's main slot; here: the slot of its host's template, if it has one."""
    for hints in (True, False):
        page = Page(html, paths, hints)
        if not page.blocks:
            continue
        sums = page.sums()
        size = {}
        for k, s in sums.items():
            size[paths.text[k]] = s
        alone = slot({paths.text[k]: (sums[k][0] - sums[k][1], sums[k][0]) for k, n in page.elements.items() if n == 1})
        if here is None or size.get(here, (0,))[0] == 0 or not here.endswith("!") and 2 * size[here][0] < size.get(alone, (0,))[0]:
            here = alone
        own = [(paths.text[k], body, heading, paths.tag[k]) for k, body, _, heading in page.blocks]
        first = next((i for i, b in enumerate(own) if inside(b[0], here)), 0)
        picked = [b for b in own if inside(b[0], here)]
        if not any(b[2] and "/h1" in b[0] for b in picked):
            title = [b for b in own[:first] if b[2] and "/h1" in b[0]][-1:]
            picked = title + picked
        if len(texts):
            gone = [not heading and token(path, body) in texts for path, body, heading, _ in picked]
            if 5 * sum(len(b[1]) for b, g in zip(picked, gone, strict=True) if g) < sum(len(b[1]) for b in picked):
                picked = [b for b, g in zip(picked, gone, strict=True) if not g]
        if picked:
            return [b[1] for b in picked]
    return []


def main_text(pages: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """pages (page_id, url, html, ...) with text: the main text of each page."""
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    known = saved(templates(tokens(rows)), "templates")
    size = known.agg(F.sum(F.length("host") + F.length("slot") + 8 * F.size("texts") + 64)).first()[0] or 0
    both = rows.join(F.broadcast(known) if size <= broadcast else known.hint("merge"), "host", "left")

    def run(batches):
        for x in batches:
            paths, out = Paths(), []
            for doc, here, texts in zip(x.html, x.slot, x.texts, strict=True):
                known = not (here is None or here != here)
                out.append("\n\n".join(extracted(doc, paths, here if known else None, set(texts) if known else ())))
            yield pd.DataFrame({"page_id": x.page_id, "url": x.url, "text": out})

    return both.select(F.col("page_id").cast("string"), "url", "html", "slot", "texts").mapInPandas(run, "page_id string, url string, text string").select(F.col("page_id").cast("long"), "url", "text")


def query(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
