"""Operator 7: main text of web pages by maximum-scoring subsequence.

A page is a sequence of words and tags.  Every word scores by where it stands (in a paragraph, heading, link, plain
container or clutter) and every tag by its name; a score is the log-odds that such a token lies in main text, as counted
on labelled pages: pages whose author marked the main text with article or main.  One linear scan finds the contiguous
region with the largest sum, and its text, without clutter inside it, is the page's.

Elements are clutter by name (nav, footer and such), if hidden, or by words of class, id or role that mark clutter.  Such
marks are no evidence, and the element's words are scored like others, where the element holds an article, main or (unless
it is named a site's header) h1, where it holds nine tenths of the page's words or more, and where the name says that
something else has the mark (has-sidebar, no-sidebar, comment-enabled).  Tags are cut in one pass that never turns back and
end tags close what is open below them, so any page takes linear time; a page without tags is one block of prose.

The weights are fitted on at most about ``sample_pages`` labelled pages, picked by hash, with prior counts that alone
decide where no page is labelled.  Null and empty html have the text ''; repeated pages are rows of their own; an empty
table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.llm.common import read_table

NAME = re.compile(r"(/?)([a-zA-Z][^\s/><]*)")
#: Where a tag ends, another begins, or a quoted value begins.
STOP = re.compile(r"""[<>]|=\s*(["'])""")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes", "svg", "math", "object", "canvas"}
RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLUTTER = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "fieldset", "datalist"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PROSE = {"p", "blockquote", "pre", "dd", "td", "figcaption"}
#: Words in class, id or role that mark clutter.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert "
    "menu nav navbar navigation navigation breadcrumb breadcrumbs sidebar side rail footer foot header masthead topbar toolbar comment comments "
    "discussion disqus replies reply respond share sharing social related recommended recommendations newsletter subscribe subscription signup "
    "login popup modal overlay paywall widget toc pagination pager skip search complementary contentinfo".split()
)
ATTRIBUTE = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
#: Prior counts, inside and outside of main text.
PRIOR = {"word clutter": (1, 400), "word link": (20, 60), "word heading": (60, 30), "word prose": (90, 10), "word plain": (40, 40), "tag": (20, 60)}
PRIOR |= {f"tag {t}": (60, 40) for t in PROSE | HEADINGS | INLINE - {"a"} | {"br"}}


#: Words by which a name says that something else has or lacks the mark beside them.
OTHERS = {"no", "not", "has", "have", "with", "without", "and", "enabled", "disabled"}
#: Words beside header that make it that of the text.
TITLES = {"entry", "post", "article", "story", "title", "section", "content"}
SITE_HEADERS = {"header", "masthead", "site-header", "page-header", "topbar", "navbar", "banner"}
FRAMES = {"body", "html", "main", "article"}


def lex(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text, '', False, '') or ('', tag name, whether an end tag, attributes) in page order.  A '<' inside a tag and outside
    of quoted values ends the tag; a quote that is not closed is an ordinary character; an open tag runs to the page's end."""
    at = start = 0
    size = len(page)
    last = {q: page.rfind(q) for q in "\"'>"}
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end, name = page.find("-->", at + 4), None
            stop = size if end < 0 else end + 3
        elif page[at + 1 : at + 2] in ("!", "?") and at < last[">"]:
            stop, name = page.find(">", at) + 1, None
        elif name := NAME.match(page, at + 1):
            stop = name.end()
            while stop < size:
                found = STOP.search(page, stop)
                if not found:
                    stop = size
                elif not found[1]:
                    stop = found.end() if found[0] == ">" else found.start()
                    break
                else:
                    stop = found.end() if last[found[1]] < found.end() else page.find(found[1], found.end()) + 1
        else:
            at += 1
            continue
        if start < at:
            yield page[start:at], "", False, ""
        if name:
            tag, attributes = name[2].lower(), page[name.end() : stop].rstrip(">")
            yield "", tag, name[1] == "/", attributes
            if not name[1] and tag in RAW and not attributes.endswith("/"):
                close = RAW_END[tag].search(page, stop)
                stop = close.end() if close else size
        at = start = stop
    if start < size:
        yield page[start:], "", False, ""


def _suspect(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether a tag's attributes mark clutter, and whether they name a site's header."""
    if not attributes or name in FRAMES:
        return False, False
    if HIDDEN.search(attributes):
        return True, False
    marked = site = False
    for m in ATTRIBUTE.finditer(attributes):
        for mark in m[1].strip("\"'").split():
            words = re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", mark).lower())
            found = MARKS.intersection(words)
            if found and not OTHERS.intersection(words) and not (found == {"header"} and TITLES.intersection(words)):
                marked = True
                site = site or mark.lower() in SITE_HEADERS
    return marked, site


def _extents(items: list[tuple[str, str, bool, str]]) -> dict[int, int]:
    """Where each element ends: at its end tag, at one of an element around it, at the next block for p, or the page's end."""
    ends: dict[int, int] = {}
    opened: list[tuple[str, int]] = []
    counts, blocks = Counter(), []

    def close(to: int, end: int) -> None:
        while len(opened) > to:
            name, i = opened.pop()
            counts[name] -= 1
            ends[i] = end
        while blocks and blocks[-1] >= to:
            blocks.pop()

    for i, (_, name, closing, attributes) in enumerate(items):
        if not name or name in VOID or name in RAW:
            continue
        if closing:
            if counts[name]:
                to = len(opened) - 1
                while opened[to][0] != name:
                    to -= 1
                close(to, i)
            continue
        if attributes.endswith("/"):
            continue
        if name not in INLINE:
            if blocks and opened[blocks[-1]][0] in ("p", "li") and (opened[blocks[-1]][0] == "p" or name == "li"):
                close(blocks[-1], i)
            blocks.append(len(opened))
        opened.append((name, i))
        counts[name] += 1
    close(0, len(items))
    return ends


def _clutter(items: list[tuple[str, str, bool, str]]) -> list[bool]:
    """Whether each item stands in clutter; the tag that begins it does."""
    ends = _extents(items)
    words, frames, heads = [0], [0], [0]
    for text, name, closing, _ in items:
        words.append(words[-1] + len(text.split()))
        frames.append(frames[-1] + (not closing and name in ("article", "main")))
        heads.append(heads[-1] + (not closing and name == "h1"))
    out, main = [False] * len(items), 0
    until = main_until = 0
    for i, (_, name, closing, attributes) in enumerate(items):
        if name in ("article", "main") and i in ends:
            main_until = max(main_until, ends[i])
        if i < until:
            out[i] = True
            continue
        end = ends.get(i)
        if end is None:
            continue
        main = i < main_until
        marked, site = _suspect(name, attributes)
        sure = name in CLUTTER or (name == "header" and not main)
        if not (sure or marked):
            continue
        holds = frames[end] > frames[i + 1]
        if name != "head" and (holds or (not sure and ((heads[end] > heads[i + 1] and not (site and not main)) or words[end] - words[i] >= 0.9 * words[-1] > 0))):
            continue
        out[i], until = True, end
    return out


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """(feature, text or tag, whether inside an article or main) in page order: the words of a text under one feature."""
    items = list(lex(page))
    main, link = 0, False
    block = "plain" if any(name for _, name, _, _ in items) else "prose"
    for (text, name, closing, _), clutter in zip(items, _clutter(items)):
        if text:
            yield "word " + ("clutter" if clutter else "link" if link else block), text, main > 0
            continue
        if name in RAW:
            continue
        if name in ("article", "main"):
            main = max(0, main + (-1 if closing else 1))
        if name == "a":
            link = not closing
        elif name not in INLINE and name != "br":
            link = False
            block = "plain" if closing else "heading" if name in HEADINGS else "prose" if name in PROSE else "plain"
        yield f"tag {name}", ("/" if closing else "") + name, main > 0


def scores(counts: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Log-odds of main text by feature, words over 0 and tags below where the counts say so."""
    out = {}
    for feature in {*counts, *PRIOR}:
        a, b = PRIOR.get(feature, PRIOR["tag"])
        inside, outside = counts.get(feature, (0, 0))
        odds = math.log((inside + a) / (outside + b))
        out[feature] = min(odds, -0.1) if feature.startswith("tag") else odds
    out["word clutter"] = min(out["word clutter"], -1.0)
    out["word prose"] = max(out["word prose"], 0.5)
    return out


def best_region(values: list[float]) -> tuple[int, int]:
    """First and end of the contiguous region with the largest sum; of equal ones the first, empty if none is above zero."""
    best, start, now, span = 0.0, 0, 0.0, (0, 0)
    for i, value in enumerate(values):
        now += value
        if now <= 0:
            now, start = 0.0, i + 1
        elif now > best:
            best, span = now, (start, i + 1)
    return span


def main_text(page: str | None, weights: dict[str, float]) -> str:
    parts = list(tokens(page or ""))
    span = best_region([(len(text.split()) if feature.startswith("word") else 1) * weights.get(feature, weights["tag"]) for feature, text, _ in parts])
    blocks, held = [], []
    for feature, text, _ in parts[span[0] : span[1]]:
        if feature == "word clutter":
            continue
        if feature.startswith("word"):
            held.append(text)
        elif (name := text.lstrip("/")) not in INLINE:
            blocks.append("".join(held))
            held = []
    blocks.append("".join(held))
    clean = (" ".join(entities.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in clean if b)


def fit_weights(pages: DataFrame, sample_pages: int = 2000) -> dict[str, float]:
    """Weights from about sample_pages labelled pages; at most a few hundred features come back to the driver."""
    marked = pages.where(F.lower("html").rlike("<(article|main)[\\s>]")).select("html")
    step = max(1, marked.count() // sample_pages)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch["html"]:
                for feature, text, main in tokens(page):
                    if feature.startswith("word") or feature[4:] in KNOWN:
                        (inside if main else outside)[feature] += len(text.split()) if feature.startswith("word") else 1
        yield pd.DataFrame([(f, inside[f], outside[f]) for f in {*inside, *outside}], columns=["feature", "inside", "outside"])

    sample = marked.where(F.pmod(F.xxhash64("html"), F.lit(step)) == 0)
    rows = sample.mapInPandas(count, "feature string, inside long, outside long").groupBy("feature").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
    return scores({r["feature"]: (r["i"], r["o"]) for r in rows.collect()})


KNOWN = VOID | INLINE | CLUTTER | HEADINGS | PROSE | set("html body div section article main header ul ol li dl dt table tr th tbody thead figure address center".split())


def extract(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """pages with text."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield pd.Series([main_text(p, weights) for p in part], dtype=object)

    return pages.withColumn("text", of(F.col("html")))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 on all pages."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, fit_weights(pages)).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
