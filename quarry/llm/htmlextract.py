"""Main text of web pages: boosted trees over the page's block elements, decoded hierarchically.

The trees are trained here on made-up pages, which a seeded generator writes from many layouts and
whose parts are known; PAGES_LEARNED bounds them. Nothing is learned from the input.

Defined results: null and empty html give the empty text; a page whose elements are all refused too;
character references are decoded, white space in a block becomes one space, blocks are joined by a
blank line, and nothing is dropped or cut within a kept block. A page is parsed whole in time that grows
with its length, end tags that fit nothing included. Equal pages give equal texts; an empty table gives
an empty table. Extra columns pass through; one that is named `to` is replaced.
"""

from __future__ import annotations

import random
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches
from quarry.llm.htmltrees import Boosted, boost, decode, features, kept_text, parse

PAGES_LEARNED = 1000
SEED = 17
_MARK = "data-kept"


class _Writer:
    """Pages of random layout. Elements of the main text carry _MARK, which features don't see."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        parts = [rng.choice("bcdfghklmnprstvwz") + rng.choice("aeiouéäö") + rng.choice(["", "n", "r", "s", "t"]) for _ in range(60)]
        self.vocabulary = ["".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(400)]

    def words(self, low: int, high: int) -> str:
        n = self.rng.randint(low, high)
        out = [self.rng.choice(self.vocabulary) + (self.rng.choice(",.") if self.rng.random() < 0.12 else "") for _ in range(n)]
        return " ".join(out).capitalize() + self.rng.choice([".", ".", "", "!", " &amp; more."])

    def attrs(self, names: str, chance: float = 0.85) -> str:
        if self.rng.random() > chance:
            return ""
        name = self.rng.choice(names.split())
        more = self.rng.choice(["", "", "-wrap", " box", "_1", "-inner", " col", "Block"])
        return f' {self.rng.choice(["class", "class", "id"])}="{self.rng.choice(["", "", "site-", "page-", "js-"])}{name}{more}"'

    def links(self, low: int, high: int, short: bool = True) -> str:
        form = self.rng.choice(["<li><a href='/x'>{}</a></li>", "<a href='/x'>{}</a> ", "<li><a href='/x'>{}</a>"])
        items = "".join(form.format(self.words(1, 3 if short else 9)) for _ in range(self.rng.randint(low, high)))
        return f"<ul>{items}</ul>" if "<li>" in form else items

    def paragraphs(self, low: int, high: int, mark: str = "", size: tuple[int, int] = (4, 90)) -> str:
        out = []
        for _ in range(self.rng.randint(low, high)):
            kind, text = self.rng.random(), self.words(*((1, 5) if self.rng.random() < 0.2 else size))
            if kind < 0.08:
                text = f"<b>{text}<br>"
            elif kind < 0.16:
                text = f"{text} <a href='/y'>{self.words(1, 4)}</a> {self.words(2, 20)}"
            elif kind < 0.2:
                text = f"<em>{self.words(1, 4)}</em> {text}"
            out.append(f"<p{mark}>{text}" + ("" if kind < 0.12 else "</p>"))
        return "".join(out)

    def boilerplate(self, kinds: tuple[str, ...] = tuple("nav menu header footer aside related ad ad comments comments cookie newsletter form share meta".split())) -> str:
        r = self.rng
        kind = r.choice(kinds)
        tag = lambda *tags: r.choice(tags)
        if kind == "nav":
            t = tag("nav", "nav", "div")
            title = f"<h2>{self.words(1, 2)}</h2>" if r.random() < 0.3 else ""
            return f"<{t}{self.attrs('nav menu navigation breadcrumb pagination toc toc contents-toc', 1 if t == 'div' else 0.4)}>{title}{self.links(2, 9)}</{t}>"
        if kind == "menu":
            return f"<ul{self.attrs('menu navbar nav tabs', 0.8)}>" + self.links(3, 9).removeprefix("<ul>").removesuffix("</ul>") + "</ul>"
        if kind == "header":
            t = tag("header", "div")
            return f"<{t}{self.attrs('header masthead banner topbar', 1 if t == 'div' else 0.4)}>" + r.choice([f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(2, 8)}</p>", f"<div>{self.words(1, 4)}</div>", self.words(2, 12)]) + (self.links(2, 6) if r.random() < 0.5 else "") + f"</{t}>"
        if kind == "footer":
            t = tag("footer", "footer", "div")
            return f"<{t}{self.attrs('footer copyright legal bottom foot', 1 if t == 'div' else 0.4)}>" + r.choice(["&copy; ", ""]) + r.choice([self.words(3, 40), self.words(3, 20), self.paragraphs(1, 2, "", (3, 25)), self.links(2, 8)]) + f"</{t}>"
        if kind in ("aside", "related"):
            t = tag("aside", "div", "section") if kind == "aside" else tag("div", "section", "aside")
            names = "sidebar widget side" if kind == "aside" else "related recommended more trending popular"
            return f"<{t}{self.attrs(names, 1 if t != 'aside' else 0.5)}><{(h := r.choice(["h3", "h3", "h4", "h2"]))}>{self.words(1, 3)}</{h}>" + r.choice([self.links(2, 7, False), self.links(1, 3, False), self.paragraphs(1, 4, "", (4, 40))]) + f"</{t}>"
        if kind == "ad":
            t = tag("div", "div", "aside", "section", "ins")
            return f"<{t}{self.attrs('ad ads advert advertisement sponsored promo', 1)}>" + r.choice([self.words(3, 25), f"<p>{self.words(3, 25)}</p>", f"<a href='/z'>{self.words(2, 10)}</a>"]) + f"</{t}>"
        if kind == "comments":
            t, u = tag("section", "div", "div"), tag("div", "li", "article")
            one = lambda: f"<{u}{self.attrs('comment reply', 0.8)}>" + r.choice(["", f"<span>{self.words(1, 2)}</span>", f"<h4>{self.words(1, 3)}</h4>"]) + r.choice([self.paragraphs(1, 2), self.words(5, 60)]) + f"</{u}>"
            return f"<{t}{self.attrs('comments comment-list responses disqus discussion', 1)}>" + r.choice(["", f"<h3>{self.words(1, 3)}</h3>", "<h2>Comments</h2>"]) + "".join(one() for _ in range(r.randint(1, 6))) + f"</{t}>"
        if kind == "cookie":
            t = tag("div", "div", "section", "dialog", "aside")
            said = self.words(4, 45)
            return f"<{t}{self.attrs('cookie cookies consent notice notice gdpr alert popup modal', 1)}>" + r.choice([f"<p>{said}</p>", said]) + r.choice(["", "<button>OK</button>"]) + f"</{t}>"
        if kind == "newsletter":
            return f"<div{self.attrs('newsletter subscribe signup', 1)}><p>{self.words(4, 25)}</p><form><label>{self.words(1, 3)}</label><input><button>{self.words(1, 2)}</button></form></div>"
        if kind == "form":
            return f"<form{self.attrs('search contact login', 0.5)}><p>{self.words(2, 15)}</p><label>{self.words(1, 5)}</label><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select><textarea>{self.words(1, 9)}</textarea><button>{self.words(1, 2)}</button></form>"
        if kind == "share":
            return f"<div{self.attrs('share social follow', 1)}>{self.links(2, 5)}</div>"
        return f"<{(t := tag('div', 'p', 'p'))}{self.attrs('byline author meta timestamp tags', 1)}>{self.words(2, 9)}</{t}>"

    def main(self) -> str:
        r, k = self.rng, f" {_MARK}"
        out = [f"<h1{k}>{self.words(2, 12)}</h1>"] if r.random() < 0.8 else []
        if r.random() < 0.15 and out:
            out = [f"<header{k}>{out[0]}</header>"]
        tiny = r.random() < 0.15
        if tiny:
            out.append(self.paragraphs(1, 1, k, (1, 12)))
        for _ in range(0 if tiny else r.choice([1, 1, 1, 2, 3])):
            if r.random() < 0.3:
                h = r.choice("234")
                out.append(f"<h{h}{k}>{self.words(1, 8)}</h{h}>")
            out.append(self.paragraphs(1, r.choice([2, 5, 12]), k))
            if r.random() < 0.15:
                out.append(f"<ul{k}>" + "".join(f"<li{k}>{self.words(2, 25)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            if r.random() < 0.1:
                out.append(f"<blockquote{k}>" + self.paragraphs(1, 2, k) + "</blockquote>")
            if r.random() < 0.06:
                out.append(f"<pre{k}>{self.words(5, 30)}</pre>")
            if r.random() < 0.06:
                out.append(f"<table{k}><tr{k}><td{k}>{self.words(1, 8)}</td><td{k}>{self.words(1, 8)}</td></tr></table>")
            if r.random() < 0.06:
                out.append(f"<div{k}>{self.words(5, 60)}</div>")
            if r.random() < 0.3:
                out.append(self.boilerplate(("ad", "cookie", "cookie", "newsletter", "share", "form", "related", "comments", "nav")))
        body = "".join(out)
        if r.random() < 0.15:
            body = f"<div{k}{self.attrs('inner text row', 0.4)}>{body}</div>"
        if r.random() < 0.1:
            return body  # straight in the body
        t = r.choice("article article article main main section div div div".split())
        names = "article content post entry story main body text"
        body = f"<{t}{k}{self.attrs(names, 0.85 if t == 'div' else 0.3)}>{body}</{t}>"
        if r.random() < 0.3:
            around = [self.boilerplate() if r.random() < 0.4 else "", body, self.boilerplate() if r.random() < 0.4 else ""]
            body = f"<{(t := r.choice(['main', 'div', 'div', 'section']))}{k}{self.attrs('main content wrapper container page', 0.6)}>{''.join(around)}</{t}>"
        return body

    def page(self) -> str:
        r = self.rng
        head = f"<head><meta charset='utf-8'><title>{self.words(2, 9)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        before = "".join(self.boilerplate() for _ in range(r.choice([0, 1, 1, 2, 3])))
        after = "".join(self.boilerplate() for _ in range(r.choice([0, 1, 1, 2, 4])))
        script = "<script>if (a < b) { track('<p>'); }</script>" if r.random() < 0.3 else ""
        body = before + self.main() + after + script
        if r.random() < 0.15:
            body = f"<div {_MARK}{self.attrs('wrapper container page site', 0.7)}>{body}</div>"
        return f"<!DOCTYPE html><html {_MARK}>{head}<body {_MARK}>{body}" + ("</body></html>" if r.random() < 0.9 else "")


def made_up_pages(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return [_Writer(rng).page() for _ in range(n)]


@cache
def trained(pages: int = PAGES_LEARNED, seed: int = SEED) -> Boosted:
    """Trees fitted on made-up pages; elements weigh by their text."""
    rows, marks, weights = [], [], []
    for source in made_up_pages(pages, seed):
        page = parse(source)
        known = np.array([_MARK in a or i == 0 for i, a in enumerate(page.attrs)], float)
        page.attrs = [a.replace(_MARK, "") for a in page.attrs]
        rows.append(features(page))
        marks.append(known)
        weights.append(0.3 + np.log1p(np.array(page.own_chars)))
    return boost(np.vstack(rows), np.concatenate(marks), np.concatenate(weights))


def extract_texts(sources: list[str | None], model: Boosted) -> list[str]:
    """Main texts of pages; the trees run once over the elements of all of them."""
    pages = [parse(x) if x else None for x in sources]
    rows = [features(p) for p in pages if p is not None]
    odds = model.predict(np.vstack(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for p in pages:
        if p is None:
            out.append("")
            continue
        n = len(p.tag)
        out.append(kept_text(p, decode(p, odds[at : at + n])))
        at += n
    return out


def extract(pages: DataFrame, html: str = "html", to: str = "main_text", pages_learned: int = PAGES_LEARNED) -> DataFrame:
    """pages with the main text of their html."""
    bounded_batches(pages.sparkSession)
    model = trained(pages_learned)

    @F.arrow_udf("string")
    def main_text(sources: pa.Array) -> pa.Array:
        found = []
        for at in range(0, len(sources), 128):
            found += extract_texts(sources.slice(at, 128).to_pylist(), model)
        return pa.array(found, pa.string())

    return pages.withColumn(to, main_text(F.col(html).cast("string")))


def texts(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    out = extract(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
