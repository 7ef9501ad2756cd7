"""The main content of a page: a small tree of its elements, and three ways of finding the content in it."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from ..storage import sliced

# Where content is looked for first, and names that speak for or against an element.
SEMANTIC = (
    ("tag", "main"), ("tag", "article"), ("role", "main"), ("class", "content"), ("id", "content"), ("class", "post-content"), ("class", "entry-content"),
    ("class", "article-content"),
)
GOOD_NAMES = re.compile("content|article|post|entry|main|story|text")
BAD_NAMES = re.compile("nav|sidebar|footer|header|menu|comment|ads|social|share")
EXCERPT_CLASSES = ("excerpt", "summary", "teaser", "lead", "intro")
PAYWALL_WORDS = ("subscribe", "premium", "member", "unlock", "sign up")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that a start tag of the key closes if they are open.
CLOSED_BY = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "div": {"p"}, "ul": {"p"}, "section": {"p"}, "article": {"p"}, "table": {"p"}}
STYLE = {"a", "b", "em", "font", "i", "small", "span", "strong", "u"}
LEAST, MOST = 200, 50_000


class Element:
    __slots__ = ("tag", "attrs", "parent", "parts")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts: list[Element | str] = []

    def walk(self):
        """All elements below, in the order of the page."""
        waiting = [p for p in reversed(self.parts) if isinstance(p, Element)]
        while waiting:
            one = waiting.pop()
            yield one
            waiting += [p for p in reversed(one.parts) if isinstance(p, Element)]

    def text(self) -> str:
        out, waiting = [], [self]
        while waiting:
            one = waiting.pop()
            if isinstance(one, str):
                out.append(one)
            else:
                waiting += reversed(one.parts)
        return "".join(out)

    def has(self, name: str, value: str) -> bool:
        if name == "tag":
            return self.tag == value
        own = self.attrs.get(name, "")
        return value in own.split() if name == "class" else own == value

    @property
    def depth(self) -> int:
        n, one = 0, self.parent
        while one is not None:
            n, one = n + 1, one.parent
        return n


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.open = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        closing, one = CLOSED_BY.get(tag, set()), self.open
        # marks of style do not keep a paragraph open
        while closing and (one.tag in closing or one.tag in STYLE):
            if one.tag in closing:
                self.open = one.parent
            one = one.parent
        own = Element(tag, {k: v or "" for k, v in attrs}, self.open)
        self.open.parts.append(own)
        if tag not in VOID:
            self.open = own

    def handle_startendtag(self, tag, attrs):
        self.open.parts.append(Element(tag, {k: v or "" for k, v in attrs}, self.open))

    def handle_endtag(self, tag):
        one = self.open
        while one is not None and one.tag != tag:
            one = one.parent
        if one is not None and one.parent is not None:
            self.open = one.parent

    def handle_data(self, data):
        self.open.parts.append(data)


def tree(html: str) -> Element:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    return parser.root


def first(elements: list[Element], name: str, value: str) -> Element | None:
    return next((e for e in elements if e.has(name, value)), None)


def main_content(elements: list[Element], body: Element) -> tuple[str, str]:
    """``(way, text)``: by a semantic element, by the densest paragraph's parent, by size, or the body."""
    for name, value in SEMANTIC:
        found = first(elements, name, value)
        if found is not None and len(text := found.text().strip()) > LEAST:
            return "semantic", text
    best, parent = 0, None
    for e in elements:
        if e.tag in ("p", "div") and len(text := e.text().strip()) >= 50:
            score = len(text) + 10 * len(re.findall("[.!?]", text)) + 2 * len(re.findall("[,;]", text))
            if score > best:
                best, parent = score, e.parent
    if parent is not None and len(text := parent.text().strip()) > LEAST:
        return "score", text
    sized = [t for e in elements if e.tag in ("div", "section", "article") and LEAST < len(t := e.text().strip()) < MOST]
    if sized:
        return "size", max(sized, key=len)
    return "body", body.text()


def element_score(e: Element) -> float:
    """How likely an element is the main content, between 0 and 1: length, paragraphs, links, names and depth."""
    text = e.text().strip()
    if len(text) < 100:
        return 0.0
    below = list(e.walk())
    paragraphs, links = sum(x.tag == "p" for x in below), sum(x.tag == "a" for x in below)
    share = links / max(paragraphs, 1)
    names = f"{e.attrs.get('class', '')} {e.attrs.get('id', '')}".lower()
    score = 0.3 * (len(text) > 500) + 0.2 * (len(text) > 1500) + 0.1 * (len(text) > 3000) + min(0.05 * paragraphs, 0.3)
    score += (0.2 if share < 0.2 else -0.3 if share > 0.5 else 0.0) + 0.3 * bool(GOOD_NAMES.search(names)) - 0.5 * bool(BAD_NAMES.search(names)) + 0.1 * (3 < e.depth < 10)
    return max(0.0, min(1.0, score))


def _meta(elements: list[Element], name: str, value: str) -> str:
    return next((e.attrs.get("content", "") for e in elements if e.tag == "meta" and e.attrs.get(name) == value), "")


def byline(elements: list[Element]) -> str:
    """The first author's name of fewer than 100 characters."""
    tests = (
        lambda e: e.tag == "a" and e.attrs.get("rel") == "author", lambda e: "author" in e.attrs.get("itemprop", ""), lambda e: e.has("class", "byline"), lambda e: e.has("class", "author"),
        lambda e: "author" in e.attrs.get("class", ""), lambda e: "author" in e.attrs.get("id", ""),
    )
    for test in tests:
        found = next((e for e in elements if test(e)), None)
        if found is not None and 0 < len(text := found.text().strip()) < 100:
            return text
    return ""


def site_name(elements: list[Element], title: str, host: str) -> str:
    named = _meta(elements, "property", "og:site_name")
    parts = re.split(r"[|\-–—]", title)
    return named or (parts[-1].strip() if len(parts) > 1 else host)


def public_content(elements: list[Element], title: str) -> dict:
    """What a page shows to everybody: title, excerpt, author, date, tags, headings and first paragraphs."""
    head = first(elements, "tag", "h1")
    told = _meta(elements, "property", "og:title") or _meta(elements, "name", "title") or (head.text().strip() if head is not None else title)
    excerpt = next((t for t in (_meta(elements, "property", "og:description").strip(), _meta(elements, "name", "description").strip()) if len(t) > 50), None)
    for c in EXCERPT_CLASSES:
        found = first(elements, "class", c)
        if excerpt is None and found is not None and len(text := found.text().strip()) > 50:
            excerpt = text
    author = _meta(elements, "name", "author") or next((e.text() for e in elements if e.attrs.get("rel") == "author" or e.has("class", "author")), "")
    date = _meta(elements, "property", "article:published_time") or next((e.attrs.get("datetime", "") for e in elements if e.tag == "time" and "pubdate" in e.attrs), "") or next((e.text() for e in elements if e.has("class", "publish-date")), "")
    tags = [e.attrs.get("content", "") for e in elements if e.tag == "meta" and e.attrs.get("property") == "article:tag"]
    headings = [{"level": int(e.tag[1]), "text": t} for e in elements if re.fullmatch("h[1-6]", e.tag) and len(t := e.text().strip()) > 10][:10]
    shown = [t for e in elements if e.tag == "p" and len(t := e.text().strip()) > 50 and not any(w in t.lower() for w in PAYWALL_WORDS)][:3]
    return {"title": told, "excerpt": excerpt, "author": author.strip() or None, "date": date.strip() or None, "tags": tags, "headings": headings, "summary": "\n\n".join(shown)}


def complexity(elements: list[Element], shadow_roots: int = 0) -> str:
    """high, medium or low by numbers of frames, shadow roots and scripts."""
    frames, scripts = sum(e.tag == "iframe" for e in elements), sum(e.tag == "script" for e in elements)
    if frames > 3 or shadow_roots > 2 or scripts > 20:
        return "high"
    return "medium" if frames or shadow_roots or scripts > 10 else "low"


CONTENT = (
    "page_id long, way string, content string, length long, byline string, site_name string, excerpt string, complexity string, best_tag string, best_score double, "
    "public struct<title: string, excerpt: string, author: string, date: string, tags: array<string>, headings: array<struct<level: int, text: string>>, summary: string>"
)


def read_page(html: str, host: str = "") -> tuple:
    root = tree(html)
    elements = list(root.walk())
    body = first(elements, "tag", "body") or root
    head = first(elements, "tag", "title")
    title = head.text() if head is not None else ""
    way, content = main_content(elements, body)
    scored = [(element_score(e), -n, e.tag) for n, e in enumerate(elements) if e.tag in ("main", "article", "section", "div")]
    best = max(scored, default=(0.0, 0, None))
    return (
        way, content, len(content), byline(elements), site_name(elements, title, host), content[:280], complexity(elements), best[2] if best[0] > 0 else None, best[0],
        public_content(elements, title),
    )


def read_pages(pages: DataFrame) -> DataFrame:
    """Everything above for ``pages (page_id, url, html)``; null pages are empty, null addresses have no host."""

    def run(batches):
        names = [c.split()[0] for c in CONTENT.split(" struct<")[0].split(", ")]
        for pdf in sliced(batches):
            rows = []
            for key, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True):
                found = re.match(r"[a-zA-Z]+://([^/:?#]+)", url or "")
                rows.append((key, *read_page(html or "", found[1] if found else "")))
            yield pd.DataFrame(rows, columns=names)

    return pages.select("page_id", "url", "html").mapInPandas(run, CONTENT)
