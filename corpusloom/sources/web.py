"""Web pages: URL rules as expressions, and one pass of a parser for everything that needs the tree."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of
from ..storage import sliced

# Fixed values.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid", "ref", "source", "campaign", "_ga", "_gid", "mc_cid", "mc_eid")
SENSITIVE = (
    "bank", "banking", "paypal", "stripe", "visa", "mastercard", "gov", "gouv", "government", "health", "medical", "hospital", "localhost",
    "127.0.0.1", "local", "intranet", "internal", "corp", "chrome://", "moz-extension://", "chrome-extension://",
)
PAYWALL = (
    "Subscribe to continue", "Login to read", "Premium content", "Subscribe for unlimited access", "Upgrade to read", "paywall",
    "subscription required", "members only",
)
TTL_MINUTES = {"news": 2.0, "documentation": 30.0, "social": 1.0, "ecommerce": 5.0, "static": 60.0, "general": 5.0}
TYPE_BONUS = {"static": 50, "documentation": 40, "general": 20, "ecommerce": 10, "news": 5, "social": 0}
CONTENT_TYPES = {
    "news": (("/news/", "/article/"), ("breaking",), ("published", "updated")),
    "documentation": (("/docs/", "/documentation/", "/api/"), ("documentation",), ("api reference",)),
    "social": (("twitter.com", "facebook.com", "linkedin.com", "instagram.com"), (), ()),
    "ecommerce": (("/product/", "/shop/"), (), ("add to cart", "price")),
    "static": (("/about", "/contact", "/privacy", "/terms"), (), ()),
}
SKIPPED = {"script", "style", "noscript", "nav", "header", "footer", "aside", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
JSON_TYPES = {
    "Product": "commerce", "Offer": "commerce", "AggregateOffer": "commerce", "Article": "article", "NewsArticle": "article", "BlogPosting": "article",
    "Dataset": "table_dataset", "Table": "table_dataset",
}
COMMERCE = (
    r"[€$£¥₹]", r"\b(prix|price|tarif|cost|coût|buy|acheter|commander|order|cart|panier|add to cart|ajouter au panier)\b",
    r"\b(eur|usd|gbp|cad|chf|jpy)\b", r"\b(stock|disponible|available|livraison|shipping|delivery)\b",
)
ARTICLE = (
    r"\b(article|author|auteur|published|publié|byline|reading time|temps de lecture)\b", r"\b(news|actualité|journal|magazine|blog|post|story|reportage)\b",
)
DATASET = r"\b(data|dataset|statistics|stats|tableau|données|results|résultats)\b"
EMAIL_LIKE = (
    r"\b(from|to|de|à|subject|objet|sent|envoyé|received|reçu)\b", r"@[\w.-]+\.[a-z]{2,}", r"\b(reply|répondre|forward|transférer|cc|bcc)\b",
)


def normalize_url(url: Column) -> Column:
    """Without tracking parameters; a fragment stays only if it begins with a letter."""
    names = "|".join(re.escape(p) for p in TRACKING)
    fragment = F.regexp_extract(url, r"#[a-zA-Z].*$", 0)
    base = F.regexp_replace(url, r"#.*$", "")
    head, query = F.regexp_replace(base, r"\?.*$", ""), F.regexp_extract(base, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(f"^({names})(=|$)")))
    return F.concat(head, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""), fragment)


def base_domain(domain: Column) -> Column:
    parts = F.split(domain, r"\.")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(domain)


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1)


def sensitive_domain(domain: Column) -> Column:
    return any_of(domain, SENSITIVE)


def consent(domain: Column, cached: Column, black: Column, white: Column, mode: Column) -> Column:
    """allow, deny or ask: a fresh cached decision, then the lists, then sensitive domains, then the mode."""
    by_mode = F.when(mode == "always", "allow").when(mode == "never", "deny").otherwise("ask")
    return F.when(cached.isNotNull(), cached).when(black, "deny").when(white, "allow").when(sensitive_domain(domain), "deny").otherwise(by_mode)


def content_type(url: Column, title: Column, content: Column) -> Column:
    texts = [F.lower(F.coalesce(c, F.lit(""))) for c in (url, title, content)]
    out = F.lit("general")
    for name, lists in reversed(CONTENT_TYPES.items()):
        found = F.lit(False)
        for text, words in zip(texts, lists, strict=True):
            found = found | any_of(text, words)
        out = F.when(found, name).otherwise(out)
    return out


def ttl_minutes(kind: Column) -> Column:
    out = F.lit(5.0)
    for name, minutes in TTL_MINUTES.items():
        out = F.when(kind == name, minutes).otherwise(out)
    return out


def cacheable(url: Column, title: Column, content: Column) -> Column:
    return (
        (F.length(F.coalesce(content, F.lit(""))) >= 100)
        & ~F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit("error"))
        & ~any_of(F.lower(url), ("/login", "/auth", "/signin"))
    )


def eviction_score(uses: Column, kind: Column, age_s: Column, idle_s: Column) -> Column:
    """Frequent use and lasting kinds score more, age and idleness less; the lowest go first."""
    bonus = F.lit(0)
    for name, value in TYPE_BONUS.items():
        bonus = F.when(kind == name, value).otherwise(bonus)
    return F.least(uses * 10, F.lit(100)) + bonus - F.least(age_s / 86_400.0 * 10, F.lit(50.0)) - F.least(idle_s / 3600.0 * 5, F.lit(30.0))


def is_pdf(url: Column, content: Column) -> Column:
    return F.contains(url, F.lit(".pdf")) | F.contains(content, F.lit("PDF"))


def is_paywalled(content: Column) -> Column:
    return any_of(F.lower(content), [p.lower() for p in PAYWALL])


def paywall_score(css: Column, text: Column, cut: Column, overlay: Column) -> Column:
    parts = [F.when(c, w).otherwise(0.0) for c, w in ((css, 0.4), (text, 0.3), (cut, 0.2), (overlay, 0.5))]
    return F.least(parts[0] + parts[1] + parts[2] + parts[3], F.lit(1.0))


def strip_tags(html: Column) -> Column:
    """Text without scripts, styles and tags, in one line."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


class _Page(HTMLParser):
    """Title, text, headings, tables, links and metadata of a page in one pass."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.text, self.headings, self.tables = "", [], [], []
        self.meta, self.open_graph, self.json, self.items = {}, {}, [], {}
        self.skip, self.inside, self.link_chars, self.chars, self.paragraphs = 0, [], 0, 0, 0
        self.cell: list[str] | None = None
        self.row: list[str] | None = None
        self.raw: list[str] | None = None
        self.selectors: set[str] = set()

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name, value = a.get("property") or a.get("name") or "", a.get("content", "")
            (self.open_graph if name.startswith("og:") else self.meta).setdefault(name, value)
        if "itemprop" in a:
            self.items.setdefault(a["itemprop"], a.get("content", ""))
        if "data-price" in a or {"price", "cost", "tarif"} & set(a.get("class", "").split()) or a.get("id") == "price":
            self.selectors.add("commerce")
        if tag == "article" or {"article", "post", "news", "blog-post"} & set(a.get("class", "").split()) or (tag == "time" and "datetime" in a):
            self.selectors.add("article")
        if tag in VOID:
            return
        self.inside.append(tag)
        if tag == "script":
            self.raw = [] if a.get("type") == "application/ld+json" else None
        self.skip += tag in SKIPPED
        self.paragraphs += tag == "p"
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.cell = []
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.headings.append("")

    def handle_endtag(self, tag):
        if tag not in self.inside:
            return
        while self.inside:
            top = self.inside.pop()
            self.skip -= top in SKIPPED
            if top == tag:
                break
        if tag == "script" and self.raw is not None:
            try:
                self.json.append(json.loads("".join(self.raw)))
            except ValueError:
                pass
            self.raw = None
        elif tag in ("td", "th") and self.cell is not None and self.row is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.row is not None and self.tables:
            if any(self.row):
                self.tables[-1].append(self.row)
            self.row = None

    def handle_data(self, data):
        if self.raw is not None:
            self.raw.append(data)
        if "title" in self.inside and not self.skip:
            self.title += data
        if self.skip or "title" in self.inside:
            return
        if self.cell is not None:
            self.cell.append(data)
        if any(t in self.inside for t in ("h1", "h2", "h3", "h4", "h5", "h6")) and self.headings:
            self.headings[-1] += data
        if data.strip():
            self.text.append(data)
            self.chars += len(data.strip())
            self.link_chars += len(data.strip()) if "a" in self.inside else 0


def content_score(length: int, paragraphs: int, link_share: float) -> float:
    """How likely an element is the main content, between 0 and 1."""
    return min(max(min(length / 2000, 0.4) + min(paragraphs * 0.05, 0.3) + 0.3 * (1 - link_share), 0.0), 1.0)


def page_class(page: _Page, text: str) -> str:
    for entry in page.json:
        first = entry[0] if isinstance(entry, list) and entry else entry
        kind = first.get("@type") if isinstance(first, dict) else None
        kind = kind[0] if isinstance(kind, list) and kind else kind
        if kind in JSON_TYPES:
            return JSON_TYPES[kind]
    low = text.lower()
    if "commerce" in page.selectors or any(re.search(p, low) for p in COMMERCE):
        return "commerce"
    if "article" in page.selectors or any(re.search(p, low) for p in ARTICLE):
        return "article"
    if any(len(t) > 6 for t in page.tables) and re.search(DATASET, low):
        return "table_dataset"
    return "email_like" if any(re.search(p, low) for p in EMAIL_LIKE) else "generic"


PAGE = (
    "page_id long, title string, main_text string, page_class string, confidence double, score double, headings array<string>, "
    "tables array<struct<headers: array<string>, rows: array<array<string>>, row_count: int, column_count: int>>, "
    "meta map<string, string>, open_graph map<string, string>, microdata map<string, string>, jsonld array<string>"
)


def extract_page(html: str) -> tuple:
    page = _Page()
    page.feed(html)
    page.close()
    text = " ".join(" ".join(page.text).split())[:50_000]
    tables = [
        {"headers": t[0], "rows": t[1:], "row_count": len(t) - 1, "column_count": max(map(len, t))} for t in page.tables if t
    ]
    title = page.open_graph.get("og:title") or page.meta.get("title") or next((h.strip() for h in page.headings if h.strip()), "") or page.title.strip()
    structured = bool(page.json or page.items)
    confidence = 0.9 if structured else 0.8 if tables else 0.6
    share = page.link_chars / page.chars if page.chars else 0.0
    headings = [h.strip() for h in page.headings if len(h.strip()) > 10][:10]
    jsonld = [json.dumps(j, sort_keys=True) for j in page.json]
    score = content_score(len(text), page.paragraphs, share)
    return (" ".join(title.split()), text, page_class(page, text), confidence, score, headings, tables, page.meta, page.open_graph, page.items, jsonld)


def extract_pages(pages: DataFrame) -> DataFrame:
    """Everything above for ``pages (page_id, html)``; null pages are empty."""

    def run(batches):
        columns = ["page_id", "title", "main_text", "page_class", "confidence", "score", "headings", "tables", "meta", "open_graph", "microdata", "jsonld"]
        for pdf in sliced(batches):
            yield pd.DataFrame([(k, *extract_page(h or "")) for k, h in zip(pdf["page_id"], pdf["html"], strict=True)], columns=columns)

    return pages.select("page_id", "html").mapInPandas(run, PAGE)


def extension(url: Column) -> Column:
    """What follows the last dot of the last part of a path."""
    return F.regexp_extract(url, r"\.([^./\\]+)$", 1)


def combine_parts(main: Column, frames: Column, shadow: Column, dynamic: Column, limit: int = 100_000) -> Column:
    """The parts of a page under headings: the main text, frames and shadow roots as ``array<struct<name, content>>``, and added texts."""

    def listed(items: Column, kind: str) -> Column:
        return F.transform(items, lambda x, i: F.concat(F.lit(f"--- {kind} "), (i + 1).cast("string"), F.lit(" ("), x["name"], F.lit(") ---\n"), x["content"]))

    def headed(heading: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.array(F.lit(heading)), items)).otherwise(F.expr("cast(array() as array<string>)"))

    first = F.when(main != "", F.array(F.lit("=== MAIN CONTENT ==="), main)).otherwise(F.expr("cast(array() as array<string>)"))
    parts = F.concat(
        first, headed("\n=== IFRAME CONTENT ===", listed(frames, "Frame")), headed("\n=== SHADOW DOM CONTENT ===", listed(shadow, "Shadow")), headed("\n=== DYNAMIC CONTENT ===", dynamic)
    )
    return F.substring(F.array_join(parts, "\n"), 1, limit)
