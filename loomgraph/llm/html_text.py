"""Main text of web pages by template deduction.

Pages of one host are made from a few templates. Tokens of a page are its tags and its text runs, each with the
path of open containers, which tells equal tokens in different places apart. The occurrence vector of a token
says how often it stands on each page of the host; tokens with equal vectors form an equivalence class. Vectors are
compared by two sums of page hashes, which tasks pre-aggregate, so a host with most of the pages is no hot key. A
class is valid when every token stands once per page, on enough of the pages that hold the tag around it, and what
else these pages say is not the same on all; classes nest by their paths. Text of valid classes is template, the
rest fills slots.

A slot's place in the template decides about it: menus, headers, footers, sidebars, notices, adverts, forms,
comments and code are known by the tags, roles and class words that enclose them. Template text is left out
everywhere. Where a page marks its article (or main part), the rest of what is inside is the main text; if template
text is the greater part of it, the page is a copy of others and keeps it all. Elsewhere blocks made of links are left
out too, unless nothing would remain.

Asides are of two levels. Wrappers known by layout words, forms and headers may stand around a whole page, so an article
or main part inside ends them; comments, adverts, related items, menus and hidden parts keep what is inside. Text of
asides is the last resort of a page that has no other, loose ones first. A class or id names an aside if all its words
do, besides words without meaning of their own: `site-footer` does, `no-sidebar` and `search-result` don't.

A NULL or empty html has no text; a NULL url belongs to host ''; repeated rows give repeated rows; an empty table
gives none; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from loomgraph.functions.scale import cut_lineage
from loomgraph.llm.common import with_package

MIN_PAGES = 3
MIN_SHARE = 50  # percent of the host's pages with the tag around it
LINK_SHARE = 60  # percent of a block's characters
MAX_BROADCAST_TOKENS = 500_000

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+[^>]*+)>?", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z_:][-A-Za-z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[a-z0-9]+")
# Elements by what they are in a page.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "object", "canvas", "textarea", "title", "xmp", "math"}
CONTAINERS = {"html", "head", "body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "dl", "table", "figure", "fieldset",
              "button", "select", "dialog", "menu", "details", "center", "td", "th", "li", "p", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt", "tr", "span", "a"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rp", "rt",
          "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ASIDE_TAGS = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
ASIDE_WORDS = {"nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "footer", "sidebar", "aside", "ad", "ads", "advert", "adverts", "advertisement",
               "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay",
               "newsletter", "subscribe", "subscription", "social", "share", "sharing", "related", "recommended", "comment", "comments", "reply", "replies", "disqus",
               "pagination", "pager", "login", "signup", "search", "toolbar", "masthead", "header"}
HEADER_WORDS = {"header", "masthead", "banner"}
COMMENT_WORDS = {"comment", "comments", "reply", "replies", "disqus"}
# Asides that articles inside do not end.
FIRM_TAGS = ASIDE_TAGS - {"form"}
FIRM_ROLES = ASIDE_ROLES - {"form", "search"}
FIRM_WORDS = COMMENT_WORDS | {"nav", "navbar", "navigation", "menu", "menubar", "footer", "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
                              "related", "recommended"}
NEUTRAL_WORDS = {"area", "article", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "div", "global", "group", "inner", "item", "items", "left", "link",
                 "links", "list", "main", "outer", "page", "panel", "post", "posts", "primary", "region", "right", "secondary", "section", "site", "slot", "text", "the", "top", "unit", "widget",
                 "widgets", "wrap", "wrapper"}
OPEN, LOOSE, FIRM = 0, 1, 2
# An opening tag ends an open element of these, as end tags may be left out.
ENDS = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}}


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)}


class Block(NamedTuple):
    text: str
    scope: str  # article, main or body
    token: int  # hash of place and text
    around: int  # token of the tag around it, 0 for the page
    links: int  # characters in links
    level: int  # OPEN, or the aside it stands in


class Page:
    """A page read once: blocks of text with where they stand, and its tokens."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.tags: list[int] = []
        stack: list[tuple[str, int, str]] = []  # name, aside level, scope
        self.runs: dict[int, tuple[list[str], list[int]]] = {}  # by level: pieces of the block, and their characters in links
        place, raw_until = 0, None
        for m in MARKUP.finditer(source):
            if raw_until is not None and m.start() < raw_until:
                continue
            self.text(source[place:m.start()] if raw_until is None or place >= raw_until else source[raw_until:m.start()], stack)
            place = m.end()
            if m[2] is None:
                continue
            name, closing = m[2].lower(), bool(m[1])
            if name in RAW and not closing:
                end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(source, m.end())
                raw_until = end.start() if end else len(source)
                place = raw_until
                continue
            if name not in INLINE:
                self.end_block(stack)
            if name not in CONTAINERS:
                continue
            if closing:
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
                if depth is not None and not (name in INLINE and any(n not in INLINE for n, _, _ in stack[depth + 1:])):
                    del stack[depth:]
                continue
            if name in ENDS:
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in ENDS[name] or stack[k][0] in ("div", "ul", "ol", "dl", "table", "article", "section")), None)
                if depth is not None and stack[depth][0] in ENDS[name]:
                    del stack[depth:]
            elif name not in INLINE and stack and stack[-1][0] in ("p", "a", "span"):
                # A block ends an open paragraph and whatever inline elements were never closed in it.
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] not in ("p", "a", "span")), -1)
                del stack[depth + 1:]
            level, scope = (stack[-1][1], stack[-1][2]) if stack else (OPEN, "body")
            own, inside = self.aside(name, m[3], scope), self.scope(name, m[3], scope)
            starts = name in ("article", "main") or inside == "main" != scope
            stack.append((name, own if starts and level == LOOSE else max(level, own), inside))
            if name not in INLINE:
                self.tags.append(self.hashed(stack, name))
        self.text(source[max(place, raw_until or 0):], stack)
        self.end_block(stack)

    @staticmethod
    def aside(name: str, attrs: str, scope: str) -> int:
        found = FIRM if name in FIRM_TAGS else LOOSE if name == "form" or name == "header" and scope != "article" else OPEN
        if found == FIRM or "=" not in attrs and "hidden" not in attrs:
            return found
        a = attributes(attrs)
        role = a.get("role", "").lower()
        if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower() or role in FIRM_ROLES:
            return FIRM
        if name in ("html", "body"):
            return found
        known = COMMENT_WORDS if name in ("article", "main") else ASIDE_WORDS - HEADER_WORDS if scope == "article" else ASIDE_WORDS
        for one in f"{a.get('class', '')} {a.get('id', '')}".lower().split():
            words = {w for w in WORDS.findall(one) if not w.isdigit()}
            if words & known and words <= known | NEUTRAL_WORDS:
                found = max(found, FIRM if words & FIRM_WORDS else LOOSE)
        return max(found, LOOSE if role in ASIDE_ROLES else OPEN)

    @staticmethod
    def scope(name: str, attrs: str, scope: str) -> str:
        if name == "article" or scope == "article":
            return "article"
        return "main" if name == "main" or "role" in attrs and attributes(attrs).get("role") == "main" else scope

    @staticmethod
    def hashed(stack, what: str) -> int:
        path = "/".join(n for n, _, _ in stack if n not in INLINE)
        return xxhash.xxh3_64_intdigest(f"{path}\0{what}") >> 1

    def text(self, piece: str, stack) -> None:
        if piece:
            pieces, links = self.runs.setdefault(stack[-1][1] if stack else OPEN, ([], []))
            pieces.append(piece)
            if any(n == "a" for n, _, _ in stack):
                links.append(len(piece))

    def end_block(self, stack) -> None:
        for level, (pieces, links) in self.runs.items():
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                around = next((n for n, _, _ in reversed(stack) if n not in INLINE), None)
                self.blocks.append(Block(text, stack[-1][2] if stack else "body", self.hashed(stack, text), self.hashed(stack, around) if around else 0, sum(links), level))
        self.runs = {}

    def content(self) -> int:
        """A number for all the page says."""
        return xxhash.xxh3_64_intdigest("\0".join(b.text for b in self.blocks if b.level == OPEN)) >> 1

    def main_text(self, template: set[int]) -> str:
        least = min((b.level for b in self.blocks), default=OPEN)
        blocks = [b for b in self.blocks if b.level == least]
        for scope in ("article", "main"):
            if inside := [b for b in blocks if b.scope == scope]:
                own = [b.text for b in inside if b.token not in template]
                copied = 2 * sum(map(len, own)) < sum(len(b.text) for b in inside)
                return " ".join([b.text for b in inside] if copied else own)
        plain = [b.text for b in blocks if b.token not in template and 100 * b.links < LINK_SHARE * len(b.text)]
        return " ".join(plain or [b.text for b in blocks])


def page_vector(page_id: object, url: str | None, row: str) -> tuple[int, int]:
    """Two numbers below 2^30 that stand for a page in the sums of an occurrence vector."""
    h = xxhash.xxh3_128_intdigest(f"{page_id}\0{url}\0{row}")
    return h & 0x3FFFFFFF, (h >> 30) & 0x3FFFFFFF


def host_of(url: str | None) -> str:
    return (url or "").split("//", 1)[-1].split("/", 1)[0].split("?", 1)[0].lower()


def token_vectors(pages: DataFrame) -> DataFrame:
    """(host, token, is_text, around, v1, v2, pages, most, low, high), summed per batch already.

    Token 0 stands for the page, `around` is the token of the tag around a text, `low` and `high` are bounds of Page.content.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int, bool, int], list[int]] = {}
            for page_id, url, source in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                page = Page(source)
                host, (a, b), content = host_of(url), page_vector(page_id, url, source), page.content()
                tokens = Counter({(0, False, 0): 1})
                tokens.update((t, False, 0) for t in page.tags)
                tokens.update((x.token, True, x.around) for x in page.blocks if x.level == OPEN)
                for token, n in tokens.items():
                    s = sums.setdefault((host, *token), [0, 0, 0, 0, content, content])
                    s[0] += n * a
                    s[1] += n * b
                    s[2] += 1
                    s[3] = max(s[3], n)
                    s[4], s[5] = min(s[4], content), max(s[5], content)
            keys = list(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.bool_()), pa.array([k[3] for k in keys], pa.int64()),
                 *[pa.array([sums[k][j] for k in keys], pa.int64()) for j in range(6)]], ["host", "token", "is_text", "around", "v1", "v2", "pages", "most", "low", "high"])

    found = with_package(pages).mapInArrow(
        run, "host string, token bigint, is_text boolean, around bigint, v1 bigint, v2 bigint, pages bigint, most bigint, low bigint, high bigint")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    return found.groupBy("host", "token", "is_text", "around").agg(
        total("v1"), total("v2"), F.sum("pages").alias("pages"), F.max("most").alias("most"), F.min("low").alias("low"), F.max("high").alias("high"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, token) of text in valid equivalence classes: once per page, on enough of the pages with the tag around it, which differ elsewhere, with another token in the class."""
    vectors = cut_lineage(token_vectors(pages).where(F.col("pages") >= MIN_PAGES))
    once = vectors.where((F.col("most") == 1) & (F.col("token") != 0))
    classes = once.groupBy("host", "v1", "v2").agg(F.count(F.lit(1)).alias("size"))
    around = vectors.where("not is_text").select("host", F.col("token").alias("around"), F.col("pages").alias("around_pages"))
    return (once.where("is_text and low < high").join(around, ["host", "around"]).where(100 * F.col("pages") >= MIN_SHARE * F.col("around_pages"))
            .join(classes.where("size > 1"), ["host", "v1", "v2"]).select("host", "token"))


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) per page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [Page(source).main_text(set(tokens or ())) for source, tokens in zip(batch.column("html").to_pylist(), batch.column("tokens").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    tokens = cut_lineage(templates(rows))
    by_host = tokens.groupBy("host").agg(F.collect_set("token").alias("tokens"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:.*?//)?([^/?]*)", 1))
    keyed = rows.withColumn("host", host).join(F.broadcast(by_host) if tokens.count() <= MAX_BROADCAST_TOKENS else by_host, "host", "left")
    kind = rows.schema["page_id"].dataType.simpleString()
    return with_package(keyed.select("page_id", "url", "html", "tokens")).mapInArrow(run, f"page_id {kind}, url string, text string")


def report(pages: DataFrame) -> DataFrame:
    return main_texts(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
