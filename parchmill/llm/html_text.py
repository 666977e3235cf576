"""Main text of web pages, with site templates removed.

1. Every page is read into a tree. Each element gives a hash of its whole subtree (tag, text and
   children in order); inside an article only elements of structure do (STRUCTURE: boxes, lists,
   tables), as its paragraphs, headings and quotations are content.
2. Hashes are counted per host in Spark. What stands on MIN_PAGES different pages of a host and on
   MIN_SHARE of them is template. Equal pages are one; inside articles those with the same title are,
   so that copies of a page do not make their content a template. A host has at most (mean elements
   a page) / MIN_SHARE such hashes, so its list is bounded; the counting is by (host, hash),
   whatever the host's size. Pages whose url names no host have nothing in common: none is deleted.
3. Pages meet the list of their host. Subtrees on it are deleted, elements that say what they
   are (navigation, footers, forms, adverts, comments and the like) too, and the rest of the
   article, or of the body where a page marks no article, is joined block by block.

Text inside an article element is not held against the counts: a passage that many pages of a
host share, such as a reprint, is content. Character references are decoded, white space inside a
block is one space, blocks are trimmed, joined by a line feed, and left out if empty. Null html
is an empty page. Rows are pages: repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill.llm.joins import broadcast_if_small
from parchmill.session import cut_lineage

MIN_PAGES = 5
MIN_SHARE = 0.1

# HTML element kinds.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div",
    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "legend", "summary"}
# An opening tag closes an open one of these, within the given bounds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
NEVER_TEXT = {
    "head", "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "audio", "video",
    "nav", "aside", "footer", "form", "button", "select", "textarea", "dialog", "menu", "search", "title",
    "noembed", "noframes", "datalist", "progress", "meter",
}
BOUNDARY = {"nav", "navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "alert",
            "dialog", "alertdialog", "form", "toolbar", "status"}
# Words of class and id names that tell what an element is for.
NOT_CONTENT = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs",
    "comment", "comments", "commentlist", "disqus", "replies", "respond", "cookie", "cookies", "consent", "gdpr",
    "notice", "notices", "alert", "footer", "header", "masthead", "menu", "menus", "nav", "navbar", "navigation", "newsletter",
    "subscribe", "subscription", "signup", "login", "paywall", "popup", "modal", "overlay", "promo", "promotion",
    "sponsor", "sponsored", "related", "recommended", "recommendations", "share", "sharing", "social", "sidebar",
    "sidebars", "skip", "toolbar", "topbar", "widget", "widgets", "pagination", "pager", "copyright", "hidden", "outbrain",
    "taboola",
}
# Words that beside one of these in a name do not change what it tells.
_NEUTRAL = {
    "area", "article", "articles", "author", "bar", "block", "blog", "body", "bottom", "box", "button", "buttons",
    "column", "container", "content", "count", "div", "element", "email", "entry", "fixed", "form", "global", "google",
    "group", "head", "heading", "holder", "home", "icon", "icons", "info", "inner", "item", "items", "js", "label",
    "latest", "leaderboard", "left", "link", "links", "list", "main", "media", "message", "meta", "more", "outer",
    "page", "panel", "post", "posts", "primary", "reader", "recent", "reply", "right", "row", "secondary", "section",
    "site", "slot", "stories", "story", "text", "this", "thread", "title", "to", "top", "unit", "us", "user", "wrap",
    "wrapper",
}
MAIN = {"article", "main"}
# What is counted inside an article.
STRUCTURE = {
    "address", "aside", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figure", "footer", "form", "header",
    "hgroup", "menu", "nav", "ol", "search", "section", "table", "ul",
}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PARTS = re.compile(r"[a-z]+")
# Names that speak of something else than the element itself.
_ABOUT_OTHERS = re.compile(r"^(?:has|with|no|without|show|is)[-_]|(?:article|entry|post|story|content|page)[-_]*header")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Element:
    tag: str
    attributes: str
    parent: Element | None
    children: list = field(default_factory=list)  # texts and elements
    hash: int = 0

    def names(self) -> dict[str, str]:
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(self.attributes)}

    def no_content(self) -> bool:
        """By its tag, role, or class and id words it is no part of the text."""
        if self.tag in NEVER_TEXT:
            return True
        if self.tag == "header":
            # A header of the article itself holds its title.
            return not any(up.tag in MAIN for up in _ancestors(self))
        if not self.attributes or self.tag in {"html", "body", "article", "main"}:
            return False
        names = self.names()
        if "hidden" in names or names.get("aria-hidden") == "true" or names.get("role", "") in BOUNDARY:
            return True
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", names.get("style", "")):
            return True
        own = f"{names.get('class', '')} {names.get('id', '')}".lower().split()
        words = [set(_NAME_PARTS.findall(name)) for name in own if not _ABOUT_OTHERS.search(name)]
        # A name counts as a whole: related-posts, but not related-work.
        return any(parts & NOT_CONTENT and parts <= NOT_CONTENT | _NEUTRAL for parts in words)


def _ancestors(element: Element) -> Iterator[Element]:
    while (element := element.parent) is not None:
        yield element


def parse(source: str) -> Element:
    """The tree of a page; tags left open close where the next block or the parent does."""
    root = here = Element("#root", "", None)
    open_tags: dict[str, int] = {}

    def close_to(element: Element) -> None:
        nonlocal here
        while here is not element:
            open_tags[here.tag] -= 1
            here = here.parent

    def close(tags: set[str], bounds: set[str]) -> None:
        """Close the highest open element of ``tags`` below the nearest of ``bounds``."""
        if not any(open_tags.get(tag) for tag in tags):
            return
        found, at = None, here
        while at is not root and at.tag not in bounds:
            if at.tag in tags:
                found = at
            at = at.parent
        if found is not None:
            close_to(found.parent)

    at = 0
    while at < len(source):
        match = _TAG.search(source, at)
        if match is None:
            here.children.append(source[at:])
            break
        if match.start() > at:
            here.children.append(source[at : match.start()])
        at = match.end()
        tag = match[2]
        if tag is None:
            continue
        tag = tag.lower()
        if match[1]:
            if open_tags.get(tag):
                up = here
                while up.tag != tag:
                    up = up.parent
                close_to(up.parent)
            elif tag == "p":
                here.children.append(Element("p", "", here))
            continue
        if tag in CLOSES_P and open_tags.get("p"):
            close({"p"}, {"td", "th", "table", "button", "object", "caption"})
        if tag in CLOSES:
            close(*CLOSES[tag])
        made = Element(tag, match[3], here)
        here.children.append(made)
        if tag in VOID or (match[3].endswith("/") and tag not in BLOCK | RAW):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            made.children.append(source[at : end.start() if end else len(source)])
            at = end.end() if end else len(source)
            continue
        open_tags[tag] = open_tags.get(tag, 0) + 1
        here = made
    return root


def _plain(text: str) -> str:
    return _SPACE.sub(" ", html.unescape(text) if "&" in text else text)


def _walk(root: Element) -> Iterator[Element]:
    """Elements, children before parents, without recursion: pages nest as deep as they like."""
    stack: list[tuple[Element, bool]] = [(root, False)]
    while stack:
        element, done = stack.pop()
        if done:
            yield element
            continue
        stack.append((element, True))
        stack += [(child, False) for child in reversed(element.children) if isinstance(child, Element)]


def hash_subtrees(root: Element) -> None:
    """Give every element the hash of its tag, texts and children."""
    for element in _walk(root):
        parts = [element.tag]
        parts += [str(c.hash) if isinstance(c, Element) else _plain(c).strip() for c in element.children]
        digest = hashlib.blake2b("\x00".join(parts).encode("utf-8", "replace"), digest_size=8).digest()
        element.hash = int.from_bytes(digest, "little", signed=True)


def _title(article: Element) -> int:
    """The hash of the first h1 of an article, or of the whole."""
    stack = [article]
    while stack:
        element = stack.pop()
        if element.tag == "h1":
            return element.hash
        stack += [child for child in reversed(element.children) if isinstance(child, Element)]
    return article.hash


def counted(root: Element) -> Iterator[tuple[int, int]]:
    """Hashes of the elements of the body that are counted, each with that of what it stands in: the
    page, or the title of the article."""
    stack = [(root, root.hash, False)]
    while stack:
        element, around, inside = stack.pop()
        for child in element.children:
            if not isinstance(child, Element) or child.tag in RAW | VOID:
                continue
            if child.tag in MAIN:
                stack.append((child, around if inside else _title(child), True))
                continue
            stack.append((child, around, inside))
            if child.tag in STRUCTURE if inside else child.tag not in {"html", "head", "body"}:
                yield child.hash, around


def main_text(root: Element, template: set[int]) -> str:
    """Blocks of the article, or of the body, without what is template or no content."""
    # Outermost articles that nothing around them rules out; main only where there is no article.
    for wanted in ("article", "main", None):
        heads, stack = [], [root]
        while stack:
            element = stack.pop()
            if element.tag == wanted or (wanted is None and element is root):
                heads.append(element)
            else:
                stack += [c for c in reversed(element.children) if isinstance(c, Element) and not c.no_content()]
        if heads:
            break
    blocks: list[str] = []
    inline: list[str] = []

    def finish() -> None:
        block = _SPACE.sub(" ", "".join(inline)).strip()
        inline.clear()
        if block:
            blocks.append(block)

    for head in heads:
        todo: list = [(head, wanted == "article")]
        while todo:
            item, kept = todo.pop()
            if item is None:
                finish()
            elif isinstance(item, str):
                inline.append(_plain(item))
            elif item.no_content() or (item.hash in template and (not kept or item.tag in STRUCTURE)):
                if item.tag in BLOCK:
                    finish()
            elif item.tag == "br":
                inline.append(" ")
            else:
                kept = kept or item.tag in MAIN
                if item.tag in BLOCK or item is head:
                    finish()
                    todo.append((None, kept))
                todo += [(child, kept) for child in reversed(item.children)]
        finish()
    return "\n".join(blocks)


# --- Spark ------------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    """Lower-case host; '' for what is no URL."""
    return F.coalesce(F.lower(F.regexp_extract(F.trim(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def subtree_counts(pages: DataFrame) -> DataFrame:
    """(host, hash, around) of counted subtrees, see ``counted``; hash null for the page itself."""
    rows = pages.where("host <> ''").select("host", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, found = [], []
            for i, source in enumerate(batch.column(1)):
                root = parse(source.as_py() or "")
                hash_subtrees(root)
                own = [(None, root.hash), *set(counted(root))]
                owners.append(np.full(len(own), i))
                found += own
            if owners:
                hashes, around = (pa.array(values, type=pa.int64()) for values in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.concatenate(owners))), hashes, around], ["host", "hash", "around"]
                )

    return rows.mapInArrow(run, "host string, hash long, around long")


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, template): the recurring subtrees of each host that has any."""
    counts = subtree_counts(pages).groupBy("host", "hash").agg(F.count_distinct("around").alias("count"))
    sizes = counts.where("hash IS NULL").select("host", F.col("count").alias("pages"))
    found = counts.where((F.col("count") >= min_pages) & F.col("hash").isNotNull()).join(sizes, "host")
    found = found.where(F.col("count") >= min_share * F.col("pages"))
    return found.groupBy("host").agg(F.collect_list("hash").alias("template"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    # Written first: a short list is broadcast, and a join with a long one can be split at a large host.
    listed = cut_lineage(templates(rows, min_pages, min_share))
    n_hashes = listed.agg(F.sum(F.size("template") + 1)).first()[0] or 0
    joined = rows.join(broadcast_if_small(listed, values=n_hashes), "host", "left")
    joined = joined.select("page_id", "url", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, template in zip(batch.column(2), batch.column(3), strict=True):
                root = parse(source.as_py() or "")
                hash_subtrees(root)
                texts.append(main_text(root, set(template.as_py() or ())))
            made = [pa.array(texts, type=pa.string()), pa.array([len(text) for text in texts], type=pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["page_id", "url", "text", "n_chars"])

    id_type = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")
