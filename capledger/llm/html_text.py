"""Main text of a page as the maximum-scoring run of its tokens.

A page is a row of tokens: runs of words and tags. Words of a container that usually
holds the article score positive, words of other containers and most tags negative;
one linear scan finds the contiguous region with the best sum. The weights are learned
from labelled pages, those that mark their article by an element: the log-odds of each
kind of token inside it against outside.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 2000
MOST_WEIGHTS = 2000
LEAST_SEEN = 5
MOST_ASIDE = 3.0

# Elements of HTML by what they do.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext"}
UNSEEN = RAW | {"head", "template", "noscript", "svg", "math", "object", "canvas", "audio", "video", "map", "datalist"}
ASIDE = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "label", "fieldset", "input"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
CLOSES_PARAGRAPH = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
# Elements that end an open one of these, unless one that bounds lists and tables is further in.
ENDS_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIST_BOUNDS = ("ul", "ol", "menu", "dl", "table", "select", "div", "article", "section")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Words of class, id and role by which pages name what is not their article.
ASIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertisements", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu",
    "breadcrumb", "breadcrumbs", "sidebar", "aside", "widget", "widgets", "footer", "masthead", "topbar", "toolbar", "cookie", "cookies", "consent", "gdpr", "notice",
    "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "search", "share", "sharing", "social", "related", "recommended",
    "comment", "comments", "commentlist", "disqus", "replies", "reply", "respond", "pagination", "pager", "skip", "complementary", "contentinfo", "dialog", "form",
}
ARTICLE_WORDS = {"article", "content", "main", "post", "entry", "story", "body", "text"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_NAMED = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[a-z]+")


@dataclass
class Token:
    kind: str  # what its weight is learned for
    text: str  # "" for a tag
    block: int  # texts of one block number are one paragraph
    shown: bool  # False below elements that are never part of an article
    labelled: bool  # below the element that marks the article


@dataclass
class Weights:
    of: dict[str, float] = field(default_factory=dict)

    def __call__(self, token: Token) -> float:
        n = len(token.text.split()) if token.text else 1
        known = self.of.get(token.kind)
        if known is None:
            known = -0.5 if not token.text else 1.0
        if token.text and not token.shown:
            known = min(known, -1.0)
        return n * known


class _Open:
    """The open elements. Where each tag is open, and which are blocks, is kept as lists, so that
    a tag finds what it closes without a look at all of them."""

    def __init__(self) -> None:
        self.elements: list[tuple[str, bool, bool, str]] = []  # tag, shown, labelled, container kind
        self.of_tag: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, element: tuple[str, bool, bool, str]) -> None:
        self.of_tag.setdefault(element[0], []).append(len(self.elements))
        if element[0] not in INLINE:
            self.blocks.append(len(self.elements))
        self.elements.append(element)

    def pop(self) -> tuple[str, bool, bool, str]:
        element = self.elements.pop()
        self.of_tag[element[0]].pop()
        if element[0] not in INLINE:
            self.blocks.pop()
        return element

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these tags, -1 if there is none."""
        return max((places[-1] for tag in tags if (places := self.of_tag.get(tag))), default=-1)

    @property
    def last_block(self) -> int:
        return self.blocks[-1] if self.blocks else -1


def tokens(page: str) -> list[Token]:
    """Tags and texts of a page, with unclosed and stray tags as they come. Each takes constant
    time, however many elements are open."""
    out: list[Token] = []
    opened = _Open()
    stack = opened.elements
    block, at, n = 0, 0, len(page)
    root = ("", True, False, "body")

    def text(raw: str, decode: bool = True) -> None:
        tag, shown, labelled, kind = stack[-1] if stack else root
        if tag in UNSEEN or kind == "unseen":
            return
        value = html.unescape(raw) if decode and "&" in raw else raw
        if value:
            out.append(Token(f"word {kind}", value, block, shown, labelled))

    def close(upto: int) -> None:
        nonlocal block
        while len(stack) > upto:
            tag, shown, labelled, kind = opened.pop()
            if kind != "unseen":
                out.append(Token(f"/{tag}", "", block, shown, labelled))
            if tag not in INLINE:
                block += 1

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"), False)
            continue
        tag = m[2].lower()
        if m[1]:
            i = opened.last(tag)
            # A stray end of inline markup ends no block.
            if i >= 0 and (tag not in INLINE or opened.last_block < i):
                close(i)
            elif i < 0 and tag not in INLINE:
                block += 1
            continue
        if tag in CLOSES_PARAGRAPH:
            i = opened.last_block
            if i >= 0 and stack[i][0] == "p":
                close(i)
        elif tag in ENDS_LIKE:
            i = opened.last(*ENDS_LIKE[tag])
            if i > opened.last(*LIST_BOUNDS):
                close(i)
        if tag == "body" and opened.of_tag.get("head"):
            close(opened.of_tag["head"][0])
        _, shown, labelled, kind = stack[-1] if stack else root
        named = {k.lower(): (v or "").strip("\"'").lower() for k, v in _NAMED.findall(m[3])} if m[3].strip() else {}
        parts = set(_PART.findall(" ".join(named.get(k, "") for k in ("class", "id", "role"))))
        hidden = "hidden" in named or named.get("aria-hidden") == "true"
        article = tag in ("article", "main") or "articlebody" in named.get("itemprop", "")
        off = tag in ASIDE or (tag == "header" and not labelled) or hidden
        if parts & ASIDE_WORDS and tag not in ("html", "body") and not article and not (parts & ARTICLE_WORDS and not parts & {"ad", "ads", "comment", "comments", "sidebar", "footer", "menu", "nav"}):
            off = True
        if tag in UNSEEN:
            kind = "unseen"
        elif tag not in INLINE and tag not in ("html", "body"):
            kind = f"{tag}{'.' + '.'.join(sorted(parts)) if parts else ''}"
            if off or not shown:
                kind = f"aside {kind}"
        if tag == "a" and kind != "unseen":
            kind = f"{kind} a" if not kind.endswith(" a") else kind
        if kind != "unseen":
            out.append(Token(tag + ("." + ".".join(sorted(parts)) if parts else ""), "", block, shown and not off, labelled or article))
        if tag not in INLINE:
            block += 1
        if tag in VOID or m[0].endswith("/>"):
            continue
        opened.push((tag, shown and not off, labelled or article, kind))
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else n
    close(0)
    return out


def scored(all_tokens: list[Token], weights: Weights) -> list[float]:
    """The score of each token. What one unseen part costs is bounded, so that a long aside does
    not end the article; its words are left out of the text anyway."""
    out, spent = [], 0.0
    for t in all_tokens:
        s = weights(t)
        if t.shown:
            spent = 0.0
        else:
            s = min(0.0, max(s, -MOST_ASIDE - spent))
            spent += s
        out.append(s)
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last-plus-one place of the contiguous run with the greatest sum; the longest
    of the first such runs, empty if no score is positive."""
    best, low, high, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0 and s > 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, low, high = total, start, i + 1
    return low, high


def main_text(page: str, weights: Weights) -> str:
    """The text of the best region: blocks in page order, one line each."""
    all_tokens = tokens(page)
    low, high = best_region(scored(all_tokens, weights))
    lines: list[str] = []
    parts: list[str] = []
    block = None
    for t in [*all_tokens[low:high], Token("", "", -1, True, False)]:
        if t.block != block and parts:
            line = " ".join("".join(parts).split())
            if line:
                lines.append(line)
            parts = []
        block = t.block
        if t.kind in ("br", "wbr"):
            parts.append(" " if t.kind == "br" else "")
        elif t.text and t.shown:
            parts.append(t.text)
    return "\n".join(lines)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, inside, outside): tokens of labelled pages, words by their number."""
    schema = pa.schema([("kind", pa.string()), ("inside", pa.int64()), ("outside", pa.int64())])
    for batch in batches:
        seen: dict[str, list[int]] = {}
        for page in batch.column(0).to_pylist():
            found = tokens(page)
            if not any(t.labelled for t in found):
                continue
            for t in found:
                seen.setdefault(t.kind, [0, 0])[0 if t.labelled and t.shown else 1] += len(t.text.split()) if t.text else 1
        yield pa.RecordBatch.from_pydict({"kind": list(seen), "inside": [v[0] for v in seen.values()], "outside": [v[1] for v in seen.values()]}, schema=schema)


def fit_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES) -> Weights:
    """Learns from at most ``sample`` pages, taken by a hash of id and page. At most
    ``MOST_WEIGHTS`` kinds of token have a weight of their own; others, and all where no page
    marks its article, count 1 for a word and -0.5 for a tag."""
    given = pages.select(F.col(f"`{html_col}`").cast("string").alias("html"), F.xxhash64(f"`{id_col}`", f"`{html_col}`").alias("h")).where("html IS NOT NULL")
    marked = given.where(F.lower("html").rlike(r"<article|<main|articlebody"))
    chosen = F.broadcast(marked.select("h").orderBy("h").limit(sample).distinct())  # bounded by ``sample``
    counts = marked.join(chosen, "h").select("html").mapInArrow(_counted, "kind string, inside long, outside long")
    top = counts.groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).where(F.col("inside") + F.col("outside") >= LEAST_SEEN)
    rows = top.orderBy(F.desc(F.col("inside") + F.col("outside")), "kind").limit(MOST_WEIGHTS).collect()
    of = {}
    for word in (True, False):
        own = [r for r in rows if r["kind"].startswith("word ") == word]
        for r in own:
            odds = math.log((r["inside"] + 0.5) / (r["outside"] + 0.5))
            of[r["kind"]] = max(-3.0, min(odds, 1.0 if word else -0.05))
    return Weights(of)


def extract_texts(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row; an empty text for a NULL page or one without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [main_text(page, weights) if page else "" for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    given = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return given.mapInArrow(run, "page_id long, url string, text string, n_chars long")
