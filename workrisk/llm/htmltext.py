"""Main text of HTML pages by a conditional random field over DOM leaf blocks (operator 10).

A page is cut into leaf blocks: the text between two boundaries of block elements, with the
tags and class names above it. A linear-chain conditional random field labels the blocks of
a page, in page order, as article or not: its features are the ancestors' tags, class and id
words, and properties of the text (length, link share, punctuation, place); its transitions
tie neighbouring blocks. Viterbi finds the best labelling; the article's blocks are joined.

It is trained on labelled pages: pages of the table whose blocks below ``article`` or
``main`` (and below no other landmark) are taken as article, and the same texts put into
layouts of known structure (menus, headers, side bars, notices, adverts, forms, comments
around content in differently named containers). The sample is bounded (``SAMPLE_PAGES``
pages of at most ``SAMPLE_BYTES`` bytes); every page is extracted from its whole html.

Defined results: null and empty html, and pages without article blocks, give the empty
string; character references are decoded, white space within a block becomes one space;
unclosed and unbalanced tags are closed as far as the block structure needs it; an unclosed
``select``, ``svg``, ``iframe``, ``noscript`` or ``template`` is read as if its tag were not there,
text of ``math`` and ``object`` stays; null ids are as good as others; repeated rows give
repeated results.
"""

from __future__ import annotations

import html as htmllib
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, hash_sample

SAMPLE_PAGES = 300
SAMPLE_BYTES = 40_000
LAYOUT_PAGES = 400
ITERATIONS = 80

# Kinds of HTML elements.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp"}  # text up to the end tag, or else up to the end of the page
SKIPPED = {"noscript", "template", "iframe", "svg", "select", "noframes"}  # left out where they are closed
NESTED = {"template", "svg"}  # those that may hold one of their own
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
          "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "label",
          "math", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msup", "msub", "msqrt", "object"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "div", "article", "section", "body", "main", "aside", "nav", "td"}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
                 r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")


@dataclass
class Block:
    path: tuple[str, ...]  # ancestors, outermost first: tag, and tag-independent class words as .word; a name
    # that comes again further in is named there only (the innermost element's names are all there)
    text: str
    link: float            # share of the characters within links


def blocks(html: str) -> list[Block]:
    """Leaf blocks of a page in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []  # tag and path
    parts: list[str] = []
    path: tuple[str, ...] = ()
    linked = links = 0
    unclosed: set[str] = set()  # skipped elements that have no end tag in the rest of the page

    def skip(tag: str, at: int) -> int | None:
        """The place after the end tag of a skipped element; None where it is not closed."""
        if tag in unclosed:
            return None
        level = 1
        for m in re.compile(rf"<(/?){tag}(?![^\s/>])[^>]*>?", re.I).finditer(html, at):
            if m[1]:
                level -= 1
            elif tag in NESTED:
                level += not m[0].endswith("/>")
            else:
                return None
            if not level:
                return m.end()
        unclosed.add(tag)
        return None

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = SPACES.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(path, text, min(1.0, linked / len(text))))
        parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal path, linked
        if "&" in text:
            text = htmllib.unescape(text)
        if not parts or not any(p.strip() for p in parts):
            path = stack[-1][1] if stack else ()
        parts.append(text)
        if links:
            linked += len(text.strip())

    def close_to(index: int) -> None:
        nonlocal links
        if any(t not in INLINE for t, _ in stack[index:]):
            flush()
        links -= sum(t == "a" for t, _ in stack[index:])
        del stack[index:]

    at, end = 0, len(html)
    while at < end:
        m = TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at:m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:  # an end tag
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close_to(i)
                    break
            else:
                if tag not in INLINE:
                    flush()
            continue
        if tag in VOID:
            if tag == "br":
                add(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in RAW:
            if not (m[3] or m[6] or "").endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = stop.end() if stop else end
            continue
        if tag in SKIPPED:
            if not (m[3] or m[6] or "").endswith("/"):
                at = skip(tag, at) or at
            continue
        above = stack[-1][1] if stack else ()
        if tag in INLINE:
            links += tag == "a"
            stack.append((tag, above))
            continue
        flush()
        closing = CLOSES.get(tag)
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closing:
                    close_to(i)
                    break
                if stack[i][0] in SCOPE:
                    break
        else:  # a block ends an open paragraph
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close_to(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        above = stack[-1][1] if stack else ()
        attributes = m[3] or m[6] or ""
        words: tuple[str, ...] = ()
        if "=" in attributes:
            words = tuple(f".{w}" for g in ATTRIBUTE.findall(attributes) for w in WORD.findall("".join(g).lower()))
        # without names that come again, so that deep nesting doesn't make long paths
        if len(set(above)) < len(above):
            above = tuple(reversed(dict.fromkeys(reversed(above))))
        stack.append((tag, (*above, tag, *words)))
    flush()
    return out


LANDMARKS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button"}
TEXT_FEATURES = 11


def text_features(page: list[Block]) -> np.ndarray:
    n = len(page)
    out = np.zeros((n, TEXT_FEATURES))
    for i, b in enumerate(page):
        t = b.text
        words = t.count(" ") + 1
        out[i] = (1, min(np.log1p(len(t)) / 6, 1.5), b.link, t[-1] in ".!?…:\"”", min(words / 40, 2),
                  "©" in t or "copyright" in t[:200].lower(), min(t.count(",") / words, 1) * 4, len(t) < 25,
                  i / n, i == 0, i == n - 1)
    return out


def path_features(path: tuple[str, ...]) -> set[str]:
    """Ancestors as a set, the innermost tag, and the last two."""
    tags = [p for p in path if p[0] != "."]
    return {*path, "in:" + (tags[-1] if tags else ""), "two:" + ">".join(tags[-2:])}


@dataclass
class Crf:
    """Weights of the label "article" against "other"; transitions by (from, to)."""

    names: dict[str, int]
    weight: np.ndarray
    text_weight: np.ndarray
    trans: np.ndarray
    ends: np.ndarray  # weights of a first and of a last article block
    cache: dict[tuple[str, ...], float] = field(default_factory=dict)

    def emissions(self, page: list[Block]) -> np.ndarray:
        score = text_features(page) @ self.text_weight
        for i, b in enumerate(page):
            value = self.cache.get(b.path)
            if value is None:
                if len(self.cache) > 50_000:
                    self.cache.clear()
                value = float(sum(self.weight[self.names[f]] for f in path_features(b.path) if f in self.names))
                self.cache[b.path] = value
            score[i] += value
        return score

    def viterbi(self, page: list[Block]) -> list[bool]:
        if not page:
            return []
        emit = self.emissions(page).tolist()
        (t00, t01), (t10, t11) = self.trans.tolist()
        other, article = 0.0, emit[0] + float(self.ends[0])
        back = []
        for e in emit[1:]:
            to_other, to_article = (other + t00, article + t10), (other + t01, article + t11)
            back.append((to_other[1] > to_other[0], to_article[1] > to_article[0]))
            other, article = max(to_other), max(to_article) + e
        label = article + float(self.ends[1]) > other
        labels = [label]
        for from_other, from_article in reversed(back):
            label = from_article if label else from_other
            labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[list[Block], list[bool]]], iterations: int = ITERATIONS) -> Crf:
    """Maximum likelihood by Adam; forward-backward runs over all pages at once."""
    pages = [(p, y) for p, y in pages if p]
    names: dict[str, int] = {}
    for p, _ in pages:
        for b in p:
            for f in path_features(b.path):
                names.setdefault(f, len(names))
    crf = Crf(names, np.zeros(len(names)), np.zeros(TEXT_FEATURES), np.zeros((2, 2)), np.zeros(2))
    if not pages:
        return crf
    size = np.array([len(p) for p, _ in pages])
    n, longest = len(pages), int(size.max())
    at_page = np.repeat(np.arange(n), size)
    at_step = np.concatenate([np.arange(s) for s in size])
    x = np.zeros((len(at_page), len(names) + TEXT_FEATURES))
    x[:, len(names):] = np.concatenate([text_features(p) for p, _ in pages])
    for i, b in enumerate(b for p, _ in pages for b in p):
        x[i, [names[f] for f in path_features(b.path)]] = 1
    y = np.concatenate([np.array(lab, dtype=float) for _, lab in pages])
    inside = np.arange(longest) < size[:, None]
    gold = np.zeros((n, longest), dtype=int)
    gold[at_page, at_step] = y.astype(int)
    weights = [np.zeros(x.shape[1]), np.zeros((2, 2)), np.zeros(2)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    last = (np.arange(n), size - 1)
    for t in range(1, iterations + 1):
        w, trans, ends = weights
        emit = np.zeros((n, longest, 2))
        emit[at_page, at_step, 1] = x @ w
        emit[:, 0, 1] += ends[0]
        emit[(*last, 1)] += ends[1]
        forward = np.zeros((n, longest, 2))
        forward[:, 0] = emit[:, 0]
        for s in range(1, longest):
            step = forward[:, s - 1, :, None] + trans
            step = np.logaddexp(step[:, 0], step[:, 1]) + emit[:, s]
            forward[:, s] = np.where(inside[:, s, None], step, forward[:, s - 1])
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        backward = np.zeros((n, longest, 2))
        d_trans = np.zeros((2, 2))
        for s in range(longest - 1, 0, -1):
            ahead = emit[:, s] + backward[:, s]
            pair = np.exp(forward[:, s - 1, :, None] + trans + ahead[:, None, :] - total[:, None, None])
            use = inside[:, s]
            d_trans += pair[use].sum(axis=0)
            d_trans -= np.bincount(gold[use, s - 1] * 2 + gold[use, s], minlength=4).reshape(2, 2)
            step = trans + ahead[:, None, :]
            step = np.logaddexp(step[..., 0], step[..., 1])
            backward[:, s - 1] = np.where(use[:, None], step, backward[:, s - 1])
        p = np.exp(forward[at_page, at_step, 1] + backward[at_page, at_step, 1] - total[at_page])
        miss = p - y
        by_page = np.zeros((n, longest))
        by_page[at_page, at_step] = miss
        grads = [x.T @ miss / n + 1e-3 * w, d_trans / n + 1e-3 * trans,
                 np.array([by_page[:, 0].mean(), by_page[last].mean()]) + 1e-3 * ends]
        for v, g, (m1, m2) in zip(weights, grads, moments, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            v -= 0.2 * (m1 / (1 - 0.9 ** t)) / (np.sqrt(m2 / (1 - 0.99 ** t)) + 1e-8)
    crf.weight, crf.text_weight = weights[0][:len(names)], weights[0][len(names):]
    crf.trans, crf.ends = weights[1], weights[2]
    return crf


# Class words of the containers in the layouts: for the article and for what stands around it.
ARTICLE_NAMES = ("content", "article", "post body", "entry content", "main", "story", "page text", "article body")
OTHER_NAMES = {
    "nav": ("menu", "navbar", "breadcrumbs", "nav links"), "header": ("header", "masthead", "top banner", "site header"),
    "aside": ("sidebar", "related", "widget", "recommended"), "ad": ("ad", "advert", "sponsored", "promo"),
    "notice": ("cookie notice", "consent", "alert", "newsletter subscribe", "popup"),
    "footer": ("footer", "copyright", "legal", "bottom"), "form": ("search", "login form", "subscribe form"),
    "comments": ("comments", "comment list", "replies", "discussion"), "share": ("share", "social", "tags", "byline meta")}


def layout(r: random.Random, texts: list[str]) -> tuple[list[Block], list[bool]]:
    """A page of known structure made of given texts, as labelled blocks."""
    def some(low: int, high: int) -> str:
        t = r.choice(texts).split(" ")
        start = r.randrange(len(t))
        return " ".join(t[start:start + r.randint(low, high)]) or "x"

    def wrap(kind: str, inner: str) -> str:
        tag = {"nav": "nav", "header": "header", "aside": "aside", "footer": "footer", "form": "form"}.get(kind, "div")
        tag = tag if r.random() < 0.6 or kind == "form" else r.choice(("div", "section"))
        name = f' {r.choice(("class", "id"))}="{r.choice(OTHER_NAMES[kind])}"' if tag in ("div", "section") or r.random() < 0.4 else ""
        return f"<{tag}{name}>{inner}</{tag}>"

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{some(1, 3)}</a></li>' for _ in range(n)) + "</ul>"

    mark = "\ue000"  # marks the blocks of the article
    body = "".join(r.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>",
                             "<h2>{}</h2>", "<pre>{}</pre>")).format(mark + some(3, r.choice((8, 60, 120))))
                   for _ in range(r.randint(1, 10)))
    inner_ad = wrap(r.choice(("ad", "share")), f"<p>{some(2, 20)}</p>") if r.random() < 0.3 else ""
    body = f"<h1>{mark}{some(3, 10)}</h1>" + body + inner_ad
    holder = r.choice(("article", "article", "main", "div", "div", "section"))
    name = f' class="{r.choice(ARTICLE_NAMES)}"' if holder in ("div", "section") or r.random() < 0.3 else ""
    body = f"<{holder}{name}>{body}</{holder}>"
    if r.random() < 0.4:
        body = f"<main>{body}</main>" if holder != "main" else f"<div>{body}</div>"
    before, after = [], []
    if r.random() < 0.8:
        before.append(wrap("nav", links(r.randint(2, 8))))
    if r.random() < 0.5:
        before.insert(0, wrap("header", f"<h1>{some(1, 4)}</h1><p>{some(2, 12)}</p>"))
    for kind, chance in (("ad", 0.5), ("notice", 0.4), ("form", 0.3), ("aside", 0.5), ("share", 0.3)):
        if r.random() < chance:
            inner = f"<p>{some(2, 40)}</p>" if r.random() < 0.7 else some(2, 25)
            if kind == "aside" and r.random() < 0.5:
                inner = f"<h3>{some(1, 3)}</h3>" + links(r.randint(2, 5))
            r.choice((before, after)).append(wrap(kind, inner))
    if r.random() < 0.5:
        after.append(wrap("comments", "".join(f"<div class=\"comment\"><p>{some(3, 60)}</p></div>" if r.random() < 0.6
                                              else f"<p>{some(3, 60)}</p>" for _ in range(r.randint(1, 5)))))
    if r.random() < 0.8:
        after.append(wrap("footer", f"&copy; {some(1, 12)}" if r.random() < 0.6 else f"<p>{some(2, 20)}</p>"))
    page = blocks(f"<html><body>{''.join(before)}{body}{''.join(after)}</body></html>")
    labels = [b.text.startswith(mark) for b in page]
    for b in page:
        b.text = b.text.replace(mark, "").strip() or "x"
    return page, labels


def labelled(page: list[Block]) -> list[bool]:
    """Labels of a page with an article element: its blocks below no other landmark."""
    def is_article(path: tuple[str, ...]) -> bool:
        start = max((i for i, p in enumerate(path) if p in ("article", "main")), default=-1)
        return start >= 0 and not LANDMARKS & set(path)
    return [is_article(b.path) for b in page]


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES,
        seed: int = 5) -> Crf:
    """Train on a bounded sample of the pages and on layouts filled with their texts."""
    short = pages.where(F.octet_length(html_col) <= SAMPLE_BYTES).select(F.col(id_col).alias("id"), F.col(html_col).alias("h"))
    parsed = [blocks(row["h"]) for row in hash_sample(short, "id", sample_pages).collect()]
    known = [(p, y) for p in parsed if any(y := labelled(p))]
    texts = [b.text for p in parsed for b in p] or ["text"]
    r = random.Random(seed)
    return train(known + [layout(r, texts) for _ in range(LAYOUT_PAGES)])


def extract_text(crf: Crf, html: str | None) -> str:
    page = blocks(html or "")
    return "\n".join(b.text for b, keep in zip(page, crf.viterbi(page), strict=True) if keep)


def extract(df: DataFrame, crf: Crf, html_col: str = "html", text_out: str = "text") -> DataFrame:
    """Append the main text of each page."""
    bc = df.sparkSession.sparkContext.broadcast(crf)  # weights of the training sample's features

    def run(columns):
        return [pa.array((extract_text(bc.value, h) for h in columns[0].to_pylist()), pa.string())]

    return append_columns(df, [html_col], [T.StructField(text_out, T.StringType())], run)
