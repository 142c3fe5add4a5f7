"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text between block-level tags, each with
its open ancestors. Inside a block, text in an inline element that has a class, id
or role is a segment of its own, so an advert in the middle of a paragraph can go.
A segment's features are its ancestors' tags, the words of their
class, id and role attributes, and properties of its block's text (length, links, marks,
set phrases). Two labels, main and other, a weight for each feature and for each
pair of neighbouring labels; the weights maximise the conditional likelihood of
labelled pages (`training_pages`, made from a fixed seed over many layouts, with and
without noise, headings, class names and lists) and
are fitted once in the driver. Viterbi gives the best labelling of a page.

A block's segments labelled main are put together, their white space is made one
space, and blocks are joined in page order by one space. Scripts, styles,
comments and the head never become blocks. Pages are decoded one at a time, so
memory is bounded by the longest page, however long.

Edge cases: null or empty html gives empty text; unclosed and stray tags are
taken as browsers do for paragraphs and list items; an unclosed script runs to the
end; a page without any block gives empty text; where both labels are equally
good the text is left out; repeated rows give repeated results; an empty table
gives an empty result; other columns pass through.
"""

from __future__ import annotations

import html as html_entities
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img svg math mi mn mo ms mtext mrow msup msub mfrac msqrt semantics annotation".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no text of the page, up to their end tags, or else to the end of the page as in browsers.
RAW = frozenset("script style noscript textarea iframe title head".split())
#: Elements that browsers never show; what they hold is left out while they are open.
HIDDEN = frozenset({"template"})
#: What a new element closes if it is open.
CLOSES = {"p": "p", "li": "li", "dt": "dt", "dd": "dd", "option": "option", "tr": "tr", "td": "td", "th": "th"}
_SCOPE = frozenset("ul ol dl table select article section div main body".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Segment(NamedTuple):
    """Text of a leaf block in one set of open inline elements that have attribute words."""

    block: int
    path: tuple  # of (tag, attribute words), the block's open ancestors
    inline: tuple  # likewise, of inline elements with attribute words
    raw: str  # white space as in the page
    text: str  # of the whole block, as it would be returned
    linked: int  # characters of the block that are inside links


def _collapsed(raw: str) -> str:
    return " ".join(raw.split())


def segments(page: str) -> Iterator[Segment]:
    """The page's text in order; every block with any text has one segment or more."""
    stack: list[tuple[str, tuple]] = []
    inline: list[tuple[str, tuple, int]] = []  # and how many ancestors were open
    parts: list[tuple[tuple, list[str]]] = []
    links = linked = number = at = 0
    path: tuple = ()

    def done():
        nonlocal parts, linked, number
        if not parts:
            return
        raws = [html_entities.unescape("".join(x)) for _, x in parts]
        text = _collapsed("".join(raws))
        if text:
            for (within, _), raw in zip(parts, raws, strict=True):
                yield Segment(number, path, within, raw, text, linked)
            number += 1
        parts, linked = [], 0

    def pop_to(tag: str, scope=frozenset()) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                del stack[k:]
                while inline and inline[-1][2] > k:
                    inline.pop()
                return
            if stack[k][0] in scope:
                return

    def words_of(attrs: str) -> tuple:
        return tuple(w.lower() for g in _NAMES.findall(attrs) for w in _PART.findall(" ".join(g))) if attrs else ()

    while m := _TOKEN.match(page, at):
        at = m.end()
        close, tag, attrs, words = m.groups()
        if words is not None:
            if any(t in HIDDEN for t, _ in stack):
                continue
            if not parts:
                path = tuple(stack)
            within = tuple((t, w) for t, w, _ in inline if w)
            if not parts or parts[-1][0] != within:
                parts.append((within, []))
            parts[-1][1].append(words)
            linked += len(words.strip()) if links else 0
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            links = max(0, links + (-1 if close else 1))
        if tag in INLINE:
            if close:
                k = next((k for k in range(len(inline) - 1, -1, -1) if inline[k][0] == tag), None)
                if k is not None:
                    del inline[k:]
            elif tag not in VOID and not attrs.endswith("/") and (inline or _NAMES.search(attrs)):
                # Elements without words are only kept to tell whose end tag it is.
                inline.append((tag, words_of(attrs), len(stack)))
            continue
        yield from done()
        links = 0
        if tag in RAW and not close:
            if tag == "head":  # its elements are skipped one by one: the end tag may be missing
                continue
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if close:
            pop_to(tag)
        elif tag not in VOID and not attrs.endswith("/"):
            if tag in CLOSES:
                pop_to(CLOSES[tag], _SCOPE)
            if tag in _CLOSES_P and tag != "p":
                pop_to("p", _SCOPE)
            stack.append((tag, words_of(attrs)))
    yield from done()


#: Set phrases that are mostly no part of an article.
PHRASES = (
    "©", "all rights reserved", "copyright", "cookie", "subscribe", "sign in", "sign up", "log in", "newsletter", "advertis", "sponsored",
    "privacy", "terms of", "related", "share this", "share on", "comments", "reply", "replies", "read more", "menu", "skip to", "follow us", "posted by",
)


_SECTIONS = frozenset("article main nav aside footer header form".split())


def closest(path: tuple) -> str:
    return next((t for t, _ in reversed(path) if t in _SECTIONS), "none")


def page_kind(found: list[Segment]) -> str:
    """What kind of page the segments are of: with an element for the main text or not, and whether it has few blocks."""
    marked = any(tag in ("article", "main") for x in found for tag, _ in x.path)
    return ("marked" if marked else "plain") + (" few" if found[-1].block < 3 else "")


def path_features(path: tuple, inline: tuple, kind: str) -> list[str]:
    out = {f"in:{tag}" for tag, _ in path}
    out |= {f"page:{kind}", f"page:{kind} closest:{closest(path)}"}
    out |= {f"word:{w}" for _, names in (*path, *inline) for w in names}
    out |= {f"inline:{w}" for _, names in inline for w in names}
    if inline:
        out.add("inline")
    out.add(f"closest:{closest(path)}")
    if path:
        out.add(f"leaf:{path[-1][0]}")
        out |= {f"near:{w}" for w in path[-1][1]}
        out.add(f"closest:{closest(path)} leaf:{path[-1][0]}")
    return sorted(out)


def text_features(text: str, linked: int, section: str) -> list[str]:
    n = len(text)
    links, length = min(3, int(4 * linked / max(1, n))), min(6, int(math.log2(n + 1)) // 2)
    out = ["bias", f"len:{length}", f"links:{links}", f"closest:{section} links:{links}", f"closest:{section} len:{length}"]
    if text[-1] in ".!?:;\"'”»":
        out.append("ends")
    if n < 400:
        low = text.lower()
        if any(p in low for p in PHRASES):
            out += ["phrase", f"closest:{section} phrase"]
    if "|" in text or "»" in text or "›" in text:
        out.append("bars")
    return out


class Crf:
    """Weights of features for main against other, and of label pairs; label -1 stands before the first block."""

    def __init__(self, weights: dict[str, float], pairs: dict[tuple[int, int], float]):
        self.weights, self.pairs = weights, pairs
        self._paths: dict[tuple, float] = {}

    def emission(self, x: Segment, kind: str) -> float:
        key = (x.path, x.inline, kind)
        got = self._paths.get(key)
        if got is None:
            if len(self._paths) > 50_000:
                self._paths.clear()
            got = self._paths[key] = sum(self.weights.get(f, 0.0) for f in path_features(*key))
        return got + sum(self.weights.get(f, 0.0) for f in text_features(x.text, x.linked, closest(x.path)))

    def decode(self, emissions: list[float]) -> list[int]:
        if not emissions:
            return []
        p = self.pairs
        other, main = p[-1, 0], p[-1, 1] + emissions[0]
        back = []
        for e in emissions[1:]:
            o0, o1, m0, m1 = other + p[0, 0], main + p[1, 0], other + p[0, 1], main + p[1, 1]
            back.append((int(o1 > o0), int(m1 > m0)))
            other, main = max(o0, o1), max(m0, m1) + e
        label = int(main > other)
        out = [label]
        for o, m in reversed(back):
            label = m if label else o
            out.append(label)
        return out[::-1]

    def extract(self, page: str | None) -> str:
        found = list(segments(page or ""))
        kind = page_kind(found) if found else ""
        labels = self.decode([self.emission(x, kind) for x in found])
        kept: dict[int, list[str]] = {}
        for x, y in zip(found, labels, strict=True):
            if y:
                kept.setdefault(x.block, []).append(x.raw)
        return _collapsed(" ".join("".join(raws) for raws in kept.values()))


def train(pages: list[list[tuple[list[str], int]]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-4) -> Crf:
    """Stochastic gradient ascent on the conditional log-likelihood of labelled block sequences."""
    number: dict[str, int] = {}
    pages = [[([number.setdefault(f, len(number)) for f in feats], y) for feats, y in page] for page in pages]
    w = [0.0] * len(number)
    pairs = {(a, b): 0.0 for a in (-1, 0, 1) for b in (0, 1)}
    order = random.Random(7)
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for page in order.sample(pages, len(pages)):
            if not page:
                continue
            e = [sum([w[f] for f in feats]) for feats, _ in page]
            n = len(page)
            fwd = [(pairs[-1, 0], pairs[-1, 1] + e[0])]
            for k in range(1, n):
                a, b = fwd[-1]
                fwd.append((add(a + pairs[0, 0], b + pairs[1, 0]), add(a + pairs[0, 1], b + pairs[1, 1]) + e[k]))
            bwd = [(0.0, 0.0)] * n
            for k in range(n - 2, -1, -1):
                a, b = bwd[k + 1]
                bwd[k] = tuple(add(pairs[y, 0] + a, pairs[y, 1] + e[k + 1] + b) for y in (0, 1))
            z = add(*fwd[-1])
            grads = {key: 0.0 for key in pairs}
            for k, (feats, y) in enumerate(page):
                diff = y - math.exp(fwd[k][1] + bwd[k][1] - z)
                for f in feats:
                    w[f] += step * (diff - decay * w[f])
                if k:
                    for a in (0, 1):
                        for b in (0, 1):
                            grads[a, b] -= math.exp(fwd[k - 1][a] + pairs[a, b] + (e[k] if b else 0.0) + bwd[k][b] - z)
                    grads[page[k - 1][1], y] += 1
                else:
                    for b in (0, 1):
                        grads[-1, b] -= math.exp(fwd[0][b] + bwd[0][b] - z)
                    grads[-1, y] += 1
            for key, g in grads.items():
                pairs[key] += step * 0.2 * g
    return Crf({f: w[k] for f, k in number.items()}, pairs)


_SYLLABLES = "an de en er es in is la le on or que re ra st ta te th ti un ver zu che ment".split()


#: Class names of the training pages' noise, and of wrappers and passages that hold main text.
NOISE = {
    "nav": ["nav", "navbar", "menu", "breadcrumb", "topnav", "pagination", "skip links", "navigation", "pager"],
    "head": ["header", "masthead", "site header", "top bar", "branding"],
    "foot": ["footer", "site-footer", "copyright", "bottom", "colophon"],
    "side": ["sidebar", "aside", "widget", "related", "recommended", "popular", "trending", "tags"],
    "ad": ["ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo", "ad-slot", "ad-label"],
    "note": ["notice", "cookie", "cookie-consent", "alert", "popup", "modal", "gdpr", "banner", "subscribe", "newsletter", "message"],
    "form": ["form", "login", "search", "signup", "contact"],
    "talk": ["comments", "comment", "comment-list", "replies", "reply", "discussion", "disqus", "responses"],
    "share": ["share", "social", "sharing", "share-button"],
}
WRAPPERS = ["content", "article", "post", "entry content", "main", "story", "article-body", "post-content", "text", "page", "container", "wrapper", "row", "column", "inner", "layout"]
PASSAGES = ["lead", "intro", "summary", "highlight", "term", "caption", "quote", "first", "em", "link", "note-ref", "paragraph", "date", "name"]


def training_pages(count: int = 1100, seed: int = 11) -> Iterator[list[tuple[str, int]]]:
    """Labelled pages: (piece of html, 1 if the text in it is main text else 0 or, for bare markup, -1)."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))

    def prose(lo: int, hi: int) -> str:
        words = [word() for _ in range(max(1, r.randint(lo, hi)))]
        words[0] = words[0].title()
        for k in range(6, len(words), r.randint(6, 14)):
            words[k] += r.choice(".,!")
        return " ".join(words) + r.choice([".", ".", ".", "", "!"])

    link = lambda lo=1, hi=3: f'<a href="/{word()}">{prose(lo, hi)}</a>'
    phrases = ["Copyright 2020 {}. All rights reserved.", "© {}", "We use cookies. {}", "Subscribe to our newsletter {}", "Sign in {}", "Advertisement {}", "Sponsored {}", "Related {}", "Share this {}", "Read more {}"]
    tags = {"nav": ["nav", "div", "ul"], "head": ["header", "div"], "foot": ["footer", "div"], "side": ["aside", "div", "section"], "ad": ["div", "aside", "ins"], "note": ["div", "section", "p"], "form": ["form"], "talk": ["section", "div", "ol"], "share": ["div", "ul"]}

    def junk(kind: str) -> list[tuple[str, int]]:
        name = r.choice(NOISE[kind])
        attr = f' {r.choice(["class", "class", "id"])}="{name}"' if r.random() < 0.75 else ""
        tag = r.choice(tags[kind])
        if tag in ("div", "section", "p", "ul", "ol", "ins") and not attr:
            attr = f' class="{name}"'
        inner: list[str] = []
        if kind in ("nav", "share"):
            inner = ["<ul>" * (tag != "ul"), *[f"<li>{link()}</li>" for _ in range(r.randint(1, 7))], "</ul>" * (tag != "ul")]
            if tag != "ul" and r.random() < 0.3:
                inner = [link() + " " for _ in range(r.randint(1, 5))]
        elif kind == "head":
            inner = [f"<{r.choice(['h1', 'p', 'div'])}>{link() if r.random() < 0.5 else prose(1, 5)}", f"<p>{prose(2, 8)}</p>" * r.randint(0, 1)]
        elif kind == "foot":
            inner = [r.choice([f"&copy; {word()}.example.com &middot; {prose(3, 20)}", f"<p>{r.choice(phrases).format(prose(2, 15))}</p>", prose(3, 25), f"<p>{link()} | {link()}</p>"])]
        elif kind == "side":
            inner = [f"<h3>{r.choice(phrases[-3:]).format(word())}</h3>", *[r.choice([f"<p>{prose(3, 40)}</p>", f"<li>{link()}</li>"]) for _ in range(r.randint(1, 4))]]
        elif kind == "form":
            inner = [f"<label>{prose(1, 3)}</label><input type=text>", f"<p>{prose(3, 20)}</p>" * r.randint(0, 1), f"<button>{prose(1, 2)}</button>", f"<select><option>{word()}<option>{word()}</select>" * r.randint(0, 1)]
        elif kind == "talk":
            inner = [f"<h{r.choice('234')}>Comments</h3>" * r.randint(0, 1)]
            for _ in range(r.randint(1, 4)):
                own = r.choice(["div", "li", "article", "p", "div"])
                inner.append(f'<{own} class="{r.choice(NOISE["talk"])}"><p>{prose(4, 60)}</p><span>{word()}</span></{own}>')
        else:
            inner = [r.choice([prose(2, 30), f"<p>{prose(3, 35)}</p>", f"<p>{r.choice(phrases).format(prose(1, 20))}</p><button>{word()}</button>"])]
        return [(f"<{tag}{attr}>" + "".join(inner) + f"</{tag}>", 0)]

    def sentence(lo: int, hi: int) -> str:
        """Prose with inline elements, some with harmless class names."""
        tag = r.choice(["b", "em", "span", "a", "code", "sup"])
        attr = f' class="{r.choice(PASSAGES)}"' if r.random() < 0.5 else ""
        part = f"<{tag}{attr}>{prose(1, 5)}</{tag}>"
        return r.choice([f"{prose(lo, hi)} {part} {prose(lo, hi)}", f"{part} {prose(lo, hi)}", f"{prose(lo, hi)} {part}"])

    def items(tag: str, linked: bool) -> str:
        return f"<{tag}>" + "".join(f"<li>{link(1, 8) if linked else prose(1, 15)}" + r.choice(["", "</li>"]) for _ in range(r.randint(1, 5))) + f"</{tag}>"

    def content(heading: float, linked: bool = True) -> list[tuple[str, int]]:
        out = []
        if r.random() < heading:
            out.append((f"<h1>{prose(2, 14)}</h1>", 1))
        for _ in range(r.choice([1, 1, 2, 2, 3, 4, 5, 6, 7, 9])):
            kind = r.random()
            attr = f' class="{r.choice(PASSAGES)}"' if r.random() < 0.12 else ""
            if kind < 0.50:
                out.append((f"<p{attr}>{prose(1, 4) if r.random() < 0.25 else prose(4, 120)}</p>", 1))
            elif kind < 0.58:
                out.append((f"<p{attr}>{sentence(2, 30)}</p>", 1))
            elif kind < 0.63:
                out.append((f"<p><b>{prose(3, 60)}<br>" + "</b></p>" * r.randint(0, 1), 1))
            elif kind < 0.70:
                out.append((f"<h{r.choice('234')}>{prose(1, 8)}</h2>", 1))
            elif kind < 0.75:
                out.append((items("ul", linked and r.random() < 0.2), 1))
            elif kind < 0.81:
                out.append((items("ol", linked and r.random() < 0.2), 1))
            elif kind < 0.84:
                out.append((f"<blockquote>{prose(5, 40)}</blockquote>", 1))
            elif kind < 0.86:
                out.append((f"<table><tr><td>{word()}<td>{prose(1, 5)}</table>", 1))
            elif kind < 0.88:
                out.append((f"<dl><dt>{prose(1, 3)}<dd>{prose(2, 20)}</dl>", 1))
            elif kind < 0.90:
                out.append((f"<pre>{prose(2, 20)}</pre>", 1))
            elif kind < 0.92:
                out.append((f"<figure><img src=x><figcaption>{prose(2, 12)}</figcaption></figure>", 1))
            elif kind < 0.96 and linked:
                out.append((f"<p>{link(1, 12)}</p>" if r.random() < 0.6 else f"<p>{prose(3, 20)} {link()} {prose(2, 10)}</p>", 1))
            else:
                out.append((f"<div>{prose(5, 60)}</div>" if r.random() < 0.5 else prose(5, 60), 1))
            if r.random() < 0.08:  # an article may hold such phrases too
                out.append((f"<p>{r.choice([*phrases, 'All rights reserved. {}', 'Comments on {}']).format(prose(0, 30) if r.random() < 0.6 else '')}</p>", 1))
            if r.random() < 0.06:
                out += junk(r.choice(["ad", "share", "note", "side", "form"]))
            if r.random() < 0.08:  # noise in the middle of a paragraph
                tag, name = r.choice(["span", "span", "a", "ins", "small", "b"]), r.choice(NOISE[r.choice(["ad", "ad", "share", "note"])])
                out += [(f"<p>{prose(3, 40)} ", 1), (f'<{tag} class="{name}">{prose(1, 8)}</{tag}>', 0), (f" {prose(3, 40)}</p>", 1)]
        return out

    for _ in range(count):
        quiet = r.random() < 0.4  # a page, or a piece of one, with little or no noise
        whole = r.random() < (0.5 if quiet else 0.95)
        page: list[tuple[str, int]] = [("<!DOCTYPE html><html><head><title>x</title></head><body>" * whole, -1)]
        around = r.random() < 0.25
        page.append((f'<div class="{r.choice(WRAPPERS[10:])}">' * around, -1))
        for kind in ("note", "head", "nav", "ad", "form"):
            if r.random() < {"nav": 0.85, "ad": 0.6, "head": 0.6, "note": 0.3, "form": 0.2}[kind] * (0.08 if quiet else 1):
                page += junk(kind)
        outer = r.choice(["article", "article", "article", "article", "main", "div", "div", "div", "section", "bare", "bare", "bare", "bare"])
        bare_div = outer == "div" and r.random() < 0.6  # neither class nor id
        named = (outer in ("div", "section") and not bare_div) or (outer not in ("bare", "div") and r.random() < 0.3)
        wrap, depth = r.random() < 0.3 and not bare_div, r.randint(1, 3) if bare_div else 1
        page.append(("<main>" * wrap, -1))
        page.append(("" if outer == "bare" else (f'<{outer} class="{r.choice(WRAPPERS)}">' if named else f"<{outer}>") * depth, -1))
        if quiet and r.random() < 0.25:  # a very short text
            page += [(f"<p>{r.choice([prose(1, 2), r.choice('ABCDE')])}</p>", 1) for _ in range(r.randint(1, 2))]
        else:
            page += content(0.5 if quiet else 0.8, linked=outer in ("article", "main"))
        if r.random() < (0.05 if quiet else 0.2):
            page += junk("talk")
        page.append((("" if outer == "bare" else f"</{outer}>" * depth) + "</main>" * wrap, -1))
        for kind in ("share", "side", "talk", "ad", "form", "note", "foot"):
            if r.random() < {"share": 0.25, "side": 0.45, "talk": 0.35, "ad": 0.3, "foot": 0.85, "form": 0.15, "note": 0.15}[kind] * (0.15 if quiet else 1):
                page += junk(kind)
        page.append(("</div>" * around + "</body></html>" * whole, -1))
        yield page


#: Stand before the text of pieces of either label while a labelled page is read.
MARKS = "\ue000\ue001"


def labelled_blocks(page: list[tuple[str, int]]) -> list[tuple[list[str], int]]:
    """Features and labels of a labelled page's segments: pieces are told apart by marks put into their text."""
    put = lambda y: lambda m: (">" + MARKS[y] + m[1]) if m[1] else MARKS[y] + m[2]
    marked = "".join(re.sub(r">([^<]*[^<\s][^<]*)|^([^<]+)", put(y), piece) if y >= 0 else piece for piece, y in page)
    clean = lambda text: _collapsed("".join(" " if c in MARKS else c for c in text))
    out = []
    found = list(segments(marked))
    for x in found:
        marks, text = [c for c in x.raw if c in MARKS], clean(x.text)
        if clean(x.raw):
            out.append((path_features(x.path, x.inline, page_kind(found)) + text_features(text, min(x.linked, len(text)), closest(x.path)), int(bool(marks) and marks[0] == MARKS[1])))
    return out


@lru_cache(maxsize=1)
def model() -> Crf:
    """The model of the built-in training pages; a few seconds, once for each process that asks."""
    return train([labelled_blocks(p) for p in training_pages()])


def extracted(spark: SparkSession, crf: Crf, page: Column) -> Column:
    shared = spark.sparkContext.broadcast((crf.weights, crf.pairs))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Crf(*shared.value)
        for pages in batches:
            yield pd.Series([own.extract(p) for p in pages])

    small_batches(spark, 256)
    return run(page)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", extracted(spark, model(), F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))
