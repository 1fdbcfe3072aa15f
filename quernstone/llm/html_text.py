"""The main text of web pages by a maximum-scoring subsequence of words and tags.

A page is a row of events: runs of words, and start and end tags.  Words score what the open elements around them are worth, tags a cost, and the content
region is the contiguous row of events with the largest sum, which one linear scan finds.  The weights are those of a logistic regression over
labelled pages: pages of the table itself that mark their article by an element, and pages made here with other layouts, whose makers know
what is content.  Of the region, elements go whose own name or class the weights call no content (adverts between paragraphs, forms, comments).

The reader of markup follows the usual repairs: comments and raw elements, quotes in attributes, implied ends of paragraphs, items and
cells, end tags that match nothing.  It takes time linear in the page, however deep or broken that is.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, slices, small_batches, table

#: Bounds of the labelled pages: so many of the table, each of at most so many characters, and so many made ones.
LABELLED = 96
LABELLED_CHARS = 100_000
MADE = 600
STEPS = 40
RIDGE = 2e-4
#: Weights are kept as whole numbers of this fraction, so that sums are exact in any order.
UNIT = 1000
TOP = 4 * UNIT
#: A tag costs this much at least.
TAG = -UNIT // 4
#: An element whose own names weigh less than this is no content: its words count nothing, and it costs this much to have it in the region,
#: inside of a marked article and elsewhere.
REFUSED = -UNIT
OVER = (UNIT // 4, 12 * UNIT)
#: Inside of a marked article, a word scores this at least and a tag costs that, so that only what the weights refuse is left out.
WORD_INSIDE, TAG_INSIDE = UNIT, -UNIT // 50

#: Elements by their part in a page.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in RAW}
NO_TEXT = frozenset("head template svg select datalist button object audio video canvas map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var math".split())
BREAKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
ENDS_P = BREAKS - frozenset("br body caption html legend option optgroup tbody td tfoot th thead title tr".split())
#: Elements that say nothing about content by their tag alone.
PLAIN = (BREAKS | INLINE) - frozenset("a article aside dialog footer form header label legend fieldset main menu nav".split())
#: Words in class, id and role attributes: of content and of everything around it.
GOOD = "article content entry main story body text post blog".split()
BAD = (
    "ad advert advertisement advertising banner promo sponsor sponsored sidebar widget related recommended recommendation share social newsletter subscribe subscription signup cookie consent gdpr notice alert message popup modal overlay menu nav navbar navigation breadcrumb "
    "header masthead topbar toolbar brand logo footer bottom copyright legal disclaimer comment discussion disqus respond reply feedback reaction form search login pagination pager toc trending popular hidden skip complementary contentinfo dialog tag"
).split()
HINTS = frozenset(GOOD) | frozenset(BAD)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

START = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
LETTER = re.compile(r"</?[a-zA-Z]")
TELLS = re.compile(r"class|id|role|hidden|style", re.I)
CORE = frozenset(("article", "main"))


def hints(value: str) -> list[str]:
    """The known words of a class, id or role; plural forms and longer words that begin with a known one count as it."""
    out = []
    for word in NAME.findall(value):
        word = word.lower()
        for w in (word, word.removesuffix("s")):
            if w in HINTS:
                out.append(w)
                break
        else:
            out += [word[:n] for n in range(len(word) - 1, 4, -1) if word[:n] in HINTS][:1]
    return out


@functools.lru_cache(maxsize=1 << 14)
def named(tag: str, attributes: str) -> tuple[str, ...]:
    """What an element is called: its tag and the known words of its attributes."""
    out = [tag]
    if attributes and tag not in ("html", "body"):
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
            if key in ("class", "id", "role"):
                out += [f"={w}" for w in hints(value)]
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                out.append("=hidden")
    return tuple(dict.fromkeys(out))


GOOD_NAMES, BAD_NAMES = (frozenset(f"={w}" for w in words) for words in (GOOD, BAD))


class Element:
    __slots__ = ("core", "features", "open", "parent", "reach", "tag", "title", "top_block")

    def __init__(self, tag: str, features: tuple[str, ...], parent: Element | None):
        self.tag, self.features, self.parent, self.open, self.title = tag, features, parent, True, False
        self.core = (tag in CORE or "=main" in features) and not any(f in BAD_NAMES for f in features)


#: What an opening tag ends: (which open elements, where the search for them stops).
LI, DD, CELL, ROW = (frozenset(x.split()) for x in ("li", "dt dd", "td th", "tr"))
IMPLIED = {t: i for i, group in enumerate((LI, DD, CELL, ROW), 1) for t in group}
STOPS = (None, frozenset("ul ol menu dir table".split()), frozenset(("dl", "table")), frozenset(("table", "tr")), frozenset(("table",)))
TEXT, OPEN, CLOSE, BREAK = range(4)


def read(page: str) -> list[tuple[int, object, int]]:
    """Events of a page: (TEXT, characters as written, place), (OPEN or CLOSE, element, place), (BREAK, None, place)."""
    events: list[tuple[int, object, int]] = []
    stack: list[Element] = []
    places: dict[str, list[int]] = {}
    silent = 0  # open elements whose text is none
    pos, n, more_tags = 0, len(page), True

    def pop_to(k: int, at: int) -> None:
        nonlocal silent
        while len(stack) > k:
            e = stack.pop()
            if e.open:
                places[e.tag].pop()
                e.open = False
                silent -= e.tag in NO_TEXT
                events.append((CLOSE, e, at))
            if e.parent is not None:
                e.parent.core |= 2 * bool(e.core)
                e.parent.title |= e.title or e.tag == "h1"

    while pos < n:
        at = page.find("<", pos) if more_tags else -1
        if at < 0:
            at = n
        if at > pos and not silent:
            events.append((TEXT, page[pos:at], pos))
        if at == n:
            break
        m = START.match(page, at) if LETTER.match(page, at) else None
        if m is None:
            follow = page[at + 1 : at + 2]
            if page.startswith("<!--", at):
                end = page.find("-->", at + 2 + page.startswith("<!--->", at) if page.startswith((">", "->"), at + 4) else at + 4)
                pos = n if end < 0 else end + 3
            elif follow in ("!", "?") or (follow == "/" and not LETTER.match(page, at)):
                end = page.find(">", at)
                pos = n if end < 0 else end + 1
            else:
                more_tags = not LETTER.match(page, at)  # a tag that never ends: what follows is text
                if not silent:
                    events.append((TEXT, "<", at))
                pos = at + 1
            continue
        pos = m.end()
        tag = m.group(2).lower()
        if m.group(1):
            if tag in ("br", "p") and not places.get(tag):
                events.append((BREAK, None, at))
            elif places.get(tag):
                k = places[tag][-1]
                if tag in INLINE and stack[-1].top_block > k:  # an inline end inside a block of its own: the block goes on
                    places[tag].pop()
                    stack[k].open = False
                    events.append((CLOSE, stack[k], at))
                else:
                    pop_to(k, at)
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, pos)
            close = page.find(">", end.end()) if end else -1
            pos = n if close < 0 else close + 1
            events.append((BREAK, None, at)) if tag in BREAKS else None
            continue
        if tag in ENDS_P and stack and stack[-1].reach[0] >= 0:
            pop_to(stack[-1].reach[0], at)
        kind = IMPLIED.get(tag, 0)
        if kind and stack and stack[-1].reach[kind] >= 0:
            pop_to(stack[-1].reach[kind], at)
        if tag in VOID:
            if tag in BREAKS:
                events.append((BREAK, None, at))
            continue
        parent = stack[-1] if stack else None
        e = Element(tag, named(tag, m.group(3) if TELLS.search(m.group(3)) else ""), parent)
        k = len(stack)
        before = parent.reach if parent else (-1, -1, -1, -1, -1)
        if tag in INLINE:
            e.reach = before
        else:
            e.reach = (k if tag == "p" else -1, *(k if kind == i else -1 if tag in STOPS[i] else before[i] for i in range(1, 5)))
        e.top_block = (parent.top_block if parent else -1) if tag in INLINE else k
        stack.append(e)
        places.setdefault(tag, []).append(k)
        silent += tag in NO_TEXT
        events.append((OPEN, e, at))
    pop_to(0, n)
    return events


def good(e: Element) -> bool:
    """Whether its class or id speaks of content and of nothing else."""
    return e.tag not in ("html", "body") and any(f in GOOD_NAMES for f in e.features) and not any(f in BAD_NAMES for f in e.features)


def worth(e: Element, inside: bool) -> tuple[str, ...]:
    """The features of an element.  What holds the article is a frame, and its names say nothing; a header inside an article is not the site's."""
    features = e.features if e.tag not in ("html", "body", "head") else ()
    if e.core == 2 or e.core == 3 or (e.title and any(f in GOOD_NAMES for f in features)):
        bad = [f for f in features if f in BAD_NAMES]
        features = tuple(f for f in features if f not in bad and (f in CORE or f in PLAIN or f[0] == "="))
    if inside and e.tag in ("header", "footer", "aside", "section"):
        features = (f"in {e.tag}", *features[1:])
    return features


@dataclass(frozen=True)
class Weights:
    """Of words, by the features of the open elements; of tags, by their element's features."""

    word: dict[str, int]
    tag: dict[str, int]

    def cost(self, features: tuple[str, ...]) -> int:
        return max(-TOP, min(TAG, self.tag.get("", 0) + sum([self.tag.get(f, 0) for f in features])))

    def refuses(self, features: tuple[str, ...]) -> bool:
        own = [self.word.get(f, 0) for f in features if f not in PLAIN and f not in ("a", *CORE)]
        return bool(own) and sum(own) < REFUSED


def scored(events: list, w: Weights, outside: bool) -> tuple[list[int], list[bool]]:
    """Each event's score, and whether its text counts.  With `outside`, words outside of a marked article bear that as a feature."""
    word, open_, total, refused, cores = w.word, Counter(), w.word.get("", 0), 0, 0
    goods = 0
    out_weight = word.get("out", 0) if outside else 0
    scores, counts, entered = [], [], {}
    for kind, x, _ in events:
        score, ok = 0, True
        if kind == TEXT:
            ok = not refused
            if ok and (n := len(x.split())):
                score = n * (max(WORD_INSIDE, min(TOP, total)) if cores else max(-TOP, min(TOP, total + out_weight)))
        elif kind == OPEN:
            features = worth(x, cores + goods > 0)
            no = w.refuses(features)
            entered[x] = features, no
            goods += good(x)
            for f in features:
                open_[f] += 1
                if open_[f] == 1:
                    total += word.get(f, 0)
            cores += x.core == 1 or x.core == 3
            score = (TAG_INSIDE if cores else w.cost(features)) - (OVER[not cores] if no and not refused else 0)
            refused += no
        elif kind == CLOSE:
            features, no = entered.pop(x)
            score = TAG_INSIDE if cores else w.cost(features)
            for f in features:
                open_[f] -= 1
                if not open_[f]:
                    total -= word.get(f, 0)
            refused -= no
            cores -= x.core == 1 or x.core == 3
            goods -= good(x)
        scores.append(score)
        counts.append(ok)
    return scores, counts


def best_range(scores: list[int]) -> tuple[int, int]:
    """The contiguous range with the largest positive sum, the first one of several; (0, 0) if none is positive."""
    best = since = total = 0
    found = (0, 0)
    for i, s in enumerate(scores):
        total += s
        if total <= 0:
            total, since = 0, i + 1
        elif total > best:
            best, found = total, (since, i + 1)
    return found


def marked(events: list) -> bool:
    return any(kind == OPEN and (x.core == 1 or x.core == 3) for kind, x, _ in events)


def main_text(page: str, w: Weights) -> str:
    """The page's content: its blocks, each with single spaces, joined by newlines; empty if the page has none."""
    events = read(page)
    found = (0, 0)
    if marked(events):
        scores, counts = scored(events, w, True)
        found = best_range(scores)
    if found == (0, 0):
        scores, counts = scored(events, w, False)
        found = best_range(scores)
    blocks, now = [], []
    for i in range(*found):
        kind, x, _ = events[i]
        if kind == TEXT:
            if counts[i]:
                now.append(entities.unescape(x) if "&" in x else x)
        elif kind == BREAK or x.tag in BREAKS:
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    return "\n".join([t for t in (" ".join(b.split()) for b in blocks) if t])


# -- labelled pages -----------------------------------------------------------------------------------------------------------------


class Maker:
    """Makes pages of many layouts and says of each piece whether it is content."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.pieces: list[tuple[str, bool]] = []

    def put(self, text: str, content: bool = False) -> None:
        self.pieces.append((text, content))

    def words(self, least: int, most: int) -> str:
        return " ".join("".join(self.r.choices("abcdefgh", k=self.r.randint(2, 8))) for _ in range(self.r.randint(least, most)))

    def attribute(self, names: list[str]) -> str:
        r = self.r
        if not names or r.random() < 0.15:
            return ""
        name = r.choice(names)
        shape = r.random()
        if shape < 0.3:
            name = f"{r.choice(['site', 'page', 'post', 'article', 'main', 'content', 'wp', 'block', 'js'])}-{name}"
        elif shape < 0.45:
            name = f"{name}-{r.choice(['wrap', 'box', 'list', 'inner', 'area', 'section', 'text', 'content', 'body'])}"
        elif shape < 0.55:
            name += "s"
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def inline(self, text: str) -> str:
        parts = text.split(" ")
        for _ in range(self.r.choice([0, 0, 1, 2])):
            i, tag = self.r.randrange(len(parts)), self.r.choice(["a href=x", "em", "b", "strong", "i", "span", "code"])
            parts[i] = f"<{tag}>{parts[i]}</{tag.split()[0]}>"
        return " ".join(parts)

    def prose(self) -> None:
        r = self.r
        for _ in range(r.choice([1, 2, 3, 4, 6, 8])):
            kind = r.random()
            if kind < 0.7:
                self.put(f"<p>{self.inline(self.words(1, 60))}{r.choice(['</p>', '</p>', '<br>'])}", True)
            elif kind < 0.8:
                h = r.choice(["h2", "h3"])
                self.put(f"<{h}>{self.words(1, 8)}</{h}>", True)
            elif kind < 0.88:
                self.put("<ul>" + "".join(f"<li>{self.inline(self.words(1, 20))}</li>" for _ in range(r.randint(1, 5))) + "</ul>", True)
            elif kind < 0.92:
                self.put(f"<blockquote><p>{self.words(3, 30)}</p></blockquote>", True)
            elif kind < 0.95:
                self.put("<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>", True)
            elif kind < 0.97:
                self.put(f"<figure><img src=x><figcaption>{self.words(2, 12)}</figcaption></figure>", True)
            else:
                self.put(f"<pre>{self.words(3, 20)}</pre>", True)
            if r.random() < 0.08:
                self.aside()

    def wrapped(self, tags: list[str], names: list[str], inside: str) -> None:
        tag = self.r.choice(tags)
        self.put(f"<{tag}{self.attribute(names)}>{inside}</{tag}>")

    def links(self) -> str:
        r = self.r
        items = [f"<a href=x>{self.words(1, 3)}</a>" for _ in range(r.randint(2, 9))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.7 else r.choice([" | ", " ", "<br>"]).join(items)

    def lines(self) -> str:
        return "".join(self.r.choice(["<p>{}</p>", "<div>{}</div>", "<span>{}</span>", "{}"]).format(self.inline(self.words(1, 30))) for _ in range(self.r.randint(1, 3)))

    def menu(self) -> None:
        self.wrapped(["nav", "nav", "div", "ul"], ["nav", "menu", "navbar", "navigation", "breadcrumb", "toolbar", "pagination", "toc"], self.links())

    def head(self) -> None:
        inside = f"<a href=x>{self.words(1, 3)}</a>" + self.r.choice(["", f"<p>{self.words(2, 9)}</p>", f"<h2>{self.words(1, 4)}</h2>", self.links()])
        self.wrapped(["header", "header", "div"], ["header", "masthead", "topbar", "banner", "brand", "logo"], inside)

    def aside(self) -> None:
        names = ["ad", "advert", "advertisement", "promo", "sponsor", "sponsored", "sidebar", "widget", "related", "recommended", "share", "social", "newsletter", "trending", "popular", "complementary", "tag"]
        self.wrapped(["aside", "div", "div", "section"], names, self.r.choice([self.links, self.lines])())

    def notice(self) -> None:
        self.wrapped(["div", "div", "section", "dialog", "p"], ["cookie", "consent", "gdpr", "notice", "alert", "message", "popup", "modal", "overlay", "banner", "hidden", "skip"], self.words(3, 40) + self.r.choice(["", " <a href=x>ok</a>", "<button>ok</button>"]))

    def form(self) -> None:
        self.wrapped(["form"], ["form", "search", "login", "newsletter", "subscribe", "signup", "feedback", ""], f"<label>{self.words(1, 5)}</label><input>{self.r.choice(['', f'<p>{self.words(2, 14)}</p>'])}<button>{self.words(1, 1)}</button>")

    def comments(self) -> None:
        r = self.r
        each = r.choice(["div", "li", "article", "section"])
        own = r.choice([' class="comment"', ' class="comment"', ' class="reply"', "" if each != "article" else ' class="comment"'])
        inside = f"<h3>{self.words(1, 3)}</h3>" + "".join(f"<{each}{own}><b>{self.words(1, 2)}</b><p>{self.words(1, 40)}</p></{each}>" for _ in range(r.randint(1, 5)))
        tag, name = r.choice(["section", "div", "div", "ol", "aside"]), r.choice(["comment", "comments", "discussion", "disqus", "respond", "reaction", "commentlist", "feedback"])
        self.put(f'<{tag} {r.choice(["class", "id"])}="{r.choice(["", "", "post-", "article-"])}{name}">{inside}</{tag}>')

    def foot(self) -> None:
        self.wrapped(["footer", "footer", "div"], ["footer", "bottom", "copyright", "legal", "disclaimer", "contentinfo"], self.r.choice([self.links, self.lines, lambda: f"&copy; {self.words(1, 12)}"])())

    def page(self) -> tuple[str, list[tuple[int, int]]]:
        """A page and where its content is."""
        r = self.r
        self.put("<!DOCTYPE html><html><head><title>x</title></head><body>")
        around = r.choice(["", "", "<div>", '<div class="page">', '<div id="wrapper"><div class="container">'])
        self.put(around)
        if r.random() < 0.2:
            self.notice()
        for part in r.sample([self.head, self.menu, self.notice, self.form, self.aside], r.randint(1, 4)):
            part()
        tag = r.choice(["article", "article", "main", "div", "div", "div", "section", "td"])
        name = "" if tag in ("article", "main") and r.random() < 0.6 else self.attribute(GOOD) if tag != "td" or r.random() < 0.3 else ""
        table_ = tag == "td"
        if table_:
            self.put("<table><tr><td>" + self.links() + "</td>")
        self.put(f"<{tag}{name}>", True)
        if r.random() < 0.7:
            title = f"<h1>{self.words(1, 12)}</h1>"
            self.put(f"<header>{title}</header>" if r.random() < 0.2 else title, True)
        inner = r.random() < 0.15
        if inner:
            self.put(f"<div{self.attribute(GOOD)}>", True)
        self.prose()
        if inner:
            self.put("</div>", True)
        if r.random() < 0.2:
            r.choice([self.comments, self.aside, self.foot, self.form])()
        self.put(f"</{tag}>", True)
        if table_:
            self.put("<td>" + self.lines() + "</td></tr></table>" if r.random() < 0.2 else "</tr></table>")
        for part in r.sample([self.comments, self.aside, self.form, self.menu, self.notice], r.randint(0, 4)):
            part()
        self.foot()
        spans, at, text = [], 0, []
        for piece, content in self.pieces:
            if content:
                spans.append((at, at + len(piece)))
            at += len(piece)
            text.append(piece)
        return "".join(text), spans


def examples(page: str, spans: list[tuple[int, int]] | None) -> list[tuple[str, frozenset[str], bool]]:
    """("word" or "tag", features, content?) of each event; without spans, what is inside a marked article is content."""
    events = read(page)
    has, open_, cores, goods, depth, out = marked(events), Counter(), 0, 0, {}, []
    starts = np.array([s for s, _ in spans or []], dtype=np.int64)
    stops = np.array([e for _, e in spans or []], dtype=np.int64)
    for kind, x, at in events:
        if spans is None:
            content = cores > 0
        else:
            i = int(np.searchsorted(starts, at, side="right")) - 1
            content = i >= 0 and at < stops[i]
        if kind == TEXT and x.strip():
            out.append(("word", frozenset([f for f, n in open_.items() if n] + (["out"] if has and not cores else [])), content))
        elif kind == OPEN:
            depth[x] = worth(x, cores + goods > 0)
            goods += good(x)
            open_.update(depth[x])
            cores += x.core == 1 or x.core == 3
            out.append(("tag", frozenset(depth[x]), content))
        elif kind == CLOSE:
            open_.subtract(depth[x])
            cores -= x.core == 1 or x.core == 3
            goods -= good(x)
            out.append(("tag", frozenset(depth[x]), content))
    return out


def fit(rows: Counter, steps: int = STEPS, ridge: float = RIDGE) -> dict[str, int]:
    """Logistic regression over counted (features, content?) rows: weights in log-odds, '' is the intercept."""
    if not rows:
        return {"": 0}
    keys = sorted(rows, key=lambda k: (sorted(k[0]), k[1]))
    names = sorted({f for k, _ in keys for f in k})
    at = {f: i + 1 for i, f in enumerate(names)}
    x = np.zeros((len(keys), len(names) + 1))
    x[:, 0] = 1
    for i, (k, _) in enumerate(keys):
        x[i, [at[f] for f in k]] = 1
    y = np.array([float(c) for _, c in keys])
    n = np.sqrt(np.array([rows[k] for k in keys], dtype=float))  # frequent patterns count more, but not by their number
    n /= n.sum()
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(n @ (np.logaddexp(0, z) - y * z) + ridge * w @ w / 2)

    now = loss(w)
    for _ in range(steps):  # Newton's method, halving steps that don't help
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (n * (p - y)) + ridge * w)
        while (then := loss(w - step)) > now and abs(step).max() > 1e-6:
            step = step / 2
        w, gain, now = w - step, now - then, then
        if gain < 1e-9:
            break
    return {"": round(w[0] * UNIT)} | {f: round(w[i] * UNIT) for f, i in at.items()}


def learn(pages: list[str], made: int = MADE, seed: int = 12) -> Weights:
    """Weights from pages that mark their article and from made ones."""
    word, tag = Counter(), Counter()
    for page in pages:
        for kind, features, content in examples(page, None):
            (word if kind == "word" else tag)[features, content] += 1
    for i in range(made):
        for kind, features, content in examples(*Maker(seed * 1_000_003 + i).page()):
            (word if kind == "word" else tag)[features, content] += 1
    return Weights(fit(word), fit(tag))


def labelled_pages(pages: DataFrame, html_col: str = "html", n: int = LABELLED, chars: int = LABELLED_CHARS) -> list[str]:
    """At most n pages that mark an article, of at most so many characters, each once: the same ones whatever the partitioning."""
    text = F.col(html_col)
    found = pages.where(F.lower(text).contains("<article") & (F.length(text) <= chars)).select(F.lit(1).alias("marked"), text.alias("html"))
    return [r["html"] for r in bounded_sample(found, "marked", "html", n).orderBy(F.xxhash64("html"), "html").limit(n).collect()]


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: Weights | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each page: one pass without a shuffle after the weights are learnt.

    Null and empty pages, and those without content, have an empty text.  Ids and urls may be null or repeated, a row each; an empty table gives no
    rows.  Pages of any length are read whole, in linear time; a task holds one page at least.  Other columns are not read.
    """
    w = weights if weights is not None else learn(labelled_pages(pages, html_col))
    narrow = small_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, 2):
            found = [main_text(t, w) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
