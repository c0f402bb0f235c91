"""Main text of web pages by a tree-structured graphical model.

The block elements of a page form a tree. Every block is content or not; its own features (tag, words of its class and
id, amount of text, share of links) give it a potential, and a potential for each parent and child says how they go
together. Sum-product messages, up the tree and down again, give each block's exact marginal of being content. The
weights are learnt by gradient ascent on the likelihood of labelled pages, whose gradient needs just these marginals.

The labelled pages are written by ``labelled_pages``: articles inside many kinds of page frames, where each piece of
text is known to be part of the article or not. Their number is a parameter, so the model's cost is fixed.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triplane.llm.common import handed, parts

#: Element names as HTML defines them.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol option optgroup p pre search section select summary table tbody td "
    "textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What these hold is no text of the page.
SKIPPED = frozenset("script style template iframe noframes noembed title head".split())
CLOSES_P = BLOCKS - frozenset("body html button caption col colgroup legend noscript option optgroup select tbody td textarea tfoot th thead tr".split())
HOLDS_P = ("table", "td", "th", "button")
#: An opening tag ends an open element of these names, up to the nearest element that holds such things.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
TAGS = (
    {"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6", "hgroup"}, {"li", "dt", "dd"}, {"ul", "ol", "dl", "menu", "dir"}, {"blockquote", "pre", "figure", "figcaption"},
    {"article"}, {"main"}, {"section"}, {"div", "center"}, {"nav"}, {"header"}, {"footer"}, {"aside"},
    {"form", "fieldset", "select", "option", "optgroup", "textarea", "button", "legend", "search"}, {"table", "tbody", "thead", "tfoot", "tr"}, {"td", "th", "caption"},
    {"dialog", "details", "summary"}, {"body", "html"}, {"address"},
)
WORDS = (
    "article|post|entry|story|content|body|text|main|prose|richtext",
    "nav|navbar|navigation|menu|breadcrumb|breadcrumbs|toc|pagination|pager|tabs|skip",
    "header|masthead|top|topbar|logo|branding|banner",
    "footer|foot|bottom|copyright|colophon|legal|imprint|impressum",
    "sidebar|aside|widget|rail|related|recommended|recommendations|popular|trending|teaser|more|promo|promoted|newsletter|subscribe|signup",
    "ad|ads|advert|advertisement|advertorial|adsense|sponsor|sponsored|sponsors|sponsoring|dfp|doubleclick|werbung|anzeige",
    "cookie|cookies|consent|notice|notices|gdpr|alert|popup|modal|overlay|paywall|banner|warning|privacy|toast|disclaimer",
    "comment|comments|reply|replies|respond|discussion|disqus|reader|readers|responses|thread|kommentare|reactions|feedback",
    "share|sharing|social|follow|facebook|twitter|login|search|form|contact|tags|rating|vote|meta|byline|author",
)
_TOKEN = re.compile(r"""<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""")
_END = {t: re.compile(f"</{t}", re.I | re.A) for t in (*SKIPPED, "xmp")}
_HEAD_END, _HEAD_SKIPS = re.compile("</head|<body", re.I | re.A), re.compile("<script|<style", re.I | re.A)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORD = re.compile(r"[a-z]+")
_KINDS = [frozenset(w.split("|")) for w in WORDS]
_TAG = {t: i for i, tags in enumerate(TAGS) for t in tags}
_MAIN = {_TAG["article"], _TAG["main"]}
_COMMENT, _NOTICE = (next(i for i, k in enumerate(_KINDS) if w in k) for w in ("comment", "notice"))
#: Pages with blocks nested deeper than this are solved block by block, not level by level.
DEEP = 400
N_FEATURES = 1 + len(TAGS) + len(WORDS) + 10


@dataclass
class Page:
    """Blocks in page order of opening: parent, tag, kinds of names, depth, and the block after the last one inside; and
    the text runs in page order."""

    parent: list[int] = field(default_factory=list)
    tag: list[int] = field(default_factory=list)
    kinds: list[tuple[int, ...]] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    runs: list[tuple[int, str, int]] = field(default_factory=list)  # block, text, characters inside links


def _kinds_of(names: str) -> tuple[int, ...]:
    return _known_kinds(names) if len(names) < 500 else _known_kinds.__wrapped__(names)


@lru_cache(maxsize=4096)
def _known_kinds(names: str) -> tuple[int, ...]:
    words = set(_WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", names).lower()))
    return tuple(i for i, k in enumerate(_KINDS) if words & k)


def parse(source: str | None) -> Page:
    """A lenient parse: unclosed and stray tags, comments, raw elements and unfinished pages give a tree all the same.

    One pass: the places of open elements are kept by name, and a mark that the rest of the page does not hold is not
    looked for again.
    """
    page = Page([-1], [_TAG["body"]], [()], [0], [0])
    names, blocks = ["html"], [0]  # open block elements
    places: dict[str, list[int]] = {}  # of each name among them
    missing: set[str] = set()  # marks that the rest of the page does not hold
    links = 0
    piece: list[str] = []
    linked = 0
    text = source or ""
    head_seen = False

    def flush() -> None:
        nonlocal linked
        if piece:
            run = " ".join(html.unescape("".join(piece)).split())
            if run:
                page.runs.append((blocks[-1], run, min(linked, len(run))))
            piece.clear()
        linked = 0

    def innermost(some) -> int:
        return max((places[t][-1] for t in some if places.get(t)), default=-1)

    def pop_to(k: int) -> None:
        nonlocal links
        flush()
        for name, b in zip(names[k:], blocks[k:]):
            places[name].pop()
            page.end[b] = len(page.parent)
        del names[k:], blocks[k:]
        links = 0

    def find(mark: str, at: int) -> int:
        place = -1 if mark in missing else text.find(mark, at)
        if place < 0:
            missing.add(mark)
        return place

    def find_end(tag: str, at: int) -> int:
        m = None if tag in missing else _END[tag].search(text, at)
        if m is None:
            missing.add(tag)
            return -1
        return m.start()

    at = 0
    while True:
        m = _TOKEN.search(text, at)
        data = text[at : m.start()] if m else text[at:]
        if data:
            piece.append(data)
            if links:
                linked += len(data.strip())
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            mark = m[0]
            if mark == "<!--":
                end = find("-->", at)
                at = end + 3 if end >= 0 else len(text)
                continue
            if mark == "<![CDATA[" and (end := find("]]>", at)) >= 0:
                piece.append(html.escape(text[at:end], quote=False))
                at = end + 3
            elif (end := find(">", at)) >= 0:
                at = end + 1
            else:
                piece.append(mark)
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS:
                if places.get(tag):
                    pop_to(places[tag][-1])
                else:
                    flush()
            elif tag == "br":
                piece.append(" ")
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br":
                piece.append(" ")
            continue
        attrs = m[3]
        if tag in SKIPPED and not attrs.endswith("/"):
            if tag == "head":  # ends at its end tag or where the body begins; there is but one
                if head_seen:
                    continue
                head_seen = True
                ends = _HEAD_END.search(text, at)
                if not ends:
                    continue
                end, script = ends.start(), -1
                for skip in _HEAD_SKIPS.finditer(text, at, end):
                    script = skip.start()
                if script < 0 or text.find("</", script, end) >= 0:
                    at = end
                continue
            end = find_end(tag, at)
            if end < 0:
                if tag in ("script", "style", "title"):
                    at = len(text)
                continue
            at = end
            piece.append(" " if tag in ("script", "style") else "")
            continue
        if tag == "xmp":  # text as it stands, without markup
            flush()
            if (end := find_end(tag, at)) >= 0:
                piece.append(html.escape(text[at:end], quote=False))
                flush()
                at = end
            continue
        if tag in BLOCKS:
            flush()
            if tag in ("html", "body"):
                continue
            if tag in CLOSES_P and places.get("p"):
                k = places["p"][-1]
                if k > innermost(HOLDS_P):
                    pop_to(k)
            if tag in ENDS:
                ends, stops = ENDS[tag]
                stop = innermost(stops)
                while (k := innermost(ends)) > stop:
                    pop_to(k)
                    if len(ends) < 2:
                        break
            if tag in VOID:
                continue
            found = _NAMES.findall(attrs) if attrs else ()
            kinds = _kinds_of(" ".join(a or b or c for a, b, c in found)) if found else ()
            if tag == "noscript" and _NOTICE not in kinds:
                kinds = (*kinds, _NOTICE)
            if attrs and _HIDDEN.search(attrs):
                kinds = (*kinds, -1)
            page.parent.append(blocks[-1])
            page.depth.append(page.depth[blocks[-1]] + 1)
            page.tag.append(_TAG.get(tag, -1))
            page.kinds.append(kinds)
            page.end.append(0)
            places.setdefault(tag, []).append(len(names))
            names.append(tag)
            blocks.append(len(page.parent) - 1)
            links = 0
        elif tag == "a":
            links += 1
    flush()
    for b in blocks:
        page.end[b] = len(page.parent)
    return page


def _features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, parents and depths of the blocks of all pages, numbered through; roots have parent -1."""
    base = np.cumsum([0, *(len(p.parent) for p in pages)])
    n = int(base[-1])
    parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + b) for p, b in zip(pages, base)])
    depth = np.concatenate([p.depth for p in pages])
    own, linked, stops, runs = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    x = np.zeros((n, N_FEATURES))
    x[:, 0] = 1
    for p, b in zip(pages, base.tolist()):
        for i, (tag, kinds) in enumerate(zip(p.tag, p.kinds)):
            if tag >= 0:
                x[b + i, 1 + tag] = 1
            for k in kinds:
                x[b + i, (1 + len(TAGS) + k) if k >= 0 else N_FEATURES - 1] = 1
        for i, text, link in p.runs:
            own[b + i] += len(text)
            linked[b + i] += link
            stops[b + i] += text.count(".") + text.count(",")
            runs[b + i] += 1
    ends = np.concatenate([np.array(p.end) + b for p, b in zip(pages, base)])
    sums = (np.concatenate([[0], np.cumsum(a)]) for a in (own, linked, runs))
    whole, whole_linked, items = (total[ends] - total[:-1] for total in sums)  # a block and all inside it stand together
    f = 1 + len(TAGS) + len(WORDS)
    x[:, f] = np.log1p(own) / 6
    x[:, f + 1] = np.log1p(whole) / 8
    x[:, f + 2] = whole_linked / np.maximum(whole, 1)
    x[:, f + 3] = np.minimum(stops / np.maximum(own, 1) * 20, 2)
    x[:, f + 4] = own == 0
    x[:, f + 5] = whole == 0
    x[:, f + 6] = np.minimum(depth, 12) / 12
    x[:, f + 7] = np.log1p(whole / np.maximum(items, 1)) / 6
    x[:, f + 8] = np.concatenate([_outside(p) for p in pages])
    return x, parent, depth


def _outside(page: Page) -> np.ndarray:
    """Blocks apart from the page's articles and main parts, where it has any; a reader's comment is no article."""
    main = [t in _MAIN and _COMMENT not in k for t, k in zip(page.tag, page.kinds)]
    if not any(main):
        return np.zeros(len(main))
    within, around = main.copy(), main.copy()
    for i in range(1, len(main)):
        within[i] = within[i] or within[page.parent[i]]
    for i in range(len(main) - 1, 0, -1):
        around[page.parent[i]] = around[page.parent[i]] or around[i]
    return ~(np.array(within) | np.array(around))


def _between(parent_x: np.ndarray, child_x: np.ndarray) -> np.ndarray:
    """Kind of each parent-child edge: the child names a role of its own, or heads a section, or neither."""
    tags = slice(1 + 10, 1 + 15)
    roles = slice(1 + len(TAGS), 1 + len(TAGS) + len(WORDS))
    return np.where(child_x[:, tags].any(1) | child_x[:, roles].any(1), 0, np.where(child_x[:, [7, 8, 9, 10, 18]].any(1), 1, 2))


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


@dataclass
class Model:
    weights: np.ndarray  # features: log potential of being content
    edges: np.ndarray  # kinds x 2 x 2: log potentials of (parent, child)

    def marginals(self, x: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum-product on forests: each block's marginal of being content, each edge's joint marginal, edge kinds."""
        n = len(x)
        local = np.stack([np.zeros(n), x @ self.weights], 1)
        kids = np.flatnonzero(parent >= 0)
        kind = np.zeros(n, np.int64)
        kind[kids] = _between(x[parent[kids]], x[kids])
        psi = self.edges[kind]
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 1)))
        up, inward = np.zeros((n, 2)), local.copy()
        for at in levels[:0:-1]:
            up[at] = np.logaddexp(psi[at][:, :, 0] + inward[at][:, None, 0], psi[at][:, :, 1] + inward[at][:, None, 1])
            first = np.flatnonzero(np.diff(parent[at], prepend=-2))  # blocks of a level stand by parent
            inward[parent[at][first]] += np.add.reduceat(up[at], first)
        down, joint = np.zeros((n, 2)), np.zeros((n, 2, 2))
        belief = inward.copy()
        for at in levels[1:]:
            rest = belief[parent[at]] - up[at]  # what the parent hears from all but this child
            down[at] = np.logaddexp(psi[at][:, 0, :] + rest[:, :1], psi[at][:, 1, :] + rest[:, 1:])
            belief[at] = inward[at] + down[at]
            table = psi[at] + rest[:, :, None] + inward[at][:, None, :]
            table = np.exp(table - table.max((1, 2), keepdims=True))
            joint[at] = table / table.sum((1, 2), keepdims=True)
        p = 1 / (1 + np.exp(belief[:, 0] - belief[:, 1]))
        return p, joint, kind

    def marginals_of_one(self, x: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """The same marginals of being content for one tree, block by block, however deep it is."""
        local, above = (x @ self.weights).tolist(), parent.tolist()
        psi = self.edges[np.concatenate([[0], _between(x[parent[1:]], x[1:])])].tolist()
        n = len(local)
        in0, in1, up0, up1 = [0.0] * n, local[:], [0.0] * n, [0.0] * n
        for i in range(n - 1, 0, -1):  # what is inside a block stands behind it
            (a, b), (c, d) = psi[i]
            up0[i], up1[i] = _log_sum(a + in0[i], b + in1[i]), _log_sum(c + in0[i], d + in1[i])
            in0[above[i]] += up0[i]
            in1[above[i]] += up1[i]
        for i in range(1, n):  # from here, in0 and in1 hold beliefs
            (a, b), (c, d) = psi[i]
            rest0, rest1 = in0[above[i]] - up0[i], in1[above[i]] - up1[i]
            in0[i] += _log_sum(a + rest0, c + rest1)
            in1[i] += _log_sum(b + rest0, d + rest1)
        return 1 / (1 + np.exp(np.array(in0) - np.array(in1)))


def fit(pages: list[Page], labels: list[list[bool]], rounds: int = 200, rate: float = 0.2, ridge: float = 1e-4) -> Model:
    """Maximum likelihood with a small ridge, by Adam steps."""
    x, parent, depth = _features(pages)
    y = np.concatenate(labels).astype(float)
    kids = np.flatnonzero(parent >= 0)
    model = Model(np.zeros(N_FEATURES), np.zeros((3, 2, 2)))
    seen = np.zeros((3, 2, 2))
    kind = _between(x[parent[kids]], x[kids])
    np.add.at(seen, (kind, y[parent[kids]].astype(int), y[kids].astype(int)), 1)
    moments = [np.zeros_like(model.weights), np.zeros_like(model.weights), np.zeros_like(seen), np.zeros_like(seen)]
    for t in range(1, rounds + 1):
        p, joint, _ = model.marginals(x, parent, depth)
        told = np.stack([joint[kids][kind == k].sum(0) for k in range(3)])
        for k, (value, grad) in enumerate(((model.weights, x.T @ (y - p) / len(y) - ridge * model.weights), (model.edges, (seen - told) / len(y) - ridge * model.edges))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            value += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return model


def labelled_pages(n: int, seed: int = 0) -> tuple[list[Page], list[list[bool]]]:
    """``n`` written pages and for each of their blocks whether most of its text belongs to the article."""
    rng = random.Random(seed)
    pick, some = rng.choice, lambda a, b: range(rng.randint(a, b))
    MARK = "⁂"  # begins every word of the article
    word = lambda: "".join(pick("abcdeilmnorstu") for _ in range(rng.randint(1, 9)))

    def words(a: int, b: int, mark: str = "") -> str:
        return " ".join(mark + word() + pick(("", "", "", ",", "", ".")) for _ in some(a, b)) + "."

    def link(mark: str = "") -> str:
        return f'<a href="/{word()}">{words(1, 4, mark)}</a>'

    def links(a: int, b: int) -> str:
        kind = pick(("ul", "ol", "div", "p"))
        inner = "".join(f"<li>{link()}</li>" for _ in some(a, b)) if kind in ("ul", "ol") else " ".join(link() for _ in some(a, b))
        return f"<{kind}>{inner}</{kind}>"

    def paras(a: int, b: int) -> str:
        return "".join(f"<p>{words(1, 60)}</p>" if rng.random() < 0.7 else f"<div>{words(1, 60)}</div>" for _ in some(a, b))

    def named(tags: tuple[str, ...], names: str, inner: str) -> str:
        tag = pick(tags)
        if tag not in ("div", "section", "p", "ul") and rng.random() < 0.5:
            return f"<{tag}>{inner}</{tag}>"
        name = pick(names.split("|")) + pick(("", "", "-wrap", "-box", " " + word()))
        return f'<{tag} {pick(("class", "id", "class"))}="{name}">{inner}</{tag}>'

    def form() -> str:
        return f"<form><label>{words(1, 4)}</label><input name=q><select><option>{word()}<option>{word()}</select><textarea>{words(0, 3)}</textarea><button>{word()}</button>{pick(('', '<p>' + words(2, 14) + '</p>'))}</form>"

    def noise() -> str:
        k = rng.randrange(9)
        if k == 0:
            return named(("nav", "div", "ul"), WORDS[1], links(2, 9))
        if k == 1:
            return named(("header", "div"), WORDS[2], pick((links(1, 6), paras(1, 1), f"<h1>{words(1, 3)}</h1>{links(2, 5)}", f"<h1>{words(1, 4)}</h1>")))
        if k == 2:
            return named(("footer", "div"), WORDS[3], pick((links(1, 6), "&copy; " + words(3, 14), paras(1, 2))))
        if k == 3:
            return named(("aside", "aside", "div", "section"), WORDS[4], f"<h3>{words(1, 4)}</h3>" + pick((links(2, 8), paras(1, 3))))
        if k == 4:
            return named(("div", "aside", "section"), WORDS[5], pick((words(3, 40), paras(1, 2), link())))
        if k == 5:
            return named(("div", "dialog", "section", "p"), WORDS[6], pick((words(4, 40), paras(1, 1) + "<button>ok</button>")))
        if k == 6:
            return comments()
        if k == 7:
            return named(("div", "section"), WORDS[8], pick((links(1, 5), form())))
        return form()

    def comments() -> str:
        each = "".join(pick((f'<div class="comment"><p>{words(2, 50)}</p></div>', f"<li><b>{word()}</b> {words(2, 40)}</li>", f"<article class=comment>{paras(1, 2)}</article>")) for _ in some(1, 5))
        return named(("div", "section", "section"), WORDS[7], f"<h2>{words(1, 3)}</h2>{each}{pick(('', form()))}")

    def piece() -> str:
        k = rng.random()
        body = words(1, 8 if rng.random() < 0.3 else 80, MARK)
        if k < 0.62:
            inner = body if rng.random() < 0.6 else f"<b>{body}<br>" if rng.random() < 0.4 else body + " " + link(MARK) + " " + words(1, 20, MARK)
            return f"<p>{inner}" + pick(("</p>", "</p>", "</p>", ""))
        if k < 0.72:
            return f"<h{pick('2334')}>{words(1, 7, MARK)}</h{pick('2334')}>"
        if k < 0.80:
            tag = pick(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{words(1, 14, MARK)}" for _ in some(2, 5)) + f"</{tag}>"
        if k < 0.85:
            return f"<blockquote>{pick((body, '<p>' + body + '</p>'))}</blockquote>"
        if k < 0.90:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{words(1, 5, MARK)}</td>" for _ in some(2, 3)) + "</tr>" for _ in some(1, 4)) + "</table>"
        if k < 0.94:
            return f"<pre>{body}</pre>"
        if k < 0.97:
            return f"<figure><img src=x><figcaption>{words(2, 14, MARK)}</figcaption></figure>"
        return f"<div>{body}</div>"

    def article() -> str:
        title = f"<h1>{words(1, 10, MARK)}</h1>"
        inner = pick((title, title, title, title, "", f"<header>{title}</header>"))
        for _ in some(1, 12):
            inner += piece()
            if rng.random() < 0.06:
                inner += noise()
        if rng.random() < 0.12:
            inner += comments()
        k = rng.random()
        if k < 0.5:
            return f"<article{pick(('', f' class={chr(34)}{word()}{chr(34)}', ' class=post'))}>{inner}</article>"
        if k < 0.62:
            return f"<main>{inner}</main>"
        name = pick(WORDS[0].split("|"))
        return f'<{pick(("div", "div", "section"))} {pick(("class", "id"))}="{name}{pick(("", "-" + word()))}">{inner}</div></section>'

    pages, labels = [], []
    for _ in range(n):
        before, after = "".join(noise() for _ in some(0, 4)), "".join(noise() for _ in some(0, 4))
        middle = article()
        k = rng.random()
        if k < 0.25:
            middle = f"<main>{middle}{pick(('', noise()))}</main>"
        elif k < 0.5:
            middle = f'<div class="{pick(("wrapper", "container", "page", "row", word()))}">{pick(("", noise()))}{middle}{pick(("", noise()))}</div>'
        page = parse(f"<html><head><title>{words(2, 6)}</title></head><body>{before}{middle}{after}</body></html>")
        marked, total = np.zeros(len(page.parent)), np.zeros(len(page.parent))
        for b, text, _ in page.runs:
            marked[b] += sum(len(w) - 1 for w in text.split() if w[0] == MARK)
            total[b] += sum(len(w.lstrip(MARK)) for w in text.split())
        for b in range(len(page.parent) - 1, 0, -1):
            marked[page.parent[b]] += marked[b]
            total[page.parent[b]] += total[b]
        page.runs = [(b, text.replace(MARK, ""), k) for b, text, k in page.runs]
        label = (marked * 2 > total).tolist()
        for b in range(1, len(label)):
            if not total[b]:
                label[b] = label[page.parent[b]]
        pages.append(page)
        labels.append(label)
    return pages, labels


@lru_cache(maxsize=4)
def trained(n_pages: int = 500, seed: int = 0) -> Model:
    return fit(*labelled_pages(n_pages, seed))


def main_texts(sources: list[str | None], model: Model) -> list[str]:
    """Main text of each page: its content blocks in page order, joined by an empty line."""
    pages = [parse(s) for s in sources]
    content: list[np.ndarray] = [np.empty(0)] * len(pages)
    flat = [i for i, p in enumerate(pages) if max(p.depth) <= DEEP]
    if flat:
        found = model.marginals(*_features([pages[i] for i in flat]))[0]
        for i, p in zip(flat, np.split(found, np.cumsum([len(pages[i].parent) for i in flat])[:-1])):
            content[i] = p
    for i in set(range(len(pages))) - set(flat):
        x, parent, _ = _features([pages[i]])
        content[i] = model.marginals_of_one(x, parent)
    return ["\n\n".join(text for b, text, _ in page.runs if p[b] >= 0.5) for page, p in zip(pages, content)]


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """``page_id, text`` for every row, and the columns of ``keep`` as they are.

    Null and empty pages, and those without main text: an empty text. White space, that of character references too,
    becomes one space within a block. Whole pages, however long, nested or unfinished, in time linear in their length;
    ties do not arise. Null or repeated page_id: every row stays. Empty table: no rows. Other columns are not read. A
    kept column called ``page_id`` or ``text`` comes out as ``page_id_kept`` or ``text_kept``, in any case of letters.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())
    taken, at, kept = handed(pages, id_col, html_col, keep, ("page_id", "text"))
    schema = T.StructType([taken.schema[0], T.StructField("text", T.StringType()), *kept])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, at, 256):
                texts = pa.array(main_texts(part.column(at).to_pylist(), shared.value), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), texts, *part.columns[1 : 1 + len(kept)]], names=names)

    return taken.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, keep=("url",)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
