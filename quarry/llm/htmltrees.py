"""HTML to a tree of block elements with features, and gradient-boosted trees over them."""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import numpy as np

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_BLANK = re.compile(r"\s+")

#: HTML's void elements, and elements whose content is not markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "html head body address article aside blockquote button canvas caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr label legend li main menu nav noscript ol optgroup option p pre search section select summary svg table tbody td "
    "template textarea tfoot th thead title tr ul video audio script style iframe object".split()
)
#: Elements that an open one of the key closes, up to the elements given.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Groups of tags, each one feature.
TAG_GROUPS = [
    {"p"},
    {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"},
    {"li", "dt", "dd"},
    {"ul", "ol", "dl", "menu"},
    {"div", "center"},
    {"section"},
    {"article"},
    {"main"},
    {"nav"},
    {"header"},
    {"footer", "address"},
    {"aside"},
    {"form", "fieldset", "label", "legend", "button", "select", "option", "optgroup", "textarea", "search"},
    {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"},
    {"pre", "blockquote"},
    {"figure", "figcaption"},
    {"html", "body"},
    {"head", "title", "script", "style", "noscript", "template", "iframe", "svg", "object", "canvas", "video", "audio"},
    {"dialog", "details", "summary"},
]
#: Words in class, id and role attributes, by what they tell of; each group is a feature.
TOKEN_GROUPS = [
    "article content contents post entry story main body text prose page markdown copy",
    "title headline heading",
    "nav navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs links",
    "header masthead banner topbar logo branding",
    "footer foot copyright legal contentinfo colophon bottom",
    "sidebar aside side widget complementary related recommended recommendation more trending popular",
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion dfp banner-ad outbrain taboola",
    "comment comments disqus reply replies respond responses discussion commentlist",
    "cookie cookies consent gdpr notice notification alert popup modal overlay dialog toast announcement warning",
    "newsletter subscribe subscription signup login register form search contact",
    "share sharing social follow tweet facebook tools toolbar buttons",
    "byline author meta date timestamp tags tag category categories credit",
    "hidden invisible sr skip screenreader offscreen none",
]
_GROUP_OF: dict[str, list[int]] = {}
for _i, _words in enumerate(TOKEN_GROUPS):
    for _w in _words.split():
        _GROUP_OF.setdefault(_w, []).append(_i)
_TAG_GROUP = {t: i for i, g in enumerate(TAG_GROUPS) for t in g}
N_TAGS, N_TOKENS = len(TAG_GROUPS), len(TOKEN_GROUPS)
#: Groups of tags and of tokens whose presence above a node is a feature of the node.
_ABOVE_TAGS = [6, 7, 8, 9, 10, 11, 12, 13, 18]
_ABOVE_TOKENS = [0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12]


@dataclass
class Page:
    """Block elements in page order; parts: (node, text or None for an end of block)."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    attrs: list[str] = field(default_factory=list)
    tags_inside: list[int] = field(default_factory=list)
    link_chars: list[int] = field(default_factory=list)
    own_chars: list[int] = field(default_factory=list)
    parts: list[tuple[int, str | None]] = field(default_factory=list)


def parse(source: str) -> Page:
    """The tree of block elements of an HTML text, however broken."""
    page = Page()
    stack: list[tuple[str, int]] = []  # (tag, node of the nearest block element)
    open_at: dict[str, list[int]] = {}  # places of a tag in the stack, so that no end tag has to search it
    blocks_at: list[int] = []
    links = 0

    def add(tag: str, attrs: str) -> int:
        page.parent.append(stack[-1][1] if stack else -1)
        page.tag.append(tag)
        page.attrs.append(attrs)
        page.tags_inside.append(0)
        page.link_chars.append(0)
        page.own_chars.append(0)
        return len(page.tag) - 1

    stack.append(("", add("html", "")))

    def say(text: str) -> None:
        node = stack[-1][1]
        page.parts.append((node, text))
        n = len(text) if not text.isspace() else 0
        page.own_chars[node] += n
        if links and n:
            page.link_chars[node] += n

    def push(tag: str, node: int) -> None:
        nonlocal links
        links += tag == "a"
        open_at.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            blocks_at.append(len(stack))
        stack.append((tag, node))

    def pop(to: int, ends: bool = True) -> None:
        nonlocal links
        while len(stack) > to:
            tag, node = stack.pop()
            open_at[tag].pop()
            links -= tag == "a"
            if tag in BLOCK:
                blocks_at.pop()
                if ends:
                    ended.append(node)
        page.parts.extend((node, None) for node in reversed(ended))
        ended.clear()

    def nearest(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    def close(names: set[str], stops, whole: bool) -> None:
        """Pop up to the nearest of names, unless a stop (or, for inline, a block) comes first."""
        at = nearest(names)
        wall = nearest(stops)
        if not whole and blocks_at:
            wall = max(wall, blocks_at[-1])
        if at and at >= wall:
            pop(at)

    ended: list[int] = []
    at = 0
    for m in iter(lambda: _TAG.search(source, at), None):
        if m.start() > at:
            say(source[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            close({name}, (), name in BLOCK)
            continue
        node = stack[-1][1]
        page.tags_inside[node] += 1
        if name == "br" or name == "wbr":
            if name == "br":
                page.parts.append((node, "\n"))
            continue
        block = name in BLOCK
        if block:
            if name not in ("button", "label", "option", "script", "style", "noscript", "iframe", "svg", "object", "template", "select", "textarea", "canvas", "video", "audio"):
                close({"p"}, {"table", "button", "td", "th", "caption", "li"} if name == "p" or name not in ("li",) else {"ul", "ol"}, True)
            if name in CLOSES:
                close(*CLOSES[name], True)
            elif name == "body":
                close({"head"}, (), True)
            page.parts.append((stack[-1][1], None))
        if name in VOID:
            continue
        push(name, add(name, m[3]) if block else stack[-1][1])
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
            at = end.end() if end else len(source)
            pop(len(stack) - 1, False)
        elif m[3].endswith("/") and name in ("svg",):
            pop(len(stack) - 1, False)
    if at < len(source):
        say(source[at:])
    return page


def attribute_groups(attrs: str) -> list[int]:
    """Groups of the words in class, id and role; inline hiding counts as the last group."""
    found: set[int] = set()
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role", "itemprop", "aria-label"):
                for w in _TOKEN.findall(value):
                    found.update(_GROUP_OF.get(w.lower(), ()))
            elif name in ("hidden", "aria-hidden") or (name == "style" and "none" in value):
                if name != "aria-hidden" or value == "true":
                    found.add(N_TOKENS - 1)
    return sorted(found)


def features(page: Page) -> np.ndarray:
    """A row of features per block element: tag and attribute groups, those above it, depth,
    density of text, links and tags in the subtree, and standing among its siblings."""
    n = len(page.tag)
    parent = page.parent
    text, link, tags, below, paragraphs = list(page.own_chars), list(page.link_chars), list(page.tags_inside), [1] * n, [0] * n
    depth, siblings, same, place = [0] * n, [0] * n, [0] * n, [0] * n
    kinds: dict[tuple[int, str], int] = {}
    for i in range(n):
        p = parent[i]
        if p >= 0:
            depth[i] = depth[p] + 1
            place[i] = siblings[p]
            siblings[p] += 1
            key = (p, page.tag[i])
            kinds[key] = kinds.get(key, 0) + 1
    for i in range(n - 1, 0, -1):
        p = parent[i]
        text[p] += text[i]
        link[p] += link[i]
        tags[p] += tags[i]
        below[p] += below[i]
        paragraphs[p] += paragraphs[i] + (page.tag[i] == "p" and page.own_chars[i] > 0)
    total = max(1, text[0])
    # elements that neither hold nor stand in an article or main element, where the page has one
    core = [t in ("article", "main") for t in page.tag]
    near = list(core)
    for i in range(n - 1, 0, -1):
        near[parent[i]] |= near[i]
    inside = list(core)
    for i in range(1, n):
        inside[i] |= inside[parent[i]]
    has_core = any(core)
    tag_rows = np.zeros((n, N_TAGS), np.float32)
    token_rows = np.zeros((n, N_TOKENS), np.float32)
    above_tags, above_tokens = np.zeros((n, N_TAGS), np.float32), np.zeros((n, N_TOKENS), np.float32)
    rest = np.zeros((n, 13), np.float32)
    for i in range(n):
        p = parent[i]
        g = _TAG_GROUP.get(page.tag[i])
        if g is not None:
            tag_rows[i, g] = 1
        for k in attribute_groups(page.attrs[i]):
            token_rows[i, k] = 1
        if p >= 0:
            above_tags[i] = np.maximum(above_tags[p], tag_rows[p])
            above_tokens[i] = np.maximum(above_tokens[p], token_rows[p])
        t = text[i]
        rest[i] = (
            depth[i],
            math.log1p(page.own_chars[i]),
            math.log1p(t),
            link[i] / (t + 1),
            tags[i] / (t + 10) * 100,
            t / below[i],
            math.log1p(paragraphs[i]),
            t / total,
            t / (text[p] + 1) if p >= 0 else 1,
            place[i] / max(1, siblings[p]) if p >= 0 else 0,
            math.log1p(kinds.get((p, page.tag[i]), 1)),
            t / (siblings[i] + 1),
            has_core and not near[i] and not inside[i],
        )
    return np.hstack([tag_rows, token_rows, above_tags[:, _ABOVE_TAGS], above_tokens[:, _ABOVE_TOKENS], rest])


@dataclass
class Boosted:
    """Gradient-boosted trees of one depth over binned features, for log-odds of a yes."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1).astype(np.uint8)

    def predict(self, x: np.ndarray) -> np.ndarray:
        b, out, depth = self.bins(x), np.full(len(x), self.base), int(math.log2(self.leaf.shape[1]))
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (b[rows, f[at]] > c[at])
            out += leaf[at - (len(leaf) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.25, most_bins: int = 32, ridge: float = 4.0) -> Boosted:
    """Fit by second-order boosting of the logistic loss, splits from histograms."""
    edges = []
    for column in x.T:
        values = np.unique(column)
        edges.append(np.unique(np.quantile(values, np.linspace(0, 1, most_bins)[1:-1])) if len(values) > most_bins else (values[1:] + values[:-1]) / 2)
    model = Boosted(edges, np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), 255), np.zeros((trees, 2**depth)), 0.0)
    b = model.bins(x).astype(np.int64)
    rate_yes = np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4)
    model.base = float(np.log(rate_yes / (1 - rate_yes)))
    score, width = np.full(len(x), model.base), most_bins + 1
    for k in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = weight * (y - p), np.maximum(weight * p * (1 - p), 1e-9)
        at = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            local = at - first
            best, gains = np.zeros((nodes, 2), np.int64), np.zeros(nodes)
            best[:, 1] = 255
            for j in range(x.shape[1]):
                g = np.bincount(local * width + b[:, j], grad, nodes * width).reshape(nodes, width)
                h = np.bincount(local * width + b[:, j], hess, nodes * width).reshape(nodes, width)
                gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                gt, ht = g.sum(1)[:, None], h.sum(1)[:, None]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                c = gain.argmax(1)
                top = gain[np.arange(nodes), c]
                better = top > gains + 1e-9
                gains[better] = top[better]
                best[better, 0], best[better, 1] = j, c[better]
            model.feature[k, first : first + nodes], model.cut[k, first : first + nodes] = best[:, 0], best[:, 1]
            at = 2 * at + 1 + (b[np.arange(len(x)), best[local, 0]] > best[local, 1])
        leaf = at - (2**depth - 1)
        g, h = np.bincount(leaf, grad, 2**depth), np.bincount(leaf, hess, 2**depth)
        model.leaf[k] = rate * g / (h + ridge)
        score += model.leaf[k][leaf]
    return model


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """Which block elements are kept: the best choice in which nothing is kept under an element that
    is dropped. An element counts by its own text, and a little by itself."""
    n = len(page.tag)
    worth = odds * (np.log1p(np.array(page.own_chars)) + 0.25)
    drop, keep = [0.0] * n, worth.tolist()
    for i in range(n - 1, -1, -1):
        drop[i] -= float(worth[i])
        if i:
            drop[page.parent[i]] += drop[i]
            keep[page.parent[i]] += max(drop[i], keep[i])
    kept = [False] * n
    for i in range(n):
        kept[i] = keep[i] > drop[i] and (not i or kept[page.parent[i]])
    return kept


def kept_text(page: Page, kept: list[bool]) -> str:
    """The texts of the kept elements: a block between ends of blocks, blocks joined by blank lines."""
    blocks, run = [], []

    def end() -> None:
        if run:
            text = _BLANK.sub(" ", html.unescape("".join(run))).strip()
            if text:
                blocks.append(text)
            run.clear()

    for node, text in page.parts:
        if text is None:
            end()
        elif kept[node]:
            run.append(text)
    end()
    return "\n\n".join(blocks)
