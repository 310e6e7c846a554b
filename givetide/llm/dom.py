"""A small tolerant HTML tree: elements and blocks of text, and the features of both."""

from __future__ import annotations

import html
import math
import re

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SPLIT = re.compile(r"[^a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
OPAQUE = frozenset("script style noscript template title textarea select iframe svg math object audio video canvas head".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
SCOPES = frozenset("ul ol dl table".split())

#: Kinds of elements, and words in their class, id, role and label that tell what they are for.
TAGS = [
    "html body", "main article", "nav menu", "header", "footer", "aside", "form fieldset button input label", "section", "div", "p", "h1 h2 h3 h4 h5 h6",
    "ul ol dl", "li dt dd", "table thead tbody tr td th caption", "pre blockquote figure figcaption",
]
WORDS = [
    "nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager tabs toc",
    "header masthead topbar banner logo branding head",
    "footer copyright colophon bottom legal foot contentinfo",
    "sidebar aside widget rail related recommended recommendations more trending popular complementary side",
    "cookie cookies consent notice alert popup modal gdpr privacy overlay warning toast message announcement disclaimer",
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion dfp adsense",
    "comment comments reply replies respond disqus discussion reader feedback thread",
    "form subscribe subscription newsletter signup login search register contact",
    "share sharing social follow tweet facebook meta byline author tags tag",
    "content article post entry main body story text page hentry blog",
    "hidden none sr only skip print",
]
_TAG_KIND = {tag: i for i, tags in enumerate(TAGS) for tag in tags.split()}
_WORD_KIND = {word: i for i, words in enumerate(WORDS) for word in words.split()}
FEATURES = 16 + 2 * len(TAGS) + 2 * len(WORDS)


class Node:
    """An element, or a block of text as a leaf. ``truth`` is the label of training pages."""

    __slots__ = ("tag", "parent", "depth", "kinds", "text", "linked", "elements", "blocks", "children", "truth")

    def __init__(self, tag: str, parent: int, depth: int, kinds: frozenset[int]):
        self.tag, self.parent, self.depth, self.kinds = tag, parent, depth, kinds
        self.text, self.linked, self.elements, self.blocks, self.children, self.truth = "", 0, 0, 0, [], None


def _kinds(tag: str, attributes: str) -> tuple[frozenset[int], str | None]:
    """Kinds of attribute words, and the marker that training pages carry."""
    if not attributes.strip():
        return frozenset(), None
    found, marker = set(), None
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role", "aria-label", "itemprop", "name", "data-role", "data-type", "data-component"):
            found.update(_WORD_KIND[w] for w in _SPLIT.split(value.lower()) if w in _WORD_KIND)
        elif name == "hidden" or name == "style" and "none" in value:
            found.add(_WORD_KIND["hidden"])
        elif name == "data-truth":
            marker = value.strip("\"'")
    return frozenset(found), marker


def parse(page: str) -> list[Node]:
    """Nodes of a page in page order, the root first, each text block after the element it stands in.

    Blocks end wherever an element that is not inline begins or ends. White space in a block becomes one space.
    """
    nodes = [Node("#page", -1, 0, frozenset())]
    stack, buffer, links, linked = [0], [], 0, 0
    at, skip = 0, None

    def flush() -> None:
        nonlocal buffer, linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                parent = stack[-1]
                leaf = Node("#text", parent, nodes[parent].depth + 1, frozenset())
                leaf.text, leaf.linked, leaf.truth = text, min(linked, len(text)), nodes[parent].truth
                nodes[parent].children.append(len(nodes))
                nodes.append(leaf)
            buffer, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            buffer.append(text)
            if links:
                linked += len(text)

    def close(names: frozenset[str], within: frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[i]].tag
            if tag in names:
                del stack[i:]
                return
            if tag in within:
                return

    for m in _TOKEN.finditer(page):
        start = m.start()
        if start < at:
            continue
        if skip is not None:
            if not (m[1] and m[2].lower() == skip):
                continue
            skip, at = None, m.end()
            continue
        add(page[at:start])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                if tag == "a":
                    links = 0
                continue
            flush()
            close(frozenset([tag]), frozenset())
            continue
        if tag in INLINE:
            if tag == "br":
                buffer.append(" ")
            elif tag == "a":
                links = 1
            continue
        flush()
        links = 0
        if tag in OPAQUE:
            if not m[3].endswith("/") and (end := page.lower().find(f"</{tag}", at) if tag == "head" else at) >= 0:
                skip = tag
                if tag == "head":
                    at = end
                    skip = "head"
                elif (raw := re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(page, at)) is not None:
                    at = raw.start()
                else:
                    at = len(page)
            continue
        if tag in CLOSES:
            close(CLOSES[tag], SCOPES if tag in ("li", "dt", "dd") else frozenset(["table"]))
        close(frozenset(["p"]), frozenset(["table", "td", "th", "button"]))
        kinds, marker = _kinds(tag, m[3])
        parent = stack[-1]
        node = Node(tag, parent, nodes[parent].depth + 1, kinds)
        node.truth = marker or nodes[parent].truth
        nodes[parent].children.append(len(nodes))
        nodes.append(node)
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(len(nodes) - 1)
    if skip is None:
        add(page[at:])
    flush()
    return nodes


def features(nodes: list[Node]) -> list[list[float]]:
    """Size, density, depth and sibling statistics, kinds of the element and of its ancestors, for each node."""
    n = len(nodes)
    length, linked, blocks, elements, stops = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        if node.tag == "#text":
            t = node.text
            length[i], linked[i], blocks[i] = len(t), node.linked, 1
            stops[i] = t.count(". ") + t.count(", ") + (t[-1] in ".!?")
        else:
            elements[i] += 1
        if node.parent >= 0:
            p = node.parent
            length[p] += length[i]
            linked[p] += linked[i]
            blocks[p] += blocks[i]
            elements[p] += elements[i]
            stops[p] += stops[i]
    above: list[tuple[frozenset[int], frozenset[int]]] = [(frozenset(), frozenset())] * n
    places = [(0, 1)] * n
    out = []
    log = math.log1p
    total = length[0] or 1
    for i, node in enumerate(nodes):
        p = node.parent
        if p >= 0:
            kind = _TAG_KIND.get(nodes[p].tag)
            tags, words = above[p]
            above[i] = (tags | {kind} if kind is not None else tags, words | nodes[p].kinds)
        for k, c in enumerate(node.children):
            places[c] = (k, len(node.children))
        k, many = places[i]
        siblings = nodes[p].children if p >= 0 else [i]
        before = length[siblings[k - 1]] if k else 0
        after = length[siblings[k + 1]] if k + 1 < many else 0
        size = length[i]
        row = [
            node.depth, log(size), log(elements[i]), size / (1 + elements[i]), linked[i] / size if size else 0.0, len(node.children), k, many, log(before), log(after),
            size / total, stops[i] / (1 + size) * 100, size / (blocks[i] or 1), log(blocks[i]), k / many, size / (length[p] or 1) if p >= 0 else 1.0,
        ]
        own = [0.0] * (2 * len(TAGS) + 2 * len(WORDS))
        kind = _TAG_KIND.get(node.tag)
        if kind is not None:
            own[kind] = 1.0
        for j in node.kinds:
            own[len(TAGS) + j] = 1.0
        tags, words = above[i]
        for j in tags:
            own[len(TAGS) + len(WORDS) + j] = 1.0
        for j in words:
            own[2 * len(TAGS) + len(WORDS) + j] = 1.0
        out.append(row + own)
    return out
