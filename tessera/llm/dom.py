"""A forgiving HTML tree, its main part and its text blocks. Plain helpers for one page."""

from __future__ import annotations

import html
import re
import sys
import zlib

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
#: Elements that are never part of the main text.
DROPPED = frozenset("head nav footer aside form script style noscript template iframe textarea title button select option input svg canvas object audio video dialog menu noembed noframes xmp annotation annotation-xml map".split())
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption optgroup option".split())
_CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "option", "optgroup"}
#: A start tag of the key ends an open element of these, up to the nearest of the borders.
_CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Words in class, id or role that name a part which isn't main text; all words of a name have to be of these.
NOISE = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations widget widgets pagination pager login complementary contentinfo".split())
#: Of these, the names of what readers write.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?", re.S)
_NAMED = re.compile(r"\b(class|id|role|itemprop)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("chars", "hidden", "holds", "key", "kids", "label", "linked", "names", "role", "tag", "unwanted")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag = tag
        self.kids: list[Node | str] = []
        self.names: frozenset[str] = frozenset()
        self.role = ""
        self.label = tag
        self.key = 0  # these three: see measure()
        self.chars = self.linked = 0
        self.hidden = False
        self.unwanted = False  # by its names
        self.holds = False  # what the page is about: see keep()
        if attrs and ("=" in attrs or "hidden" in attrs):
            words = []
            for name, a, b, c in _NAMED.findall(attrs):
                value = a or b or c
                for whole in value.split():
                    own = [w.lower() for w in _PARTS.split(whole) if w]
                    words += own
                    self.unwanted = self.unwanted or (bool(own) and NOISE.issuperset(own))
                if name.lower() == "class":
                    self.label = f"{tag}.{' '.join(value.split())}"
                elif name.lower() in ("role", "itemprop"):
                    self.role += f" {value.lower()}"
            self.names = frozenset(words)
            bare = re.sub(r"\"[^\"]*\"|'[^']*'", "", attrs).lower()
            self.hidden = bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", bare)) or bool(re.search(r"display\s*:\s*none", attrs, re.I))

    def noise(self) -> bool:
        """Whether the element itself says that it isn't main text."""
        if self.holds and self.tag not in DROPPED - {"form"}:
            return False
        return self.tag in DROPPED or self.hidden or (self.tag not in ("html", "body", "article", "main") and self.unwanted) or (self.tag == "article" and "comment" in self.names)


def parse(page: str) -> Node:
    """The tree of ``page``; missing and stray end tags are taken as browsers do, roughly."""
    root = Node("html")
    stack, at, deepest = [root], 0, 1
    while at < len(page):
        found = _TOKEN.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text:
            stack[-1].kids.append(html.unescape(text) if "&" in text else text)
        if not found:
            break
        at = max(found.end(), at + 1)
        tag = found[2]
        if tag is None:
            if found[0].startswith("<![CDATA["):
                stack[-1].kids.append(found[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if found[1]:
            if tag == "p" and not any(n.tag == "p" for n in stack):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("table", "article", "main", "body") and tag not in BLOCKS:
                    break
            continue
        if tag == "html":
            continue
        if tag in _CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCKS:
                    break
        if tag in _CLOSED_BY:
            closed, borders = _CLOSED_BY[tag]
            lowest = None
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in borders:
                    break
                if stack[i].tag in closed:
                    lowest = i
            if lowest:
                del stack[lowest:]
        if tag == "body":
            stack[1:] = [n for n in stack[1:] if n.tag not in ("head",)]
        node = Node(tag, found[3])
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not found[3].endswith("/"):
            stack.append(node)
            deepest = max(deepest, len(stack))
    # Walks call themselves for each level; such calls take no room on the C stack.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 6 * deepest + 1000))
    return root


def spaced(text: str) -> str:
    return " ".join(text.split())


def blocks(root: Node, skip: frozenset[int] = frozenset(), inside_article: bool = False) -> list[tuple[str, int]]:
    """Text blocks in page order, each with how many of its characters are in links. ``skip``: ids of nodes left out."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    linked = [0]

    def flush() -> None:
        text = spaced("".join(held))
        if text:
            out.append((text, linked[0]))
        held.clear()
        linked[0] = 0

    def walk(node: Node, in_link: bool, in_article: bool) -> None:
        in_article = in_article or node.tag in ("article", "main")
        for kid in node.kids:
            if isinstance(kid, str):
                held.append(kid)
                linked[0] += len(kid) if in_link else 0
            elif kid.tag == "br":
                held.append(" ")
            elif id(kid) in skip or kid.noise() or (not in_article and (kid.tag == "header" or "header" in kid.names)):
                if kid.tag in BLOCKS:
                    flush()
                else:
                    held.append(" " if kid.tag in ("button", "input", "select", "iframe", "svg") else "")
            else:
                block = kid.tag in BLOCKS
                if block:
                    flush()
                walk(kid, in_link or kid.tag == "a", in_article)
                if block:
                    flush()

    walk(root, False, inside_article)
    flush()
    return out


def _elements(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [k for k in reversed(node.kids) if isinstance(k, Node)]
    return out


def _shown(node: Node, without: frozenset[str] = frozenset()) -> dict[int, int]:
    """For every element, by id, the characters in it outside of elements that are dropped by their tag (but for forms), or by a name of ``without``."""
    sizes: dict[int, int] = {}
    for n in reversed(_elements(node)):
        dropped = (n.tag in DROPPED and n.tag != "form") or (n.unwanted and bool(n.names & without))
        sizes[id(n)] = 0 if dropped else sum(len(k.strip()) if isinstance(k, str) else sizes[id(k)] for k in n.kids)
    return sizes


def keep(root: Node) -> None:
    """Mark the elements that no name, form or hiding drops: those around the largest article (or else main), or else around most text."""
    nodes = _elements(root)
    if not any(n.hidden or n.unwanted or n.tag == "form" for n in nodes):
        return
    above = {id(k): n for n in nodes for k in n.kids if isinstance(k, Node)}
    for tag in ("article", "main"):
        says = [n for n in nodes if (n.tag == tag or {"article": "articlebody", "main": "main"}[tag] in n.role.split()) and "comment" not in n.names]
        if says:
            sizes = _shown(root) if len(says) > 1 else {}
            inner = max(says, key=lambda n: sizes.get(id(n), 0))
            while (inner := above.get(id(inner))) is not None:
                inner.holds = True
            return
    sizes = _shown(root)
    for n in nodes:
        n.holds = 2 * sizes[id(n)] > sizes[id(root)]


def keep_large(part: Node) -> None:
    """Mark those elements of the main part that have a quarter of its text and aren't named as comments: no name drops them."""
    nodes = _elements(part)
    if any(n.unwanted for n in nodes):
        sizes = _shown(part, without=COMMENTS)
        for n in nodes:
            n.holds = n.holds or (n.unwanted and not n.names & COMMENTS and 4 * sizes[id(n)] > sizes[id(part)])


def main_part(root: Node, skip: frozenset[int] = frozenset()) -> list[Node]:
    """The elements that hold the main text, in page order: the outermost articles of one parent that have the most text.

    Where the main element around them has more text beside them, it is that element. Empty, if no element says so.
    ``skip``: ids of nodes whose text doesn't count.
    """
    length = lambda n: sum(len(t) for t, _ in blocks(n, skip, inside_article=True))
    for says in (
        lambda n: n.tag == "article" or "articlebody" in n.role,
        lambda n: n.tag == "main" or "main" in n.role.split(),
    ):
        found: dict[int, list[Node]] = {}
        around: dict[int, Node | None] = {}
        stack: list[tuple[Node, Node, Node | None]] = [(root, root, None)]
        while stack:
            node, parent, main = stack.pop()
            if node is not root and node.noise():
                continue
            if says(node):
                found.setdefault(id(parent), []).append(node)
                around[id(parent)] = main
                continue
            if node.tag == "main" or "main" in node.role.split():
                main = node
            stack += [(k, node, main) for k in reversed(node.kids) if isinstance(k, Node)]
        if found:
            sizes = {p: sum(map(length, nodes)) for p, nodes in found.items()} if len(found) > 1 or any(around.values()) else {}
            best = max(found, key=lambda p: sizes.get(p, 0))
            main = around[best]
            if main is not None and length(main) > 2 * sum(sizes[p] for p in found if around[p] is main):
                return [main]
            return found[best]
    return []


def measure(node: Node) -> None:
    """Set, on every element: a checksum of its whole text, white space aside, and the characters of its text and of that in links.

    Text of elements that are never main text has a checksum, but no characters.
    """
    for n in reversed(_elements(node)):
        key, chars, linked = 1, 0, 0
        for kid in n.kids:
            if isinstance(kid, str):
                plain = " ".join(kid.split())
                if plain:
                    key = zlib.crc32(zlib.crc32(plain.encode()).to_bytes(4, "big"), key)
                    chars += len(plain)
            else:
                key = zlib.crc32(kid.key.to_bytes(4, "big"), key) if kid.key != 1 else key
                chars += kid.chars
                linked += kid.linked
        n.key = key
        n.chars, n.linked = (0, 0) if n.tag in DROPPED else (chars, chars if n.tag == "a" else linked)
