"""Main text of pages by wrapper induction.

Pages of a host are grouped by layout: the same container elements and classes around the article,
digits aside. One page of each layout of a host (the first by a hash of its id and url)
stands for it; the tree of every other page of it is aligned with that page's tree by simple tree
matching (see ``alignment``). What the alignments of all its pages say of each element of that
tree makes the layout's wrapper:

- elements that most pages have are the frame, whatever their text;
- elements whose text is the same on most pages that have them are constant;
- from the root down, the frame element that holds most of the varying text outside of links is
  followed as long as it holds nearly all of it, is a container, and isn't an article or main
  element: where that ends is the content. Everything else of the frame is the template;
- elements of the content that are mostly links on most pages are link lists.

A page's main text is the text of its element that aligns with the content, without constant
elements and link lists. If the page has article elements there, all those of the story count.
Elements of some tags (nav, aside, footer, form, script) are never main text. Names (classes, ids)
drop elements as comments, adverts and the like only where structure doesn't say what they are:
not the content, nor a part that has a quarter of its text. Layouts with fewer than LEAST_PAGES
different pages have no wrapper: there the article element (or else main) is the content, or
else all blocks that aren't mostly links.

Pages with the reference page's own article teach nothing about its template, and pages with one
article teach once: copies of an article, however many, don't make a template of it.

Edge cases: a null or empty html has an empty text; a null url or one without a host is a page
without a template; a null page_id is an id like any other; repeated rows are extracted each; a
layout's pages meet its one small tree in parts, whose number grows with the table, so that a hot
host is dealt over many tasks; very long pages cost time in proportion to the square of their
longest child list of different structure, and memory in proportion to their length; of equally
good matchings one is fixed (see ``alignment``); an empty table gives an empty result; other
columns aren't carried.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import Matching, Twig, below
from .dom import BLOCKS, Node, blocks, keep, keep_large, main_part, measure, parse

#: Least articles whose pages match an element, and the least share of them with its text, for a constant.
LEAST_PAGES = 3
CONSTANT_SHARE = 0.6
#: Share of a layout's pages that have an element of the frame.
FRAME_SHARE = 0.6
#: Share of an element's varying text that one of its children has to hold to be followed.
HELD_SHARE = 0.7
#: Share of an element's text in links that makes it a link list.
LINK_SHARE = 0.5
#: Parts into which the pages of one host are dealt when they meet its tree: so many at least, and one for PART_PAGES pages of the table.
SALTS = 32
PART_PAGES = 500_000
#: Of each matched element: its number, whether its text is equal, characters of its text and of that in links.
_FACTS = 4


def _kids(node: Node) -> list[Node]:
    return [k for k in node.kids if isinstance(k, Node) and k.tag not in ("script", "style", "br", "head")]


def _twigs(root: Node) -> Twig:
    """The page's elements as a tree to be matched."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        kids = _kids(node)
        order.append((node, kids))
        stack += kids
    made: dict[int, Twig] = {}
    for node, kids in reversed(order):
        made[id(node)] = Twig(node.label, node.key, [made[id(k)] for k in kids], node)
    return made[id(root)]


def _flat(tree: Twig) -> list[tuple[str, int, int]]:
    """Label, text key and number of children of each element, a parent before its children."""
    return [(x.label, x.key, len(x.kids)) for x in below(tree)]


def _nested(flat: list) -> Twig:
    """The tree of ``_flat``; each element stands for its place in it."""
    made: list[Twig] = []  # of what comes after, the first last
    for place in range(len(flat) - 1, -1, -1):
        label, key, n = flat[place]
        kids = [made.pop() for _ in range(n)]
        made.append(Twig(label, key, kids, place))
    return made[0]


def article_blocks(root: Node, skip: frozenset[int] = frozenset(), content: Node | None = None) -> list[str]:
    """The blocks of the page's main text. ``skip``: ids of elements left out; ``content``: the wrapper's element, if it has one."""
    parts = main_part(root, skip)
    if content is not None:
        inside = {id(content)} | {id(x) for x in _under(content)}
        if not any(id(p) in inside for p in parts):
            length = lambda nodes: sum(len(t) for p in nodes for t, _ in blocks(p, skip, inside_article=True))
            around = any(id(content) in {id(x) for x in _under(p)} for p in parts)
            parts = [content] if around or not parts or length([content]) >= length(parts) else parts
    for part in parts:
        keep_large(part)
    if parts:
        return [t for part in parts if id(part) not in skip for t, _ in blocks(part, skip, inside_article=True)]
    return [t for t, linked in blocks(root, skip) if 2 * linked <= len(t)]


def _under(node: Node) -> list[Node]:
    out, stack = [], [k for k in node.kids if isinstance(k, Node)]
    while stack:
        out.append(stack.pop())
        stack += [k for k in out[-1].kids if isinstance(k, Node)]
    return out


@lru_cache(maxsize=256)
def _reference(text: str) -> tuple[Twig, int]:
    """The reference tree, whose elements stand for their numbers, and the key of its article."""
    flat, article = json.loads(text)
    return _nested(flat), article


def _article_key(root: Node) -> int:
    return zlib.crc32("\n".join(article_blocks(root)).encode())


def _prepared(page: str | None) -> Node:
    root = parse(page or "")
    keep(root)
    measure(root)
    return root


def host_of(url: str) -> F.Column:
    found = F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def layout_of(html: str) -> F.Column:
    """A hash of a page's different container tags, with their classes, outside what lies in article elements."""
    around = F.regexp_replace(F.lower(html), r"(?s)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<article\b.*</article\s*>", " ")
    tags = F.regexp_extract_all(around, F.lit(r"<((?:div|section|main|nav|header|footer|aside|form)\b(?:[^>]*?\sclass\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+))?)"), 1)
    kinds = F.transform(tags, lambda t: F.concat_ws(" ", F.regexp_extract(t, r"^\w+", 0), F.regexp_replace(F.regexp_extract(t, r"\sclass\s*=\s*[\"']?([^\"'>]*)", 1), r"[0-9]+", "")))
    return F.xxhash64(F.array_sort(F.array_distinct(kinds)))


def reference_trees(pages: DataFrame) -> DataFrame:
    """``(site, tree)``: the tree of one page of each site, as JSON; ``pages(rank, html, site)``."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[str, tuple[int, int]] = {}
            for i, (site, rank) in enumerate(zip(batch.column("site").to_pylist(), batch.column("rank").to_pylist())):
                if site:
                    first[site] = min(first.get(site, (rank, i)), (rank, i))
            rows = []
            for site, (rank, i) in first.items():
                root = _prepared(batch.column("html")[i].as_py())
                rows.append((site, rank, json.dumps([_flat(_twigs(root)), _article_key(root)], separators=(",", ":"))))
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()))], ["site", "rank", "tree"])

    picked = pages.mapInArrow(pick, "site string, rank long, tree string")
    return picked.groupBy("site").agg(F.min(F.struct("rank", "tree")).alias("m")).select("site", "m.tree")


def _matches(pages: DataFrame) -> DataFrame:
    """``(site, node, matched, same, chars, links)``: for elements of reference trees, how many articles' pages match them, and sums over these."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, int], bytes] = {}
            for site, tree, page in zip(*(batch.column(c) for c in ("site", "tree", "html"))):
                if not tree.is_valid:
                    continue
                reference, article = _reference(tree.as_py())
                root = _prepared(page.as_py())
                own = _article_key(root)
                if own == article or (site.as_py(), own) in found:
                    continue
                facts = [(x.stands_for, x.key == y.key, y.stands_for.chars, y.stands_for.linked) for x, y in Matching(reference, _twigs(root)).aligned()]
                found[site.as_py(), own] = np.array(sorted(facts), dtype=np.int32).tobytes()
            columns = list(zip(*((*k, v) for k, v in found.items()))) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()))], ["site", "article", "nodes"])

    names = ["site", "node", "matched", "same", "chars", "links"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, dict[int, list[int]]] = defaultdict(dict)
            for site, nodes in zip(batch.column("site").to_pylist(), batch.column("nodes").to_pylist()):
                own = found[site]
                for n, same, chars, links in np.frombuffer(nodes, dtype=np.int32).reshape(-1, _FACTS).tolist():
                    held = own.setdefault(n, [0, 0, 0, 0])
                    held[0] += 1
                    held[1] += same
                    held[2] += chars
                    held[3] += links
            columns = list(zip(*((site, n, *held) for site, own in found.items() for n, held in own.items()))) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int32(), *[pa.int64()] * 4])], names)

    # One page of each article: copies of it would count its own text as the layout's.
    one = pages.mapInArrow(align, "site string, article long, nodes binary").groupBy("site", "article").agg(F.min("nodes").alias("nodes"))
    counted = one.mapInArrow(count, "site string, node int, matched long, same long, chars long, links long")
    return counted.groupBy("site", "node").agg(*[F.sum(c).alias(c) for c in names[2:]])


def learned(tree: Twig, facts: dict[int, tuple[int, int, int, int]]) -> tuple[set[int], set[int], int] | None:
    """Numbers of constant elements and link lists, of template elements, and of the content; of a tree's ``facts`` by number.

    The reference page counts as one that matches all its elements. Nothing, if there are too few pages.
    """
    order = below(tree)
    pages = facts.get(0, (0, 0, 0, 0))[0] + 1
    if pages < LEAST_PAGES:
        return None
    matched = {x.stands_for: facts.get(x.stands_for, (0, 0, 0, 0))[0] + 1 for x in order}
    frame = {n for n, m in matched.items() if m >= LEAST_PAGES and m >= FRAME_SHARE * pages}
    constant = {n for n, (_, same, *_) in facts.items() if same + 1 >= max(LEAST_PAGES, CONSTANT_SHARE * matched[n])}
    mass: dict[int, int] = {}
    for x in reversed(order):
        n = x.stands_for
        _, _, chars, links = facts.get(n, (0, 0, 0, 0))
        inner = [(facts.get(k.stands_for, (0, 0, 0, 0)), mass[k.stands_for]) for k in x.kids]
        mass[n] = 0 if n in constant else max(0, chars - links - sum([f[2] - f[3] for f, _ in inner])) + sum([m for _, m in inner])
    at, template = tree, set()
    while at.label.split(".")[0] not in ("article", "main"):
        kids = [k for k in at.kids if k.stands_for in frame]
        best = max(kids, key=lambda k: mass[k.stands_for], default=None)
        if best is None or not mass[best.stands_for] or mass[best.stands_for] < HELD_SHARE * mass[at.stands_for]:
            break
        if best.label.split(".")[0] not in ("article", "main") and not any(k.stands_for in frame and k.label.split(".")[0] in BLOCKS for k in best.kids):
            break
        template.add(at.stands_for)
        template |= {y.stands_for for k in kids if k is not best for y in below(k)} & frame
        at = best
    links = {n for n, (_, _, chars, linked) in facts.items() if matched[n] >= LEAST_PAGES and linked > LINK_SHARE * chars}
    ours = {x.stands_for for x in below(at)} - {at.stands_for}
    return (constant | (links & ours)), template | constant, at.stands_for


def wrappers(trees: DataFrame, matches: DataFrame) -> DataFrame:
    """``(site, tree, skipped, template, content)``: what was learned of each layout; a tree's facts are as many as its elements."""
    facts = matches.groupBy("site").agg(F.collect_list(F.struct("node", "matched", "same", "chars", "links")).alias("facts"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, facts in zip(batch.column("tree").to_pylist(), batch.column("facts").to_pylist()):
                known = learned(_reference(text)[0], {f["node"]: (f["matched"], f["same"], f["chars"], f["links"]) for f in facts or []})
                rows.append((sorted(known[0]), sorted(known[1]), known[2]) if known else (None, None, None))
            columns = list(zip(*rows)) or [[]] * 3
            made = [pa.array(c, t) for c, t in zip(columns, (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("site"), batch.column("tree"), *made], ["site", "tree", "skipped", "template", "content"])

    return trees.join(facts, "site", "left").mapInArrow(learn, "site string, tree string, skipped array<int>, template array<int>, content int")


def extract_articles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, host, text, n_template)`` of each page; ``n_template``: its elements that are its layout's template."""
    slim = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"),
        host_of(url_col).alias("host"), F.xxhash64(F.col(id_col), F.col(url_col)).alias("rank"),
    )
    slim = slim.withColumn("site", F.when(F.col("host") != "", F.concat_ws(" ", "host", layout_of("html").cast("string"))).otherwise(""))
    slim = slim.withColumn("salt", F.pmod("rank", F.lit(max(SALTS, pages.count() // PART_PAGES))).cast("int"))
    trees = reference_trees(slim)
    parts = slim.select("site", "salt").distinct()  # a layout's tree is copied for the parts that it has pages in, no others
    columns = ["id", "url", "html", "host", "site", "tree"]
    matches = _matches(slim.join(parts.join(trees, "site"), ["site", "salt"], "left").select(*columns))
    known = wrappers(trees, matches)
    joined = slim.join(parts.join(known, "site"), ["site", "salt"], "left").select(*columns, "skipped", "template", "content")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = [], []
            for tree, page, skipped, template, content in zip(*(batch.column(c) for c in ("tree", "html", "skipped", "template", "content"))):
                root = _prepared(page.as_py())
                skip: frozenset[int] = frozenset()
                chosen, n = None, 0
                if content.is_valid:
                    out, known = set(skipped.as_py()), set(template.as_py())
                    left_out = []
                    for x, y in Matching(_reference(tree.as_py())[0], _twigs(root)).aligned():
                        if x.stands_for in out and (x.key == y.key or y.stands_for.linked > LINK_SHARE * y.stands_for.chars):
                            left_out.append(id(y.stands_for))
                        n += x.stands_for in known
                        chosen = y.stands_for if x.stands_for == content.as_py() else chosen
                    skip = frozenset(left_out)
                texts.append("\n".join(article_blocks(root, skip, chosen)))
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), batch.column("host"), pa.array(texts, pa.string()), pa.array(sizes, pa.int32())], ["id", "url", "host", "text", "n_template"])

    return joined.mapInArrow(extract, "id long, url string, host string, text string, n_template int")
