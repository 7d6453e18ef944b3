"""Operator 3, HTML extraction by a site style tree.

Each page is parsed into a tree. The trees of one host are merged: nodes with
the same path of tags, classes and roles are one style node. For each style node
the tables hold how many different pages have it, and for each of its contents
(its text and the list of its children) how many of them have that. All nodes of
a page count; pages of a host with the same main text are one page.

The importance of a content on d of P pages is its information, log(P / d), as a
share of the greatest possible, log P. Nodes whose content is of low importance
(the same notice on all pages of a host) go, other nodes of their path stay. The
branches that HTML itself or its class names call menus, headers, footers,
sidebars, notices, adverts, forms or comments go as well. This holds inside the
page's article too. No node of a host with too few pages to judge is removed for
low importance alone.

The statistics are grouped counts with map-side sums over distinct rows. The
contents to remove are each on at least P to the power 0.7 of a host's P pages,
so they are few; their keys go to the tasks up to a checked number, beyond it to
the pages by a join on the host.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pieces_of, small_batches, written

#: Pages a host needs before its statistics count, and the importance below which a node goes.
PAGES, IMPORTANCE = 8, 0.3
#: Removed contents (host and key) that are sent to all tasks at most.
SENT = 200_000
#: Elements nested deeper stand beside each other; browsers do the same.
DEPTH = 400
# Fixed values of HTML.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style noscript template svg math iframe object canvas audio video textarea select title".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub "
    "sup time tt u var wbr".split()
)
_CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre search section table ul".split()
)
_NOISE_TAGS = set("nav footer aside form header menu dialog button head".split()) | _RAW
_NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_NOISE_WORDS = set(
    "ad ads advert adverts advertisement adsense advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent notice gdpr popup modal newsletter subscribe "
    "subscription signup login share sharing social comment comments respond disqus related recommended widget pagination pager "
    "copyright toolbar notices notification alert replies teaser".split()
)
#: Class names that make an article element something else than the page's article.
_NO_ARTICLE = set("ad ads advert advertisement sponsored promo comment comments reply replies related recommended teaser".split())
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = set("ul ol dl table body html article section div main".split())
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"([^\s=\"'>/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")
_BASE = 0x9E3779B97F4A7C15


class Node:
    __slots__ = ("tag", "path", "noise", "main", "children", "parent", "depth", "key")

    def __init__(self, tag: str, path: str, parent: Node | None, noise: int, main: bool):
        self.tag, self.path, self.parent, self.noise, self.main = tag, path, parent, noise, main
        self.children: list = []
        self.key = 0
        self.depth: int = parent.depth + 1 if parent is not None else 0


def _is_noise(tag: str, attrs: dict[str, str], inside_main: bool) -> int:
    """2 for noise by element or role, 1 for noise by class or id alone, 0 for content."""
    if tag in _NOISE_TAGS:
        # An article's own header holds its headline.
        return 0 if tag == "header" and inside_main else 2
    if attrs.get("role", "").lower() in _NOISE_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return 2
    if "display:none" in attrs.get("style", "").replace(" ", ""):
        return 2
    if tag in ("body", "html", "main") or tag in _INLINE - {"span", "a"}:
        return 0
    names = _CAMEL.sub(" ", f"{attrs.get('class', '')} {attrs.get('id', '')}").lower()
    return int(not (_NO_ARTICLE if tag == "article" else _NOISE_WORDS).isdisjoint(_WORD.findall(names)))


def _tags(source: str) -> Iterator[tuple[str, str, str, int]]:
    """(text before, name or /name or nothing, attributes, end) of each tag; then the text after the last.

    The caller may send a place to go on from. A tag cut off by the end of the
    page is no text. Takes linear time: once a quote is found open to the end,
    tags end at the next >.
    """
    at = seek = 0
    quotes = True
    while (start := source.find("<", seek)) >= 0:
        name = _NAME.match(source, start)
        if name:
            rest = _REST.match(source, name.end()) if quotes else None
            quotes = quotes and rest is not None
            end = rest.end() if rest else source.find(">", name.end()) + 1
            tag, attrs = name[1] + name[2].lower(), source[name.end() : end - 1]
        elif source.startswith("<!--", start):
            end, tag, attrs = source.find("-->", start + 4) + 3, "", ""
            end = 0 if end == 2 else end
        elif source[start + 1 : start + 2] in ("!", "?", "/"):
            end, tag, attrs = source.find(">", start) + 1, "", ""
        else:
            seek = start + 1
            continue
        if not end:
            yield source[at:start], "", "", len(source)
            return
        at = seek = (yield source[at:start], tag, attrs, end) or end
    yield source[at:], "", "", len(source)


def parse(source: str) -> Node:
    """The page's tree; unclosed and misplaced tags close as browsers close them in the main."""
    root = node = Node("#root", "", None, 0, False)
    tags, go = _tags(source), None
    while True:
        try:
            text, tag, rest, at = tags.send(go)
        except StopIteration:
            break
        go = None
        if text:
            node.children.append(text)
        if not tag:
            continue
        if tag[0] == "/":
            tag, up = tag[1:], node
            while up is not None and up.tag != tag:
                if tag in _INLINE and up.tag not in _INLINE:
                    up = None  # an inline end tag closes no block
                    break
                up = up.parent
            if up is not None and up.parent is not None:
                node = up.parent
            continue
        if tag == "body":
            while node.parent is not None and node.tag != "html":
                node = node.parent
        elif tag in _CLOSES_P:
            up = node
            while up.tag in _INLINE:
                up = up.parent
            if up.tag == "p":
                node = up.parent
            elif tag not in _INLINE and node.tag in _INLINE:
                node = up  # a block inside unclosed inline tags stands beside them
        elif tag in _SELF_CLOSING:
            up = node
            while up is not None and up.tag not in _SCOPE and up.tag not in _SELF_CLOSING[tag]:
                up = up.parent
            if up is not None and up.tag in _SELF_CLOSING[tag]:
                node = up.parent
        attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(rest)} if rest.strip() else {}
        look = ".".join(sorted(_WORD.findall(f"{attrs.get('class', '')} {attrs.get('role', '')}".lower())))
        child = Node(tag, f"{node.path}/{tag}.{look}", node, _is_noise(tag, attrs, node.main), node.main or tag in ("article", "main"))
        node.children.append(child)
        if tag in ("article", "main") and not child.noise:
            up = node  # what holds the article is a wrapper, whatever its class says ("no-sidebar")
            while up is not None:
                up.noise = 0 if up.noise == 1 else up.noise
                up = up.parent
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s>/]", re.I).search(source, at)
            go = len(source) if not end else source.find(">", end.start()) + 1 or len(source)
        elif tag not in _VOID and not rest.endswith("/") and child.depth < DEPTH:
            node = child
    return root


def _fold(node: Node) -> tuple[int, int]:
    """The runs of text below as a polynomial hash and their number; sets ``key`` of each block on the way, once."""
    total, n = 0, 0
    for c in node.children:
        if isinstance(c, str):
            text = " ".join(html.unescape(c).split())
            if not text:
                continue
            h, k = xxhash.xxh64_intdigest(text.encode("utf-8", "replace")), 1
        else:
            h, k = _fold(c)
        total, n = (total * pow(_BASE, k, 1 << 64) + h) % (1 << 64), n + k
    if node.tag not in _INLINE:
        look = " ".join([c.tag for c in node.children if isinstance(c, Node) and not c.noise and c.tag not in _INLINE])
        node.key = _hash(f"{node.path}\0{look}\0{n}\0{total}")
    return total, n


def style_nodes(root: Node) -> Iterator[tuple[str, int]]:
    """(path, key) of the block nodes outside noise; a key is a hash of path, presentation and content."""
    _fold(root)
    stack = [root]
    while stack:
        node = stack.pop()
        if node.parent is not None and node.tag not in ("html", "body"):
            yield node.path, node.key
        stack += [c for c in node.children if isinstance(c, Node) and not c.noise and c.tag not in _INLINE]


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))
    return h - 2**64 if h >= 2**63 else h


def main_text(root: Node, removed: frozenset[int] = frozenset()) -> str:
    """The blocks of the remaining branches in page order, joined by two line ends. ``removed``: keys of contents to leave out.

    A page with an article or main element is read from its outermost ones alone.
    """
    if removed:
        _fold(root)
    blocks: list[str] = []
    piece: list[str] = []

    def close() -> None:
        text = " ".join(html.unescape("".join(piece)).split())
        if text:
            blocks.append(text)
        piece.clear()

    def walk(node: Node) -> None:
        for c in node.children:
            if isinstance(c, str):
                piece.append(c)
            elif c.noise or (removed and c.tag not in _INLINE and c.key in removed):
                if c.tag not in _INLINE:
                    close()
            elif c.tag == "br":
                piece.append(" ")
            elif c.tag in _INLINE:
                walk(c)
            else:
                close()
                walk(c)
                close()

    mains: list[Node] = []

    def find(node: Node) -> None:
        for c in node.children:
            if isinstance(c, Node) and not c.noise:
                if c.tag in ("article", "main"):
                    mains.append(c)
                else:
                    find(c)

    find(root)
    for top in mains or [root]:
        walk(top)
        close()
    return "\n\n".join(blocks)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def style_tree(pages: DataFrame, url_col: str, html_col: str, importance: float, least_pages: int) -> DataFrame:
    """(host, node, pages, importance): the contents of the merged tree below ``importance``, of style nodes on at least ``least_pages`` pages."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            out = []
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                root, host = parse(source or ""), host_of(url)
                page = _hash(main_text(root))
                out += [(host, page, _hash(path), key) for path, key in set(style_nodes(root))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                names=["host", "page", "path", "node"],
            )

    seen = pages.select(url_col, html_col).mapInArrow(nodes, "host string, page long, path long, node long")
    seen = written(seen.distinct(), "style-nodes")
    have = seen.select("host", "path", "page").distinct().groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least_pages)
    # A content below the importance is on this many pages at least, as the host has at least ``least_pages``.
    fewest = max(2, math.ceil(least_pages ** (1 - importance) - 1e-9))
    each = seen.groupBy("host", "path", "node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= fewest)
    found = each.join(have, ["host", "path"]).select("host", "node", "pages", (1 - F.log("n") / F.log("pages")).alias("importance"))
    return found.where(F.col("importance") < importance)


def extract(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    importance: float = IMPORTANCE,
    least_pages: int = PAGES,
    sent: int = SENT,
) -> DataFrame:
    """page_id, url, text, n_chars of each page.

    Null html counts as empty (text empty); a null or odd url belongs to the
    host of no name; repeated rows each give a row; very long pages are read
    whole, elements nested beyond ``DEPTH`` as neighbours; other columns are
    ignored, whatever their names; an empty table gives no rows. Up to ``sent``
    removed contents go to all tasks, more to the pages by a join on the host.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    small_batches(pages.sparkSession)
    removed = written(style_tree(rows, "url", "html", importance, least_pages).select("host", "node"), "style-removed")
    few = None
    if removed.count() <= sent:
        by_host: dict[str, set[int]] = {}
        for r in removed.collect():  # at most ``sent`` rows
            by_host.setdefault(r["host"], set()).add(r["node"])
        few = pages.sparkSession.sparkContext.broadcast({h: frozenset(n) for h, n in by_host.items()})
        found = rows.withColumn("removed", F.lit(None).cast("array<long>"))
    else:
        host = F.pandas_udf(lambda urls: urls.map(host_of), "string")
        each = removed.groupBy("host").agg(F.collect_set("node").alias("removed"))
        found = rows.withColumn("host", host("url")).join(each, "host", "left")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none: frozenset[int] = frozenset()
        for batch in pieces_of(batches):
            out = []
            for url, source, gone in zip(*(batch.column(c).to_pylist() for c in ("url", "html", "removed"))):
                low = few.value.get(host_of(url), none) if few is not None else frozenset(gone or ())
                out.append(main_text(parse(source or ""), low))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return found.select("page_id", "url", "html", "removed").mapInArrow(texts, "page_id long, url string, text string, n_chars long")


def op3_html_extract(spark, sf_dir: str) -> DataFrame:
    """Main texts of ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
