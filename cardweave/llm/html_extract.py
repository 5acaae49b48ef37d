"""Main text of web pages by wrapper induction.

Trees of a host's pages are aligned by place: the path of names from the root to a node. Over all pages of a host, each
text at each place is counted by the pages that have it, exactly, in a grouped aggregate: siblings aren't folded, no
wrapper is capped, and the order of rows doesn't matter. (This takes the place of simple tree matching, whose time is
quadratic in siblings and whose merged wrapper depends on the order of pages.) Texts on nearly all pages are template,
the others are varying slots, that is content; menus, forms, adverts and the like vary too, and are told by their
names. Where articles hold most of a host's varying text, the slots outside of them aren't content.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_by_key, on_workers
from .url_filter import parts

#: A text at its place is template if so many pages of its host, and this share of them, have it.
MIN_PAGES, MIN_SHARE = 5, 0.8

#: Fixed values of HTML: elements without content, with raw content, that begin a block, that may stand in the head,
#: and for each element that ends others by its start, which ones, and which stop it.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
IN_HEAD = frozenset("base link meta noscript script style template title".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select", "datalist")}
P_SCOPES = ("p", "td", "th", "li", "article", "div", "section", "body", "button")
#: The families above that look for the nearest node of an element's name.
WATCHED = {t: [f for f in (*ENDS, "p") if t in (P_SCOPES if f == "p" else ENDS[f] + SCOPES[f])] for t in {*P_SCOPES, *(x for f in ENDS for x in ENDS[f] + SCOPES[f])}}

#: Names of what isn't the article: elements, roles, and words of classes and ids. Outside of articles one of WORDS is
#: enough. Within them, and for WEAK ones, which also name other things, all words of a name must be of WORDS, WEAK or
#: FILLERS; HEADERS there are the article's own.
DROPPED = frozenset("head nav footer aside form button dialog menu input svg select template datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
WORDS = frozenset(
    "advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr "
    "masthead menu modal nav navbar navigation newsletter pagination paywall popup promo promoted recommended related "
    "sidebar social sponsor sponsored toolbar widget widgets".split()
)
HEADERS = frozenset("header banner".split())
WEAK = HEADERS | frozenset("ad ads adv notice notices reply replies respond share sharing signup subscribe subscription teaser".split())
FILLERS = frozenset(
    "area bar block bottom box button buttons container count form global icons inline inner item items left link links list main "
    "media page panel reader readers right section site slot sticky thread tools top unit user wrap wrapper".split()
)
OWN_HEADERS = frozenset(f"{a}{mark}{b}" for a in ("article", "post", "entry", "story") for b in ("header", "headline") for mark in ("-", "_", "__"))
ARTICLE_WORDS = OWN_HEADERS | frozenset("article articlebody article-body post post-content post-body entry entry-content story story-body content main-content maincontent".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}


class Node:
    __slots__ = ("kind", "tag", "name", "nodes", "parent", "near")

    def __init__(self, tag: str, name: str, kind: str, parent: Node | None):
        self.tag, self.name, self.kind, self.parent = tag, name, kind, parent
        self.nodes: list[Node | str] = []
        #: By family of WATCHED the nearest node up from here, this one included.
        self.near: dict[str, Node] = parent.near if parent else {}
        if tag in WATCHED:
            self.near = {**self.near, **dict.fromkeys(WATCHED[tag], self)}


_named: dict[tuple[str, str], tuple[str, str]] = {}


def _kind(tag: str, found: dict[str, str]) -> str:
    """dropped: no content anywhere; outside: none unless within an article; article; or nothing."""
    names = (found.get("class", "") + " " + found.get("id", "")).lower().split()
    words = [set(re.split(r"[-_:]+", n)) - {""} for n in names]
    role = found.get("role", "").lower()
    if tag in DROPPED or role in ROLES or "hidden" in found or found.get("aria-hidden") == "true":
        return "dropped"
    if tag in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody" or ARTICLE_WORDS & set(names):
        return "article"
    if tag not in ("html", "body"):
        if any(w & ((WORDS | WEAK) - HEADERS) and w <= WORDS | WEAK | FILLERS for w in words):
            return "dropped"
        if tag == "header" or any(w & WORDS or (w & WEAK and w <= WORDS | WEAK | FILLERS) for w in words):
            return "outside"
    return ""


def _describe(tag: str, attributes: str) -> tuple[str, str]:
    """A node's name for alignment, and its kind."""
    if not attributes.strip(" /"):
        return tag, _kind(tag, {})
    known = _named.get((tag, attributes))
    if known is None:
        found: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        known = f"{tag}.{' '.join(sorted(re.sub(r'[0-9]+', '0', n) for n in found.get('class', '').lower().split()))}", _kind(tag, found)
        if len(_named) > 50_000:
            _named.clear()
        if len(attributes) < 300:
            _named[tag, attributes] = known
    return known


def parse(source: str) -> Node:
    """The tree of a page; never fails: what is cut off or misnested is closed. Each tag takes constant time, but for
    the nodes that it closes."""
    root = at = Node("#root", "#root", "", None)
    pos, still_open = 0, Counter()

    def close(node: Node) -> Node:
        nonlocal at
        while at is not node:
            still_open[at.tag] -= 1
            at = at.parent
        still_open[at.tag] -= 1
        return at.parent

    while True:
        m = TAG.search(source, pos)
        text = source[pos : m.start()] if m else source[pos:]
        if text:
            # A tag's beginning that the page ends in isn't text; TAG takes it.
            if at.tag == "head" and not text.isspace():
                at = close(at)
            at.nodes.append(text)
        if not m:
            return root
        pos = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if still_open[tag] > 0:
                up = at
                while up.tag != tag:
                    up = up.parent
                at = close(up)
            continue
        if at.tag == "head" and tag not in IN_HEAD:
            at = close(at)
        if tag in BLOCKS and (up := at.near.get("p")) is not None and up.tag == "p":
            at = close(up)
        if tag in ENDS and (up := at.near.get(tag)) is not None and up.tag in ENDS[tag]:
            at = close(up)
            if tag == "tr" and up.tag in ("td", "th") and at.tag == "tr":
                at = close(at)
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            end = RAW_END[tag].search(source, pos)
            pos = end.end() if end else len(source)
            continue
        name, kind = _describe(tag, attributes)
        node = Node(tag, name, kind, at)
        at.nodes.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            at = node
            still_open[tag] += 1


def places(root: Node) -> Iterator[tuple[int, int, int, bool]]:
    """(id of the node, digest of its path and own text, length of the text, whether an article has it) of nodes with
    text that may be content."""
    open_nodes = [(root, b"", False)]
    while open_nodes:
        node, above, inside = open_nodes.pop()
        inside = inside or node.kind == "article"
        path = blake2b(above + node.name.encode("utf-8", "replace"), digest_size=8).digest()
        own = " ".join(" ".join(x for x in node.nodes if isinstance(x, str)).split())
        if own:
            yield id(node), int.from_bytes(blake2b(own.encode("utf-8", "replace"), digest_size=8, key=path).digest(), "little", signed=True), len(own), inside
        open_nodes += [(x, path, inside) for x in node.nodes if isinstance(x, Node) and _may(x, inside)]


def _may(node: Node, inside: bool) -> bool:
    return node.kind != "dropped" and (inside or node.kind != "outside")


def extract(source: str | None, constant: frozenset[int] | None, focus: bool = False) -> str:
    """The article's text of a page under its host's template, which is None where the host has none; focus: whether
    articles hold most of the host's varying text."""
    root = parse(source or "")
    template = {node for node, key, *_ in places(root) if key in constant} if constant else set()
    whole = _blocks(root, template)
    if constant is not None and not focus:
        return "\n\n".join(whole)
    named = [t for top in _articles(root) for t in _blocks(top, template)]
    # Without a template names may tell the article, but not if most of the page's text is elsewhere.
    least = 0 if constant is not None else sum(map(len, whole))
    return "\n\n".join(named if named and 2 * sum(map(len, named)) >= least else whole)


def _articles(root: Node) -> list[Node]:
    """The topmost article nodes, in page order; of a main with articles in it, these."""
    found, tops = [], []
    open_nodes = [(root, None)]
    while open_nodes:
        node, top = open_nodes.pop()
        if node.kind == "article":
            if top is None or top.tag != "article" and node.tag == "article":
                found.append(node)
                tops.append(top)
            top = node if top is None or top.tag != "article" else top
        open_nodes += [(x, top) for x in reversed(node.nodes) if isinstance(x, Node) and _may(x, top is not None)]
    outer = {id(t) for t in tops if t is not None}
    return [n for n in found if id(n) not in outer]


def _blocks(top: Node, template: set[int]) -> list[str]:
    """The texts of top's blocks."""
    blocks: list[list[str]] = [[]]
    open_nodes: list[tuple[Node, Iterator[Node | str], bool]] = [(top, iter(top.nodes), top.kind == "article")]
    while open_nodes:
        node, rest, inside = open_nodes[-1]
        for child in rest:
            if isinstance(child, str):
                if id(node) not in template:
                    blocks[-1].append(child)
            elif child.tag in ("br", "wbr"):
                blocks[-1].append("\n" if child.tag == "br" else "")
            elif _may(child, inside):
                if child.tag in BLOCKS:
                    blocks.append([])
                open_nodes.append((child, iter(child.nodes), inside or child.kind == "article"))
                break
        else:
            open_nodes.pop()
            if node.tag in BLOCKS:
                blocks.append([])
    return [t for b in blocks if (t := " ".join(html.unescape("".join(b)).split()))]


def templates(pages: DataFrame, counted: DataFrame, total: int) -> DataFrame:
    """(host, constant, focus) of pages (host, html) and their hosts' numbers n: the digests of the template's texts, and
    whether articles hold most of the varying text. Hosts of too few pages, and those whose pages have little but
    constant texts, aren't in it. A host's template has at most 1 / MIN_SHARE times the texts of its mean page."""
    on_workers(pages.sparkSession)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, hosts, keys, inner, outer = batch.slice(at, 512), [], [], [], []
                for host, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own: dict[int, list[int]] = {}
                    for _, key, size, inside in places(parse(source or "")):
                        own.setdefault(key, [0, 0])[not inside] += size
                    hosts += [host] * len(own)
                    keys += own
                    inner += [x for x, _ in own.values()]
                    outer += [x for _, x in own.values()]
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(x, pa.int64()) for x in (keys, inner, outer))], names=["host", "key", "inner", "outer"])

    sums = [F.sum(c).alias(c) for c in ("inner", "outer")]
    texts = pages.select("host", "html").mapInArrow(found, "host string, key bigint, inner bigint, outer bigint")
    texts = cut(texts.groupBy("host", "key").agg(F.count("*").alias("n_with"), *sums), "texts")
    often = join_by_key(texts.filter(F.col("n_with") >= MIN_PAGES), counted.withColumn("n_pages", F.col("n")), "host", "n", total)
    fixed = often.filter(F.col("n_with") >= F.col("n_pages") * MIN_SHARE).groupBy("host")
    fixed = fixed.agg(F.sort_array(F.collect_list("key")).alias("constant"), F.sum("n_with").alias("n_fixed"), F.sum("inner").alias("inner_fixed"), F.sum("outer").alias("outer_fixed"))
    sums = texts.groupBy("host").agg(F.sum("n_with").alias("n_texts"), *sums).join(counted, "host").filter(F.col("n") >= MIN_PAGES)
    # What varies is content only if it is about as frequent as a page.
    none = {c: F.coalesce(c, F.lit(0)) for c in ("n_fixed", "inner_fixed", "outer_fixed")}
    known = sums.join(fixed, "host", "left").withColumns(none).filter(F.col("n_texts") - F.col("n_fixed") >= F.col("n") * MIN_SHARE)
    focus = F.col("inner") - F.col("inner_fixed") >= F.col("outer") - F.col("outer_fixed")
    return known.select("host", F.coalesce("constant", F.array().cast("array<bigint>")).alias("constant"), focus.alias("focus"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    Whole pages of any depth; a null or empty html has the text "". Pages with a null url, or without a host in it,
    share one template. A host with fewer than MIN_PAGES pages has none and is read by names alone. Repeated rows get
    equal rows, an empty table none; other columns are ignored.
    """
    on_workers(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), parts(F.col(url_col))[0].alias("host"))
    counted = rows.groupBy("host").agg(F.count("*").alias("n"))
    counted = cut(counted, "hosts")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = cut(counted.join(templates(rows, counted, total), "host", "left"), "templates")
    joined = join_by_key(rows, known, "host", "n", total).select("page_id", "url", "html", "constant", "focus")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                asked = zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True)
                texts = [extract(source, None if keys is None else frozenset(keys), bool(focus)) for source, keys, focus in asked]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
