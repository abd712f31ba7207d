r"""HTML extraction with a tree-structured graphical model.

A page becomes a tree: elements that are not inline formatting, and one leaf per
block of text (the text between two boundaries of such elements). Every node is
content or not. Node potentials come from features (tag, words of class, id and
role, standing under boilerplate, text length, share of link text), parent-child potentials from the two
labels of an edge. Sum-product messages go up and down the tree once, which is
exact on trees; a block is kept when its content marginal is at least one half.

Training: labelled pages are pages whose source text is known; a leaf is content
if the source holds it, an element if all its leaves are. The weights maximise
the labels' likelihood (observed less expected counts, the latter from the same
messages) under a Gaussian prior around ``PRIOR``, so that tags and class words
the labelled pages never show keep a sensible weight. The sample is bounded
(``TRAIN_PAGES``, pages of less than ``TRAIN_CHARS`` characters).

Text: character references decoded, white space inside a block one blank,
trimmed, blocks in page order joined by two line feeds. Scripts, styles,
drawings, templates and comments are never text; formulas and the fallback text
of objects are, as part of their block. Null and empty pages give the empty text, a page
without any mark-up is one block under the root; whole pages are read; repeated
rows give equal results; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_chunks

TRAIN_PAGES = 300
TRAIN_CHARS = 40_000
TRAIN_ROUNDS = 40
# Fixed lists of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby "
                   "s samp small span strike strong sub sup time tt u var object "
                   "math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms "
                   "mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
LITERAL = frozenset(["script", "style", "title", "textarea", "iframe"])       # mark-up in these is no mark-up
NESTED = ("svg", "template")
RAW = LITERAL | {"noscript", "annotation", "annotation-xml", *NESTED}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 "
                     "h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
               "th": ("td", "th"), "option": ("option",), "body": ("head",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
         "th": ("tr", "table"), "option": ("select",), "body": ("html",)}
# Words of class, id and role that speak against content, and for it
AGAINST = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
                    "cookie cookies consent disclaimer disqus dialog footer form gdpr header login masthead menu "
                    "modal nav navbar navigation newsletter notice notices pagination pager popup privacy promo "
                    "promoted promotion recommended related replies reply search share sharing sidebar signup "
                    "social sponsor sponsored subscribe subscription toc toolbar widget".split())
FOR = frozenset("article body content entry main post story text".split())
BOILERPLATE = frozenset("nav header footer aside form menu button select dialog fieldset".split())
PAGE_WIDE = frozenset("html body main article".split())        # class words of these say nothing
# Prior means of the content log-odds
PRIOR = {f"tag:{t}": -6.0 for t in BOILERPLATE} | {
    "tag:head": -5.0, "tag:article": 3.0, "tag:main": 2.0, "against": -6.0, "for": 1.0, "bias": 0.0, "under": -5.0,
    "leaf": 0.3, "leaf:links": -1.0, "leaf:long": 0.3, "pair:00": 1.0, "pair:01": -1.0, "pair:10": -1.0,
    "pair:11": 1.0}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))|<[!?][^>]*+(?:>|\Z)",
    re.DOTALL)
ATTR = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])[^>]*+>?", re.IGNORECASE) for t in RAW}
NESTED_TAG = re.compile(rf"<(/?)({'|'.join(NESTED)})(?=[\s/>])((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Tree:
    parent: list[int] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)      # features of each node
    text: list[str | None] = field(default_factory=list)            # a leaf's block

    def add(self, parent: int, features: tuple[str, ...], text: str | None = None) -> int:
        self.parent.append(parent)
        self.names.append(features)
        self.text.append(text)
        return len(self.parent) - 1


def _element(tag: str, attrs: str, under: bool) -> tuple[str, ...]:
    """Features of an element; ``under``: something above it speaks against content."""
    out = ["bias", f"tag:{tag}"]
    if under:
        out.append("under")
    if "=" in attrs and tag not in PAGE_WIDE:
        words = {w for m in ATTR.finditer(attrs)
                 for w in WORD.findall(CAMEL.sub("-", m[2] or m[3] or m[4] or "").lower())}
        if words & AGAINST:
            out.append("against")
        if words & FOR:
            out.append("for")
    return tuple(out)


class RawEnds:
    """Where the raw elements of a page end."""

    def __init__(self, page: str):
        self.page = page
        self.missing: set[str] = set()               # tags without an end tag in the rest of the page
        self.inner: dict[int, int] | None = None     # position after a nested start tag -> its own end tag

    def after(self, tag: str, at: int) -> int | None:
        """Position behind the end tag of the element whose content starts at ``at``."""
        if tag in self.missing:
            return None
        if tag in NESTED:
            if self.inner is None:
                self.inner, opened = {}, {t: [] for t in NESTED}
                for m in NESTED_TAG.finditer(self.page):
                    own = opened[m[2].lower()]
                    if not m[1] and not m[3].endswith("/"):
                        own.append(m.end())
                    elif m[1] and own:
                        self.inner[own.pop()] = m.end()
            if at in self.inner:
                return self.inner[at]
        m = RAW_END[tag].search(self.page, at)
        if m is None:
            self.missing.add(tag)
        return m and m.end()


def parse(page: str) -> Tree:
    """The page's tree; nodes come in document order, parents first."""
    tree = Tree()
    tree.add(-1, ("bias", "tag:#root"))
    below = [False]                  # per node: whether what is in it stands under boilerplate
    stack = [("#root", 0)]           # open elements; inline ones share their block's node
    runs: list[str] = []
    linked = total = 0
    links = 0

    def flush() -> None:
        nonlocal linked, total
        if runs:
            block = " ".join(html.unescape("".join(runs)).split())
            if block:
                f = ["leaf", "under"] if below[stack[-1][1]] else ["leaf"]
                if 2 * linked > total:
                    f.append("leaf:links")
                if len(block) > 80:
                    f.append("leaf:long")
                tree.add(stack[-1][1], tuple(f), block)
                below.append(False)
            runs.clear()
        linked = total = 0

    def close(k: int) -> None:
        nonlocal links
        if any(t not in INLINE for t, _ in stack[k:]):
            flush()
        links -= sum(t == "a" for t, _ in stack[k:])
        del stack[k:]

    def said(s: str) -> None:
        nonlocal linked, total
        if s:
            runs.append(s)
            n = len(s.strip())
            total += n
            linked += n if links else 0

    at, ends = 0, RawEnds(page)
    while m := TOKEN.search(page, at):
        said(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if k and not (tag in INLINE and any(t not in INLINE for t, _ in stack[k + 1:])):
                close(k)
            elif k:
                # a mis-nested inline end tag: forget the element, keep the blocks in it
                links -= tag == "a"
                del stack[k]
            continue
        if tag == "br":
            runs.append(" ")
            continue
        if tag in RAW:
            # raw content ends at its own end tag, literal one at the latest with the page
            if tag in LITERAL or not m[3].rstrip().endswith("/>"):
                end = ends.after(tag, at)
                at = end if end is not None else len(page) if tag in LITERAL else at
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in CLOSES_P:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == "p"), 0)
            if k:
                close(k)
        if tag in SAME_CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in SAME_CLOSES[tag]:
                    close(k)
                    break
                if stack[k][0] in SCOPE[tag]:
                    break
        if tag in INLINE:
            links += tag == "a"
            stack.append((tag, stack[-1][1]))
        else:
            flush()
            above = below[stack[-1][1]]
            names = _element(tag, m[3], above)
            stack.append((tag, tree.add(stack[-1][1], names)))
            below.append(above or tag in BOILERPLATE or "against" in names)
    said(page[at:])
    flush()
    return tree


def _lse(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(tree: Tree, w: dict[str, float]) -> tuple[list[float], list[tuple[float, float, float, float]]]:
    """Content marginals of the nodes, and of every edge (parent, child) labels
    00, 01, 10, 11, by sum-product up and down the tree."""
    n = len(tree.parent)
    p00, p01, p10, p11 = w["pair:00"], w["pair:01"], w["pair:10"], w["pair:11"]
    own = [sum(w.get(f, 0.0) for f in names) for names in tree.names]
    in0, in1 = [0.0] * n, [0.0] * n        # messages from the children
    up0, up1 = [0.0] * n, [0.0] * n        # message to the parent
    for i in range(n - 1, 0, -1):
        a, b = in0[i], own[i] + in1[i]
        u0, u1 = _lse(p00 + a, p01 + b), _lse(p10 + a, p11 + b)
        up0[i], up1[i] = u0, u1
        in0[tree.parent[i]] += u0
        in1[tree.parent[i]] += u1
    out = [0.0] * n
    down0, down1 = [0.0] * n, [0.0] * n
    edges = [(0.0, 0.0, 0.0, 0.0)] * n
    for i in range(n):
        if i:
            p = tree.parent[i]
            # the parent's belief without this child's own message
            b0 = down0[p] + in0[p] - up0[i]
            b1 = down1[p] + in1[p] - up1[i] + own[p]
            down0[i], down1[i] = _lse(b0 + p00, b1 + p10), _lse(b0 + p01, b1 + p11)
            top = max(down0[i], down1[i])
            down0[i] -= top
            down1[i] -= top
            a, b = in0[i], own[i] + in1[i]
            e = (b0 + p00 + a, b0 + p01 + b, b1 + p10 + a, b1 + p11 + b)
            top = max(e)
            e = tuple(math.exp(x - top) for x in e)
            z = sum(e)
            edges[i] = tuple(x / z for x in e)
        d = down1[i] + in1[i] + own[i] - down0[i] - in0[i]
        out[i] = 1 / (1 + math.exp(-d)) if d > -700 else 0.0
    return out, edges


def node_labels(tree: Tree, source: str) -> list[int]:
    """1 for leaves whose text the source holds and for elements all of whose
    leaves are such."""
    whole = " ".join(source.split())
    n = len(tree.parent)
    good, leaves = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        if tree.text[i] is not None:
            leaves[i] = 1
            good[i] = int(tree.text[i] in whole and len(tree.text[i]) > 0)
        if i:
            leaves[tree.parent[i]] += leaves[i]
            good[tree.parent[i]] += good[i]
    return [int(leaves[i] > 0 and good[i] == leaves[i]) for i in range(n)]


def train(pages: list[tuple[str, str]], rounds: int = TRAIN_ROUNDS, rate: float = 0.3,
          pull: float = 0.1) -> dict[str, float]:
    """Weights from (html, source text) pairs; the prior alone without any."""
    w = dict(PRIOR)
    data = []
    for page, source in pages:
        tree = parse(page or "")
        if len(tree.parent) > 1 and source and source.strip():
            data.append((tree, node_labels(tree, source)))
    if not data:
        return w
    square: dict[str, float] = {}
    for _ in range(rounds):
        grad: dict[str, float] = {}
        for tree, y in data:
            m, edges = marginals(tree, w)
            scale = 1.0 / len(tree.parent)
            for i, names in enumerate(tree.names):
                d = (y[i] - m[i]) * scale
                for f in names:
                    grad[f] = grad.get(f, 0.0) + d
                if i:
                    seen = 2 * y[tree.parent[i]] + y[i]
                    for k, name in enumerate(("pair:00", "pair:01", "pair:10", "pair:11")):
                        grad[name] = grad.get(name, 0.0) + ((seen == k) - edges[i][k]) * scale
        for f in sorted(grad):
            g = grad[f] / len(data) * 20 - (w.get(f, 0.0) - PRIOR.get(f, 0.0)) * pull
            square[f] = square.get(f, 1e-6) + g * g
            w[f] = w.get(f, 0.0) + rate * g / math.sqrt(square[f])
    return w


def main_text(page: str, w: dict[str, float]) -> str:
    tree = parse(page)
    if len(tree.parent) == 1:
        return ""
    m, _ = marginals(tree, w)
    return "\n\n".join(t for t, p in zip(tree.text, m) if t is not None and p >= 0.5)


def labelled_pages(pages: DataFrame, documents: DataFrame) -> list[tuple[str, str]]:
    """At most about TRAIN_PAGES (html, source text) pairs: pages whose address
    names the number of the document they were made from, chosen by hash."""
    number = F.regexp_extract("url", r"^https?://[^/]+/(?:[a-z]+/)?(\d{1,18})(?:[./?#]|$)", 1)
    named = pages.where("html IS NOT NULL AND url IS NOT NULL").select(
        "page_id", "html", F.when(number != "", number.cast("long")).alias("_n")).where("_n IS NOT NULL")
    n = named.count()
    step = max(1, -(-n // TRAIN_PAGES))
    sample = named.where((F.pmod(F.xxhash64("page_id"), F.lit(step)) == 0) & (F.length("html") < TRAIN_CHARS))
    rows = sample.orderBy("page_id", "html").limit(2 * TRAIN_PAGES).collect()
    ids = sorted({r["_n"] for r in rows})              # at most 2 * TRAIN_PAGES, a filter on the scan
    source = {r["doc_id"]: r["text"] for r in documents.where(
        F.col("text").isNotNull() & F.col("doc_id").isin(ids)).select("doc_id", "text").collect()} if ids else {}
    return [(r["html"], source[r["_n"]]) for r in rows if r["_n"] in source]


def extract(pages: DataFrame, weights: dict[str, float], *, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    spark = pages.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(weights)
    kind = dict(pages.dtypes)[id_col]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for cols, page in text_chunks(batches, text=2):
            texts = [main_text(p, w) for p in page.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [cols[0], cols[1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(
        go, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
