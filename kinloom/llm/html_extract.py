"""Main text of HTML pages by site style trees (operator 1).

The DOM trees of a host's pages are merged into one style tree: its nodes are paths of block
elements with class and id. For each node the pages' child sequences (presentation) and text
blocks (content) are counted. The more evenly a text block is spread over the pages, the higher
its entropy and the less it says about any one of them. A node's statistical importance is a mix
of one minus the mean entropy of its blocks and of the entropy of its child sequences: 1 where
every page says something of its own, 0 where all say the same in the same shape.

What the markup itself says is a prior, mixed in on every page for every text block:

    importance = (1 - STATISTICS) * prior + STATISTICS * statistical importance

and a block stays if its importance is at least LEAST_IMPORTANCE. A branch is removed when all
of its blocks are, so the importance of a branch is the largest of its content nodes'. Priors:

* 1 for article, main and role=main, which are the page's landmarks, and text directly in them;
* INSIDE for what else stands in a landmark: all but worthless statistics keep it;
* NEUTRAL for a page without a landmark: statistics decide;
* OUTSIDE for what stands beside a landmark, in a form, or under a class or id that names chrome;
* 0 for elements that are never content (nav, footer, aside, ...), adverts and comments.

Names match whole class names or ids, or compounds of nothing but such names. A landmark inside
a named wrapper or a form counts where the page has no other, so it is never lost with its
wrapper; beside a free landmark it is a teaser, and under the name of comments or adverts it is
none. Fewer than MIN_PAGES
pages are no evidence: the prior stands alone. Where statistics would leave nothing of the
landmark, or of a page without one (pages that are copies of each other), they do not count.

All statistics are sums by (host, node, feature), so a host with a third of all pages is added
up before it is shuffled. The few nodes of low importance are broadcast as arrays if they have
been counted to be few; else each page's own nodes are joined with them, so that nothing grows
with a host. Block elements nested deeper than MAX_DEPTH share the node of that depth: only
the statistics are coarser there, no text is lost.

Defined cases: a null or empty page has empty text; pages without a host share one; repeated
rows each get a row (and count as pages).
"""

from __future__ import annotations

import html as _html
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, pick, read

MIN_PAGES = 4
LEAST_IMPORTANCE = 0.5
#: Weight of statistics against the prior, and of content against presentation within them.
STATISTICS, CONTENT_WEIGHT = 0.4, 0.9
INSIDE, NEUTRAL, OUTSIDE = 0.8, 0.5, 0.1
#: No prior above OUTSIDE loses to a higher statistical importance than this.
CEILING = (LEAST_IMPORTANCE - (1 - STATISTICS) * NEUTRAL) / STATISTICS
MAX_DEPTH = 64
#: Up to so many nodes of low importance are broadcast (24 bytes each); more are joined page by page.
BROADCAST_NODES = 200_000
#: A worker hands on its sums when it holds so many.
HELD_SUMS = 200_000

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_KEEP = frozenset(("article", "main"))
#: Never content. A form may wrap a whole page, so a landmark in it still counts, as under a name.
_DROP = frozenset("nav header footer aside button select dialog menu search head script style template svg object embed iframe noscript textarea title canvas audio video datalist".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login comment comments respond replies disqus social share sharing related pagination pager toolbar widget".split()
)
#: Of these, names of what others say: a landmark in it is no landmark.
_FOREIGN = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo comment comments respond replies disqus related".split())
_WITH_NAMES = frozenset("area bar block box container list item left right top bottom section wrapper".split())
#: A new element of the key closes an open one of the values, within the nearest of the stops.
_CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
_CUT_P = frozenset(("td", "th", "table", "button", "article", "section", "div", "li", "body", "main", "aside"))
_PARTS = re.compile(r"[-_]+")


def _hash(s: str) -> int:
    x = xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


def _named(attrs: dict[str, str]) -> set[str]:
    """Class names and ids that name chrome."""
    out = set()
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        parts = set(_PARTS.split(name)) - {""}
        if parts & _NAMES and parts <= _NAMES | _WITH_NAMES:
            out.add(name)
    return out


def _mark(tag: str, attrs: dict[str, str], inside: bool) -> int:
    """1 for a landmark, 2 for chrome by name, 3 for what is never content, 0 for anything else."""
    if tag in ("html", "body"):
        return 0
    role = attrs.get("role", "").lower()
    named = _named(attrs) if attrs else set()
    if tag == "header" or named == {"header"} or named == {"masthead"}:
        return 0 if inside else 3 if tag == "header" else 2  # an article's own header belongs to it
    if tag in _DROP or role in _DROP_ROLES:
        return 3
    if named or tag == "form" or role == "form":
        return 3 if any(_FOREIGN & set(_PARTS.split(x)) for x in named) else 2
    return 1 if tag in _KEEP or role == "main" else 0


class Page:
    """A page read into elements (parent, node, mark) and text blocks (element, text).

    Elements are numbered as they open, so that a parent comes before its children."""

    def __init__(self, source: str | None):
        self.blocks: list[tuple[int, str]] = []
        self.styles: dict[int, list[str]] = {}
        self.up, self.node, self.mark, self._depth, self._in = [0], [0], [0], [0], [False]
        self._stack: list[tuple[str, int]] = []  # open elements: tag, number
        self._at: dict[str, list[int]] = {}  # tag: its places on the stack
        self._run: list[str] = []
        self._read(source or "")

    def _end_block(self):
        if self._run:
            text = " ".join(_html.unescape("".join(self._run)).split())
            self._run = []
            if text:
                self.blocks.append((self._block_element, text))

    def _text(self, s: str):
        if s:
            if not self._run:
                self._block_element = self._stack[-1][1] if self._stack else 0
            self._run.append(s)

    def _top(self, tags) -> int:
        """The highest place on the stack of an element of these tags, or -1."""
        return max((self._at[t][-1] for t in tags if self._at.get(t)), default=-1)

    def _pop(self, place: int):
        if any(t in _BLOCK for t, _ in self._stack[place:]):
            self._end_block()
        for t, _ in self._stack[place:]:
            self._at[t].pop()
        del self._stack[place:]

    def _close(self, tags, stops) -> None:
        place = self._top(tags)
        if place >= 0 and place > self._top(stops):
            self._pop(place)

    def _open(self, tag: str, raw: str):
        attrs = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)} if "=" in raw else {}
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        if tag in _BLOCK:
            self._close(("p",), _CUT_P)
            self._end_block()
        up = self._stack[-1][1] if self._stack else 0
        path, depth = self.node[up], self._depth[up]
        mark = _mark(tag, attrs, self._in[up])
        node = path
        if tag in _BLOCK and depth < MAX_DEPTH:
            label = f"{tag}.{attrs.get('class', '')}#{attrs.get('id', '')}" if attrs else tag
            node = _hash(f"{path} {label}")
            depth += 1
            style = self.styles.setdefault(path, [])
            if not style or style[-1] != label:
                style.append(label)
        for held, value in ((self.up, up), (self.node, node), (self.mark, mark), (self._depth, depth), (self._in, self._in[up] or mark == 1)):
            held.append(value)
        self._at.setdefault(tag, []).append(len(self._stack))
        self._stack.append((tag, len(self.up) - 1))

    def _read(self, s: str):
        at = 0
        while True:
            m = _TAG.search(s, at)
            if not m:
                self._text(s[at:])
                break
            self._text(s[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue  # a comment or a declaration
            tag = m[2].lower()
            if m[1]:
                self._shut(tag)
                continue
            if tag in _RAW_END:
                end = _RAW_END[tag].search(s, at)
                at = end.end() if end else len(s)
                continue
            if tag == "br":
                self._text(" ")
            elif tag == "hr":
                self._end_block()
            elif tag not in _VOID:
                self._open(tag, m[3])
        self._end_block()

    def _shut(self, tag: str):
        place = self._top((tag,))
        # A stray end tag never leaves an article.
        if place >= 0 and not (tag in _BLOCK and tag not in ("body", "html") and tag not in _KEEP and place < self._top(_KEEP)):
            self._pop(place)
        elif tag == "p":
            self._end_block()

    def features(self):
        """(node, kind, feature, count): kind 0 a text block, 1 a child sequence, 2 the page itself."""
        out: dict[tuple[int, int, int], int] = {}
        for element, text in self.blocks:
            key = (self.node[element], 0, _hash(text))
            out[key] = out.get(key, 0) + 1
        for node in {k[0] for k in out}:
            if node in self.styles:
                out[node, 1, _hash(" ".join(self.styles[node]))] = 1
            out[node, 2, 0] = 1
        return out

    def priors(self) -> list[float]:
        """The prior of every text block."""
        # Of every element: the level of the landmark it stands in (0 none, 1 free, 2 in a wrapper), and the chrome inside that.
        land, chrome = [0] * len(self.up), [0] * len(self.up)
        for e in range(1, len(self.up)):
            up, mark = self.up[e], self.mark[e]
            land[e], chrome[e] = land[up], max(chrome[up], mark - 1 if mark > 1 else 0)
            if mark == 1 and not land[e] and chrome[e] < 2:
                land[e], chrome[e] = 1 + chrome[e], 0
        level = min((land[e] for e, _ in self.blocks if land[e] and not chrome[e]), default=0)
        out = []
        for e, _ in self.blocks:
            if chrome[e] or land[e] != level:
                out.append(0.0 if chrome[e] == 2 else OUTSIDE)
            else:
                out.append(1.0 if self.mark[e] == 1 else INSIDE if level else NEUTRAL)
        return out

    def main_text(self, importance: dict[int, float] | None = None) -> str:
        """The text blocks whose importance is high enough; importance: statistics of nodes that have some."""
        known, priors = importance or {}, self.priors()
        kept = []
        for (element, text), prior in zip(self.blocks, priors):
            said = known.get(self.node[element])
            mixed = prior if said is None else (1 - STATISTICS) * prior + STATISTICS * said
            if mixed >= LEAST_IMPORTANCE:
                kept.append(text)
        return "\n".join(kept or [t for (_, t), prior in zip(self.blocks, priors) if prior >= LEAST_IMPORTANCE])


def _host(url):
    return F.xxhash64(F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^[^:]*://([^/?#]*)", 1), F.lit(""))))


def importance(pages: DataFrame, host_col: str, html_col: str) -> DataFrame:
    """(host, node, pages, importance) of the nodes that hold text in the merged style trees."""
    base = pages.select(F.col(host_col).alias("host"), F.col(html_col).alias("html"))

    def count(batches):
        sums: dict[tuple, list] = {}

        def told():
            cols = list(zip(*[(*k, *v) for k, v in sums.items()])) or [[] for _ in range(6)]
            kinds = [pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["host", "node", "kind", "feature", "c", "s"])

        for b in bounded(batches):
            for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for key, c in Page(source).features().items():
                    got = sums.setdefault((host, *key), [0, 0.0])
                    got[0] += c
                    got[1] += c * math.log(c) if c > 1 else 0.0
                if len(sums) >= HELD_SUMS:
                    yield told()
                    sums = {}
        yield told()

    parts = base.mapInArrow(count, "host long, node long, kind tinyint, feature long, c long, s double")
    each = parts.groupBy("host", "node", "kind", "feature").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))
    # Entropy of a block over pages, in nats: ln C - (sum of c ln c) / C. Of child sequences: ln m - (sum of C ln C) / m.
    node = each.groupBy("host", "node").agg(
        F.max(F.when(F.col("kind") == 2, F.col("c"))).alias("pages"),
        F.sum(F.when(F.col("kind") == 0, F.col("c") * F.ln("c") - F.col("s"))).alias("spread"),
        F.sum(F.when(F.col("kind") == 0, F.col("c"))).alias("blocks"),
        F.sum(F.when(F.col("kind") == 1, F.col("c") * F.ln("c"))).alias("styles"),
        F.sum(F.when(F.col("kind") == 1, F.col("c"))).alias("styled"),
    )
    content = F.when(F.col("pages") > 1, 1 - F.least(F.lit(1.0), F.col("spread") / F.col("blocks") / F.ln("pages"))).otherwise(1.0)
    look = F.when(F.col("styled") > 1, (F.ln("styled") - F.col("styles") / F.col("styled")) / F.ln("styled")).otherwise(0.0)
    # A node without child elements has one look only: there content alone speaks.
    mixed = F.when(F.col("styled").isNull(), content).otherwise(CONTENT_WEIGHT * content + (1 - CONTENT_WEIGHT) * look)
    return node.select("host", "node", "pages", F.round(mixed, 9).alias("importance"))


def _joined(base: DataFrame, low: DataFrame) -> DataFrame:
    """base with `low`, the statistics of those of a page's own nodes that are low; equal pages share them."""

    def nodes(batches):
        for b in bounded(batches):
            host, page, node = [], [], []
            for h, digest, source in zip(*(c.to_pylist() for c in b.columns)):
                p = Page(source)
                for x in {p.node[e] for e, _ in p.blocks}:
                    host.append(h)
                    page.append(digest)
                    node.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.int64()), pa.array(page, pa.string()), pa.array(node, pa.int64())], names=["host", "page", "node"])

    base = base.withColumn("page", F.sha2("html", 256))
    own = base.select("host", "page", "html").mapInArrow(nodes, "host long, page string, node long").distinct()
    found = own.join(low.hint("merge"), ["host", "node"]).groupBy("host", "page").agg(F.collect_list(F.struct("node", "importance")).alias("low"))
    return base.join(found.hint("merge"), ["host", "page"], "left").select("id", "url", "html", "low")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """(id, url, text) for every row of pages."""
    spark = pages.sparkSession
    base = pick(pages, id=id_col, url=url_col, html=html_col).withColumn("host", _host(F.col("url")))
    low = cut(importance(base, "host", "html").where((F.col("pages") >= MIN_PAGES) & (F.col("importance") < CEILING)).select("host", "node", "importance"))
    names, kinds = ["id", "url", "text"], f"id {base.schema['id'].dataType.simpleString()}, url string, text string"

    if low.limit(broadcast_nodes + 1).count() > broadcast_nodes:

        def by_page(batches):
            for b in bounded(batches):
                texts = [Page(s).main_text({x["node"]: x["importance"] for x in found or ()}) for s, found in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=names)

        return _joined(base, low).mapInArrow(by_page, kinds)

    table = low.toArrow()  # counted: broadcast_nodes rows at most
    host, node, value = (table.column(c).to_numpy() for c in ("host", "node", "importance"))
    order = np.argsort(host, kind="stable")
    sent = spark.sparkContext.broadcast((host[order], node[order], value[order]))

    def run(batches):
        hosts, nodes, values = sent.value
        held: tuple = (None, {})
        for b in bounded(batches):
            texts = []
            for h, s in sorted(zip(b.column(3).to_pylist(), range(b.num_rows))):
                if h != held[0]:
                    lo, hi = np.searchsorted(hosts, h, "left"), np.searchsorted(hosts, h, "right")
                    held = (h, dict(zip(nodes[lo:hi].tolist(), values[lo:hi].tolist())))
                texts.append((s, Page(b.column(2)[s].as_py()).main_text(held[1])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t for _, t in sorted(texts)], pa.string())], names=names)

    return base.mapInArrow(run, kinds)


def op1_html(spark, sf_dir: str) -> DataFrame:
    out = extract(read(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
