"""Main text of web pages by a site style tree.

Pages of a host are merged by the style path of their elements (tag and class names from the body down). Every style node gets
an importance from two entropies over the host's pages: of its presentations (the kinds of its child elements) and of its contents (all text
in its branches). A node whose contents and presentation repeat from page to page is unimportant. Repetition alone doesn't make noise, as headings, quotes
and licence lines recur in articles: only branches go that differ in kind from running text, too. So a branch goes if it is unimportant, is
a container (never a heading, paragraph, quote, item, cell or part of a line), and

* consists of links and controls (``LINKED`` of its text or more), inside a declared article as well as outside, or
* lies outside a declared article and outside the flow of text: its parent holds no paragraph, heading, quote or preformatted text of its own.

Pages of a host that say the same count once, so copies of a page don't make it noise. Elements that markup itself declares as no content (menus, footers, adverts, forms, scripts,
comments, ...) go whatever their entropy; all else is kept, in an <article> or not. A class, id or role declares only by a whole token
(``cookie-notice`` does, ``has-sidebar`` doesn't), and never html, body, article, main or an element that holds a main or all articles of the page.

What is gathered per host is one row per style node and distinct content, summed before any shuffle. Removed paths travel
to the pages as one short list of hashes per host, broadcast only if the list is proven small, else by a join that can split hot hosts.

A node is judged if pages of different text hold it, two at least and ``SHARE`` of the host's, so that the evidence grows with the host: what a site repeats
everywhere is judged alike on two pages and on two million, and what a few of many pages share is left.

Defined cases: null or empty html gives an empty text; a null url is a host of its own; pages cut off in the middle keep what is
readable (a cut-off tag is markup); repeated rows get equal rows; extra columns are ignored.
Text is decoded, white space within a block becomes one space, blocks are joined by one line feed; <br> is white space.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Markup: comments, declarations, end tags, start tags. Possessive, so that broken markup stays linear.
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|</([a-zA-Z][^\s/>]*+)[^>]*+>?|<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"?|'[^']*+'?)*+)>?""", re.S)
CLASS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z0-9]+")
#: Fixed word lists: elements whose text is no text, void elements, elements that begin and end blocks, elements that close an open paragraph or item.
RAW = frozenset("script style noscript template textarea title iframe svg canvas select annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
ITEMS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Elements and class words that declare what isn't the article.
NOISE_TAGS = frozenset("head nav footer aside form dialog menu".split()) | RAW
NOISE_WORDS = frozenset("ad ads advert advertisement adverts advertising banner sponsor sponsored promo sidebar comments comment cookie cookies consent notice newsletter subscribe share sharing social related popup modal disqus respond".split())
OUTER_TAGS = frozenset("header button".split())
OUTER_WORDS = frozenset("nav navbar navigation menu menubar footer header breadcrumb breadcrumbs masthead topbar toolbar banner contentinfo complementary".split())
#: Elements that no class word condemns.
FRAME = frozenset("html body article main".split())
#: Elements that may go for their importance: containers, never running text or parts of it.
CONTAINERS = frozenset("div section ul ol dl table center details nav menu".split())
#: Elements of running text: what holds one of them directly is in the flow of text.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Elements whose text counts as links and controls.
LINKS = frozenset("a button option".split())
#: Share of the contents in a node's importance; threshold; share of a host's pages that hold a node which is judged; share of links in what is no text.
CONTENT_SHARE, THRESHOLD, SHARE, LINKED = 0.9, 0.15, 0.3, 0.8
#: Rows (a host and its few removed paths) up to which the removal lists are broadcast.
BROADCAST_ROWS = 50_000


def _events(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes), ("close", tag, "") in page order, raw-text elements left out."""
    at, n = 0, len(page)
    while at < n:
        i = page.find("<", at)
        if i < 0:
            yield "text", page[at:], ""
            return
        m = MARKUP.match(page, i)
        if not m:
            yield "text", page[at : i + 1], ""
            at = i + 1
            continue
        if i > at:
            yield "text", page[at:i], ""
        at = m.end()
        if m[1]:
            yield "close", m[1].lower(), ""
        elif m[2]:
            tag = m[2].lower()
            if tag in RAW and not m[0].endswith("/>"):
                close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
                end = page.find(">", close.end()) if close else -1
                at = end + 1 if end >= 0 else n
            else:
                yield "open", tag, m[3] or ""


def _tokens(attributes: str) -> list[list[str]]:
    """The words of each token of class, id and role."""
    return [words for found in CLASS.findall(attributes) for token in "".join(found).lower().split() if (words := WORD.findall(token))] if "=" in attributes else []


def _declares(tokens: list[list[str]], names: frozenset[str]) -> bool:
    """A token consists of such words, numbers aside."""
    return any(names.issuperset(said) for words in tokens if (said := [w for w in words if not w.isdigit()]))


class _Walk:
    """One pass over a page with a stack of open elements: (tag, style path, is noise, is in article, within which a header is content, number)."""

    def __init__(self, page: str, low: frozenset[int] = frozenset(), tree: bool = False, cleared: frozenset[int] = frozenset(), outer: frozenset[int] = frozenset(), flow: frozenset[int] = frozenset()):
        self.stack: list[tuple[str, str, bool, bool, int]] = []
        self.blocks: list[str] = []
        self.whole = xxhash.xxh64()  # of all text of the page
        self.nodes: dict[str, xxhash.xxh64] = {}  # style path -> digest of all text in its branches
        self.tree = tree
        self.children: dict[str, list[str]] = {}  # style path -> child tags
        self.chars: dict[str, list[int]] = {}  # style path -> characters in its branches, those of links among them
        self.low = low  # unimportant paths of links and controls
        self.outer = outer  # other unimportant paths, which go outside a declared article and the flow of text
        self.flowing = flow  # numbers of elements that hold running text themselves, known from a pass before
        self.flow: set[int] = set()  # such elements of this pass; 0 is the page itself
        self.cleared = cleared  # numbers of elements that class words don't condemn
        self.number = self.articles = 0  # elements and articles so far
        self.held: dict[int, int] = {}  # element that a class word condemns -> articles within
        self.mains: set[int] = set()  # such elements that hold a main
        self.marked: list[tuple[int, int]] = []  # depth in the stack and number of such elements that are open
        self.buffer: list[str] = []
        for kind, value, attributes in _events(page):
            if kind == "text":
                self.text(value)
            elif kind == "open":
                self.open(value, attributes)
            else:
                self.close(value)
        self.flush()

    def text(self, value: str) -> None:
        noise = bool(self.stack) and self.stack[-1][2]
        if self.tree and (said := " ".join(value.split())):
            self.whole.update(f"{said}\n")
            linked = len(said) if any(tag in LINKS for tag, *_ in self.stack) else 0
            for _, open_path, *_ in self.stack:
                self.nodes.setdefault(open_path, xxhash.xxh64()).update(f"{said}\n")
                chars = self.chars.setdefault(open_path, [0, 0])
                chars[0] += len(said)
                chars[1] += linked
        if not noise:
            self.buffer.append(value)

    def flush(self) -> None:
        if self.buffer:
            text = " ".join(entities.unescape("".join(self.buffer)).split())
            if text:
                self.blocks.append(text)
            self.buffer = []

    def open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.buffer.append(" ") if self.buffer else None
            return
        if tag in BLOCK:
            self.flush()
            self.imply(tag)
        if tag in VOID or attributes.endswith("/"):
            return
        _, path, noise, article, parent = self.stack[-1] if self.stack else ("", "", False, False, 0)
        if tag in FLOW:
            self.flow.add(parent)
        tokens = _tokens(attributes)
        if self.tree:
            self.children.setdefault(path, []).append(tag)
        path = f"{path}/{tag}" + "".join(f".{w}" for words in tokens for w in words if not w.isdigit())
        self.number += 1
        while self.marked and self.marked[-1][0] >= len(self.stack):
            self.marked.pop()
        main = tag == "main" or ["main"] in tokens
        if main or tag == "article":
            article = True
            self.articles += tag == "article"
            for _, number in self.marked:
                self.held[number] += tag == "article"
                self.mains.update([number] if main else [])
        declared = tag in NOISE_TAGS or (not article and tag in OUTER_TAGS)
        if tag not in FRAME and not declared and (_declares(tokens, NOISE_WORDS) or (not article and _declares(tokens, OUTER_WORDS))):
            declared = self.number not in self.cleared
            self.held[self.number] = 0
            self.marked.append((len(self.stack), self.number))
        repeated = False
        if tag in CONTAINERS and (self.low or self.outer):
            node = xxhash.xxh64_intdigest(path)
            repeated = node in self.low or (node in self.outer and not article and parent not in self.flowing)
        self.stack.append((tag, path, noise or declared or repeated, article, self.number))

    def imply(self, tag: str) -> None:
        """Elements that a start tag closes by the rules of the language."""
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name == "p" or (tag in ITEMS and (name == tag or {name, tag} in ({"dt", "dd"}, {"td", "th"}))):
                del self.stack[i:]
                if name != "p":
                    return
            elif name in BLOCK and (tag not in ITEMS or name in ITEMS[tag]):
                return

    def close(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return
            if tag == "p" and self.stack[i][0] in BLOCK:
                return


def main_text(page: str, low: frozenset[int] = frozenset(), outer: frozenset[int] = frozenset()) -> str:
    """All blocks that neither markup nor their importance makes noise. ``low``: hashes of unimportant style paths of links; ``outer``: of others."""
    walk = _Walk(page, low)
    frames = frozenset(x for x, n in walk.held.items() if x in walk.mains or (n and n == walk.articles))
    return "\n".join((_Walk(page, low, cleared=frames, outer=outer, flow=frozenset(walk.flow)) if frames or outer else walk).blocks)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            walk = _Walk(page or "", tree=True)
            for path in walk.nodes.keys() | walk.children.keys():
                if path:
                    content, shape = walk.nodes.get(path), walk.children.get(path, [])
                    rows.append((host, path, content.intdigest() if content else 0, xxhash.xxh64_intdigest(" ".join(dict.fromkeys(shape))), walk.whole.intdigest(), *walk.chars.get(path, (0, 0))))
        signed = [[x - (1 << 64) if x >= 1 << 63 else x for x in col] for col in ([xxhash.xxh64_intdigest(r[1]) for r in rows], *([r[i] for r in rows] for i in (2, 3, 4)))]
        sizes = [pa.array([r[i] for r in rows], pa.int64()) for i in (5, 6)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array(col, pa.int64()) for col in signed), *sizes], ["host", "node", "content", "shape", "page", "chars", "linked"])


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, pages, host_pages, importance, linked) of every style node, over the host's pages of different text; ``linked`` is the share of links in its text."""
    rows = pages.select(_host(), "html").mapInArrow(_nodes, "host string, node long, content long, shape long, page long, chars long, linked long")
    sums = [F.sum("chars").alias("chars"), F.sum("linked").alias("linked")]
    counted = cut(rows.groupBy("host", "node", "content", "shape").agg(F.count_distinct("page").alias("n"), *sums), "nodes")

    def entropy(feature: str) -> DataFrame:
        """Entropy of a feature over a node's pages, to the base of their number: 1 if all differ, 0 if all agree."""
        each = counted.groupBy("host", "node", feature).agg(F.sum("n").alias("n"), *sums)
        total = each.groupBy("host", "node").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.ln("n")).alias("s"), *sums)
        spread = F.when(F.col("pages") > 1, 1 - F.col("s") / F.col("pages") / F.ln("pages")).otherwise(1.0)
        return total.select("host", "node", "pages", spread.alias(feature), "chars", "linked")

    both = entropy("content").join(entropy("shape").drop("pages", "chars", "linked"), ["host", "node"])
    # The node that most pages hold stands for their number; a host's frame is on all of them.
    most = both.groupBy("host").agg(F.max("pages").alias("host_pages"))
    share = F.when(F.col("chars") > 0, F.col("linked") / F.col("chars")).otherwise(0.0)
    importance = CONTENT_SHARE * F.col("content") + (1 - CONTENT_SHARE) * F.col("shape")
    return both.join(most, "host").select("host", "node", "pages", "host_pages", importance.alias("importance"), share.alias("linked"))


def _host() -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)), F.lit("")).alias("host")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unsigned = lambda column: [frozenset(x % (1 << 64) for x in found or ()) for found in column.to_pylist()]
    for batch in batches:
        # A page at a time, so that a batch of large pages isn't held twice.
        texts = [main_text(page.as_py() or "", low, outer) for page, low, outer in zip(batch.column(2), unsigned(batch.column(3)), unsigned(batch.column(4)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, threshold: float = THRESHOLD, share: float = SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) of every page row."""
    tree = style_tree(pages).filter((F.col("importance") < threshold) & (F.col("pages") >= 2) & (F.col("pages") >= share * F.col("host_pages")))
    links = F.col("linked") >= LINKED
    listed = lambda kept: F.collect_set(F.when(kept, F.col("node")))
    removed = cut(tree.groupBy(F.col("host").alias("_host")).agg(listed(links).alias("low"), listed(~links).alias("outer")), "removed")
    # A site has few style nodes; hosts are what may be many, so their number decides.
    if removed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        removed = F.broadcast(removed)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), _host())
    rows = rows.join(removed, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "low", "outer")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
