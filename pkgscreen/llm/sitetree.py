"""Main text of web pages with a site style tree.

The pages of a host are merged into one style tree: its nodes are paths of
elements (tag and class), each with the presentations (sequences of children) and
contents seen under it on distinct pages. A node's importance is the larger of
the normalised entropies of its presentations and of its contents: what looks and
reads the same on every page has importance near 0 and is cut as a branch,
together with branches that their element or a name says to be menu, header,
footer, sidebar, notice, advert, form, script or reader comments. A name is a class or id,
whole or made of such a word and words of place (``sidebar-left``, ``ad-slot``, ``comment-list``);
an id does not name a heading, nor a section unless of comments. No name but that of reader comments
cuts an element that holds the page's largest article (or main part), or, menus, footers and asides apart,
paragraphs with most of its text.

The article is what remains of the elements that say so (article, main, a content name with most of the text).
Articles beside or inside the largest one are teasers if their heading is a link and they are under half as long,
or if they stand under another path and are under a quarter as long. On pages that say nothing the tree
chooses: the innermost block that holds nine tenths of the text outside links in branches of some importance,
and all first headings; blocks made of links are left out there. Paragraphs and
headings of an element that says it is the article are never cut by importance.

Pages are read in one pass: a tag is looked for once, and a quote or raw element that never closes is not looked for again.

The tree is aggregated by Spark on (host, path, content), so a host with a third
of all pages is reduced before it is shuffled. Only branches on at least half of
a host's pages can be cut, so a host's list is bounded by twice its mean page.

Defined results: null html or no text gives ""; null or odd urls share the host ""; repeated
pages count once in the tree. Extra columns pass through; scratch columns are prefixed ``_st_``.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pkgscreen.llm.base import broadcast_if, written

MIN_PAGES = 8
MIN_SHARE = 0.5
LOW = 0.15
MAX_BROADCAST_HOSTS = 2_000

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_STOP = re.compile(r""">|=\s*+["']?""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")
RAW = set("script style textarea title noscript iframe noframes xmp template svg select object annotation annotation-xml".split())
OPEN = set("noscript template svg select object annotation annotation-xml".split())  # left open they hide nothing
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
            "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NOISE_TAG = set("nav footer aside form button dialog menu head fieldset".split())
NOISE_WORD = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
                 "masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup share sharing social related recommended "
                 "recommendations comment comments disqus reply replies respond widget toolbar pagination pager login search skip".split())
NOISE_ROLE = set("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
COMMENT_WORD = set("comment comments commentlist disqus reply replies respond".split())
STRICT_TAG = set("nav footer aside menu dialog".split())  # hold no article by having most paragraphs
PLACE_WORD = set("area bar block body bottom box col column container content desktop fixed form global group holder inner item items left link links list main mobile outer "
                 "page panel posts primary region right row secondary section site slot sticky stories thread top unit wrap wrapper zone".split())
ALONE_WORD = set("skip alert".split())  # name nothing together with words of place
CONTENT_WORD = set("article content post entry story main".split())


def _says(tokens: set[str], words: set[str], more: frozenset[str] = frozenset()) -> bool:
    """Whether a token is one of the words, or is made of one and words of place (or ``more``)."""
    for token in tokens:
        if token in words:
            return True
        parts = [p for p in _WORDS.findall(token) if len(p) > 1]
        if any(p in words and p not in ALONE_WORD for p in parts) and all(p in words or p in PLACE_WORD or p in more for p in parts):
            return True
    return False


_OF_COMMENTS = frozenset(("author", "avatar", "meta", "text"))


class Node:
    __slots__ = ("tag", "names", "whole", "comment", "named", "holds", "role", "hidden", "parent", "block", "children", "path", "free", "total", "links", "heading", "leads")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.block = self if tag in BLOCK or parent is None else parent.block  # the innermost block around, itself included
        own = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
        self.names = set(_WORDS.findall(own.get("class", "") + " " + own.get("id", "")))
        classes, ids = set(own.get("class", "").split()), {own.get("id", "")}
        self.whole = classes | (set() if tag in HEADING or tag == "section" else ids)
        bare = tag in ("html", "body")
        self.comment = not bare and _says(classes | (set() if tag in HEADING else ids), COMMENT_WORD, _OF_COMMENTS)
        self.named = not bare and _says(self.whole, NOISE_WORD)
        self.holds = self.heading = self.leads = False
        self.free = self.total = self.links = 0
        self.role = own.get("role", "")
        self.hidden = "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "")
        label = f"{tag}.{own.get('class', '')}"
        self.path = zlib.crc32(label.encode("utf-8", "surrogatepass"), parent.path if parent else 0)
        if parent:
            parent.children.append(self)

    def article(self) -> bool:
        return self.tag == "article" or self.role == "article"

    def noise(self) -> bool:
        if self.hidden or self.comment:
            return True
        return not self.holds and (self.tag in NOISE_TAG or self.role in NOISE_ROLE or self.named)

    def header(self) -> bool:
        return not self.holds and (self.tag == "header" or _says(self.whole, {"header"}))


def _tag_end(page: str, at: int) -> int:
    """Where the tag ends whose attributes start at ``at``; -1 if a quoted value or the page runs out first."""
    while True:
        m = _STOP.search(page, at)
        if m is None or m[0] == ">":
            return m.start() if m else -1
        at = m.end()
        if m[0][-1] in "\"'":
            at = page.find(m[0][-1], at) + 1
            if not at:
                return -1


def parse(page: str) -> Node:
    """Tolerant tree of a page: children are nodes and strings in page order; raw elements and comments are dropped."""
    root = Node("#root", "", None)
    at, here, end = 0, root, len(page)
    opened: Counter[str] = Counter()
    unclosed: set[str] = set()  # raw elements without an end tag in the rest of the page
    quotes = True  # until a tag's quotes run to the end of the page

    def up(to: Node) -> Node:
        node = here
        while node is not to:
            opened[node.tag] -= 1
            node = node.parent
        return to

    while at < end:
        start = page.find("<", at)
        m = _NAME.match(page, start) if start >= 0 else None
        if m is None:
            if start >= 0 and page.startswith("<!--", start):
                stop = page.find("-->", start + 2)
                stop = end if stop < 0 else stop + 2
            elif start >= 0 and page.startswith(("<!", "<?"), start):
                stop = page.find(">", start)
            elif start >= 0:
                here.children.append(page[at:start + 1])
                at = start + 1
                continue
            else:
                stop = -1
            if stop < 0:
                here.children.append(page[at:])
                break
            here.children.append(page[at:start])
            at = stop + 1
            continue
        stop = _tag_end(page, m.end()) if quotes else -1
        if stop < 0:
            quotes, stop = False, page.find(">", m.end())
            if stop < 0:
                here.children.append(page[at:])
                break
        if start > at:
            here.children.append(page[at:start])
        at = stop + 1
        tag, attributes = m[2].lower(), page[m.end():stop]
        if m[1]:
            if opened[tag]:
                node = here
                while node.tag != tag:
                    node = node.parent
                here = up(node.parent)
            elif tag == "p" or tag == "br":
                here.children.append(" ")
            continue
        alone = attributes.endswith("/")
        if tag in RAW:
            if not alone:
                close = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(page, at)
                if close is None:
                    unclosed.add(tag)
                at = close.end() if close else at if tag in OPEN else end
            continue
        if tag in BLOCK:
            shut = CLOSES.get(tag, ())
            block = here.block
            while block.tag == "p" or block.tag in shut:
                here = up(block.parent)
                if block.tag == "p":
                    break
                block = here.block
        if tag in VOID:
            here.children.append("\n" if tag in ("br", "hr") else "")
            continue
        node = Node(tag, attributes, here)
        if not alone or tag in BLOCK:
            here = node
            opened[tag] += 1
    return root


def blocks(node: Node, skip) -> list[str]:
    """Texts of the blocks below ``node`` in page order, one space for white space, without branches that ``skip`` names."""
    out, text = [], []

    def flush():
        block = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
        text.clear()
        if block:
            out.append(block)

    stack = [(node, iter(node.children))]
    while stack:
        here, rest = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            if here.tag in BLOCK:
                flush()
        elif isinstance(child, str):
            text.append(child)
        elif not skip(child):
            if child.tag in BLOCK:
                flush()
            stack.append((child, iter(child.children)))
    flush()
    return out


def _walk(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]


def _mark(tree: Node) -> None:
    """Set each element's text lengths, links and headings, and ``holds`` where it holds the largest article (without any: main part) or paragraphs with most of the text."""
    order = list(_walk(tree))
    flags: dict[int, tuple[bool, bool, bool]] = {}  # in a paragraph, in a link, in reader comments
    said: list[list[Node]] = [[], []]
    inside = {id(n): 0 for n in order}
    for n in order:
        p, a, c = flags[id(n.parent)] if n.parent is not None else (False, False, False)
        flags[id(n)] = p or n.tag == "p", a or n.tag == "a", c or n.comment or n.hidden
        if not flags[id(n)][2]:
            if n.article():
                said[0].append(n)
            elif n.tag == "main" or n.role == "main":
                said[1].append(n)
    for n in reversed(order):
        p, a, _ = flags[id(n)]
        text = sum(len(c.strip()) for c in n.children if isinstance(c, str))
        n.total += text
        n.links += n.tag == "a"
        if not a:
            n.free += text
            inside[id(n)] += text if p else 0
        if n.tag in HEADING:
            n.heading, n.leads = True, n.total > 0 and n.free == 0
        up = n.parent
        if up is not None:
            up.total, up.free, up.links = up.total + n.total, up.free + n.free, up.links + n.links
            up.heading, up.leads = up.heading or n.heading, up.leads or n.leads
            inside[id(up)] += inside[id(n)]
    largest = max(said[0] or said[1], key=lambda n: n.free, default=None)
    around = set()
    if largest is not None and 4 * largest.free >= tree.free:
        while largest is not None:
            around.add(id(largest))
            largest = largest.parent
    for n in order:
        most = 2 * inside[id(n)] > tree.free and n.tag not in STRICT_TAG
        n.holds = n.tag != "p" and (id(n) in around or most)


def _teaser(node: Node, largest: Node) -> bool:
    """Whether an article is a teaser beside (or inside) the page's largest one."""
    return node is not largest and ((node.leads and 2 * node.free < largest.free) or (node.path != largest.path and 4 * node.free < largest.free))


def _links_only(node: Node) -> bool:
    return node.tag in BLOCK and node.tag != "p" and node.links >= 3 and 3 * node.free <= node.total


def _chosen(tree: Node, skip) -> Node:
    """The innermost block with nine tenths of the text outside links that ``skip`` leaves, and with all first headings left."""
    order, stack = [], [tree]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and not skip(c)]
    weight: dict[int, list[int]] = {id(n): [0, 0] for n in order}
    for n in reversed(order):
        own = weight[id(n)]
        own[0] += 0 if n.tag == "a" else sum(len(c.strip()) for c in n.children if isinstance(c, str))
        own[1] += n.tag == "h1"
        if n.parent is not None and n is not tree and n.tag != "a":
            weight[id(n.parent)][0] += own[0]
            weight[id(n.parent)][1] += own[1]
    here = tree
    while True:
        inner = [c for c in here.children if isinstance(c, Node) and id(c) in weight and c.tag in BLOCK and c.tag not in ("p", "pre", "ul", "ol", "table", *HEADING)]
        best = max(inner, key=lambda n: weight[id(n)][0], default=None)
        all_text, all_first = weight[id(here)]
        if best is None or 10 * weight[id(best)][0] < 9 * all_text or weight[id(best)][1] < all_first or not all_text:
            return here
        here = best


def _roots(tree: Node) -> tuple[list[Node], bool]:
    """The parts that say they hold the article, outermost first found; else the body. And whether they are said to."""
    def outermost(test):
        found, stack = [], [tree]
        while stack:
            node = stack.pop()
            if node.noise():
                continue
            if test(node):
                found.append(node)
            else:
                stack += [c for c in reversed(node.children) if isinstance(c, Node)]
        return found

    found = outermost(Node.article)
    if found:
        largest = max(found, key=lambda n: n.free)
        return [n for n in found if not _teaser(n, largest)], True
    found = outermost(lambda n: n.tag == "main" or n.role == "main")
    if found:
        return found, True
    found = outermost(lambda n: n.tag in ("div", "section", "td") and bool(n.names & CONTENT_WORD))
    if found and 2 * sum(n.free for n in found) >= tree.free:
        return found, True
    return [n for n in _walk(tree) if n.tag == "body"][:1] or [tree], False


def main_text(page: str | None, low: frozenset[int] = frozenset()) -> str:
    """The article's text; ``low`` are the paths of the host's branches of low importance."""
    if not page:
        return ""
    tree = parse(page)
    _mark(tree)
    roots, named = _roots(tree)
    largest = max(roots, key=lambda n: n.free)
    keep = {"p", "pre", "blockquote", "ul", "ol", "li", "table", "tr", "td", "tbody", "figure", *HEADING}
    menus = not named and not _links_only(roots[0])

    def skip(node: Node) -> bool:
        if node.noise() or (named and node.article() and _teaser(node, largest)):
            return True
        if node.header():
            return not named or not node.heading
        if node.parent is not None and node.parent.header() and named and node.tag not in HEADING:
            return not node.heading
        if menus and _links_only(node):
            return True
        return node.path in low and node.tag in BLOCK and not (named and (node.tag in keep or not node.names))

    if not named:
        roots = [_chosen(roots[0], skip)]
    return " ".join(block for root in roots for block in blocks(root, skip))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, style, content, page) of the block elements of each page, once per path and page."""
    for batch in batches:
        out: set[tuple] = set()
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = zlib.crc32((page or "").encode("utf-8", "surrogatepass"))
            seen: dict[int, list[int]] = {}
            for node, content in _contents(parse(page or "")):
                style = zlib.crc32(" ".join(c.tag for c in node.children if isinstance(c, Node)).encode())
                both = seen.setdefault(node.path, [0, 0])
                both[0], both[1] = zlib.crc32(b"%d" % style, both[0]), zlib.crc32(b"%d" % content, both[1])
            out |= {(host, path, style, content, own) for path, (style, content) in seen.items()}
        columns = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["host", "path", "style", "content", "page"])


def _contents(tree: Node) -> list[tuple[Node, int]]:
    """Block elements with a hash of the text below them."""
    order = list(_walk(tree))
    value: dict[int, int] = {}
    for node in reversed(order):
        h = 0
        for c in node.children:
            h = zlib.crc32(c.encode("utf-8", "surrogatepass"), h) if isinstance(c, str) else zlib.crc32(b"%d" % value[id(c)], h)
        value[id(node)] = h
    return [(n, value[id(n)]) for n in order if n.tag in BLOCK]


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    return pages.withColumn("_st_host", host)


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, n_pages, importance of each node of the hosts' style trees."""
    rows = with_host(pages).select("_st_host", "html").mapInArrow(_nodes, "host string, path long, style long, content long, page long").distinct()

    def entropy(value: str) -> DataFrame:
        counts = rows.groupBy("host", "path", value).agg(F.count(F.lit(1)).alias("c"))
        total = counts.groupBy("host", "path").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"))
        return total.select("host", "path", "m", F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * F.log("m"))).otherwise(1.0).alias("e"))

    rows = written(rows, "nodes")
    style, content = entropy("style"), entropy("content").withColumnRenamed("m", "n").withColumnRenamed("e", "f")
    return style.join(content, ["host", "path"]).select("host", "path", F.col("m").alias("n_pages"), F.greatest("e", "f").alias("importance"))


def low_branches(tree: DataFrame) -> DataFrame:
    """_st_of, low (array of paths): the branches to cut, per host that has any."""
    size = tree.groupBy("host").agg(F.max("n_pages").alias("pages")).withColumnRenamed("host", "_st_of")
    low = tree.where((F.col("n_pages") >= MIN_PAGES) & (F.col("importance") < LOW))
    low = low.join(size, F.col("host") == F.col("_st_of")).where(F.col("n_pages") >= MIN_SHARE * F.col("pages"))
    return low.groupBy("_st_of").agg(F.collect_set("path").alias("low"))


def _extractor(columns: tuple[str, ...]):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            texts = [main_text(page, frozenset(low or ())) for page, low in zip(get("html").to_pylist(), get("_st_low").to_pylist())]
            yield pa.RecordBatch.from_arrays([*map(get, columns), pa.array(texts, pa.string())], [*columns, "text"])

    return extract


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` without html, with ``text``."""
    low = written(low_branches(style_tree(pages)), "low").withColumnRenamed("low", "_st_low")
    columns = tuple(c for c in pages.columns if c not in ("html", "text"))
    rows = with_host(pages)
    rows = rows.join(broadcast_if(low, MAX_BROADCAST_HOSTS), F.col("_st_host") == F.col("_st_of"), "left").select(*columns, "html", "_st_low")
    schema = StructType([*pages.select(*columns).schema.fields, StructField("text", StringType())])
    return rows.mapInArrow(_extractor(columns), schema)
