"""HTML extraction by composite text density.

A page becomes a tree; blocks that are no article (menus, headers, footers, sidebars, notices, adverts, forms, comments) are cut
off by tag, role and name (a name that is only part of a longer one cuts off what is mostly links); the rest is rated by
link-adjusted characters per tag. The node with the largest sum of its children's densities is the article, where marks inside a
paragraph are no children (else a paragraph with links would be an article without its heading); the least density on the path from it
to the body is the threshold for what it keeps. Beside it, in page order, the node of the largest sum in every other branch that
reaches the threshold is kept.
Edge cases: null html is empty and gives an empty text; broken markup is read as far as it goes; very long or deep pages take time in
proportion to their length; of equal sums the outer, then the first node is taken; repeated rows give one result each; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

import bisect
import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, text_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math select object canvas".split())
DROPPED = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math select object canvas head nav footer aside form button dialog menu".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Tags whose start ends an open paragraph, and what else a start tag ends, down to the tags that hold it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = frozenset("table td th caption button object html body".split())
#: Words in class, id or role that mark what is not the article.
WORDS = r"ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|header|masthead|footer|sidebar|aside|widget|cookies?|consent|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|comments?|disqus|replies|reply|responses|complementary|contentinfo|search|toolbar|pagination|pager|skip|legal|copyright"
#: As a whole value or in a compound known for it they do; beside a hyphen or underscore they also occur in names of an article's parts.
CERTAIN = re.compile(
    rf"(?:{WORDS}"
    r"|(?:ads?|advert\w*|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|footer|sidebar|cookies?|consent|newsletter|login|signup|share|sharing|comments?|toolbar|pagination)[-_](?:banner|notice|bar|box|popup|modal|overlay|container|wrapper|inner|widget|menu|links?|list|buttons?|icons?|form|area|block|slot|unit|panel|message)"
    r"|(?:site|global|top|bottom|left|right|primary|secondary)[-_](?:header|footer|nav\w*|menu|banner|sidebar|masthead|toolbar)"
    r"|social[-_](?:links|icons|buttons|share|sharing|media)|related[-_](?:posts|articles|stories|links)|search[-_](?:form|box|bar)|skip[-_]links?)",
    re.I,
)
NOISE = re.compile(rf"(?:^|[\s_-])(?:{WORDS})(?=$|[\s_-])", re.I)
#: What names never cut off.
NAMED = frozenset("h1 h2 h3 h4 h5 h6 hgroup p".split())
KEEP = frozenset(("article", "main", "body", "html"))
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "kids", "parent", "dropped", "chars", "tags", "link_chars", "link_tags", "density", "total", "peak", "block", "low", "bare")

    def __init__(self, tag: str, parent, dropped: bool = False):
        self.tag, self.parent, self.dropped, self.kids = tag, parent, dropped, []


def noisy(tag: str, attributes: str, inside: bool) -> bool | None:
    """inside: within an article, whose own header is kept. None: the name is in doubt, and links decide."""
    if tag in DROPPED:
        return True
    if tag == "header":
        return not inside
    if not attributes or tag in KEEP:
        return False
    doubt = False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name in ("class", "id", "role") and tag not in NAMED and NOISE.search(value):
            if any(CERTAIN.fullmatch(v) for v in value.split()):
                return True
            doubt = True
    return None if doubt else False


class Open:
    """The stack of open elements, with the places of each tag in it, so that no search walks up the tree."""

    def __init__(self, root: Node):
        self.stack, self.places, self.scopes = [root], {}, []

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def last(self, tag: str) -> int:
        at = self.places.get(tag)
        return at[-1] if at else -1

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(node)

    def cut(self, depth: int) -> None:
        """Ends all elements from this place on."""
        while len(self.stack) > depth:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()

    def scope(self) -> int:
        return self.scopes[-1] if self.scopes else 0


def parse(page: str) -> Node:
    """The tree under a root node; text is str among the children. Open elements end as browsers end them, in the common cases.

    Takes time in proportion to the page, however deep it is nested.
    """
    root = Node("#root", None)
    open_, body = Open(root), None
    pos, n = 0, len(page)
    while pos < n:
        m = TOKEN.search(page, pos)
        if not m:
            open_.top.kids.append(page[pos:])
            break
        if m.start() > pos:
            open_.top.kids.append(page[pos : m.start()])
        pos = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                open_.top.kids.append(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = m[2].lower()
        if m[1]:
            # an inline element isn't ended from inside a cell or button
            at = open_.last(tag)
            if tag not in ("body", "html") and at > 0 and (tag == "p" or tag in BLOCK or at >= open_.scope()):
                open_.cut(at)
            continue
        if tag in ("html", "body"):
            if tag == "body" and body is None:
                body = Node("body", root)
                root.kids.append(body)
                open_.cut(1)
                open_.push(body)
            continue
        if body is not None and len(open_.stack) == 1 and tag not in RAW and tag != "head":
            open_.push(body)
        if tag in BLOCK and open_.last("p") > open_.scope():
            open_.cut(open_.last("p"))
        if tag in CLOSES:
            ends, holders = CLOSES[tag]
            held = max(open_.last("body"), *(open_.last(x) for x in holders), 0)
            inner = [places[k] for x in ends if (places := open_.places.get(x)) and (k := bisect.bisect_right(places, held)) < len(places)]
            if inner:
                open_.cut(min(inner))
        attributes = m[3] or ""
        node = Node(tag, open_.top, noisy(tag, attributes, open_.last("article") > 0 or open_.last("main") > 0))
        open_.top.kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.I).search(page, pos)
            pos = end.end() if end else n
        elif tag not in VOID and not attributes.endswith("/"):
            open_.push(node)
    return root


def cut_doubtful(root: Node) -> bool:
    """Cuts off the nodes of doubtful names that are mostly links, after `rate`; whether there were any."""
    found, stack = False, [root]
    while stack:
        node = stack.pop()
        if node.dropped is None and node.link_chars > 0.5 * node.chars:
            node.dropped = found = True
            continue
        stack.extend(k for k in node.kids if isinstance(k, Node) and not k.dropped)
    return found


def rate(root: Node) -> tuple[float, float]:
    """Sets the counts of every kept node; returns the link characters and characters of the body."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(k for k in node.kids if isinstance(k, Node) and not k.dropped)
    for node in reversed(order):
        own = sum(len(SPACE.sub(" ", entities.unescape(k)).strip()) for k in node.kids if isinstance(k, str))
        kids = [k for k in node.kids if isinstance(k, Node) and not k.dropped]
        node.chars = own + sum(k.chars for k in kids)
        node.tags = sum(k.tags + 1 for k in kids)
        node.link_chars = node.chars if node.tag == "a" else sum(k.link_chars for k in kids)
        node.link_tags = sum(k.link_tags + (k.tag == "a") for k in kids)
        node.block = node.tag in BLOCK or any(k.block for k in kids)
    link, chars = root.link_chars, max(root.chars, 1)
    for node in order:
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        unlinked = max(c - node.link_chars, 1)
        base = math.log(c / unlinked * node.link_chars + link / chars * c + math.e)
        node.density = c / t * (math.log(max(c / lc * t / lt, 1.0)) / math.log(base) if base > 1.0001 else math.log(max(c / lc * t / lt, 1.0))) if c else 0.0
    for node in reversed(order):
        kids = [k for k in node.kids if isinstance(k, Node) and not k.dropped]
        # marks inside a paragraph aren't parts of a page
        node.total = sum(k.density for k in kids if k.block)
        node.peak = node
        for k in kids:
            if k.peak.total > node.peak.total:
                node.peak = k.peak
    for node in order:
        above = node.parent if node is not root else None
        node.low = node.density if above is None else min(above.low, node.density)
        node.bare = plain(node) if above is None else min(above.bare, plain(node))
    return link, chars


def blocks(node: Node, threshold: float, out: list[str]) -> None:
    """The texts of the blocks under node, in order. Among block children of mixed nodes those under the threshold that are mostly links go."""
    run: list[str] = []

    def flush():
        text = SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    stack = [iter((node,))]
    ends: list[bool] = [False]
    while stack:
        k = next(stack[-1], None)
        if k is None:
            stack.pop()
            if ends.pop():
                flush()
            continue
        if isinstance(k, str):
            run.append(entities.unescape(k))
            continue
        if k.dropped:
            if k.tag in BLOCK:
                flush()
            continue
        if k.tag in ("br", "wbr"):
            run.append(" " if k.tag == "br" else "")
            continue
        block = k.tag in BLOCK
        if block and k is not node and k.density < threshold and k.chars and k.link_chars > 0.5 * k.chars:
            flush()
            continue
        if block:
            flush()
        stack.append(iter(k.kids))
        ends.append(block)
    flush()


def plain(node: Node) -> float:
    """Characters outside links per tag. Unlike the density it does not grow with a node's size."""
    return (node.chars - node.link_chars) / max(node.tags, 1)


def branches(top: Node, dense) -> list[Node]:
    """The node of the largest sum under top and those of all `dense` branches beside the path to it, in page order."""
    out, stack = [], [top]
    while stack:
        node = stack.pop()
        if node.peak is node:
            out.append(node)
            continue
        kids = [k for k in node.kids if isinstance(k, Node) and not k.dropped]
        stack.extend(k for k in reversed(kids) if k.peak is node.peak or k.tag in BLOCK and k.chars and dense(k) and k.link_chars <= 0.5 * k.chars)
    return out


def extract(page: str) -> str:
    root = parse(page)
    body = next((k for k in root.kids if isinstance(k, Node) and k.tag == "body"), root)
    rate(body)
    if cut_doubtful(body):
        rate(body)
    best = body.peak
    threshold, bare = best.low, best.bare
    # a short part has a smaller density than a long one of the same paragraphs
    dense = lambda k: k.density >= threshold or plain(k) >= bare
    chosen = branches(body, dense)
    out: list[str] = []
    for node in chosen:
        blocks(node, min(threshold, node.low), out)
    return "\n\n".join(out)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row, where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    src = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), text_of(pages["html"]).alias("html"))
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
