"""HTML extraction by composite text density.

Every DOM node gets a density: its characters per tag, adjusted by how many of them stand in links.
The density sum of a node adds up its children's. The body's density, and the least one on the path
from the body to the node of the largest sum, are the thresholds: below the latter nothing is
content, and of every node that reaches it the subtree with the largest density sum belongs to the
article, which may thus stand in several boxes.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, small_batches, table

#: Tag names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
NEVER = frozenset("script style textarea title noscript iframe noembed noframes template svg math head form button select option input nav footer aside header menu dialog object canvas audio video map".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())
CLOSES_P = BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: A start tag closes an open element of these names, up to an element of the names after the bar.
IMPLIED = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tr td th tbody thead tfoot", "table"), "thead": ("tr td th tbody thead tfoot", "table"), "tfoot": ("tr td th tbody thead tfoot", "table")}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}

#: Words of class, id or role that name something beside the article.
BESIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banners?|nav|navbar|navigation|menus?|breadcrumbs?|footer|header|masthead|side-?bar|aside|widgets?|related|recommend\w*|comments?|comment-?list|respond|replies|reply|disqus|share|sharing|social|cookies?|consent|gdpr|notices?|alerts?|pop-?ups?|modal|overlay|newsletter|subscri\w*|sign-?up|login|paywall|pagination|pager|copyright|legal|disclaimer|toolbar|skip-?links?|search\w*|form|complementary|contentinfo|tags?|byline)(?=$|[\s_-])",
    re.I,
)
#: Names of an article that is not the page's.
OTHER = re.compile(r"^(?:comments?|reply|replies|respond|related|recommend\w*|promo\w*|sponsor\w*|widgets?)(?=$|[_-])", re.I)
#: Words that say what kind of box it is, not what is in it: with one of BESIDE they name something beside the article.
BOX = frozenset("ad area articles bar block blocks box boxes button buttons card cards col column feed form grid group heading icon icons inline inner item items left link links list media message more note panel popular post posts reading right row section slot small stories story text thread title top bottom unit widget".split())
#: Words of a box of readers' comments, which is beside the article however much is in it, and of what stands around one.
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
AROUND = frozenset("container wrapper user reader readers area".split())
#: From here on, a name says that something is or isn't beside the article, not that this is it.
WITH = re.compile(r"(?:^|[_-])(?:has|with|without|no|not)[_-].*", re.I | re.S)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
#: Where markup that the page doesn't end begins.
UNENDED = re.compile(r"<[a-zA-Z/!?]")
TABLE = ("table", "td", "th")
IN_TABLE = frozenset(("table", "tr", "tbody", "body", "html", "div", "article", "section", "main"))
P_ENDS = frozenset(("td", "th", "table", "button", "object", "body"))
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I | re.S)


class Node:
    __slots__ = ("tag", "parent", "children", "aside", "named", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, aside: bool = False, named: str = ""):
        self.tag, self.parent, self.aside, self.named = tag, parent, aside, named
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


class _Open:
    """The path of open elements, and the depths of those of each name: looking for the nearest doesn't walk the path."""

    def __init__(self, root: Node):
        self.path, self.depths = [root], {root.tag: [0]}

    @property
    def node(self) -> Node:
        return self.path[-1]

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.path))
        self.path.append(node)

    def nearest(self, names) -> int:
        """Depth of the nearest open element of these names, or -1."""
        return max((self.depths[x][-1] for x in names if self.depths.get(x)), default=-1)

    def close(self, depth: int) -> None:
        """Closes the element at this depth and all inside it."""
        while len(self.path) > depth:
            self.depths[self.path.pop().tag].pop()

    def close_implied(self, names, within) -> None:
        """Closes the nearest open element of these names, if none of `within` is inside it."""
        if (at := self.nearest(names)) > self.nearest(within):
            self.close(at)


def parse(html: str) -> Node:
    """A tree of the page, in one pass. Start tags close what HTML lets them close; stray end tags and a tag that
    doesn't end are passed over. References are decoded in each run of text: none is made of text on both sides of a tag."""
    root = Node("html", None)
    opened = _Open(root)
    opened.push(Node("body", root))
    body = opened.node
    root.children.append(body)

    def add(text: str) -> None:
        opened.node.children.append(entities.unescape(text))

    at, n, last = 0, len(html), html.rfind(">") + 1
    while at < n:
        m = TOKEN.search(html, at, last) if at < last else None
        if not m:
            end = UNENDED.search(html, max(at, last))
            add(html[at : end.start() if end else n])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                opened.node.children.append(m[0][9:].removesuffix("]]>"))
            elif m[0].startswith("<!--") and not m[0].endswith("-->"):
                break
            continue
        if m[1] or m[4]:
            found, barrier = opened.nearest((name,)), opened.nearest(TABLE) if name not in IN_TABLE else -1
            if found > 0 and found >= barrier and opened.path[found] is not body:
                opened.close(found)
            elif name == "p":
                opened.node.children.append(Node("p", opened.node))
            continue
        attributes = m[3] if m[3] is not None else m[6] or ""
        if name in ("html", "body"):
            continue
        if name != "head" and name in CLOSES_P:
            opened.close_implied(("p",), P_ENDS)
        if name in IMPLIED:
            opened.close_implied(*IMPLIED[name])
        if opened.node.tag == "head" and name not in RAW and name not in VOID:
            opened.close(len(opened.path) - 1)
        heads_article = name == "header" and opened.nearest(("article", "main")) > 0  # its headline
        child = Node(name, opened.node, not heads_article and _aside(name, attributes), _named(name, attributes))
        opened.node.children.append(child)
        if name in VOID or attributes.rstrip().endswith("/") and name in ("svg", "path", "math"):
            continue
        if name in RAW:  # their text is not markup
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
            continue
        opened.push(child)
    return root


def _aside(name: str, attributes: str) -> bool:
    if name in NEVER:
        return True
    if name in ("article", "main", "html", "body") or not attributes.strip():
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _named(name: str, attributes: str) -> str:
    """What class, id and role say: 'comments' of a box of readers' comments, 'only' where they say nothing but that this
    is beside the article, 'partly' where they mention such a word among others, else ''. An article may have tags and a
    header: only other words count for it."""
    found = ""
    words_beside = OTHER if name in ("article", "main") else BESIDE
    for m in ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role"):
            words = [WITH.sub("", w) for w in (m[2] or m[3] or m[4] or "").split()]
            beside = [bool(words_beside.search(w)) for w in words]
            if not any(beside):
                continue
            parts = [[x for x in re.split(r"[_-]+", w.lower()) if x and not x.isdigit()] for w in words]
            said = {x for p in parts for x in p}
            if said & COMMENTS and said <= COMMENTS | BOX | AROUND:
                return "comments"
            if all(parts) and all(w and (x in BOX or BESIDE.fullmatch(x)) for w, p in zip(words, parts, strict=True) for x in p):
                found = "only"
            elif not found:
                found = "partly"
    return found


def _set_aside(root: Node, body: Node) -> None:
    """Elements that are beside the article by their name can't be it, unless they hold it: a main, an article where
    none stands elsewhere, or, of comments, a first-level heading. A name that says other things too counts only where
    the text agrees: inside an article, a main or the densest subtree the box must be links for the most part, elsewhere
    it must not have most of the body's characters. If nothing would be left, names other than of comments don't count."""
    nodes = _walk(root)
    if not any(x.named and x.tag not in ("article", "main") for x in nodes):
        return
    holds, free = {}, {}
    for node in nodes:  # parents first
        free[node] = node.parent is None or free[node.parent] and (not node.named or node.tag in ("article", "main"))
    elsewhere = any(free[x] and not x.named and x.tag in ("article", "main") for x in nodes)
    for node in reversed(nodes):
        inner = [x for x in node.children if isinstance(x, Node) and not node.aside]
        holds[node] = {x.tag for x in inner if x.tag in ("article", "main", "h1") and not x.named}.union(*(holds[x] for x in inner))
    named = [x for x in nodes if x.named and not x.aside and x.tag not in ("article", "main")]
    spared = lambda x: "main" in holds[x] or "article" in holds[x] and not elsewhere
    for node in named:
        if node.named != "partly":
            node.aside = not spared(node) and not (node.named == "comments" and "h1" in holds[node])
    left = densities(root, body)
    if any(x.named == "partly" for x in named):
        best = max(left, key=lambda x: x.total)
        around, inside = set(), {}
        up: Node | None = best
        while up is not None:
            around.add(up)
            up = up.parent
        for node in left:  # parents first
            inside[node] = inside.get(node.parent, False) or node is best or node.tag in ("article", "main") and not node.named
        for node in left:
            if node.named == "partly" and node.tag not in ("article", "main") and not spared(node) and node not in around:
                node.aside = 2 * node.link_chars >= node.chars if inside[node] else 2 * node.chars <= body.chars
    if not any(x.chars for x in densities(root, body) if x is not root):
        for node in named:
            node.aside = node.named == "comments" and node.aside


def _walk(root: Node) -> list[Node]:
    """All nodes, parents first, but for those inside elements that can't be an article."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        if not node.aside:
            stack += [x for x in reversed(node.children) if isinstance(x, Node)]
    return out


def densities(root: Node, body: Node) -> list[Node]:
    """Sets every node's density and density sum; returns the nodes, parents first.

    Characters in elements that can't be an article (scripts, menus, forms) don't count.
    """
    nodes = _walk(root)
    for node in nodes:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.density = node.total = 0.0
    for node in reversed(nodes):
        if node.aside:
            node.tags, node.link_tags = 1, 0
            continue
        for x in node.children:
            if isinstance(x, Node):
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags
            else:
                node.chars += len("".join(x.split()))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        if not c:
            continue
        plain = max(1, c - lc)
        base = math.log(c * lc / plain + share * c + math.e)
        node.density = c / t * max(0.0, math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(base)) if base > 1.0 else c / t
    for node in nodes:
        node.total = sum(x.density for x in node.children if isinstance(x, Node))
        # a node's own text counts as a child of one tag
        node.total += sum(len("".join(x.split())) for x in node.children if isinstance(x, str)) if not node.aside else 0
    return nodes


def extract(html: str | None) -> str:
    """The article's text: blocks in page order, white space within a block made one space, blocks joined by one space."""
    if not html:
        return ""
    root = parse(html.replace("\x00", ""))
    body = root.children[0]
    _set_aside(root, body)
    nodes = [x for x in densities(root, body) if x.chars and x is not root]
    if not nodes:
        return ""
    best = max(nodes, key=lambda x: x.total)  # ties: the first in page order
    threshold, up = best.density, best
    while up is not root:
        threshold = min(threshold, up.density)
        up = up.parent
    peaks: dict[Node, Node] = {}
    for node in reversed(nodes):
        peaks[node] = node
        for x in node.children:
            if x in peaks and peaks[x].total > peaks[node].total:
                peaks[node] = peaks[x]
    chosen = {peaks[x] for x in nodes if x.density >= threshold}
    article: dict[Node, Node | None] = {}  # the outermost article or main around a node, or itself
    for node in nodes:  # parents first
        article[node] = article.get(node.parent) or (node if node.tag in ("article", "main") else None)
    if article[best]:  # the page says where its articles are: those with content, whole
        chosen = {article[x] for x in chosen if article[x]}
    else:
        chosen = _widened(nodes, chosen, body)
    out, inside = [], set()
    for node in nodes:  # parents first: the outermost of nested ones
        if node.parent in inside:
            inside.add(node)
        elif node in chosen:
            inside.add(node)
            out.append(blocks(node))
    return " ".join(x for x in out if x)


def _widened(nodes: list[Node], chosen: set[Node], body: Node) -> set[Node]:
    """chosen with the boxes that hold little else: headings and paragraphs beside the densest blocks belong
    to the article. The body only around several."""
    out, covered = set(chosen), {}
    for node in reversed(nodes):
        parts = [covered[x] for x in node.children if covered.get(x)]
        if node not in out and parts and (node is not body or len(parts) > 1) and node.chars <= 1.1 * sum(parts):
            out.add(node)
        covered[node] = node.chars if node in out else sum(parts)
    return out


def blocks(top: Node) -> str:
    out, line = [], []

    def close() -> None:
        if text := " ".join("".join(line).split()):
            out.append(text)
        line.clear()

    stack: list[tuple[Node | str, bool]] = [(top, False)]
    while stack:
        x, left = stack.pop()
        if isinstance(x, str):
            line.append(x)
        elif left:
            close()
        elif x.aside and x is not top or _links_only(x) and x is not top:
            if x.tag in BLOCK:
                close()
        else:
            if x.tag in BLOCK:
                close()
                stack.append((x, True))
            stack += [(y, False) for y in reversed(x.children)]
    close()
    return " ".join(out)


def _links_only(node: Node) -> bool:
    """A list or box that is nothing but links is a menu."""
    return node.tag in ("ul", "ol", "dl", "div", "section", "table") and node.link_tags >= 2 and node.link_chars >= 0.8 * node.chars


def extract_pages(pages: DataFrame, source: str = "html", target: str = "text") -> DataFrame:
    """pages with the article of `source` in `target`, in place of a column of that name.

    Lists and boxes that are links for the most part (two or more) count as menus, inside the article too. A null, an empty page or one without text gives the empty string; repeated rows give the same text each; a
    page of any length or depth is read once, whole. Null ids and columns of any other name pass through; an
    empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c != target or c == source]
    (made,) = free(pages, "__text")
    schema = pages.select(*kept).withColumn(made, F.lit("")).schema

    def run(batches):
        for batch in batches:
            texts = [extract(x) for x in batch[source].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(texts, pa.string())], names=[*kept, made])

    out = pages.select(*kept).mapInArrow(run, schema)
    return out.drop(target).withColumnRenamed(made, target)


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_pages(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
