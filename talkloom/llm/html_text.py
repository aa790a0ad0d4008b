"""Main text of HTML pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from talkloom.llm.support import small_batches, table

# Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe noembed noframes textarea title xmp".split())
#: What browsers show only where they can't show something else, and what they never show as text.
FALLBACK = frozenset("object canvas audio video svg template select datalist map annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img label nobr "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mstyle mpadded mphantom menclose semantics".split()
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"},
}
SCOPES = frozenset("ul ol dl table html body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_BLOCKS = HEADINGS | frozenset("p pre blockquote ul ol dl table figure".split())
# Elements, roles and words in class or id of what is no article.
NOT_ARTICLE = frozenset("nav footer aside button input menu dialog head legend".split())
MAYBE_ARTICLE = frozenset("form fieldset".split())
NOT_ARTICLE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies".split())
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs footer sidebar cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets pagination "
    "pager toolbar masthead copyright skip".split()
)
HEADER_WORDS = frozenset("header topbar".split())
DISCUSSION = "discussion"
#: States in a class name, which say what a block has or lacks and not what it is: comments-open, has-sidebar.
STATES = re.compile(r"(?:^|\s)(?:has|no|with|without)-\S+|\S+-(?:open|closed|enabled|disabled|on|off)(?=\s|$)", re.I)

TAG = re.compile(r"""(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^>"'])*+)>""")
#: A tag whose quotes don't match ends at the next bracket.
PLAIN_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(
    r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.I
)
WORD = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden")


class Node:
    """A block element. parts are, in order, pieces of raw text, child nodes, and booleans that open or close a link.

    drop: no part of the article; kind: for what is unsure until sizes are known, why it may be none.
    """

    __slots__ = (
        "tag", "parent", "parts", "drop", "kind", "chars", "tags", "link_chars", "link_tags", "density", "density_sum",
        "holds_article", "holds_talk"
    )

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.parts = tag, parent, []
        self.drop = self.holds_article = self.holds_talk = False
        self.kind = ""
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.density_sum = 0.0

    def children(self) -> Iterator[Node]:
        return (p for p in self.parts if type(p) is Node)


def _words(value: str) -> set[str]:
    return set(WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", STATES.sub(" ", value)).lower()))


def _mark(node: Node, attributes: str, inside: bool) -> None:
    """What kind, role, style and names say of the element. inside: an article or main part is around it.

    Headings are never told by their names, and inside an article neither are sections and paragraphs by their ids,
    which are targets of links there.
    """
    if node.tag in NOT_ARTICLE or node.tag == "header" and not inside:
        node.kind = "kind"
    elif node.tag in MAYBE_ARTICLE:
        node.kind = "weak"
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return
    words: set[str] = set()
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "class" or name == "id" and not (inside and node.tag in ("section", "p")):
            words |= _words(value)
        elif name == "id" and DISCUSSION in _words(value):
            words.add(DISCUSSION)
        elif name == "role" and value.lower() in NOT_ARTICLE_ROLES:
            node.kind = "weak" if value.lower() == "form" else "kind"
        elif name == "style" and HIDDEN.search(value.lower()):
            node.drop = True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            node.drop = True
    if node.tag in HEADINGS:
        return
    if words & COMMENT_WORDS:
        node.kind = "talk"
    elif DISCUSSION in words:
        node.kind = node.kind or DISCUSSION
    elif words & OTHER_WORDS or words & HEADER_WORDS and not inside:
        node.kind = node.kind or "weak"


def parse(page: str) -> Node:
    """The tree of block elements. Unclosed and misplaced tags are read as browsers do in the common cases.

    One pass: what is looked for in vain once (a raw element's end tag, a matching quote) isn't looked for again.
    """
    root = Node("body", None)
    node, links, at = root, 0, 0
    inside = 0
    size = len(page)
    unended: set[str] = set()
    opened: Counter = Counter()
    tag_end = TAG
    while at < size:
        start = page.find("<", at)
        while start >= 0 and not (
            page[start + 1 : start + 2].isalpha() or page[start + 1 : start + 2] in ("!", "?", "/") and start + 1 < size
        ):
            start = page.find("<", start + 1)
        text = page[at:start] if start >= 0 else page[at:]
        if text:
            node.parts.append(text)
        if start < 0:
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else size
            continue
        m = tag_end.match(page, start + 1)
        if m is None:
            end = page.find(">", start + 1)
            if end < 0:
                break  # the page's end cuts a tag off
            if page[start + 1] in "!?" or not (m := PLAIN_TAG.match(page, start + 1)):
                at = end + 1
                continue
            tag_end = PLAIN_TAG
        at = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if tag in RAW:
            if not closing and not attributes.rstrip().endswith("/") and tag not in unended:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*+>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    at = size
                else:
                    unended.add(tag)
            continue
        if tag in INLINE:
            if tag == "a":
                if links:
                    node.parts.append(False)
                links = 0 if closing else 1
                if links:
                    node.parts.append(True)
            elif tag in ("br", "img"):
                node.parts.append(" ")
            continue
        if tag in ("html", "body"):
            continue
        if closing:
            if opened[tag]:
                if links:
                    node.parts.append(False)
                    links = 0
                while node.tag != tag:
                    inside -= node.tag in ("article", "main")
                    opened[node.tag] -= 1
                    node = node.parent
                inside -= node.tag in ("article", "main")
                opened[tag] -= 1
                node.drop |= tag in FALLBACK  # one that is never closed holds what follows it
                node = node.parent
            elif tag == "p":
                node.parts.append(Node("p", node))
            continue
        ends = {"p"} if tag in ENDS_PARAGRAPH else CLOSED_BY.get(tag)
        if ends and any(opened[x] for x in ends):
            up, found = node, None
            while up is not root and up.tag not in SCOPES and not (
                tag in ENDS_PARAGRAPH and up.tag in ("td", "th", "button")
            ):
                if up.tag in ends:
                    found = up
                    break
                up = up.parent
            if found is not None:
                if links:
                    node.parts.append(False)
                    links = 0
                while node is not found.parent:
                    inside -= node.tag in ("article", "main")
                    opened[node.tag] -= 1
                    node = node.parent
        if tag in VOID:
            node.parts.append(Node(tag, node))
            continue
        child = Node(tag, node)
        _mark(child, attributes, inside > 0)
        if links:
            child.parts.append(True)
        node.parts.append(child)
        node = child
        opened[tag] += 1
        inside += tag in ("article", "main")
    return root


def _measure(root: Node) -> list[Node]:
    """Counts of characters, tags and what of them links hold, without what is dropped; the nodes left, top down."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.drop:
            continue
        order.append(node)
        stack += reversed(list(node.children()))
    for node in reversed(order):
        in_link = False
        for part in node.parts:
            kind = type(part)
            if kind is str:
                n = len(" ".join(part.split()))
                node.chars += n
                if in_link:
                    node.link_chars += n
            elif kind is bool:
                in_link = part
                node.link_tags += part
                node.tags += part
            elif not part.drop:
                node.chars += part.chars
                node.link_chars += part.link_chars
                node.tags += part.tags + 1
                node.link_tags += part.link_tags
                node.holds_article |= part.holds_article or part.tag in ("article", "main", "h1") and part.kind != "talk"
                node.holds_talk |= part.holds_talk or part.kind == "talk" or part.tag in ("form", "textarea")
    return order


def _drop_unsure(root: Node, order: list[Node]) -> bool:
    """Drops what its kind or names say is no article.

    But for what holds most of the text of a page that marks no article elsewhere (menus apart, whose text is links);
    names and forms don't drop what holds an article, comments not what is most of the text, and a discussion has to
    hold comments or a form.
    """
    found = False
    for node in order:
        if not node.kind:
            continue
        main = node.chars > 0.6 * root.chars and node.link_chars <= 0.3 * node.chars
        if node.kind == "kind":
            keep = main and not root.holds_article
        elif node.kind == "talk":
            keep = main and (node.holds_article or node.tag in ("article", "main"))
        elif node.kind == DISCUSSION:
            keep = not node.holds_talk
        else:
            keep = node.holds_article or node.tag in ("article", "main") or main and (
                not root.holds_article or node.chars > 0.8 * root.chars
            )
        if not keep:
            node.drop = found = True
    return found


def _densities(root: Node, order: list[Node]) -> None:
    """Composite text density: characters per tag, less where links hold much of them; and its sums over children."""
    share = root.link_chars / max(root.chars, 1)
    for node in order:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        value = c / max(lc, 1) * (t / max(lt, 1))
        node.density = (
            c / t * (math.log(value) / math.log(base) if base > 1 else 1.0)
        ) if c else 0.0  # base is 1 on a page without links
    for node in order:
        node.density_sum = sum(x.density for x in node.children() if not x.drop)


def _main_node(root: Node, order: list[Node]) -> tuple[Node, float]:
    """The node of largest density sum, and the least density on its path to the body."""
    best = max(order, key=lambda n: n.density_sum)
    path, threshold = best, best.density
    while path.parent is not None:
        path = path.parent
        threshold = min(threshold, path.density)
    return best, threshold


def _blocks(node: Node, only: set[int] | None) -> Iterator[str]:
    """Text between the borders of block elements, in page order."""
    run: list[str] = []
    stack: list = [iter(node.parts)]
    owners = [node]
    while stack:
        part = next(stack[-1], None)
        if part is None:
            stack.pop()
            owners.pop()
            yield "".join(run)
            run = []
        elif type(part) is str:
            run.append(part)
        elif type(part) is Node and not part.drop and not (
            only is not None and owners[-1] is node and id(part) not in only
        ):
            yield "".join(run)
            run = []
            stack.append(iter(part.parts))
            owners.append(part)


def main_text(page: str | None) -> str:
    """The article's text: one line a block, white space runs as one space, character references decoded.

    Elements whose kind, role or names say that they are no article go first. Of the rest, the node with the
    largest sum of its children's composite densities is the article's core; it grows to its ancestors as long as
    these are an article or hold other children at least as dense as the least dense node between core and body.
    """
    if not page:
        return ""
    root = parse(page)
    order = _measure(root)
    if _drop_unsure(root, order):
        for node in order:
            node.chars = node.tags = node.link_chars = node.link_tags = 0
        order = _measure(root)
    _densities(root, order)
    region, threshold = _main_node(root, order)
    only = None
    up = region
    while up.parent is not None:
        up = up.parent
        dense = [c for c in up.children() if not c.drop and c.chars and c.density >= threshold]
        if up.tag in ("article", "main") or len(dense) > 1:
            chosen = {id(c) for c in dense}
            below = region
            while below.parent is not up:
                below = below.parent
            known = up.tag in ("article", "main")
            few_links = [c for c in up.children() if (known or c.tag in TEXT_BLOCKS) and c.link_chars <= 0.5 * c.chars]
            only = chosen | {id(below)} | {id(c) for c in few_links}
            region = up
    lines = (" ".join(html.unescape(b).split()) for b in _blocks(region, only))
    return "\n".join(line for line in lines if line)


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """page_id, url and text of every row; a null or empty html gives the empty text.

    Rows are kept one to one, repeated and null ids included; other columns are ignored.
    """

    small_batches(pages.sparkSession)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                ["page_id", "url", "text"]
            )

    rows = pages.select(
        F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html")
    )
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes[:2])
    return rows.mapInArrow(extracted, f"{kinds}, text string")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
