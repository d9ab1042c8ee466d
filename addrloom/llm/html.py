"""Main text of web pages, with site templates removed by counting subtrees.

Every element's subtree is hashed: tag, name of its class and role, text and children.  Spark counts on how many
different pages of a host each hash occurs (copies, pages of one text, count once); a subtree on many of them is the
site's template and is deleted before the text is taken.  Where counting cannot tell (a site of few pages, a block that is
another on each page), tags and roles that are no article go too, and so do class names: whole ones like ``sidebar`` or ``site-footer``
for themselves, others that only begin or end like one (``share-price``, ``related-posts``) with a second sign, which is that the
subtree recurs or is mostly links.  The text of an ``article`` or ``main`` is the author's: inside it only containers can be
template, never its blocks of prose, and one with prose in it is not judged by its name alone unless it holds readers' comments.

A page is parsed where it lies; only hashes are shuffled: (host, content, page) once a page to find the copies, then
(host, hash) pairs, partially counted first.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from addrloom.llm.shared import stored

# different pages that make a subtree template: so many on any host, or fewer where they are this share of a small host's pages
MANY_PAGES, MIN_PAGES, SHARE = 10, 4, 0.2
# text of an article's container, in characters, from which it counts as prose
PROSE_LENGTH = 60

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
DROPPED = frozenset(
    "script style noscript template head title nav footer aside form iframe object svg canvas button select textarea "
    "option dialog menu video audio map noembed noframes input".split()
)
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 "
    "header hr hgroup html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption address hr".split())
# an open p ends where one of these begins, an open element of the key where one of its values begins
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body html article section div main td th".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
# words of class and id attributes that name no article
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads adv advert adverts "
    "advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice notices popup modal "
    "overlay comment comments commentlist disqus reply replies respond discussion share sharing social related "
    "recommended recommendations newsletter subscribe subscription signup login pagination pager widget form search".split()
)

# of these, the ones that also name the layout around an article, and the ones that may name its head
LAYOUT_WORDS = DROPPED_WORDS - frozenset(
    "comment comments commentlist disqus reply replies respond discussion related recommended recommendations".split()
)
HEAD_WORDS = frozenset("header masthead".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
# parts of a class name that say nothing about what it holds
PLAIN_WORDS = frozenset(
    "site page main top bottom left right box container wrapper wrap block bar section list area inner outer content primary secondary "
    "global row col column group item items panel buttons button links link unit slot".split()
)
# inside an article these name its own sections as well, so there only counting tells
SECTION_WORDS = HEAD_WORDS | frozenset("notice notices discussion search form menu banner cookie cookies consent".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|\Z)", re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")


@dataclass(slots=True)
class Node:
    tag: str
    marks: str = ""
    classes: str = ""
    role: str = ""
    hidden: bool = False
    around: bool = False  # an article is inside
    children: list = field(default_factory=list)  # nodes and texts
    hash: int = 0
    text: int = 0  # characters below, and those of links among them
    links: int = 0
    prose: bool = False  # a block of prose with text is below


def parse(source: str) -> Node:
    """The element tree: forgiving, without recursion, linear in the source."""
    root = Node("#root")
    stack, open_tags, at, n = [root], {}, 0, len(source)

    def close(depth: int) -> None:
        while len(stack) > depth:
            tag = stack.pop().tag
            open_tags[tag] -= 1

    while at < n:
        mark = source.find("<", at)
        if mark < 0:
            stack[-1].children.append(source[at:])
            break
        if mark > at:
            stack[-1].children.append(source[at:mark])
        token = _TOKEN.match(source, mark)
        if token is None:  # a lone <
            stack[-1].children.append("<")
            at = mark + 1
            continue
        at = token.end()
        if token[1]:
            tag = token[1].lower()
            if open_tags.get(tag):
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                close(depth)
            continue
        if not token[2]:
            continue
        tag = token[2].lower()
        if tag in BLOCKS and open_tags.get("p"):
            depth = len(stack) - 1
            while stack[depth].tag != "p" and stack[depth].tag not in SCOPES:
                depth -= 1
            if stack[depth].tag == "p":
                close(depth)
        if tag in CLOSES:
            depth = len(stack) - 1
            while depth and stack[depth].tag not in CLOSES[tag] and stack[depth].tag not in SCOPES - {"td", "th"}:
                depth -= 1
            if stack[depth].tag in CLOSES[tag]:
                close(depth)
        node = Node(tag)
        if token[3].strip(" /\t\r\n"):
            for m in _ATTRIBUTE.finditer(token[3]):
                name, value = m[1].lower(), next((g for g in m.groups()[1:] if g is not None), "")
                if name in ("class", "id"):
                    node.marks += " " + value.lower()
                    node.classes += " " + value.lower() if name == "class" else ""
                elif name == "role":
                    node.role = value.lower().strip()
                elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                    node.hidden = True
        stack[-1].children.append(node)
        if is_article(node):
            for above in reversed(stack):
                if above.around:
                    break
                above.around = True
        if tag in VOID or token[3].endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            node.children.append(source[at : end.start() if end else n])
            at = (source.find(">", end.start()) + 1 or n) if end else n
            continue
        stack.append(node)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    return root


def _names(marks: str) -> tuple[set[str], set[str]]:
    """Words that name no article: of class names made up of such words, and of names that only have one among others."""
    whole, part = set(), set()
    for token in marks.split():
        words = set(_WORD.findall(token))
        (whole if words <= DROPPED_WORDS | PLAIN_WORDS else part).update(words & DROPPED_WORDS)
    return whole, part


def is_boilerplate(node: Node, inside_article: bool, recurs: bool = False) -> bool:
    """By tag, role and names.  A form around an article is layout; inside an article blocks of prose, figures and ids,
    which are named by what they say, are not judged by names."""
    around_form = node.around and (node.tag == "form" or node.role == "form")
    if node.hidden or (node.tag in DROPPED or node.role in DROPPED_ROLES) and not around_form:
        return True
    if node.tag == "header" and not inside_article:
        return True
    if node.tag in ("html", "body") or inside_article and (node.tag in PROSE or node.tag == "figure"):
        return False
    marks = node.classes if inside_article or is_article(node) else node.marks
    if not marks:
        return False
    whole, part = _names(marks)
    spared = LAYOUT_WORDS if node.around else SECTION_WORDS if inside_article else frozenset()
    whole, part = whole - spared, part - spared
    second = recurs or node.links > 0 and 2 * node.links >= node.text
    if inside_article:
        alone = bool(whole & COMMENT_WORDS) or not node.prose and node.text < PROSE_LENGTH
        return bool(whole) and (alone or second) or bool(part) and second
    return bool(whole) or bool(part) and second


def measure(root: Node) -> list[Node]:
    """All elements in page order, with their characters of text, those of links, and whether they hold prose."""
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    for node in reversed(nodes):
        if node.tag in RAW:
            continue
        for c in node.children:
            if isinstance(c, Node):
                node.text += c.text
                node.links += c.links
                node.prose = node.prose or c.prose or c.tag in PROSE and c.text > c.links
            else:
                node.text += len("".join(c.split()))
        if node.tag == "a":
            node.links = node.text
    return nodes


def hash_subtrees(root: Node) -> list[Node]:
    """All elements in page order, measured and hashed, children before their parents."""
    nodes = measure(root)
    for node in reversed(nodes):
        digest = xxhash.xxh64(f"{node.tag}\x00{node.marks}\x00{node.role}")
        for c in node.children:
            digest.update(b"\x01" + c.hash.to_bytes(8, "little") if isinstance(c, Node) else b"\x02" + " ".join(c.split()).encode("utf-8", "surrogatepass"))
        node.hash = digest.intdigest()
    return nodes


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def candidates(source: str) -> tuple[int, set[int]]:
    """Hash of what the page says (of the whole page if it says nothing), and hashes of its subtrees that could be
    template: those with text, above single blocks of an article."""
    root = parse(source)
    hash_subtrees(root)
    said = _blocks_of(root, frozenset())
    content = signed(xxhash.xxh64_intdigest(said.encode("utf-8", "surrogatepass")) if said else root.hash)
    out, stack = set(), [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or is_article(node)
        if node.tag not in ("#root", "html", "body", "head") and not (inside and (node.tag in PROSE or node.tag not in BLOCKS or is_article(node))):
            out.add(signed(node.hash))
        stack.extend((c, inside) for c in node.children if isinstance(c, Node))
    return content, out


def is_article(node: Node) -> bool:
    return node.tag in ("article", "main") or node.role == "main"


def main_text(source: str, templates: frozenset[int] = frozenset(), rules: bool = True) -> str:
    """The blocks of the page's article (of all its articles, of the body if there is none) without template.  Without
    ``rules`` only what was counted is deleted, and what is never text: this is to measure what counting achieves."""
    root = parse(source)
    hash_subtrees(root) if templates else measure(root)
    return _blocks_of(root, templates, rules)


def _blocks_of(root: Node, templates: frozenset[int], rules: bool = True) -> str:
    def removed(node: Node, inside: bool) -> bool:
        recurs = bool(templates) and signed(node.hash) in templates and node.tag not in ("#root", "html", "body")
        if is_boilerplate(node, inside, recurs) if rules else node.tag in RAW or node.tag in ("head", "template"):
            return True
        return recurs and not (inside and (node.tag in PROSE or node.tag not in BLOCKS or is_article(node)))

    # the articles that stand, outermost first
    mains, stack = [], [root]
    while stack:
        node = stack.pop()
        if rules and is_article(node) and node is not root:
            if not is_boilerplate(node, False):
                mains.append(node)
            continue
        if node is root or not removed(node, False):
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    blocks, line = [], []

    def end_block() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            blocks.append(text)

    for main in mains or [root]:
        inside = bool(mains)
        stack = [(main, False)]
        while stack:
            node, leaving = stack.pop()
            if isinstance(node, str):
                line.append(entities.unescape(node))
            elif leaving:
                end_block()
            elif node is main or not removed(node, inside):
                if node.tag == "br":
                    line.append(" ")
                    continue
                if node.tag in BLOCKS:
                    end_block()
                    stack.append((node, True))
                stack.extend((c, False) for c in reversed(node.children))
        end_block()
    return "\n".join(blocks)


# -- on Spark ----------------------------------------------------------------------------------

def host(url: Column) -> Column:
    """Small letters, without user and port; empty for a null or odd address."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(pages: DataFrame, url_column: str = "url", html_column: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """``host`` and ``hashes``: the subtrees on at least ``many_pages`` different pages of the host, or on ``min_pages`` where these are
    a ``share`` of the host's different pages.  Pages of a host that say the same are one page.  Pages without a host have no
    common template."""
    rows = pages.select(host(F.col(f"`{url_column}`")).alias("host"), F.col(f"`{html_column}`").cast("string").alias("html"))
    rows = rows.where("host <> ''")
    schema = T.StructType([
        T.StructField("host", T.StringType()), T.StructField("content", T.LongType()), T.StructField("hashes", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # subtrees of the different pages of a batch; 0 stands for the page itself
        for batch in batches:
            found: dict[tuple[str, int], set[int]] = {}
            for name, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                content, hashes = candidates(source or "")
                found.setdefault((name, content), {0}).update(hashes)
            columns = [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64())]
            columns.append(pa.array([list(h) for h in found.values()], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    different = rows.mapInArrow(run, schema).select("host", "content", F.explode("hashes").alias("hash")).distinct()
    counts = stored(different.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(min_pages, many_pages)), "html-subtrees")
    whole = counts.where("hash = 0").select("host", F.col("n").alias("pages"))
    common = counts.where("hash <> 0").join(whole, "host").where((F.col("n") >= many_pages) | (F.col("n") >= share * F.col("pages")))
    return common.groupBy("host").agg(F.collect_list("hash").alias("hashes"))


def extract(
    pages: DataFrame, carry: tuple[str, ...] = ("page_id", "url"), url_column: str = "url", html_column: str = "html",
    min_pages: int = MIN_PAGES, share: float = SHARE, many_pages: int = MANY_PAGES, rules: bool = True,
) -> DataFrame:
    """``document`` (a struct of the carried columns) and ``text``: the main text, blocks joined by line feeds.

    Null and empty pages have an empty text, and so have pages of nothing but template.  Repeated pages each
    give a row, but count as one page when subtrees are counted.  Whole pages of any length are parsed; an empty table
    gives no rows; carried names cannot clash with results, as they stay inside the struct.
    """
    found = templates(pages, url_column, html_column, min_pages, share, many_pages)
    rows = pages.select(
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("document"),
        host(F.col(f"`{url_column}`")).alias("host"), F.col(f"`{html_column}`").cast("string").alias("html"),
    ).join(stored(found, "html-templates"), "host", "left").select("document", "html", "hashes")
    schema = T.StructType([rows.schema["document"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                main_text(source or "", frozenset(hashes or ()), rules)
                for source, hashes in zip(batch.column("html").to_pylist(), batch.column("hashes").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column("document"), pa.array(texts, pa.string())], names=["document", "text"])

    return rows.mapInArrow(run, schema)
