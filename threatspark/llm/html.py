"""Main text of web pages by site template removal.

Each page is parsed into its element tree. Every block element with text is hashed with all below it (tag, class, id, text
and children); Spark counts on how many different pages of a host each hash occurs, and subtrees that recur on many of
them are template: they are deleted, together with what is boilerplate by its element, role or class. Many are
``LEAST_PAGES``, however large the host. Only headings, list items and table cells on their own, which are equal by chance
("Introduction", "5"), must also recur on ``LEAST_SHARE`` of the host's pages.

Inside an article only containers are compared: paragraphs, headings and lists of an article (or of a ``main`` without
one) are its text even where several pages share them. What stands outside of articles is text, too, unless it is template
or boilerplate; loose text in no block of the body is compared as the block it would make.

A class or id marks boilerplate if one of its names is a word of the list, alone or beside words of place and shape only
(``sidebar``, ``comment-list``; not ``has-sidebar`` or ``related-work``); paragraphs and headings are never marked so inside an
article. What is marked stays if it holds an article, or most of the text of a page without one. Forms, dialogs, asides and
hidden containers stay if they hold most of the page's text, and all but asides if they hold the larger part of its articles.
Only comments and lists of other articles go whatever they hold, unless the page has no other text. What the names can't tell,
the counts decide.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatspark.llm.common import settled, ship_code
from threatspark.llm.urls import host_of

LEAST_PAGES = 10
LEAST_SHARE = 0.2

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_TEXT_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tr td th figure figcaption address".split())
#: Parts of a text, list or table, that are equal on many pages by chance.
_PARTS = frozenset("h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot figcaption".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_PROSE = _HEADINGS | {"p", "blockquote", "pre", "figure", "figcaption", "table"}
_LISTS = frozenset("ul ol dl".split())
_DROPPED = frozenset(
    "head script style noscript template nav footer menu iframe embed applet svg canvas audio video "
    "select button input textarea fieldset datalist noembed noframes title link meta".split()
)
#: Boilerplate unless the page's text is in them; the same by role.
_WRAPPERS = frozenset("aside form dialog".split())
_WRAPPER_ROLES = frozenset("complementary form dialog".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in class or id that mark boilerplate.
_DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner banners breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies disclaimer disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices "
    "notification notifications overlay pager pagination popup promo promos promotion recommended related replies reply respond "
    "share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Those of them that mark boilerplate even where it is made of ``article`` elements.
_LISTED_WORDS = frozenset("comment comments commentlist disqus recommended related replies reply respond".split())
#: Words that make a list one of readers' contributions.
_THREAD_WORDS = frozenset("discussion discussions thread threads responses conversation".split())
#: Words of place and shape beside the marking one.
_COMPANIONS = frozenset(
    "area article articles bar block bottom box buttons button center col column container content desktop fixed form global group header "
    "inner inline item items left link links list main mobile module outer page panel post posts primary right row secondary section site slot "
    "sticky top unit user widget wrap wrapper".split()
)
_KNOWN_WORDS = _DROPPED_WORDS | _THREAD_WORDS | _COMPANIONS
_CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}, "option": {"option"},
}
_SCOPE = {
    "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"},
    "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"},
}
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "marks", "role", "hidden", "children", "digest", "has_article", "size", "held", "most", "holds", "alone", "bare")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.children, self.digest, self.has_article = tag, [], b"", False
        self.marks, self.role, self.hidden = "", "", False
        self.size, self.held = 0, 0  # words without those of boilerplate, and those of them in articles
        self.most, self.holds = True, True  # whether these are the larger part of the page's; known at its end
        self.alone, self.bare = False, True  # the page has no text but in what is marked; it has no article
        if attributes and not attributes.isspace():
            for m in _ATTRIBUTE.finditer(attributes):
                name = m[1].lower()
                if name in ("class", "id"):
                    self.marks += f"{name}={m[2] or m[3] or m[4] or ''} "
                elif name == "role":
                    self.role = (m[2] or m[3] or m[4] or "").strip().lower()
                elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", m[2] or m[3] or "", re.I):
                    self.hidden = True

    def boilerplate(self, inside: bool = False) -> bool:
        """By element, role or class; outside of articles (``inside``) never what holds the article."""
        if self.tag in _DROPPED:
            return True
        wraps = self.has_article and not inside
        if self.tag in _WRAPPERS and not (self.most or wraps and self.holds and self.tag != "aside"):
            return True
        if self.hidden and (self.tag not in _BLOCK or self.tag in _TEXT_BLOCK or not (self.most or wraps and self.holds)):
            return True
        if self.tag in ("html", "body", "main"):
            return False
        if self.role in _DROPPED_ROLES and not wraps and not (self.most and self.role in _WRAPPER_ROLES):
            return True
        if not self.marks or self.alone or inside and self.tag in _PROSE:
            return False
        words = _marking(self.marks)
        if words & _LISTED_WORDS or self.tag in _LISTS and words & _THREAD_WORDS:
            return True
        return bool(words & _DROPPED_WORDS) and not wraps and not (self.most and self.bare)


@lru_cache(4096)
def _marking(marks: str) -> frozenset[str]:
    """The marking words of classes and ids that stand alone or beside companions only."""
    found: set[str] = set()
    for name in re.sub(r"\b(?:class|id)=", " ", marks).split():
        pieces = [p for p in re.split(r"[-_]+", name) if p]
        words = {w for p in pieces for w in ([p.lower()] if p.lower() in _KNOWN_WORDS else [x.lower() for x in _WORD.findall(p)])}
        marking = words & (_DROPPED_WORDS | _THREAD_WORDS)
        if marking and words <= marking | _COMPANIONS:
            found |= marking
    return frozenset(found)


def parse(text: str) -> Node:
    """The element tree; unclosed, misnested and cut markup is taken as browsers do in the common cases."""
    root = Node("html")
    stack = [root]
    at, n = 0, len(text)
    while at < n:
        found = _MARKUP.search(text, at)
        if not found:
            stack[-1].children.append(text[at:])
            break
        if found.start() > at:
            stack[-1].children.append(text[at : found.start()])
        at = found.end()
        if found[2] is None or not found[4] and not found[1] and at == n:
            continue  # comments, declarations, and a start tag cut off at the end
        tag = found[2].lower()
        if found[1]:
            if tag == "br":
                stack[-1].children.append(" ")
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in _BLOCK and tag not in _BLOCK:
                    break  # an inline end tag doesn't close blocks
            continue
        if tag == "html":
            continue
        if tag == "br":
            stack[-1].children.append(" ")
            continue
        if tag in _BLOCK:
            _close(stack, {"p"}, {"td", "th", "table", "button"})
        if tag in _CLOSED_BY:
            _close(stack, _CLOSED_BY[tag], _SCOPE[tag])
        node = Node(tag, found[3])
        stack[-1].children.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(text, at)
            if tag == "textarea":
                node.children.append(text[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in _VOID and not found[3].rstrip().endswith("/") or tag in _BLOCK - {"hr"}:
            stack.append(node)
    _finish(root)
    return root


def _close(stack: list[Node], tags: set[str], scope: set[str]) -> None:
    """Closes the outermost open element among ``tags`` this side of ``scope``."""
    last = None
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            last = k
        elif stack[k].tag in scope:
            break
    if last is not None:
        del stack[last:]


def _finish(root: Node) -> None:
    """Hashes of all subtrees with text, from the leaves up, their words, and what holds an article."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        hash_, any_text = xxhash.xxh3_64(f"{node.tag} {node.marks}"), False
        for c in node.children:
            if isinstance(c, Node):
                if not c.boilerplate():
                    node.has_article |= c.has_article or c.tag in ("article", "main")
                    node.size += c.size
                    node.held += c.held
                if c.digest:
                    any_text = True
                    hash_.update(b"<" + c.digest)
            elif words := c.split():
                any_text = True
                node.size += len(words)
                hash_.update((">" + " ".join(words)).encode("utf-8", "surrogatepass"))
        node.digest = hash_.digest() if any_text else b""
        if node.tag in ("article", "main"):
            node.held = node.size
    if not root.size and any(n.digest and n.marks for n in order):
        for node in reversed(order):
            node.alone = True
            node.size = sum(len(c.split()) if isinstance(c, str) else 0 if c.boilerplate() else c.size for c in node.children)
    for node in reversed(order):
        node.most, node.holds, node.bare = 2 * node.size > root.size, 2 * node.held > root.held, not root.held
    if any(n.tag in _WRAPPERS or n.hidden or n.role in _WRAPPER_ROLES or n.alone for n in order):
        for node in reversed(order):  # again, as wrappers may be boilerplate by now
            below = (c for c in node.children if isinstance(c, Node) and (c.has_article or c.tag in ("article", "main")))
            node.has_article = any(not c.boilerplate() for c in below)


def _inner(node: Node, inside: bool) -> bool:
    """Whether the children of an element are inside an article, or a main element without one."""
    return inside or node.tag == "article" or node.tag == "main" and not node.has_article


def _walk(node: Node, inside: bool) -> Iterator[tuple[Node, bool]]:
    """All elements with whether they are inside an article, in page order, without what boilerplate() drops."""
    todo = [(node, inside)]
    while todo:
        here, within = todo.pop()
        yield here, within
        within = _inner(here, within)
        todo += [(c, within) for c in reversed(here.children) if isinstance(c, Node) and not c.boilerplate(within)]


def _comparable(node: Node, inside: bool) -> bool:
    """Whether a subtree may be template: a block that isn't the page, and not text of an article."""
    if not node.digest or node.tag not in _BLOCK or node.tag in ("html", "body", "article", "main") or node.has_article:
        return False
    return not (inside and node.tag in _TEXT_BLOCK)


def subtree_hashes(text: str | None) -> dict[int, bool]:
    """The hashes of all subtrees and loose blocks of a page that may be template, with whether they are only parts of a text,
    list or table."""
    page = parse(text or "")
    found = (n for n, inside in _walk(page, False) if _comparable(n, inside))
    blocks = (_loose_hash(b) for b, loose in (_blocks(page) if _has_loose(page) else ()) if loose)
    return dict.fromkeys(blocks, False) | {int.from_bytes(n.digest, "big", signed=True): n.tag in _PARTS for n in found}


def _has_loose(page: Node) -> bool:
    """Whether there is text in no block of the body."""
    todo = [page]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, str):
                if c and not c.isspace():
                    return True
            elif c.tag not in _BLOCK or c.tag in ("html", "body"):
                todo.append(c)
    return False


def _loose_hash(block: str) -> int:
    return int.from_bytes(xxhash.xxh3_64(("#loose " + block).encode("utf-8", "surrogatepass")).digest(), "big", signed=True)


def main_text(text: str | None, template: set[int] = frozenset()) -> str:
    """The blocks of the main text, joined by an empty line."""
    return "\n\n".join(b for b, loose in _blocks(parse(text or ""), template) if not (loose and _loose_hash(b) in template))


def _blocks(page: Node, template: set[int] = frozenset()) -> Iterator[tuple[str, bool]]:
    """The blocks of the main text in page order, and whether they lie loose in the body."""
    open_: list[str] = []
    at_loose = False

    def closed() -> Iterator[tuple[str, bool]]:
        if words := references.unescape("".join(open_)).split():
            yield " ".join(words), at_loose
        open_.clear()

    # (node or text, inside an article, inside an article or main, only headings count, in no block); None closes a block
    todo: list = [(page, False, False, False, True)]
    while todo:
        item = todo.pop()
        if item is None:
            yield from closed()
            continue
        here, inside, within, only, loose = item
        if isinstance(here, str):
            if not only:
                at_loose = loose
                open_.append(here)
            continue
        if here is not page:
            if here.boilerplate(inside) or _comparable(here, inside) and int.from_bytes(here.digest, "big", signed=True) in template:
                if here.tag in _BLOCK:
                    yield from closed()
                continue
            if here.tag == "header" and not here.has_article:
                if not within:
                    yield from closed()
                    continue
                only = True  # of an article's own header its title is text
            elif here.tag in _HEADINGS:
                only = False
        if here.tag in _BLOCK:
            yield from closed()
            todo.append(None)
        inside, within = _inner(here, inside), within or here.tag in ("article", "main")
        loose = loose and (here.tag not in _BLOCK or here.tag in ("html", "body"))
        todo += [(c, inside, within, only, loose) for c in reversed(here.children)]
    yield from closed()


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE,
) -> DataFrame:
    """One row per page: page_id, url, text.

    A subtree is template if it occurs on ``least_pages`` different pages of a host at least; a heading, list item or table
    cell on its own must also occur on ``least_share`` of them. Blocks are joined in page order by an empty line, white
    space within one is a blank, character references are decoded.

    Null or empty html gives an empty text. Pages with a null url, or one without host, are compared as pages of one host.
    Null ids pass through, repeated rows each get a row; pages with equal html count as one, so copies of a page aren't
    taken for template. An empty table gives no rows; other columns are not read.
    """
    ship_code(pages)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"),
                        host_of(F.col(url_col)).alias("host")).withColumn("page", F.xxhash64("html"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, keys, found, parts = [], [], [], []
            for host, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = {0: False} | subtree_hashes(text)  # 0 counts the pages
                hosts += [host] * len(own)
                keys += [key] * len(own)
                found += own
                parts += own.values()
            yield pa.RecordBatch.from_arrays([
                pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(found, pa.int64()), pa.array(parts, pa.bool_())],
                names=["host", "page", "hash", "part"])

    found = rows.select("host", "page", "html").mapInArrow(hashes, "host string, page long, hash long, part boolean")
    subtrees = settled(found.distinct(), "subtrees")
    counts = subtrees.groupBy("host", "hash", "part").agg(F.count("*").alias("n"))
    counts = settled(counts.where((F.col("n") >= least_pages) | (F.col("hash") == 0)), "counts")
    sizes = counts.where("hash = 0").select(F.col("host").alias("_host"), F.col("n").alias("pages"))
    common = counts.where("hash <> 0").join(sizes, F.col("host") == F.col("_host")).where(~F.col("part") | (F.col("n") >= least_share * F.col("pages")))
    common = common.select("_host", F.col("hash").alias("_hash"))
    # what is template of each page: at most the subtrees of the page, whatever its host has
    own = subtrees.join(common, (F.col("host") == F.col("_host")) & (F.col("hash") == F.col("_hash")))
    template = settled(own.groupBy(F.col("host").alias("_host"), F.col("page").alias("_page")).agg(F.collect_list("hash").alias("template")), "template")
    joined = rows.join(template, (F.col("host") == F.col("_host")) & (F.col("page") == F.col("_page")), "left").select("page_id", "url", "html", "template")

    @F.pandas_udf(T.StringType())
    def text_of(texts: pd.Series, templates: pd.Series) -> pd.Series:
        return pd.Series([main_text(t, set() if x is None else set(x)) for t, x in zip(texts, templates, strict=True)], dtype="object")

    return joined.select("page_id", "url", text_of("html", "template").alias("text"))
