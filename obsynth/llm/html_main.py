"""Main text of web pages by removal of site templates.

Every page is parsed into a tree; the hash of each block element's subtree is counted per host in
Spark; subtrees that recur across many pages of a host are template and are deleted, along with what
markup itself marks as menu, advert, form and the like.  The article, or the page where articles hold
less than half of what is left, is the text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_arrow, slices
from .urls import host_of

MIN_PAGES = 8  # a template subtree stands on so many pages of its host at least,
MIN_SHARE = 0.02  # and on this share of them
SENT = 1 << 22  # digests (32 MB) that may travel to every task
SALTS = 16  # parts of a host where they may not
MAX_PART = 1 / 3  # inside an article, a recurring container with more of its text is the article itself

# Element names by their role in HTML (fixed values of the standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption tr".split())
NO_TEXT = frozenset("head script style noscript template nav footer aside form button select textarea input iframe svg canvas object dialog menu title xmp noembed noframes".split())
CLOSES_P = BLOCK - {"body", "html", "li", "dd", "dt", "tr", "tbody", "tfoot", "thead", "summary", "figcaption"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}

# Words of class, id and role that name what is no article text.
NOT_MAIN = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside widget footer contentinfo complementary cookie cookies consent gdpr notice notices alert popup modal overlay dialog newsletter subscribe signup login "
    "comment comments reply replies respond disqus share sharing social related recommended search form pagination pager toolbar skip masthead".split()
)
HEADER = frozenset("header topbar site-header".split())

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+|=)*+)(?:>|\Z)|</?(?:[a-zA-Z].*)?\Z""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
WORDS = re.compile(r"[a-z0-9]+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Element:
    name: str
    attrs: str = ""
    children: list[Element | str] = field(default_factory=list)
    digest: int = 0
    size: int = 0  # letters of text below


def parse(source: str) -> Element:
    """The tree of a page.  Tags that HTML lets out are implied, stray end tags are skipped, a tag or
    comment cut off by the end of the page is dropped."""
    root = Element("html")
    stack, at, end = [root], 0, len(source)
    while at < end:
        m = TAG.search(source, at)
        if m is None:
            stack[-1].children.append(source[at:])
            break
        if m.start() > at:
            stack[-1].children.append(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
            continue
        if name in ("html", "body") and len(stack) == 1:
            continue
        if name in CLOSES_P:
            _close(stack, {"p"}, {"table", "td", "th", "button", "article", "section", "div"} if name != "p" else {"table", "td", "th", "button"})
        elif name in SIBLINGS:
            _close(stack, SIBLINGS[name], SCOPE[name])
        node = Element(name, m[3])
        stack[-1].children.append(node)
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?|\Z", re.I).search(source, at)
            at = close.end()
            continue
        stack.append(node)
    return root


def _close(stack: list[Element], names: set[str], stop: set[str]) -> None:
    """Ends the lowest open element of ``names`` that no element of ``stop`` shields."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name in names:
            del stack[i:]
            return
        if stack[i].name in stop:
            return


def seal(tree: Element) -> None:
    """Sets digest and size of every subtree: its name, attributes, children and text without white space."""
    for node in reversed(list(walk(tree))):  # children before parents
        h, size = xxhash.xxh3_64(node.name), 0
        if node.attrs:
            h.update(node.attrs.strip().lower())
        for c in node.children:
            if isinstance(c, str):
                letters = "".join(c.split())
                size += len(letters)
                h.update("t" + letters)
            else:
                h.update(c.digest.to_bytes(8, "little"))
                size += c.size
        node.digest, node.size = h.intdigest(), size


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text else {}


def is_main(node: Element, inside: bool) -> bool:
    """Whether markup leaves an element to the main text; ``inside`` an article a header stays."""
    if node.name in NO_TEXT or (node.name == "header" and not inside):
        return False
    if not node.attrs:
        return True
    a = attributes(node.attrs)
    if "hidden" in a or a.get("aria-hidden") == "true" or UNSEEN.search(a.get("style", "").lower()):
        return False
    words = set(WORDS.findall(" ".join(a.get(k, "") for k in ("class", "id", "role")).lower()))
    return not (words & NOT_MAIN or (words & HEADER and not inside))


def walk(node: Element) -> Iterator[Element]:
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(c for c in n.children if not isinstance(c, str))


def outermost(tree: Element, test: Callable[[Element], bool]) -> list[Element]:
    """The outermost elements that pass the test and are no menus, comments or the like."""
    out, stack = [], [tree]
    while stack:
        n = stack.pop()
        if n is not tree and not is_main(n, inside=False):
            continue
        if n is not tree and test(n):
            out.append(n)
            continue
        stack.extend(c for c in reversed(n.children) if not isinstance(c, str))
    return out


def blocks_of(roots: list[Element], tree: Element, template: frozenset[int] | set[int]) -> list[str]:
    """Blocks of text below the roots.  Of the whole tree any block of the template goes; of other
    roots containers that hold a small part of the root's text."""
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        line.clear()
        if text:
            blocks.append(text)

    for root in roots:
        whole = root is tree
        stack: list[Element | str | None] = [root]
        while stack:
            n = stack.pop()
            if n is None:
                end()
            elif isinstance(n, str):
                line.append(n)
            elif n.name == "br" or n.name in ("td", "th"):
                line.append(" ")
                stack.extend(reversed(n.children))
            elif n is not root and not is_main(n, inside=not whole):
                if n.name in BLOCK or n.name in NO_TEXT:
                    end()
            elif n is not root and n.digest in template and (whole or (n.name not in CONTENT and n.size <= MAX_PART * root.size)):
                end()
            elif n.name in BLOCK or n is root:
                end()
                stack.append(None)
                stack.extend(reversed(n.children))
            else:
                stack.extend(reversed(n.children))
    return blocks


def main_text(tree: Element, template: frozenset[int] | set[int]) -> str:
    """Blocks of the main text joined by blank lines; ``template`` holds digests to delete.

    Recurring subtrees go first.  Of what is left, elements marked main are the page if they hold
    half of its text, and articles if they hold half of that; so cards marked as articles do not
    displace a body that stands outside them.  Recurring articles count only where they hold more
    text than all that would be kept without them (copies of one page)."""
    letters = lambda blocks: sum(map(len, blocks))
    articles = outermost(tree, lambda n: n.name == "article")
    again = [a for a in articles if a.digest in template]
    mains = outermost(tree, lambda n: n.name == "main" or attributes(n.attrs).get("role") == "main")
    chosen = blocks_of([tree], tree, template)
    for roots in (mains, [a for a in articles if a.digest not in template]):
        if roots and 2 * letters(part := blocks_of(roots, tree, template)) >= letters(chosen):
            chosen = part
    if again and letters(blocks_of(again, tree, template)) > letters(chosen):
        chosen = blocks_of(articles, tree, template)
    return "\n\n".join(chosen)


def tree_of(source: str | None) -> Element:
    tree = parse(source or "")
    seal(tree)
    return tree


def template_digests(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, digests): block subtrees on many pages of a host, from rows (host, html).  A page
    counts a subtree once.  A host has at most (blocks of a page / min_share) of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, "html"):
                found = []
                for x in b.column("html").to_pylist():
                    found.append(list({n.digest for n in walk(tree_of(x)) if n.name in BLOCK and n.size}))
                flat = np.array([d for f in found for d in f] or [0], np.uint64).view(np.int64)[: sum(map(len, found))]
                rows = np.repeat(np.arange(b.num_rows), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([b.column("host").take(pa.array(rows)), pa.array(flat)], names=["host", "digest"])

    counts = map_arrow(pages.select("host", "html"), run, "host string, digest long").groupBy("host", "digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    return counts.join(sizes, "host").where(F.col("n") >= min_share * F.col("pages")).groupBy("host").agg(F.collect_list("digest").alias("digests"))


def with_templates(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """``pages`` with the ``digests`` of their host.  Templates are counted first: up to SENT digests travel to the
    tasks that read the pages, so that no html is shuffled; beyond it pages are dealt by host and salt,
    so that the pages of a large host do not meet in one task."""
    templates = cut_lineage(templates)
    if (templates.agg(F.sum(F.size("digests"))).first()[0] or 0) <= SENT:
        return pages.join(F.broadcast(templates), "host", "left")
    dealt = templates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("_salt", F.pmod(F.xxhash64("url", "page_id"), F.lit(SALTS)).cast("int")).join(dealt, ["host", "_salt"], "left")


def extract_main(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE
) -> DataFrame:
    """Per row: page_id, url, text, n_chars.

    Null or empty html gives an empty text, very long html is read whole; null urls share the empty host; repeated rows stay (and
    count as pages of their host); further columns are dropped; no rows give no rows.
    """
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = with_templates(p, template_digests(p, min_pages, min_share)).select("page_id", "url", "html", "digests")
    schema = f"page_id {joined.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[object, frozenset[int]] = (None, frozenset())
        for big in batches:
            for b in slices(big, "html"):
                texts = []
                for source, digests in zip(b.column("html").to_pylist(), b.column("digests"), strict=True):
                    if digests.is_valid:
                        key = digests.values.to_numpy(zero_copy_only=False).view(np.uint64)
                        if last[0] is None or not np.array_equal(key, last[0]):
                            last = key, frozenset(key.tolist())
                    template = last[1] if digests.is_valid else frozenset()
                    texts.append(main_text(tree_of(source), template) if source else "")
                yield pa.RecordBatch.from_arrays(
                    [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    return map_arrow(joined, run, schema)
