"""Main text of web pages by removal of site templates.

Every element subtree gets a hash of its tag and of the texts and hashes below
it.  Spark counts beside how many main texts of a host each hash occurs;
subtrees that recur beside many are the host's template and are deleted.  Pages
of one main text count once, so copies of a page make no template, and subtrees
with an article or most of a page's text are never deleted as such.  Inside the
page's article a whole block of prose is template only if it recurs beside
INSIDE_SHARE of the host's main texts; words within prose and parts of tables
and lists stay, because they recur without being template.  Elements whose tag,
role or class says that they are menus, forms, adverts and so on are deleted
too, which is all that can be done for a host with few pages.  If the page has
an article (or main) element, text outside it goes.

Counting shuffles (host, hash, main text's hash), so no host is hot.  A host's
template has at most elements / MIN_SHARE hashes.  Hosts with more than one
page in HOT_SHARE number fewer than HOT_SHARE, so their templates are
broadcast and their pages stay where they are; the pages of other hosts meet
their templates by a shuffle on host in which no host is large.

Defined results: null and empty html gives an empty text; a null url is a host
of its own; broken markup is closed as browsers do; repeated pages are pages of
their own; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, HOT_SHARE, slices, stored, table, text_of

MIN_PAGES = 4
MIN_SHARE = 0.02
INSIDE_SHARE = 0.5
INSIDE = 0x5BD1E9955BD1E995  # sets hashes of prose inside an article apart
MOST = 0.75  # of a page's text: no subtree with as much is template
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.DOTALL)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)

# fixed values: element classes of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr".split())
SCOPE = frozenset("html body table td th caption article section div main aside nav header footer form ul ol dl blockquote button object".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
DROPPED = frozenset("head nav footer aside form script style noscript template iframe object svg canvas button select textarea input label dialog menu title".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices alert alerts sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments replies disqus share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay paywall skiplink pagination pager widget widgets toolbar".split()
)
PLAIN = frozenset(
    "area bar block body bottom box btn button buttons card center col column container content desktop fixed form global header head icon icons inline inner item items left link links list main mobile nag outer page pane panel post primary reader right row secondary section site slot sticky text top unit user wrap wrapper zone".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
PROSE = frozenset("article main p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table tbody thead tfoot tr td th figure figcaption section div span a b i em strong u s small sub sup code q cite mark abbr time font tt kbd samp var del ins big strike header hgroup details summary address center".split())
WHOLE = (BLOCK & PROSE) - frozenset("article main li dl dt dd table tbody thead tfoot tr td th caption figcaption summary".split())


def says_furniture(names: str) -> bool:
    """Whether one of the class names or ids is made of words for furniture, and of nothing else but plain words and numbers.

    So `ad`, `cookie-banner` and `comments_list` are, and `share-price`,
    `related-work` and `comments-on-method` are not.
    """
    for name in names.lower().split():
        words = [w for w in re.split(r"[-_]+", name) if w and not w.isdigit()]
        if "".join(words) in HINTS or any(w in HINTS for w in words) and all(w in HINTS or w in PLAIN for w in words):
            return True
    return False


class Node:
    __slots__ = ("tag", "hint", "children", "hash", "size", "holds")

    def __init__(self, tag: str, hint: bool = False):
        self.tag, self.hint, self.children, self.hash, self.size, self.holds = tag, hint, [], 0, 0, False


def _furniture(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    if tag in ("html", "body", "article", "main") and "comment" not in attributes:
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if value.lower() in ROLES if name.lower() == "role" else says_furniture(value):
            return True
    return False


def parse(page: str, lists: bool = True) -> Node:
    """The element tree; text children are strings with references decoded. Without lists no tag, role or class is furniture."""
    root = Node("#root")
    stack = [root]
    at = 0

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(html.unescape(piece) if "&" in piece else piece)

    def close(tags: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in stop:
                return

    while True:
        found = TOKEN.search(page, at)
        if found is None:
            text(page[at:])
            return root
        text(page[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag not in VOID:
                close({tag}, SCOPE - {tag} if tag in ("p", "li", "a", "b", "i", "em", "strong", "span") else frozenset())
            continue
        if tag in CLOSES_P:
            close({"p"}, SCOPE)
        if tag in SIBLINGS:
            close(SIBLINGS[tag], frozenset({"ul", "ol", "dl", "table", "select", "menu"}))
        node = Node(tag, lists and _furniture(tag, found[3]))
        stack[-1].children.append(node)
        if tag in VOID or found[3].endswith("/") and tag in ("svg", "path", "g"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.IGNORECASE).search(page, at)
            at = end.end()
            continue
        stack.append(node)


def _digest(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def hash_trees(node: Node) -> Node:
    """Sets every element's hash, its text's length and whether it holds an article, children first, without recursion."""
    order, left = [], [node]
    while left:
        x = left.pop()
        order.append(x)
        left += [c for c in x.children if isinstance(c, Node)]
    for x in reversed(order):
        below = [str(c.hash) if isinstance(c, Node) else f"t{' '.join(c.split())}" for c in x.children]
        x.hash = _digest(f"{x.tag}\0" + "\0".join(y for y in below if y != "t"))
        x.size = sum(c.size if isinstance(c, Node) else len(y) - 1 for c, y in zip(x.children, below))
        x.holds = x.tag in ("article", "main") or any(c.holds for c in x.children if isinstance(c, Node))
    return node


def _removable(x: Node, root: Node) -> bool:
    """Whether an element may go as template: not with an article or most of the page's text in it."""
    return x.tag not in ("html", "body") and not x.holds and x.size < MOST * root.size


def _prose(x: Node, inside: bool) -> bool:
    return inside and x.tag in PROSE and not x.hint


def candidates(root: Node) -> list[tuple[int, bool]]:
    """Hashes of the subtrees that may be template, and whether each is prose inside an article."""
    found, left = set(), [(root, False)]
    while left:
        x, inside = left.pop()
        if x.tag[0] != "#" and x.size and _removable(x, root):
            if not _prose(x, inside):
                found.add((x.hash, False))
            elif x.tag in WHOLE:
                found.add((x.hash ^ INSIDE, True))
        inside = inside or x.tag in ("article", "main")
        left += [(c, inside) for c in x.children if isinstance(c, Node)]
    return list(found)


def _articles(root: Node, gone) -> list[Node]:
    for wanted in ("article", "main"):
        found, left = [], [root]
        while left:
            x = left.pop()
            if gone(x, False):
                continue
            if x.tag == wanted:
                found.append(x)
            else:
                left += [c for c in reversed(x.children) if isinstance(c, Node)]
        if found:
            return found
    return []


def main_text(root: Node, template: frozenset[int], lists: bool = True) -> str:
    """Blocks of what is left of a hashed tree, one to a line; without lists, outside articles too."""

    def gone(x: Node, inside: bool) -> bool:
        if x.hint or lists and x.tag == "header" and not inside:
            return True
        return _removable(x, root) and (x.hash ^ INSIDE if _prose(x, inside) else x.hash) in template

    blocks, now = [], []

    def flush() -> None:
        if now:
            if line := " ".join("".join(now).split()):
                blocks.append(line)
            now.clear()

    tops = _articles(root, gone) if lists else []
    for top in tops or [root]:
        left: list = [(top, bool(tops))]
        while left:
            x, inside = left.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                now.append(x)
            elif x is top or not gone(x, inside):
                if x.tag == "br":
                    now.append(" ")
                block = x.tag in BLOCK
                if block:
                    flush()
                    left.append((None, inside))
                left += [(c, inside) for c in reversed(x.children)]
        flush()
    return "\n".join(blocks)


def host_of(url: str = "url") -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, lists: bool = True) -> DataFrame:
    """(host, pages, hashes): subtrees that recur beside at least min_pages and min_share of the host's main texts."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            hosts, found, insides, contents = [], [], [], []
            for host, page in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                root = hash_trees(parse(page, lists))
                mine = [(0, False), *candidates(root)]  # 0 counts the page itself
                hosts += [host] * len(mine)
                found += [h for h, _ in mine]
                insides += [x for _, x in mine]
                contents += [_digest(main_text(root, frozenset(), lists))] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(found, pa.int64()), pa.array(insides, pa.bool_()), pa.array(contents, pa.int64())], ["host", "hash", "inside", "content"])

    counts = pages.select(host_of().alias("host"), text_of("html").alias("html")).transform(mapped, hashes, "host string, hash long, inside boolean, content long").groupBy("host", "hash", "inside").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("content").alias("n"))
    # only what occurs often can be template, so the records of a host are few from here on
    often = stored(counts.filter((F.col("n") >= min_pages) | (F.col("hash") == 0)), "site-counts")
    sizes = often.filter("hash = 0 AND NOT inside").select("host", "pages", F.col("n").alias("contents"))
    return often.filter("hash <> 0").drop("pages").join(sizes, "host").filter(F.col("n") >= F.col("contents") * F.when(F.col("inside"), max(min_share, INSIDE_SHARE)).otherwise(min_share)).groupBy("host", "pages").agg(F.collect_set("hash").alias("hashes"))


def extract_pages(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, lists: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) for pages of (page_id, url, html); without lists by recurring subtrees alone."""
    templates = stored(site_templates(pages, min_pages, min_share, lists), "site-templates")
    least = max(pages.count() // HOT_SHARE, 1)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"), host_of().alias("host"))
    hot, cold = (templates.filter(x).select("host", "hashes") for x in (F.col("pages") > least, F.col("pages") <= least))
    near = rows.join(F.broadcast(hot), "host")
    far = rows.join(F.broadcast(hot.select("host")), "host", "left_anti").join(cold, "host", "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            texts = [main_text(hash_trees(parse(page, lists)), frozenset(found or ()), lists) for page, found in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return near.unionByName(far).select("page_id", "url", "html", "hashes").transform(mapped, extract, "page_id long, url string, text string, n_chars long")


def op5_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
