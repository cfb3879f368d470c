"""HTML extraction by a site style tree.

The pages of a host are merged by presentation: a node is the path of tags, classes and ids that leads to
it.  For every node the pages of the host tell how its content varies: a node whose contents recur from
page to page has a low entropy-based importance, one whose contents are each page's own a high one; and a
branch node's importance adds how its children's layout varies.  Branches of low importance are removed
from every page, inside articles and beside them.

Roles of elements are the tree's prior.  An element that HTML or ARIA name as a menu, footer, form and so on,
or that holds reader comments, has no importance whatever its contents.  A class or id word that is often one of
noise only hints at it: such an element keeps its contents, and their own importance, where it carries the most
text of its host's pages, which no advert or notice does.  All others begin as important, with the weight of PRIOR
pages (bare elements of an article with that of BARE_PRIOR), so few pages change nothing and many decide.
Pages of a host may be copies of one article, so nodes inside an article that makes up half of its
page are counted over distinct article texts, and a page that would be left with nothing keeps its article.

Statistics are counted over distinct page contents of a host, aggregated before every shuffle; a page gets
only its host's lists of nodes, which are broadcast while they are small.

Edge cases: a null or empty page has an empty text; a null url, or one without a host, belongs to the host
''; unclosed and stray tags are repaired by the usual rules, a tag that another begins in is text, and elements
nested deeper than DEPTH count as siblings; repeated rows give repeated results; an empty table gives no rows.
Time is linear in a page's length.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices, some, staged, text_bytes

#: Nodes less important than this go.
LEAST_IMPORTANCE = 0.75
#: So many pages without a word against it is every node's prior, and that of a bare element of an article.
PRIOR, BARE_PRIOR = 24, 240
#: An element that hints at noise is trusted if it holds this part of the text, with so many pages against it.
TRUSTED_SHARE, DOUBT = 0.5, 2
#: Open elements at most, as in browsers.
DEPTH = 512
#: Bytes of node lists that are broadcast, at most; more are joined.
MAX_SENT = 64 << 20
#: Weight of a node's own layout against its children's content.
DECAY = 0.9

# Elements by their part in HTML, and words that name parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN = frozenset("head script style noscript template iframe object svg math canvas audio video select textarea title".split())
NOISE_TAGS = frozenset("nav footer aside form button dialog menu search fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs "
    "footer foot header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login "
    "share sharing social related recommended widget toolbar pagination pager skip disclaimer copyright".split()
)
COMMENT_WORDS = frozenset("comment comments disqus respond reply replies".split())
ARTICLE_NOISE = frozenset("ad ads advert advertisement comment comments reply replies related recommended sponsored promo promotion widget".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
_CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "option", "button", "optgroup", "legend"}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|textarea|title|noscript|template|iframe|svg|math)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|$)|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")


class _Node:
    __slots__ = ("article", "noise", "path", "tag")

    def __init__(self, tag: str, path: str, noise: str | None, article: bool):
        self.tag, self.path, self.noise, self.article = tag, path, noise, article


def _child(parent: _Node, tag: str, attributes: str) -> _Node:
    """An element; its noise is "" if it surely is some, the path of the innermost element that hints at it, or None."""
    article = parent.article or tag in ("article", "main")
    sure = parent.noise == "" or tag in NOISE_TAGS or (tag == "header" and not article)
    hint, name = False, tag
    if attributes and "=" in attributes:
        for m in _NAMES.finditer(attributes):
            value = (m[2] or m[3] or m[4] or "").lower()
            kind = m[1].lower()
            name += f"[{kind}={_DIGITS.sub('0', value)}]"
            words = _WORD.findall(value)
            if tag in ("article", "main", "body", "html"):
                # their classes often tell the site's theme; a comment or teaser is named by a whole class
                sure = sure or (tag == "article" and kind == "class" and not ARTICLE_NOISE.isdisjoint(value.split()))
            elif kind == "role":
                sure = sure or value in NOISE_ROLES
            else:
                sure = sure or not COMMENT_WORDS.isdisjoint(words)
                hint = hint or not NOISE_WORDS.isdisjoint(words)
    path = f"{parent.path}/{name}"
    return _Node(tag, path, "" if sure else path if hint else parent.noise, article)


def blocks(page: str) -> list[tuple[str, str | None, bool, str]]:
    """(path, noise by role, in an article, text) of every block with text, in page order."""
    root = _Node("", "", None, False)
    stack = [root]
    out: list[tuple[str, str | None, bool, str]] = []
    parts: list[str] = []
    holder = root  # the innermost block element when the first text of the block came

    def flush() -> None:
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((holder.path, holder.noise, holder.article, text))

    def add(text: str) -> None:
        nonlocal holder
        if not parts:
            if text.isspace():
                return
            holder = stack[-1]
        parts.append(text)

    hidden = 0
    at = 0
    for m in _MARKUP.finditer(page):
        if m.start() > at and not hidden:
            add(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:  # an end tag
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth:
                if any(n.tag in BLOCK for n in stack[depth:]):
                    flush()
                hidden -= sum(n.tag in HIDDEN for n in stack[depth:])
                del stack[depth:]
            continue
        if tag in VOID:
            if tag == "br" and not hidden:
                add(" ")
            elif tag == "hr":
                flush()
            continue
        if tag == "body" and hidden:  # an unclosed head ends here
            del stack[1:]
            hidden = 0
        if tag in BLOCK:
            flush()
            if tag in _CLOSES_P:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p"), 0)
                if depth and not any(n.tag in ("td", "th", "table", "button", "caption") for n in stack[depth:]):
                    del stack[depth:]
            if tag in CLOSED_BY:
                closes, limits = CLOSED_BY[tag], LIMITS[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in limits:
                        break
                    if stack[i].tag in closes:
                        del stack[i:]
        if m[4].endswith("/") and tag not in BLOCK:
            continue
        if len(stack) > DEPTH:
            flush()
            hidden -= stack.pop().tag in HIDDEN
        stack.append(_child(stack[-1], tag, m[4]))
        hidden += tag in HIDDEN
    if at < len(page) and not hidden:
        add(page[at:])
    flush()
    return out


def _hash(text: str) -> int:
    return np.uint64(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))).astype(np.int64).item()


_LEAF, _BARE, _BRANCH, _HINT = range(4)


def _prepared(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, url, html and the host's hash."""
    host = F.translate(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), "(?s)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_bytes(html_col).alias("html"), F.xxhash64(host).alias("host"))


def _looked(pages: DataFrame) -> DataFrame:
    """What the pages of a host (host, html) show: (host, path, feature, page, kind), all but kind as hashes.

    A leaf's feature is its text, a branch's the names of its children, a hint's its millionths of its page's text.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            rows = set()
            for host, raw in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = np.uint64(xxhash.xxh3_64_intdigest(raw)).astype(np.int64).item()
                layout: dict[str, list[str]] = {}
                outside: set[str] = set()
                hints: dict[str, int] = {}
                left = [b for b in blocks(raw.decode("utf-8", "replace")) if b[1] != ""]
                # the same for all copies of an article, unless it is but a small part of its page
                own = [text for _, _, article, text in left if article]
                whole = sum(len(text) for *_, text in left)
                copy = _hash("\0".join(own)) if 2 * sum(map(len, own)) >= whole else page
                for path, noise, article, text in left:
                    if noise:
                        hints[noise] = hints.get(noise, 0) + len(text)
                    within = path[max(path.rfind("/article"), path.rfind("/main")) + 1 :].partition("/")[2] if article else ""
                    bare = within and "[" not in within
                    rows.add((host, _hash(path), _hash(text), copy if article else page, _BARE if bare else _LEAF))
                    parent, _, name = path.rpartition("/")
                    layout.setdefault(parent, []).append(name)
                    if not article:
                        outside.add(parent)
                rows.update((host, _hash(parent), _hash(" ".join(names)), page if parent in outside else copy, _BRANCH) for parent, names in layout.items() if parent)
                rows.update((host, _hash(root), 1_000_000 * n // whole, page, _HINT) for root, n in hints.items())
            host, path, feature, page, kind = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (host, path, feature, page)), pa.array(kind, pa.int8())], names=["host", "path", "feature", "page", "kind"])

    return arrow_map(pages.select("host", "html"), look, "host long, path long, feature long, page long, kind byte").distinct()


def style_tree(seen: DataFrame) -> DataFrame:
    """host, path (as hashes), kind, pages and importance of every node that was looked at."""
    seen = seen.where(F.col("kind") != _HINT)
    node = ["host", "path", "kind"]
    by_feature = seen.groupBy(*node, "feature").agg(F.count(F.lit(1)).alias("k"))
    by_node = seen.select(*node, "page").distinct().groupBy(*node).agg(F.count(F.lit(1)).alias("pages"))
    # leaves: 1 less the mean entropy of their contents over the pages; branches: the entropy of their layouts
    # (the sum of -k/pages * log(k/pages), with pages taken out, so that a node's many contents are summed before the join)
    sums = by_feature.groupBy(*node).agg(F.avg(F.log("k")).alias("spread"), F.sum("k").alias("ks"), F.sum(F.col("k") * F.log("k")).alias("klogk"))
    layout = (F.col("ks") * F.log("pages") - F.col("klogk")) / F.col("pages")
    entropy = sums.join(by_node, node).withColumn("layout", layout)
    whole = F.log(F.greatest("pages", F.lit(2)))
    importance = F.when(F.col("pages") == 1, 1.0).when(F.col("kind") == _BRANCH, F.least(F.lit(1.0), F.col("layout") / whole)).otherwise(1 - F.col("spread") / whole)
    return entropy.select(*node, "pages", importance.alias("importance"))


def trusted_hints(seen: DataFrame) -> DataFrame:
    """host and path of the elements that hint at noise, but carry most of the text of the host's pages."""
    share = F.sum(F.col("feature") / 1_000_000) / (F.count(F.lit(1)) + DOUBT)
    return seen.where(F.col("kind") == _HINT).groupBy("host", "path").agg(share.alias("share")).where(F.col("share") >= TRUSTED_SHARE).select("host", "path")


def low_nodes(tree: DataFrame) -> DataFrame:
    """host and path of the nodes whose content or branch is of low importance.

    A leaf that is also a branch (text beside children) weighs both: (1 - DECAY) of its layout's
    importance and DECAY of its content's.  Pages and prior pages are weighed together.
    """
    of = lambda value, *kinds: F.max(F.when(F.col("kind").isin(*kinds), F.col(value)))
    both = tree.groupBy("host", "path").agg(F.max("pages").alias("pages"), of("importance", _LEAF, _BARE).alias("content"), of("importance", _BRANCH).alias("layout"), of("pages", _BARE).isNotNull().alias("bare"))
    told = F.coalesce((1 - DECAY) * F.col("layout") + DECAY * F.col("content"), "content")
    prior = F.when(F.col("bare"), BARE_PRIOR).otherwise(PRIOR)
    return both.where(F.col("content").isNotNull() & ((F.col("pages") * told + prior) / (F.col("pages") + prior) < LEAST_IMPORTANCE)).select("host", "path")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page."""
    slim = _prepared(pages, id_col, url_col, html_col)
    few = some(pages.sparkSession)
    seen = staged(_looked(slim), "html-seen")
    nodes = low_nodes(style_tree(seen)).withColumn("low", F.lit(True)).unionByName(trusted_hints(seen).withColumn("low", F.lit(False)))
    lists = staged(nodes.groupBy("host").agg(F.collect_list(F.when(F.col("low"), F.col("path"))).alias("removed"), F.collect_list(F.when(~F.col("low"), F.col("path"))).alias("trusted")), "html-nodes", few)
    size = lists.agg(F.sum(F.lit(64) + 8 * (F.size("removed") + F.size("trusted")))).first()[0] or 0
    kind = slim.schema["id"].dataType.simpleString()
    url_kind = slim.schema["url"].dataType.simpleString()
    named = slim.join(F.broadcast(lists) if size <= MAX_SENT else lists, "host", "left").select("id", "url", "html", "removed", "trusted")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}

        def is_in(path: str, paths: frozenset[int]) -> bool:
            if path not in known:
                known[path] = _hash(path)
            return known[path] in paths

        for batch in slices(batches, "html"):
            texts = []
            for raw, low, trusted in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                low, trusted = frozenset(low or ()), frozenset(trusted or ())
                kept, own = [], []
                for path, noise, article, text in blocks(raw.decode("utf-8", "replace")):
                    if noise is not None and not (noise and trusted and is_in(noise, trusted)):
                        continue
                    if article:
                        own.append(text)
                    if not (low and is_in(path, low)):
                        kept.append(text)
                texts.append(" ".join(kept or own))
            if len(known) > 100_000:
                known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return arrow_map(named, extract, f"`{id_col}` {kind}, `{url_col}` {url_kind}, text string, n_chars long")
