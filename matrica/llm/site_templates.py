"""Main text of web pages, with site templates removed.

Pages are parsed into trees.  Every container of the whole page, menus, headers
and footers as well as boxes inside the article, has its subtree hashed and is
counted per host in Spark: one that recurs with many of a host's different
articles, by their share or on a large host by their number, is the site's
template and is deleted.  Copies of one article count once, in the share too,
and bare paragraphs inside a page's article are never candidates, so repeated
articles and passages stay.  What recurrence cannot tell, on hosts of few pages
or in blocks that differ from page to page (adverts, reader comments, forms),
goes by element, role or class; ``n_templates`` says how many subtrees of a
page recurrence deleted, so how much of the work each did can be read off.
Counting is a grouped sum over (host, hash) with map-side combining; hits go
back by page, so a host with a third of all pages is spread like any other.

The text that is left: of the page's articles, in page order, if it has any
(else of ``main``, a container named so, or the body), character references
decoded, white space inside a block to one space, trimmed, blocks joined by
one line break.  Trees are walked without recursion, at any depth.

Defined cases: null or empty HTML gives an empty text; unclosed and stray tags
are tolerated, a page without any tag is one block of text; a null URL counts
as the host ''; repeated pages are extracted each, those of one id lose what is
a template on any of them; a null id keeps its templates; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrica.llm._shared import materialize

#: A subtree is a template from so many different articles of its host on, and so large a share of them.
MIN_PAGES, MIN_SHARE = 5, 0.1
#: From so many different articles on it is one whatever the share, as on large hosts a section's template has a small one.
SURE_PAGES = 200

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe object svg math textarea title head canvas audio video".split())
_DROP = frozenset("nav footer aside form button select dialog menu fieldset label option datalist input noembed noframes map".split())
_BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Containers whose subtrees may be templates, in and outside the article.
_UNITS = frozenset("div section ul ol dl table header figure details center nav footer aside form menu dialog fieldset".split())
_ENDS_P = _BLOCK - {"body", "html"}
_ROLE = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form".split())
_BAD = re.compile(
    r"(?:^|[\s_\-])(?:ads?|adverts?|advertisement|advertising|adbox|adslot|sponsor(?:ed|s)?|promo(?:tion|ted)?|banner|nav|navbar|navigation|menu|menus|topbar|breadcrumbs?|"
    r"sidebar|side|aside|widget|footer|foot|site-?header|page-?header|masthead|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|"
    r"login|search|share|sharing|social|related|recommended|recommendations|comments?|commentlist|respond|replies|reply|disqus|pagination|pager|skip|toolbar|legal|copyright|disclaimer|paywall)(?:$|[\s_\-\d])",
    re.I,
)
_MAIN = re.compile(r"(?:^|[\s_\-])(?:article|post|entry|content|story|main)(?:[\s_\-]?(?:body|content|text))?(?:$|[\s_\-])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:\-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|$)", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][\w:.\-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([a-zA-Z_:][\w:.\-]*)""")
_WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "kids", "up", "key")

    def __init__(self, tag: str, attrs: str = "", up: Node | None = None):
        self.tag, self.attrs, self.kids, self.up, self.key = tag, attrs, [], up, None

    def get(self, name: str) -> str:
        if name not in self.attrs.lower():
            return ""
        for m in _ATTR.finditer(self.attrs):
            if (m[1] or m[5]).lower() == name:
                return m[2] or m[3] or m[4] or ""
        return ""


def parse(html: str) -> Node:
    """A tree; text is kept as strings among the children, raw elements are left out."""
    root = Node("#root")
    at, pos = root, 0
    while True:
        m = _TOKEN.search(html, pos)
        text = html[pos : m.start() if m else len(html)]
        if text:
            at.kids.append(text)
        if not m:
            return root
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            node = at
            while node is not root and node.tag != tag:
                if node.tag in ("article", "main", "body", "table") and tag not in ("body", "html", "article", "main"):
                    node = root
                    break
                node = node.up
            if node is not root:
                at = node.up
            continue
        if tag in _RAW:
            if not m[3].rstrip().endswith("/") or tag not in ("svg", "math"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, pos)
                if tag == "head":  # its elements may be left open; the body ends it
                    end = end or re.compile(r"(?=<body)", re.I).search(html, pos)
                    pos = end.end() if end else pos
                elif end:
                    pos = end.end()
                else:
                    pos = len(html) if tag in ("script", "style", "textarea", "title") else pos
            continue
        if tag in _ENDS_P:
            node = at
            while node is not root and node.tag not in _UNITS and node.tag not in ("article", "main", "body", "td", "li", "blockquote", "section"):
                if node.tag == "p":
                    at = node.up
                    break
                node = node.up
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            node = at
            while node is not root and node.tag not in ("ul", "ol", "dl", "table", "div", "article", "body", "main"):
                if node.tag == tag or (node.tag, tag) in (("dt", "dd"), ("dd", "dt"), ("td", "th"), ("th", "td")):
                    at = node.up
                    break
                node = node.up
        node = Node(tag, m[3] or "", at)
        at.kids.append(node)
        if tag not in _VOID and not (m[3] or "").rstrip().endswith("/"):
            at = node


def boilerplate(node: Node, in_main: bool) -> bool:
    """By element, role, class or id alone."""
    if node.tag in _DROP or (node.tag == "header" and not in_main):
        return True
    if not node.attrs or node.tag in ("html", "body", "article", "main"):
        return False
    if node.get("role").lower() in _ROLE or node.get("aria-hidden").lower() == "true" or re.search(r"(?:^|\s)hidden(?:\s|=|$)", node.attrs) or "display:none" in node.get("style").replace(" ", "").lower():
        return True
    return bool(_BAD.search(f"{node.get('class')} {node.get('id')}"))


def _strip(root: Node, gone: frozenset[str] = frozenset()) -> int:
    """Take out templates, then boilerplate; returns how many templates went."""
    count, stack = 0, [(root, False)]
    while stack:
        node, in_main = stack.pop()
        kept = []
        for k in node.kids:
            if not isinstance(k, str):
                inside = in_main or k.tag in ("article", "main")
                if gone and k.key in gone:
                    count += 1
                    continue
                if boilerplate(k, inside):
                    continue
                stack.append((k, inside))
            kept.append(k)
        node.kids = kept
    return count


def _set_keys(root: Node) -> list[Node]:
    """Give every container its subtree's digest, children first; lists the containers."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [k for k in n.kids if not isinstance(k, str)]
    units, digest = [], {}
    for n in reversed(order):
        out = [n.tag, n.get("class") if n.attrs else ""]
        for k in n.kids:
            out.append("\1" + _WHITE.sub(" ", k).strip() if isinstance(k, str) else "\2" + digest.pop(id(k)))
        key = digest[id(n)] = hashlib.md5("\0".join(out).encode("utf-8", "replace")).hexdigest()
        if n.tag in _UNITS:
            n.key = key
            units.append(n)
    return units


def main_node(root: Node) -> Node:
    """The page's articles under one node, in page order; else the heaviest ``main``, container named so, or body."""
    found: dict[int, list[Node]] = {0: [], 1: [], 2: [], 3: []}
    stack = [root]
    while stack:
        n = stack.pop()
        for k in n.kids:
            if isinstance(k, str):
                continue
            stack.append(k)
            if k.tag == "article":
                found[0].append(k)
            elif k.tag == "main" or (k.attrs and k.get("role") == "main"):
                found[1].append(k)
            elif k.attrs and k.tag in ("div", "section") and _MAIN.search(f"{k.get('class')} {k.get('id')}"):
                found[2].append(k)
            elif k.tag == "body":
                found[3].append(k)
    if found[0]:
        return _outermost(root)
    for level in (1, 2, 3):
        if found[level]:
            return max(found[level], key=lambda n: sum(map(len, _texts(n))))
    return root


def _texts(node: Node) -> Iterator[str]:
    stack = [node]
    while stack:
        for k in stack.pop().kids:
            if isinstance(k, str):
                yield k
            else:
                stack.append(k)


def _outermost(root: Node) -> Node:
    """A node with the articles that are in no other article."""
    top, stack = Node("body"), [root]
    while stack:
        n = stack.pop()
        if n.tag == "article":
            top.kids.append(n)
        else:
            stack += reversed([k for k in n.kids if not isinstance(k, str)])
    return top.kids[0] if len(top.kids) == 1 else top


def blocks(node: Node) -> list[str]:
    """Texts of the blocks in page order."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = _WHITE.sub(" ", _html.unescape("".join(line))).strip()
        line.clear()
        if text:
            out.append(text)

    stack: list = list(reversed(node.kids))
    while stack:
        k = stack.pop()
        if k is None:  # a block ends
            end()
        elif isinstance(k, str):
            line.append(k)
        elif k.tag == "br":
            line.append(" ")
        elif k.tag in _BLOCK:
            end()
            stack.append(None)
            stack += reversed(k.kids)
        else:
            stack += reversed(k.kids)
    end()
    return out


def unit_keys(html: str | None) -> tuple[str, list[str]]:
    """A digest of the article's text, and the keys of the page's containers."""
    root = parse(html or "")
    keys = {n.key for n in _set_keys(root)}
    _strip(root)
    top = main_node(root)
    whole = hashlib.md5("\n".join(b for b in _plain(top)).encode("utf-8", "replace")).hexdigest()
    return whole, sorted(keys)


def _plain(top: Node) -> list[str]:
    """Blocks that are in no container, or all if there is none: what tells one article from another."""
    out: list[str] = []
    for k in top.kids:
        if isinstance(k, str):
            if k.strip():
                out.append(k)
        elif k.tag not in _UNITS:
            out += blocks(k)
    return out or blocks(top)


def extract(html: str | None, gone: frozenset[str] = frozenset()) -> tuple[str, int]:
    """The main text, and how many subtrees went as templates."""
    root = parse(html or "")
    if gone:
        _set_keys(root)
    count = _strip(root, gone)
    return "\n".join(blocks(main_node(root))), count


def host_key(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def template_keys(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, sure_pages: int = SURE_PAGES) -> DataFrame:
    """``(id, key)``: containers of each page that are templates of its host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for k in range(0, big.num_rows, 256):
                b = big.slice(k, 256)
                got = [unit_keys(h) for h in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got]), pa.array([g[1] for g in got], pa.list_(pa.string()))], ["_id", "_host", "_article", "_keys"])

    src = pages.select(F.col(id_col).alias("_id"), host_key(F.col(url_col)).alias("_host"), F.col(html_col))
    units = src.mapInArrow(run, f"_id {dict(pages.dtypes)[id_col]}, _host string, _article string, _keys array<string>")
    units = materialize(units, "page-units")
    each = units.select("_id", "_host", "_article", F.explode("_keys").alias("_key"))
    seen = each.groupBy("_host", "_key", "_article").agg(F.lit(1).alias("x")).groupBy("_host", "_key").agg(F.count(F.lit(1)).alias("n"))
    hosts = units.groupBy("_host", "_article").agg(F.lit(1).alias("x")).groupBy("_host").agg(F.count(F.lit(1)).alias("articles"))
    seen = seen.where(F.col("n") >= min_pages).join(hosts, "_host")
    bad = seen.where((F.col("n") >= F.lit(min_share) * F.col("articles")) | (F.col("n") >= sure_pages)).select("_host", "_key")
    return each.join(bad, ["_host", "_key"], "left_semi").select("_id", "_key")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, sure_pages: int = SURE_PAGES) -> DataFrame:
    """``(id, url, text, n_chars, n_templates)`` for every page."""
    hits = template_keys(pages, id_col, url_col, html_col, min_pages, min_share, sure_pages).groupBy("_id").agg(F.collect_set("_key").alias("_gone"))
    hits = materialize(hits, "page-templates")
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("_html"))
    rows = rows.join(hits, rows[id_col] == hits["_id"], "left").select(id_col, url_col, "_html", "_gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for k in range(0, big.num_rows, 256):
                b = big.slice(k, 256)
                texts = [extract(h, frozenset(g or ())) for h, g in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t for t, _ in texts], pa.string()), pa.array([len(t) for t, _ in texts], pa.int64()), pa.array([n for _, n in texts], pa.int32())], [id_col, url_col, "text", "n_chars", "n_templates"])

    kinds = dict(pages.dtypes)
    return rows.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars bigint, n_templates int")
