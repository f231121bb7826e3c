"""Main text of web pages by composite text density.

A page is read once into a tree of block elements; formatting elements only contribute text. Scripts, styles, menus,
forms, sidebars, notices, adverts, footers, site headers and reader comments hold no text. They are told by element, role, or a
whole class or id: each of its parts must be a word for such things or a neutral one ("site-footer", but not "social-history").
For every node the characters per tag, corrected for links, give its density:

    C / T * log(1 + C / LC * T / LT) / log(1 + log(C / (C - LC) * LC + LCb / Cb * C + e))

(C characters, T tags, LC and LT those in links, Cb and LCb of the body; zeros count as one). The node whose children
(and own text) have the largest sum of densities is the densest subtree. The smallest density on its path to the body is
the threshold. The content is the outermost node on that path whose density is nearer to the densest subtree's than to the threshold (by
ratio), or the outermost ``article`` on the path, as density cannot tell an article's own lists of links from menus. Of what lies outside,
titles before the path are kept. Inside, all blocks are kept but those below the threshold that consist mostly of
links, and these too in an ``article`` or ``main`` or if they hold a heading, list, table or caption.

Words that also stand for content ("notice", "related", "banner") don't remove a block with the densest subtree and over half of the page's plain text.

Defined cases: null or empty html gives an empty text; pages cut anywhere, unclosed or stray tags and unknown elements
are read as browsers do for blocks; ``br`` is white space; a page of any length is read whole; ties go to the outer node;
repeated rows agree; extra columns travel along and columns named like results are replaced.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_NAME_PART = re.compile(r"[a-z0-9]+")

# Element names and words that mark what is not the article.
_BLOCKS = frozenset("html body address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("head nav footer aside form button select menu dialog svg canvas object template search audio video datalist".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
_MARKS = frozenset("ad ads adv advert adverts advertisement advertisements advertising sponsor sponsors sponsored cookie cookies consent gdpr newsletter sidebar sidebars menu menus submenu nav navbar navigation navi breadcrumb breadcrumbs footer masthead topbar toolbar pagination pager popup login signup".split())
_AMBIGUOUS = frozenset("notice notices alert alerts banner promo promotion promotions subscribe subscription overlay modal social share sharing related recommended recommendations widget widgets copyright disclaimer header".split())
_COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
_NEUTRAL = frozenset("area articles bar block body bottom box button buttons col column container content desktop fixed floating global group holder icon icons inner item items js large left link links list main mobile module outer page panel posts primary region right row secondary section site slot small sticky stories text thread title top trail unit wide wrap wrapper zone".split())
_OF_COMMENTS = _NEUTRAL | frozenset("article discussion entry form post reader story user".split())
_CLOSE_P = _BLOCKS - frozenset("html body caption tbody td tfoot th thead tr option optgroup legend summary".split())
_SCOPE = frozenset("html table td th caption button object".split())
_SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th")}
_KEPT = frozenset("h1 h2 h3 h4 h5 h6 p pre ul ol dl dir li dt dd table caption thead tbody tfoot tr td th figcaption".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_HOLDERS = frozenset("ul ol dl table select menu html".split())


class _Node:
    __slots__ = ("name", "parent", "parts", "skip", "inline", "doubtful", "own", "links", "chars", "tags", "link_chars", "link_tags", "density", "total", "kept")

    def __init__(self, name: str, parent: _Node | None, skip: str, inline: bool, doubtful: bool = False):
        self.name, self.parent, self.skip, self.inline = name, parent, skip, inline
        #: Marked by a word that content has as well.
        self.doubtful = doubtful
        #: Text and child blocks in order.
        self.parts: list = []
        #: Characters of its own text, those of them in links, and its own links.
        self.own, self.links = (0, 0), 0
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        #: Holds text in a block that belongs to an article by its element.
        self.kept = False


def _mark(names: str, in_article: bool) -> str:
    """What the classes and ids say: "comments", "other", "doubtful" or ""."""
    found = ""
    for name in names.split():
        parts = {p for p in _NAME_PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if not p.isdigit()}
        if parts & _COMMENTS and parts <= _COMMENTS | _OF_COMMENTS:
            return "comments"
        if "header" in parts and (in_article or parts - {"header", "site", "global", "top", "main"}):
            continue
        if parts & (_MARKS | _AMBIGUOUS) and parts <= _MARKS | _AMBIGUOUS | _NEUTRAL:
            found = "other" if parts & _MARKS else found or "doubtful"
    return found


def _unwanted(name: str, attributes: str, inside: str, in_article: bool) -> str:
    """Why an element holds no article text: "comments", "other", "doubtful" or ""."""
    if name in _DROPPED:
        return "other"
    if name == "header" and not in_article:
        return "other"
    if attributes and name not in ("html", "body"):
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        if "hidden" in found or found.get("role", "").lower() in _ROLES or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
            return "other"
        mark = _mark(f"{found.get('class', '')} {found.get('id', '')}", in_article)
        if mark == "comments" or mark and name not in ("article", "main"):
            return mark if not inside or mark != "doubtful" else inside
    # an article inside an unclosed advert or menu is still the article
    return "" if name in ("article", "main") and inside == "other" else inside


def _tree(page: str) -> _Node:
    root = _Node("html", None, "", False)
    stack, at, articles = [root], 0, 0

    def close(to: int) -> None:
        nonlocal articles
        for n in stack[to:]:
            articles -= n.name in ("article", "main")
        del stack[to:]

    def text(s: str) -> None:
        top = stack[-1]
        if top.skip or not s:
            return
        k = len(stack) - 1
        linked = False
        while stack[k].inline:
            linked |= stack[k].name == "a"
            k -= 1
        s = entities.unescape(s) if "&" in s else s
        stack[k].parts.append(s)
        n = len(s) - s.count(" ")
        chars, linked_chars = stack[k].own
        stack[k].own = chars + n, linked_chars + n * linked

    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:  # an end tag
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    close(k)
                    break
                if name not in _BLOCKS and not stack[k].inline:
                    break
            continue
        if name == "br":
            text(" ")
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _CLOSE_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    close(k)
                    break
                if stack[k].name in _SCOPE:
                    break
        if name in _SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in _SIBLINGS[name]:
                    close(k)
                if k < len(stack) and stack[k].name in _HOLDERS:
                    break
        if name == "body" and len(stack) > 1 and stack[-1].name == "head":
            close(len(stack) - 1)
        if name == "html":
            continue
        inline = name not in _BLOCKS and name not in _DROPPED
        top = stack[-1]
        skip = _unwanted(name, m[3] or m[6] or "", top.skip, articles > 0)
        doubtful, skip = skip == "doubtful", "" if skip == "doubtful" else skip
        block = next(n for n in reversed(stack) if not n.inline)
        if inline:
            if name == "a":
                block.links += 1
            if skip == top.skip and (name in _VOID or name != "a"):
                if name not in _VOID:
                    stack.append(_Node(name, block, skip, True))
                continue
        if name in _VOID:
            if name == "hr" and not top.skip:
                block.parts.append(_Node(name, block, skip, False))
            continue
        node = _Node(name, block, skip, inline, doubtful)
        if not inline:
            if name == "body":
                while len(stack) > 1 and stack[-1].inline:
                    stack.pop()
            block.parts.append(node)
        stack.append(node)
        articles += name in ("article", "main")
    text(page[at:])
    return root


def _ordered(root: _Node) -> list[_Node]:
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [x for x in reversed(n.parts) if not isinstance(x, str)]
    return out


def _measure(nodes: list[_Node]) -> None:
    """Fills in counts, densities and sums from the nodes' own text."""
    own = {}
    for n in nodes:
        own[n] = n.chars, n.link_chars = n.own
        n.tags, n.link_tags, n.kept = 0, n.links, False
    for n in reversed(nodes):
        for x in n.parts:
            if not isinstance(x, str):
                n.chars += x.chars
                n.tags += x.tags + 1
                n.link_chars += x.link_chars
                n.link_tags += x.link_tags
                n.kept |= x.kept
        n.kept |= n.name in _KEPT and n.chars > 0
    root = nodes[0]
    ratio = root.link_chars / max(1, root.chars)

    def density(c: int, t: int, lc: int, lt: int) -> float:
        if not c:
            return 0.0
        t, plain = max(1, t), max(1, c - lc)
        unlinked = c / max(1, lc) * t / max(1, lt)
        return c / t * math.log(1 + max(1.0, unlinked)) / math.log(1 + math.log(c / plain * lc + ratio * c + math.e))

    for n in nodes:
        n.density = density(n.chars, n.tags, n.link_chars, n.link_tags)
    for n in nodes:
        c, lc = own[n]
        n.total = density(c, 1, lc, 1 if lc else 0) + sum(x.density for x in n.parts if not isinstance(x, str))


def _densest(nodes: list[_Node]) -> _Node:
    return max(nodes, key=lambda n: n.total)


def _path(node: _Node) -> list[_Node]:
    """The node and what it is in, up to the root."""
    out = [node]
    while out[-1].parent is not None:
        out.append(out[-1].parent)
    return out


def _sure(nodes: list[_Node]) -> list[_Node]:
    """The nodes without doubtful blocks, but for one that has the densest subtree and most of the plain text."""
    plain, around = nodes[0].chars - nodes[0].link_chars, set(_path(_densest(nodes)))
    gone: set[_Node] = set()
    for n in nodes:
        if n.parent in gone or n.doubtful and not (n in around and (n.chars - n.link_chars) * 2 > plain):
            gone.add(n)
    for n in nodes:
        if n not in gone:
            n.parts = [x for x in n.parts if isinstance(x, str) or x not in gone]
    return [n for n in nodes if n not in gone]


def _content(path: list[_Node]) -> tuple[_Node, float, bool]:
    """(node with the content, threshold, whether it is an article) from the densest subtree's path to the body."""
    threshold = min(n.density for n in path)
    enough = math.sqrt(threshold * path[0].density)
    best = ([n for n in path if n.name == "article"] or [n for n in path if n.density >= enough or n is path[0]])[-1]
    return best, threshold, any(n.name in ("article", "main") for n in _path(best))


def main_text(page: str | None) -> str:
    """The blocks of the page's main content, one per line."""
    if not page:
        return ""
    nodes = _ordered(_tree(page))
    _measure(nodes)
    if any(n.doubtful for n in nodes):
        nodes = _sure(nodes)
        _measure(nodes)
    path = _path(_densest(nodes))
    if not path[0].chars:
        return ""
    best, threshold, article = _content(path)
    lines: list[str] = []
    held: list[str] = []

    def flush() -> None:
        line = " ".join("".join(held).split())
        if line:
            lines.append(line)
        held.clear()

    todo: list = [best, *reversed(_headings(path[path.index(best) :]))]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            held.append(x)
        elif x is None:
            flush()
        else:
            flush()
            if not article and x is not best and not x.kept and x.link_chars * 2 > x.chars and x.density < threshold:
                continue
            todo.append(None)
            todo += reversed(x.parts)
    flush()
    return "\n".join(lines)


def _headings(path: list[_Node]) -> list[_Node]:
    """Titles before the path's first node or one that it is in: any ``h1``, and headings with no block between."""
    out: list[_Node] = []
    for below, node in zip(path, path[1:], strict=False):
        here, near = [], True
        for x in reversed(node.parts[: node.parts.index(below)]):
            if isinstance(x, str):
                near &= not x.strip()
            elif x.name == "h1" or near and x.name in _HEADINGS:
                here.insert(0, x)
            else:
                near &= not x.chars
        out = here + out
    return out


def _run(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(x.as_py()) for x in pages], pa.string())


_run.__annotations__ = {"pages": pa.Array, "return": pa.Array}


def extract_pages(pages: DataFrame) -> DataFrame:
    """The rows with text and its length in code points, n_chars."""
    text = F.arrow_udf(_run, "string")(F.col("html").cast("string"))
    return pages.drop("text", "n_chars").withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
