"""Main text of HTML pages by composite text density over the DOM."""

from __future__ import annotations

import html as _html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_batches, text_of

#: Comments, declarations and tags. Possessive repeats keep a page without a closing bracket linear.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S)
#: One attribute after another: name and value.
ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+)))?""")

#: Elements by what HTML says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split()
)
ENDS_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDS_LIKE = frozenset("ul ol dl menu select table tbody thead tfoot body".split())
NO_TEXT = frozenset(
    "head script style noscript template textarea iframe object embed svg math canvas audio video map button select input label nav aside footer menu dialog title xmp noembed noframes".split()
)
#: Elements that stand beside the paragraphs of an article on their own.
TEXT_LEVEL = frozenset("h1 h2 h3 h4 h5 h6 hgroup p blockquote pre figure figcaption table dl ol ul details time address header".split())
WHOLE = frozenset("html body article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
PROSE = frozenset("p blockquote pre table dl ol ul figure article main".split())
#: The end of a sentence.
SENTENCE = re.compile(r"\w\W?[.!?\u2026\u3002](?:\s|$)")
#: Words in a class, id or role that name what is no part of an article.
NO_CONTENT = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion popup modal overlay lightbox "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pager pagination toc sidebar aside widget widgets rail "
    "footer foot copyright colophon header masthead topbar toolbar skip cookie cookies consent gdpr notice notices notification alert disclaimer "
    "comment comments disqus respond reply replies discussion reader readers share sharing social follow subscribe subscription newsletter signup signin login register search searchbox "
    "related recommended recommendations recirculation trending popular tags taglist contentinfo complementary".split()
)
#: What may stand beside such a word in one name (site-footer, nav-bar, comment-list) without making it a name of something else.
NEUTRAL = frozenset(
    "site page main global primary secondary top bottom left right upper lower bar box block list item items link links wrap wrapper container section inner outer area panel row col js "
    "posts stories articles news form button buttons icon icons title slot unit policy media tools message messages thread fixed sticky mobile desktop".split()
)


def names_no_content(value: str, in_article: bool) -> bool:
    """Whether one of the names in a class, id or role says that it is no content: all its words do, or are neutral beside them.

    So has-sidebar, tag-search and header-and-content say nothing. An article's header and tags are its own.
    """
    own = NO_CONTENT - {"header", "tags"} if in_article else NO_CONTENT
    for name in value.split():
        words = set(re.split(r"[^a-z]+", name)) - {""}
        if words & own and words <= NO_CONTENT | NEUTRAL:
            return True
    return False


def attributes(attrs: str) -> dict[str, str]:
    """Name and value, in lower case, of a tag's attributes; of equal names the first one counts."""
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        out.setdefault(name.lower(), (a or b or c).lower())
    return out


def never_text(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether HTML itself says that the element and all in it are no article text."""
    if tag in NO_TEXT or (tag == "header" and not in_article):
        return True
    return tag not in WHOLE and (attrs.get("hidden", "x") in ("", "hidden") or attrs.get("aria-hidden") == "true")


def says_no_content(tag: str, attrs: dict[str, str], in_article: bool, nested: bool) -> bool:
    """Whether the element calls itself no content. An article doesn't by its names, unless it is ``nested`` in another one: such a one may be a comment."""
    if tag in ("form", "fieldset"):
        return True
    if tag in WHOLE and not (tag == "article" and nested):
        return False
    return any(names_no_content(attrs[k], in_article) for k in ("class", "id", "role") if k in attrs)


class Page:
    """The DOM in preorder: for each node its parent, tag, last descendant, whether it is never text (``out``), and whether it calls itself no content (``named``)."""

    def __init__(self, source: str):
        self.parent, self.tags, self.last, self.out, self.named, self.link, self.article, self.nested = [-1], ["#root"], [0], [False], [False], [False], [False], [False]
        #: (node, text) in page order; None ends a block.
        self.pieces: list[tuple[int, str | None]] = []
        self.stack = [0]
        at, end = 0, source.rfind(">")  # no tag ends after it
        while at <= end and (m := TOKEN.search(source, at)) is not None:
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            if not (tag := m[2]):
                continue
            tag = tag.lower()
            if m[1]:
                self.close(tag)
                continue
            self.open(tag, m[3])
            if tag in RAW and not m[3].endswith("/"):
                closing = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = closing.end() if closing else len(source)
                self.stack.pop()
        if at < len(source):
            self.text(source[at:])
        for node in range(len(self.parent) - 1, 0, -1):
            p = self.parent[node]
            self.last[p] = max(self.last[p], self.last[node])

    def text(self, text: str) -> None:
        self.pieces.append((self.stack[-1], text))

    def pop(self, k: int) -> None:
        for node in self.stack[k:]:
            if self.tags[node] in BLOCK:
                self.pieces.append((node, None))
        del self.stack[k:]

    def open(self, tag: str, attrs: str) -> None:
        if tag in ENDS_P:
            for k in range(len(self.stack) - 1, 0, -1):
                name = self.tags[self.stack[k]]
                if name == "p":
                    self.pop(k)
                    break
                if name in ENDS_P or name in ("td", "th", "button", "object"):
                    break
        if like := ENDS_LIKE.get(tag):
            for k in range(len(self.stack) - 1, 0, -1):
                name = self.tags[self.stack[k]]
                if name in like:
                    self.pop(k)
                    if tag != "tr" or name == "tr":
                        break
                elif name in HOLDS_LIKE:
                    break
        up, node = self.stack[-1], len(self.parent)
        inside = self.article[up]
        self.parent.append(up)
        self.tags.append(tag)
        self.last.append(node)
        found = attributes(attrs) if attrs else {}
        self.out.append(self.out[up] or never_text(tag, found, inside))
        self.named.append(not self.out[node] and says_no_content(tag, found, inside, self.nested[up]))
        self.link.append(self.link[up] or tag == "a")
        self.article.append(inside or tag in ("article", "main"))
        self.nested.append(self.nested[up] or tag == "article")
        if tag in BLOCK:
            self.pieces.append((node, None))
        if tag not in VOID:
            self.stack.append(node)

    def close(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.tags[self.stack[k]] == tag:
                self.pop(k)
                return
        if tag == "br":
            self.pieces.append((self.stack[-1], None))


def letters(text: str | None) -> int:
    """Characters other than spaces; none in a text of white space only."""
    return len(text) - text.count(" ") if text and text.strip() else 0


def densities(page: Page, out: list[bool]) -> tuple[list[float], list[float]]:
    """Composite text density of each node that isn't ``out``, and the sum of its children's.

    The density is characters per tag, adjusted for those in links. With C characters and T tags in a node, LC and LT
    of them in links, and LCb / Cb the share of link characters on the page: C/T * log(C/LC * T/LT + e - 1), to the
    base ln(C/(C-LC) * LC + LCb/Cb * C + e). Counts of 0 below a line count as 1. In the sums, text straight in a
    block counts as a child with one tag.
    """
    n = len(page.parent)
    c, t, lc, lt, sums = [0] * n, [0] * n, [0] * n, [0] * n, [0.0] * n
    for node, text in page.pieces:
        if text is not None and not out[node] and (size := letters(text)):
            c[node] += size
            if page.link[node]:
                lc[node] += size
            elif page.tags[node] in BLOCK:
                sums[node] += size
    for node in range(n - 1, 0, -1):
        p = page.parent[node]
        if not out[node]:
            c[p] += c[node]
            lc[p] += lc[node]
            t[p] += t[node] + 1
            lt[p] += lt[node] + (page.tags[node] == "a")
    share = lc[0] / max(1, c[0])
    density = [0.0] * n
    for node in range(n):
        if c[node] and not out[node]:
            base = math.log(c[node] / max(1, c[node] - lc[node]) * max(1, lc[node]) + share * c[node] + math.e)
            inner = max(1.0, c[node] / max(1, lc[node]) * max(1, t[node]) / max(1, lt[node]))
            density[node] = c[node] / max(1, t[node]) * math.log(inner + math.e - 1) / math.log(base)
            if node:
                sums[page.parent[node]] += density[node]
    return density, sums


def path_up(page: Page, node: int) -> list[int]:
    """The node and its ancestors, up to the body; without one, up to the root."""
    path = [node]
    while page.tags[path[-1]] != "body" and page.parent[path[-1]] >= 0:
        path.append(page.parent[path[-1]])
    return path


def inside(page: Page, marks: list[bool]) -> list[bool]:
    """Whether a node or one around it is marked."""
    held = list(marks)
    for node in range(1, len(held)):
        held[node] = held[node] or held[page.parent[node]]
    return held


def left_out(page: Page) -> list[bool]:
    """Nodes that are no content: those that HTML says so of, and those that say so themselves.

    How much text is in them doesn't matter: long comments below a short article are comments. Names don't count for
    what must be the article's own: where all titles (h1, main) of the page are in named nodes, the ones around a
    title; and where nothing outside named nodes is text of an article (a paragraph, list, table or quotation, or a
    sentence), so that names would leave headings and scraps at most, the ones around the largest density sum.
    """
    named, n = list(page.named), len(page.parent)
    within = inside(page, named)
    titles = [k for k in range(n) if page.tags[k] in ("h1", "main") and not page.out[k]]
    if titles and all(within[k] for k in titles):
        for k in titles:
            for node in path_up(page, k):
                named[node] = False
        within = inside(page, named)
    head, prose = inside(page, [t in HEADINGS for t in page.tags]), inside(page, [t in PROSE for t in page.tags])
    own = any(
        text is not None and letters(text) and not (page.out[k] or page.link[k] or within[k] or head[k]) and (prose[k] or SENTENCE.search(text)) for k, text in page.pieces
    )
    if not own and any(named):
        _, sums = densities(page, page.out)
        for node in path_up(page, max(range(n), key=lambda k: (sums[k], -k))):
            named[node] = False
    return inside(page, [a or b for a, b in zip(page.out, named, strict=True)])


def main_nodes(page: Page, out: list[bool]) -> list[int]:
    """The nodes whose subtrees are the article, in page order.

    The first is the node of the largest density sum; where the page has one main element, or else one article that is
    in no other, only nodes in it count. The smallest density on the path up to the body is the threshold for what
    joins from the levels above: text-level elements; sections, which are elements with a heading and more text-level
    elements; and what reaches the threshold and holds a text-level element, at the body's level two. Nothing joins
    that is mostly links. The levels end at an article or main element; from an article in a main one, only text-level
    elements join.
    """
    density, sums = densities(page, out)
    n = len(density)
    nodes = [k for k in range(n) if not out[k] and density[k] > 0]
    for tag in ("main", "article"):
        held = [k for k in nodes if page.tags[k] == tag and not (tag == "article" and page.nested[page.parent[k]])]
        if held:
            if len(held) == 1:
                nodes = [k for k in nodes if held[0] <= k <= page.last[held[0]]]
            break
    if not nodes:
        return []
    best = max(nodes, key=lambda k: (sums[k], -k))
    path = path_up(page, best)
    threshold = min(density[k] for k in path)
    unlinked, linked, level, heads, children = [0] * n, [0] * n, [0] * n, [0] * n, [[] for _ in range(n)]
    for node, text in page.pieces:
        if text is not None and not out[node]:
            (linked if page.link[node] else unlinked)[node] += letters(text)
    for node in range(n - 1, 0, -1):
        p = page.parent[node]
        unlinked[p] += unlinked[node]
        linked[p] += linked[node]
        if unlinked[node]:
            level[p] += level[node] + (page.tags[node] in TEXT_LEVEL)
            heads[p] += heads[node] + (page.tags[node] in HEADINGS)
        children[p].append(node)
    chosen, whole = [best], page.tags[best] == "article"
    if page.tags[best] == "main":
        return chosen
    for below, up in zip(path, path[1:], strict=False):
        if whole and page.tags[up] != "main":
            break
        least = 1 if page.article[up] or page.tags[up] not in ("body", "html", "#root") else 2
        for k in children[up]:
            if k == below or out[k] or not unlinked[k] or unlinked[k] < linked[k]:
                continue
            section = 0 < heads[k] < level[k] or (density[k] >= threshold and level[k] >= least)
            if page.tags[k] in TEXT_LEVEL or (section and not whole):
                chosen.append(k)
        if page.tags[up] == "main":
            break
        whole = whole or page.tags[up] == "article"
    return sorted(chosen)


def extract(source: str) -> str:
    """The text of the page's article: blocks in page order, white space as single spaces, references decoded."""
    page = Page(source)
    out = left_out(page)
    kept = bytearray(len(page.parent))
    for k in main_nodes(page, out):
        kept[k : page.last[k] + 1] = b"\1" * (page.last[k] + 1 - k)
    held, blocks = [], []
    for node, text in page.pieces:
        if kept[node] and out[node]:
            continue
        if kept[node] and text is not None:
            held.append(text)
        elif held:
            blocks.append("".join(held))
            held = []
    blocks.append("".join(held))
    words = [" ".join(_html.unescape(b).split()) for b in blocks]
    return " ".join(w for w in words if w)


def extract_text(pages: DataFrame, html_col: str = "html", name: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``pages`` with the article text of the whole HTML in column ``name`` (``_name`` if the column is there already).

    Null or empty HTML, and pages without an article, give an empty text. Unclosed and stray tags are read as
    browsers do; a page without any tag is all text. Repeated rows get equal texts; the columns in ``keep`` (all by
    default) stay as they are. No shuffle: a page's tree lives in one task while the page is read.
    """
    (source,) = fresh(pages, "html_")
    keep = pages.columns if keep is None else keep
    rows = pages.withColumn(source, text_of(html_col)).select(*[f"`{c}`" for c in dict.fromkeys([*keep, source])])
    return map_batches(rows, source, lambda xs: {name: [extract(x) for x in xs]}, T.StructType().add(name, "string"), keep=keep, rows=64)


def with_length(rows: DataFrame, text_col: str = "text", name: str = "n_chars") -> DataFrame:
    """Adds the number of code points, in ``_name`` if the column is there already."""
    return rows.withColumn(fresh(rows, name)[0], F.length(text_col).cast("long"))
