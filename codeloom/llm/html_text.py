"""Main text of web pages by composite text density.

The page becomes a tree (tolerant of unclosed and stray tags; script, style and
comments hold no text), in time linear in the page. Each node has its characters,
its tags and the same within links, which give its composite text density (Sun,
Song and Liao 2011),

    C/T * log(C/LC * T/LT) / log(log(C/NC * LC + LCb/Cb * C + e) + 1)

where C and T are characters and tags, LC and LT those inside links, NC the
characters outside links, and b the body (the 1 keeps pages without links from a
division by zero), and its plain one: characters per tag, both outside links.

1. The node with the largest sum of its children's densities is the core of the
   article and is kept.
2. The least densities on the path from the body to the core are the thresholds.
   On that path, blocks beside it are kept if they reach the threshold of either
   density; blocks that don't are searched for blocks within them that do. Short
   lines of running text beside the path (headings anywhere; paragraphs and loose
   text below the body) stay as well, so that a heading or a first sentence beside
   the core isn't lost.
3. Anywhere, a block of three links or more that are over half of its text, and
   that doesn't reach the threshold, is a menu and goes.

Boilerplate is by tag and role (nav, aside, form and so on; a header outside of an
article) or by a class or id of a sort that can be dense (adverts, comments,
sidebars) unless that block holds the article itself. Words that also name
content (notice, social, related) count only for blocks of low density: below one
threshold, and below half of the other. Nothing else is left out.

Defined results: null or empty html gives empty text; so does a page without
text; null ids and urls pass through; repeated rows give repeated rows; an empty
table gives none; other columns are ignored. An end of page within a tag ends it.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
GAP = re.compile(r"[\s/]*")
KEY = re.compile(r"[^>][^\s=/>]*")
EQUALS = re.compile(r"\s*=\s*")
BARE = re.compile(r"[^\s>]*")
HIDDEN = re.compile(r"display\s*:\s*none")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}[^>]*(?:>|\Z)", re.I) for t in "script style textarea title iframe noembed noframes xmp".split()}
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li legend main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head script style noscript template iframe object embed svg canvas nav footer aside form button select textarea input dialog menu title".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
LINES = frozenset("p pre blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar".split())
STRONG = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertis\w*|adsense|adbox|sponsor(?:s|ed)?|side-?bars?|nav|navbar|navigation|menu|footer|comments?|commentlist|disqus|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|signup|breadcrumbs?|pagination|pager|login)(?=$|[\s_-])", re.I)
WEAK = re.compile(r"(?:^|[\s_-])(?:notices?|alert|banner|social|related|recommend\w*|shar(?:e|ing)|promo\w*|widget|toolbar|header|masthead|foot|respond|replies|overlay|skip)(?=$|[\s_-])", re.I)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = ("ul", "ol", "dl", "table", "select")
SCOPES = frozenset("article section div body html table ul ol dl main aside nav td th form blockquote".split())


class Node:
    __slots__ = ("tag", "parent", "kids", "mark", "junk", "chars", "tags", "link_chars", "link_tags", "density", "plain", "sum")

    def __init__(self, tag: str, parent: Node | None, mark: int = 0):
        self.tag, self.parent, self.kids, self.mark, self.junk = tag, parent, [], mark, mark == 3

    def nodes(self) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node) and not k.junk]


def _mark(tag: str, attrs: list[tuple[str, str]], in_article: bool) -> int:
    """3 boilerplate, 2 by a strong word, 1 by a weak word, 0 none."""
    if tag in DROPPED or tag == "header" and not in_article:
        return 3
    mark = 0
    if attrs and tag not in ("html", "body", "article", "main"):
        for name, value in attrs:
            if name in ("class", "id"):
                mark = max(mark, 2 if STRONG.search(value) else 1 if WEAK.search(value) else 0)
            elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
                return 3
    return mark


def _attributes(page: str, at: int, last: dict[str, int]) -> tuple[list[tuple[str, str]], int]:
    """The attributes of a tag and where it ends. last: the last place of each quote."""
    out: list[tuple[str, str]] = []
    while True:
        at = GAP.match(page, at).end()
        if at >= len(page):
            return out, at
        if page[at] == ">":
            return out, at + 1
        m = KEY.match(page, at)
        at, value = m.end(), ""
        if eq := EQUALS.match(page, at):
            at = eq.end()
            quote = page[at : at + 1]
            if quote in last and at < last[quote]:
                end = page.index(quote, at + 1)
                value, at = page[at + 1 : end], end + 1
            else:  # a quote that nothing closes is no quote
                v = BARE.match(page, at)
                value, at = v[0], v.end()
        out.append((m[0].lower(), value))


class _Builder:
    """The tree, with the open nodes in a stack and the places of each tag in it, so that no lookup walks."""

    def __init__(self):
        self.root = Node("html", None)
        self.stack, self.at, self.scopes = [self.root], defaultdict(list), [0]

    def text(self, s: str) -> None:
        if s:
            self.stack[-1].kids.append(html.unescape(s) if "&" in s else s)

    def _pop_to(self, size: int) -> None:
        while len(self.stack) > size:
            n = self.stack.pop()
            self.at[n.tag].pop()
            if self.scopes[-1] == len(self.stack):
                self.scopes.pop()

    def _last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at[t]), default=-1)

    def close(self, tag: str) -> None:
        at = self._last((tag,))
        if at > 0 and (tag in BLOCKS or at >= self.scopes[-1]):
            self._pop_to(at)

    def open(self, tag: str, attrs: list[tuple[str, str]], empty: bool) -> None:
        if tag == "html":
            return
        if tag in BLOCKS and (at := self._last(("p",))) > 0 and at >= self.scopes[-1]:  # a block ends an open paragraph
            self._pop_to(at)
        if tag in CLOSES and (at := self._last(CLOSES[tag])) > self._last(LISTS):
            self._pop_to(min(self.at[t][k] for t in CLOSES[tag] for k in range(len(self.at[t])) if self.at[t][k] > self._last(LISTS)) if tag == "tr" else at)
        if self.stack[-1].tag == "head" and tag in ("body", "div", "article", "main", "p"):
            self._pop_to(len(self.stack) - 1)
        here = self.stack[-1]
        new = Node(tag, here, _mark(tag, attrs, bool(self.at["article"] or self.at["main"])))
        here.kids.append(new)
        if not empty and tag not in VOID and tag not in RAW:
            self.at[tag].append(len(self.stack))
            if tag in SCOPES:
                self.scopes.append(len(self.stack))
            self.stack.append(new)


def tree(page: str) -> Node:
    build, at, n = _Builder(), 0, len(page)
    last = {q: page.rfind(q) for q in "\"'"}
    last_end = page.rfind(">")
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            build.text(page[at:])
            break
        c = page[begin + 1 : begin + 2]
        if not (c.isascii() and (c.isalpha() or c in "/!?")) or not c:  # no tag
            end = begin + 1
            build.text(page[at:end])
            at = end
            continue
        build.text(page[at:begin])
        if c == "!" and page.startswith("--", begin + 2):
            end = page.find("-->", begin + 2)
            at = end + 3 if end >= 0 else n
        elif begin > last_end:  # the page ends within a tag
            break
        elif c in "!?":
            at = page.index(">", begin) + 1
        elif c == "/":
            if m := NAME.match(page, begin + 2):
                build.close(m[0].lower())
            at = page.index(">", begin) + 1
        else:
            m = NAME.match(page, begin + 1)
            tag, at = m[0].lower(), m.end()
            attrs, at = ([], at + 1) if page[at : at + 1] == ">" else _attributes(page, at, last)
            build.open(tag, attrs, page[at - 2 : at] == "/>")
            if tag in RAW:
                m = RAW[tag].search(page, at)
                at = m.end() if m else n
    return build.root


def _settle_marks(root: Node) -> None:
    """Blocks with a strong word are boilerplate unless they hold the article, or there is nothing else."""
    nodes, stack = [], [root]
    while stack:
        n = stack.pop()
        nodes.append(n)
        stack += n.nodes()
    holds = {n for n in nodes if n.tag in ("article", "main", "h1", "body")}
    for n in reversed(nodes):
        if n in holds and n.parent is not None:
            holds.add(n.parent)
    for n in nodes:
        n.junk = n.junk or n.mark == 2 and n not in holds


def _densities(body: Node) -> list[Node]:
    """Sets the densities of all nodes below the body but boilerplate, and gives them, parents first."""
    nodes, stack = [], [body]
    while stack:
        n = stack.pop()
        nodes.append(n)
        stack += n.nodes()
    for n in reversed(nodes):
        own = n.nodes()
        n.chars = sum(len(" ".join(k.split())) for k in n.kids if isinstance(k, str)) + sum(k.chars for k in own)
        n.tags = len(own) + sum(k.tags for k in own)
        n.link_chars = n.chars if n.tag == "a" else sum(k.link_chars for k in own)
        n.link_tags = (n.tag == "a") + sum(k.link_tags for k in own)
    share = body.link_chars / max(1, body.chars)
    for n in reversed(nodes):
        c, t, lc, lt = n.chars, max(1, n.tags), n.link_chars, n.link_tags
        if c:
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            n.density = c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt))) / math.log(base + 1)
        else:
            n.density = 0.0
        n.plain = (c - lc) / max(1, n.tags - lt)
        n.sum = sum(k.density for k in n.nodes())
    return nodes


def select(root: Node) -> Node:
    """The body, with all that isn't the article marked as boilerplate or taken out."""
    _settle_marks(root)
    body = root
    while (below := next((k for k in body.nodes() if k.tag == "body"), None)) is not None:
        body = below
    nodes = _densities(body)
    core = max((n for n in nodes if n.tag in BLOCKS), key=lambda n: n.sum, default=body)
    if core.sum == 0:
        core = body
    path = [core]
    while path[-1] is not body:
        path.append(path[-1].parent)
    least, plain, on_path = min(n.density for n in path), min(n.plain for n in path), set(path)

    def menu(n: Node) -> bool:
        return n.link_tags >= 3 and 2 * n.link_chars > n.chars and n.density < least

    def reaches(n: Node) -> bool:
        return (n.density >= least or n.plain >= plain) and 2 * n.link_chars <= n.chars

    def beside(k: Node | str, n: Node) -> bool | None:
        """Whether what stands beside the path in n is kept; None: parts of it."""
        if isinstance(k, str):
            return n is not body or len(" ".join(k.split())) >= plain
        if k.tag in HEADS or k.tag in LINES and n is not body or k.tag not in BLOCKS:
            return 2 * k.link_chars <= k.chars and (n is not body or k.tag in HEADS or reaches(k))
        return reaches(k) or None

    for n in nodes:
        if n not in on_path and n.tag in BLOCKS and (menu(n) or n.mark == 1 and (n.density < least and 2 * n.plain < plain or 4 * n.link_chars > n.chars)):
            n.junk = True
    parts = []
    for n, below in zip(path[1:], path):
        kept = []
        for k in n.kids:
            is_node = isinstance(k, Node)
            verdict = True if k is below else False if is_node and k.junk else beside(k, n)
            if verdict is not False:
                kept.append(k)
            if verdict is None:
                parts.append(k)
        n.kids = kept
    while parts:  # blocks within blocks that are not dense enough
        n = parts.pop()
        n.kids = [k for k in n.nodes() if k.tag in BLOCKS]
        parts += [k for k in n.kids if not reaches(k)]
    return body


def blocks(top: Node) -> list[str]:
    """Texts of the blocks below a node in page order, without boilerplate; a run of links is none."""
    out: list[str] = []
    now: list[str] = []
    links = [0, 0]  # characters and number of the links in the run

    def end() -> None:
        if text := " ".join("".join(now).split()):
            if not (links[1] >= 3 and 2 * links[0] > len(text)):
                out.append(text)
        now.clear()
        links[:] = 0, 0

    stack: list = [top]
    while stack:
        n = stack.pop()
        if n is None:
            end()
        elif isinstance(n, str):
            now.append(n)
        elif n.tag == "br":
            now.append(" ")
        elif not n.junk:
            if n.tag in BLOCKS:
                end()
                stack.append(None)
            elif n.tag == "a" and n.chars:
                links[0] += n.chars
                links[1] += 1
            stack += reversed(n.kids)
    end()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n\n".join(blocks(select(tree(page))))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text): one row per input row. No shuffle."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(h.as_py()) for h in b.column(2)], pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
