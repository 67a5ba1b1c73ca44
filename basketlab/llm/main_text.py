"""Main text of web pages by the distribution of line blocks.

Markup is stripped into lines, one per block of text; containers that never hold the article
(menus, page headers, footers, sidebars, adverts, notices, forms, reader comments, scripts, styles)
leave empty lines. The text lengths of each window of ``WINDOW`` lines are summed. Where the sums
leave zero the text surges, where they return to zero it dives; a stretch between surge and dive
whose largest window reaches the threshold (``SURGE`` characters, or half of the page's largest
window where that is less) is kept, with all its lines. Words of links do not count towards a
length (inside an article: those in lists), so a bare list of links dives. Where a page marks its
article (``article``, ``main``, or a class of such a name around half of the text or more), only
lines inside are looked at, and what is stripped inside leaves no empty line.

A block ends where a block element begins or ends; ``br`` and inline elements do not end it. Runs
of white space in a block become one space, blocks are joined by an empty line. Character
references are decoded once. Nothing of a kept line is dropped.

Results: null and empty pages, and pages without text outside stripped containers, give ``''`` and
0 characters. Unclosed and misnested tags are closed by the containers around them; text after an
unclosed script or comment is not text. Equal rows get equal results; pages may have any length. An
empty table gives an empty result. The columns ``main_text`` and ``n_main`` are replaced, all others
are carried.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlab.llm.common import add_columns

# Lines of a window; characters a window must reach for the text to surge.
WINDOW, SURGE = 3, 86

# Elements by their part in a page.
_RAW = "script style noscript template svg math iframe object canvas audio video map".split()
_STRIPPED = "nav header footer aside form dialog menu select button textarea head title label option datalist".split()
_BLOCKS = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead title tr ul option select textarea search"
).split()
_VOID = "area base br col embed hr img input link meta param source track wbr".split()
# Words of class, id and role names that tell a stripped container, or the article.
_STRIPPED_NAMES = (
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle banner breadcrumb breadcrumbs "
    "comment comments commentlist complementary consent contentinfo cookie cookies copyright dialog discussion disqus "
    "disclaimer footer gdpr hidden legal login masthead menu menubar modal nav navbar navigation newsletter notice "
    "notices notification outbrain pager paywall pagination popup privacy promo promoted promotion reader-comments "
    "recommendations recommended related replies reply respond search share sharing sidebar signup skip social "
    "site-header siteheader page-header pageheader sponsor sponsored subscribe subscription taboola toc toolbar topbar widget widgets alert"
).split()
_ARTICLE_NAMES = "article articlebody content entry main post story".split()

_IS_RAW, _IS_STRIPPED, _IS_BLOCK, _IS_VOID = map(frozenset, (_RAW, _STRIPPED, _BLOCKS, _VOID))
_IS_STRIPPED_NAME, _IS_ARTICLE_NAME = frozenset(_STRIPPED_NAMES), frozenset(_ARTICLE_NAMES)
_ARTICLE_TAGS = frozenset(("article", "main"))
# Elements a class name never strips, since the whole page or the article may carry it.
_NEVER_NAMED = frozenset(("html", "body", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# An opening tag of these ends an open element of the same list.
_ENDED_BY = {
    "p": _IS_BLOCK,
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "tbody", "tfoot")),
    "td": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "th": frozenset(("td", "th", "tr", "tbody", "tfoot")),
}

_MARK = re.compile(r"<(?:(/)?([A-Za-z][^\s/>]*)|(!--)|([!?]))")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_NAMED = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?<![\w-])(?:hidden(?=[\s/>=]|$)|aria-hidden\s*=\s*["']?true)|display\s*:\s*none""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in _RAW}


def _names(attributes: str) -> tuple[bool, bool]:
    """Whether the names of an element tell a stripped container, or the article."""
    if _HIDDEN.search(attributes):
        return True, False
    stripped = article = False
    for kind, *values in _NAMED.findall(attributes):
        for name in "".join(values).split():
            words = {w.lower() for w in _PARTS.findall(name)} | {name.lower()}
            stripped |= not words.isdisjoint(_IS_STRIPPED_NAME)
            # A name of the article is whole, or says what the content or body is of.
            article |= name.lower() in _IS_ARTICLE_NAME or len(words & {"article", "entry", "main", "post", "story"}) > 0 and not words.isdisjoint(("content", "body", "text"))
    return stripped, article and not stripped


class _Page:
    """Lines of a page: (text, characters outside links, inside an article)."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, int, bool]] = []
        self.text: list[str] = []
        self.plain = 0
        self.open: list[tuple[str, bool, bool]] = []  # name, stripped, article
        self.count: dict[str, int] = {}
        self.stripped = self.articles = self.headers = self.links = self.heading = 0
        self.tagged = False

    def say(self, text: str) -> None:
        # The header of an article keeps its headings.
        if self.stripped and not (self.heading and self.articles and self.stripped == self.headers):
            return
        text = html.unescape(text) if "&" in text else text
        self.text.append(text)
        if not self.links or self.articles and not self.count.get("li"):
            self.plain += len("".join(text.split()))

    def end_block(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                self.lines.append((line, self.plain, self.articles > 0))
            self.text, self.plain = [], 0

    def gap(self, lines: int = 1) -> None:
        if not self.articles:
            self.lines += [("", 0, False)] * lines

    def push(self, name: str, stripped: bool, article: bool) -> None:
        if stripped and not self.stripped:
            self.gap(WINDOW)
        self.open.append((name, stripped, article))
        self.count[name] = self.count.get(name, 0) + 1
        self.stripped += stripped
        self.headers += stripped and name == "header"
        self.articles += article

    def pop(self) -> str:
        name, stripped, article = self.open.pop()
        self.count[name] -= 1
        self.stripped -= stripped
        self.headers -= stripped and name == "header"
        self.articles -= article
        if article or stripped and not self.stripped:
            self.gap(WINDOW)
        return name

    def begin(self, name: str, attributes: str) -> None:
        block = name in _IS_BLOCK
        if block:
            self.end_block()
            while self.open and name in _ENDED_BY.get(self.open[-1][0], ()):
                self.pop()
            self.links = 0
        if name == "br":
            self.text.append(" ")
        if name == "a":
            self.links = 1
        if name in _HEADINGS:
            self.heading = 1
        if name in _IS_VOID:
            return
        if name in _ARTICLE_TAGS and self.stripped:
            # A menu or header that was never closed ends here.
            while self.open and self.stripped and self.open[-1][0] in ("nav", "header", "menu", "ul", "ol", "li"):
                self.pop()
        if name not in _NEVER_NAMED and attributes:
            stripped, article = _names(attributes)
        elif name in _ARTICLE_TAGS and attributes and not self.stripped:
            # Reader comments are often articles of their own.
            stripped, article = _names(attributes)[0] and (self.articles > 0 or any(x[2] for x in self.lines)), False
        else:
            stripped = article = False
        stripped |= name in _IS_STRIPPED
        article = not stripped and (article or name in _ARTICLE_TAGS) and not self.stripped
        self.tagged |= article and name in _ARTICLE_TAGS
        if not block and self.open and self.open[-1][0] == name:
            self.push(name, False, False)  # within a stripped inline element
        elif block or stripped:
            if name in ("div", "section", "table", "ul", "ol"):
                self.gap()
            if name != "p" or stripped or article:
                self.push(name, stripped, article)

    def end(self, name: str) -> None:
        block = name in _IS_BLOCK
        if block:
            self.end_block()
            self.links = 0
        if name == "a":
            self.links = 0
        if name in _HEADINGS:
            self.heading = 0
        if not self.count.get(name):
            return
        if not block and self.open[-1][0] != name:
            return  # an inline element does not close blocks
        while self.pop() != name:
            pass
        if name in ("div", "section", "table", "ul", "ol"):
            self.gap()


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """Lines of text of a page, markup stripped; of the article alone where it is marked."""
    out = _Page()
    at, n = 0, len(page)
    while at < n:
        mark = _MARK.search(page, at)
        if not mark:
            break
        start = mark.start()
        if start > at:
            out.say(page[at:start])
        close, name, comment, _ = mark.groups()
        if comment:
            end = page.find("-->", start + 2)
            at = n if end < 0 else end + 3
            continue
        rest = _REST.match(page, mark.end()) if name else None
        end = rest.end() if rest else page.find(">", mark.end()) + 1
        if not end:  # no tag ends after this: what follows is text
            out.say(page[start:])
            at = n
            break
        at = end
        if not name:
            continue
        name = name.lower()
        if name in _IS_RAW:
            if not close and page[end - 2] != "/":
                ended = _ENDS[name].search(page, end)
                at = ended.end() if ended else n
        elif close:
            out.end(name)
        else:
            out.begin(name, page[mark.end() : end - 1])
    if at < n:
        out.say(page[at:])
    out.end_block()
    marked = [line for line in out.lines if line[2]]
    if out.tagged or 2 * sum(x[1] for x in marked) >= sum(x[1] for x in out.lines):
        return marked or out.lines
    return out.lines


def stretches(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """(from, to) of the lines between each surge and its dive."""
    n = len(lengths)
    sums = [sum(lengths[max(0, k) : k + window]) for k in range(1 - window, n)]
    need = min(surge, max(sums, default=0) / 2)
    found, k = [], 0
    while k < len(sums):
        if not sums[k]:
            k += 1
            continue
        start = k
        while k < len(sums) and sums[k]:
            k += 1
        # Windows start .. k-1 cover the lines from start to k-1 of the shifted count.
        if max(sums[start:k]) >= need:
            found.append((start, k - window + 1))
    return found


def main_text(page: str | None) -> str:
    """The article of a page."""
    lines = lines_of(page or "")
    lengths = [length for _, length, _ in lines]
    kept = [lines[k][0] for a, b in stretches(lengths) for k in range(a, b) if lines[k][0]]
    return "\n\n".join(kept)


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """``pages`` with ``main_text`` and ``n_main``, its number of code points."""

    def start():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            values = batch.column(batch.schema.get_field_index(source)).to_pylist()
            return [pa.array([main_text(v) for v in values], pa.string())]

        return work

    found = add_columns(pages, start, [("main_text", T.StringType())])
    return found.withColumn("n_main", F.length("main_text").cast("long"))
