"""Main text of HTML pages: parser events, text-to-tag ratios, smoothing, threshold clustering.

One pass of the standard library's parser turns a page into lines, one a block of text, each
with its characters, its link characters and the tags it took. Scripts, hidden elements and the like
are out at once. Lines inside elements that say what they are (nav, footer, aside, form, roles, class
or id words such as ``sidebar``, ``cookie``, ``comment``) are out too, unless such an element turns
out to wrap the page's text (``layout has-sidebar``): see ``_named_apart``. The others' text-to-tag ratios are
smoothed by a Gaussian over neighbouring lines, and lines at or over ``THRESHOLD`` standard
deviations form the content cluster. The cluster selects regions, not lines: the article is the
innermost container that holds all lines of the cluster (the ``article`` or ``main`` element around it, if
there is one; else with a heading before it), and all its lines are kept, short ones too, but for inner containers without a line of the cluster that are mostly links.

Character references are decoded; white space inside a block becomes one space; blocks are
joined in page order by a line feed. Null and empty pages, and pages without text, give the empty
string. Repeated rows give repeated results; null keys are carried; unclosed, misnested and cut
markup is read as far as it goes. Only the named columns are read.
"""

from __future__ import annotations

import re
import sys
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from matchsmith.llm.common import map_texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

THRESHOLD = 0.5
SIGMA = 1.0
# Shares of a page's text by which an element named apart wraps it.
NEARLY_ALL, MOST = 0.8, 0.5
# What may stand in a head; anything else ends one without an end tag.
HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
# Elements of ``OUT`` that may wrap a page.
WRAPPERS = frozenset("nav footer aside form menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LINK_SHARE = 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose text is never the article's.
OUT = frozenset("nav footer aside form script style noscript template button select textarea iframe svg math object "
                "canvas audio video head title menu dialog datalist".split())
CONTAINERS = frozenset("html body article main section div td table ul ol dl blockquote details".split())
BLOCKS = CONTAINERS | OUT | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr th thead tbody tfoot caption pre header hgroup "
                                      "figure figcaption address fieldset legend hr summary center".split())
# A start tag of the key closes an open element of these, up to the nearest container.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",)}
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
# Words of a class or id that name something other than the article.
WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs sidebar footer ad ads advert adverts advertisement "
                  "advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay "
                  "newsletter subscribe subscription signup comment comments reply replies disqus related recommended share sharing "
                  "social widget pagination pager toolbar login search copyright skip".split())
# Such words that also name a subject: inside an article they count only as a whole class.
TOPICS = frozenset("search login share social menu related recommended navigation notice notices promotion subscription consent "
                   "copyright skip".split())
# Beginnings of such words in compounds (``commentlist``, ``footerlinks``).
BEGINNINGS = ("comment", "advert", "sidebar", "cookie", "newsletter", "breadcrumb", "footer", "sponsor", "subscri", "navig", "popup")
# Such words that an article's own head may bear.
PAGE_WORDS = frozenset(("header", "masthead", "topbar"))
_SPLIT = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")
_TAG = re.compile(r"<[A-Za-z/!?]")
_SPACE = re.compile(r"\s+")
_NO_COMMENT = re.compile(r"<!--+>")  # a comment at once at its end
_LOUD_END = re.compile(r"(<!--(?:(?!-->).)*?)--!>", re.DOTALL)
_COMMENT_END = re.compile(r"--!?>|<!--+>")


class Lines(HTMLParser):
    """Blocks of a page: ``text``, ``container``, ``tags``, ``linked`` (characters), level of a heading or 0."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.parents, self.kinds, self.apart = [-1], ["page"], [0]  # of containers; apart: 1 by part of a name, 2 by name
        self.stack: list[tuple[str, int, bool, bool]] = []  # tag, container, out, in an article
        self.container, self.out, self.own = 0, False, False
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                level = next((int(t[1]) for t, *_ in reversed(self.stack) if t in HEADINGS), 0)
                self.lines.append((text, self.container, self.tags, self.linked, level))
            self.parts = []
        self.tags = self.linked = 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            if self.parts:
                self.parts.append(" ")
            self.tags += 1
            return
        if tag == "body" or (tag not in HEAD and self.stack and self.stack[-1][0] == "head"):
            self._end_head()
        apart = 0
        if not self.out:
            apart = self._named_apart(tag, attrs)
        block = tag in BLOCKS or (apart and "-" in tag)
        if block:
            self.flush()
            self._close(("p",))
            if tag in CLOSES:
                self._close(CLOSES[tag])
        self.tags += 1
        if tag in VOID:
            return
        self.stack.append((tag, self.container, self.out, self.own))
        if tag == "a":
            self.links += 1
        if block and (tag in CONTAINERS or apart):
            self.parents.append(self.container)
            self.kinds.append(tag)
            self.apart.append(apart)
            self.container = len(self.kinds) - 1
            if tag == "article" or tag == "main":
                self.own = True
        if not self.out:
            self.out = (tag in OUT and tag not in WRAPPERS) or (bool(attrs) and self._hidden(tag, attrs)) or (apart > 0 and not block)

    def _end_head(self) -> None:
        for at, held in enumerate(self.stack):
            if held[0] == "head":
                self.parts = []
                self._pop(at)
                return

    @staticmethod
    def _hidden(tag, attrs) -> bool:
        if tag in ("html", "body", "main"):
            return False
        return any(name == "hidden" or (name == "aria-hidden" and (value or "").strip().lower() == "true")
                   or (name == "style" and "display:none" in (value or "").replace(" ", "").lower()) for name, value in attrs)

    def _named_apart(self, tag, attrs) -> int:
        """2 for an element that names itself something other than the article, 1 if only a part of
        a class does. A part of an id, or of a heading's or paragraph's class, says nothing."""
        if tag in ("html", "body", "main"):
            return 0
        if tag in WRAPPERS or (tag == "header" and not self.own):
            return 2
        found = 0
        prose = tag == "p" or tag in HEADINGS  # sites make their ids and classes from titles and topics
        for name, value in attrs:
            if not value:
                continue
            if name == "role" and value.strip().lower() in ROLES:
                return 2
            if name == "class" or (name == "id" and not prose):
                for whole in value.split():
                    words = {w.lower() for w in _SPLIT.split(whole)}
                    if len(words) > 1 and (prose or name == "id"):
                        continue  # a part of such a name says nothing
                    known = WORDS - TOPICS if self.own and (len(words) > 1 or name == "id") else WORDS
                    if words & known or any(w.startswith(BEGINNINGS) for w in words) or (not self.own and tag != "article" and words & PAGE_WORDS):
                        found = max(found, 2 if len(words) == 1 else 1)
        return found

    def _pop(self, at: int) -> None:
        while len(self.stack) > at:
            tag, self.container, self.out, self.own = self.stack.pop()
            if tag == "a":
                self.links -= 1

    def _close(self, tags) -> None:
        for at in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[at][0]
            if tag in tags:
                self._pop(at)
                return
            if tag in BLOCKS:
                return

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                self._pop(at)
                return
            if tag not in BLOCKS and self.stack[at][0] in BLOCKS:
                return

    def handle_data(self, data):
        if self.out and self.stack[-1][0] == "head" and data.strip():
            self._end_head()
        if not self.out:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def _in_script(html: str, at: int) -> bool:
    """Whether a place lies inside a script or style, whose text is no markup."""
    low = html[:at].lower()
    return any(low.rfind(f"<{tag}") > low.rfind(f"</{tag}") for tag in ("script", "style"))


def lines_of(html: str) -> Lines:
    last = max((m.end() for m in _COMMENT_END.finditer(html)), default=0)
    opened = html.find("<!--", last)  # a comment without an end runs to the page's end, as in a browser
    while opened >= 0 and _in_script(html, opened):
        opened = html.find("<!--", opened + 4)
    if opened >= 0:
        html = html[:opened]
    html = _NO_COMMENT.sub("", html)
    if "--!>" in html:
        html = _LOUD_END.sub(r"\1-->", html)
    cut = html.rfind("<")  # a tag that the page's end cuts off
    if cut > html.rfind(">") and _TAG.match(html, cut):
        html = html[:cut]
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian-weighted means; at the ends, of the neighbours there are."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(ratios, kernel)[reach:reach + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[reach:reach + len(ratios)]


def _plain(page: Lines, c: int) -> bool:
    """Whether an article element isn't one of comments, teasers or the like by its own whole name, nor by
    part of its name inside another element named apart."""
    if page.apart[c] == 1:
        while page.parents[c] >= 0:
            c = page.parents[c]
            if page.apart[c]:
                return False
        return True
    return not page.apart[c]


def _left(page: Lines, containers: np.ndarray, prose: np.ndarray, headings: np.ndarray) -> np.ndarray:
    """Containers whose lines are judged: all outside elements named apart, and those in such elements
    that wrap the page's text. One wraps it if it holds most of the text and the page's first heading,
    an article or a main element; without any of these on the page, nearly all of the text, or all
    that there is."""
    n = len(page.kinds)
    held = np.bincount(containers, weights=prose, minlength=n)
    marks = np.bincount(containers, weights=headings == 1, minlength=n)
    marks += [kind == "main" or (kind == "article" and _plain(page, c)) for c, kind in enumerate(page.kinds)]
    for c in range(n - 1, 0, -1):
        held[page.parents[c]] += held[c]
        marks[page.parents[c]] += marks[c]
    left = np.ones(n, bool)
    for c in range(1, n):
        left[c] = left[page.parents[c]]
        if left[c] and page.apart[c]:
            if held[0] == held[c] > 0 and page.kinds[c] not in ("nav", "footer", "menu"):
                continue
            if marks[0]:
                wraps = held[c] >= MOST * held[0] and marks[c] > 0 and (page.apart[c] == 1 or marks[c] == marks[0])
            else:
                wraps = page.apart[c] == 1 and held[c] >= NEARLY_ALL * held[0]
            left[c] = wraps and held[c] > 0
    return left


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = lines_of(html)
    if not page.lines:
        return ""
    if any(page.apart):
        _, containers, _, linked, headings = map(np.array, zip(*page.lines))
        chars = np.array([len(line[0]) for line in page.lines], float)
        left = _left(page, containers, np.maximum(chars - linked, 0), headings)
        page.lines = [line for line in page.lines if left[line[1]]]
        if not page.lines:
            return ""
    texts, containers, tags, linked, headings = zip(*page.lines)
    chars = np.array([len(t) for t in texts], float)
    linked = np.minimum(np.array(linked, float), chars)
    ratio = smoothed((chars - linked) / np.maximum(np.array(tags, float), 1))
    content = ratio >= THRESHOLD * ratio.std()
    containers = np.array(containers)
    weight = np.where(content, chars - linked, 0.0)
    if not weight.sum():
        weight = chars
    n = len(page.kinds)
    held = np.bincount(containers, weights=weight, minlength=n)
    cluster = (weight > 0) & (linked <= LINK_SHARE * chars)
    lines = np.bincount(containers, weights=cluster if cluster.any() else weight > 0, minlength=n)
    for c in range(n - 1, 0, -1):  # a container comes after the one around it
        held[page.parents[c]] += held[c]
        lines[page.parents[c]] += lines[c]
    region = int(np.flatnonzero(lines == lines[0])[-1])  # the innermost that holds all of the cluster's lines
    around = region
    while around >= 0 and page.kinds[around] not in ("article", "main"):
        around = page.parents[around]
    before = range(0)  # a heading before the region, with the lines between
    if around >= 0:
        region = around
    else:
        up, within = region, {region}
        for c in range(region + 1, n):
            if page.parents[c] in within:
                within.add(c)
        first = next((i for i, c in enumerate(containers) if c in within), 0)
        while not before and page.parents[up] >= 0:
            up = page.parents[up]
            at = first
            while at > 0 and containers[at - 1] == up:
                at -= 1
                if headings[at]:
                    before = range(at, first)
    inside = np.zeros(n, bool)
    inside[region] = True
    all_chars = np.bincount(containers, weights=chars, minlength=n)
    all_links = np.bincount(containers, weights=linked, minlength=n)
    for c in range(n - 1, 0, -1):
        all_chars[page.parents[c]] += all_chars[c]
        all_links[page.parents[c]] += all_links[c]
    for c in range(region + 1, n):
        inside[c] = inside[page.parents[c]] and not (held[c] == 0 and all_links[c] > LINK_SHARE * all_chars[c])
    return "\n".join(t for i, (t, c) in enumerate(zip(texts, containers)) if inside[c] or i in before)


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key, url, text, n_chars`` of each page."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, url)}

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in part.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            [key, url, "text", "n_chars"])

    return map_texts(df, [key, url, html], html, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long", step)
