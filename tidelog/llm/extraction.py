"""Main text of HTML pages by text-to-tag ratios over parser events."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

SIGMA = 2.0       # lines
LEVEL = 0.5       # threshold in standard deviations of the smoothed ratios

# Elements by their part in a page, and words in class, id and role that name page furniture.
HIDDEN = frozenset("script style noscript template head title svg canvas object iframe audio video map".split())
FURNITURE = frozenset("nav footer aside form menu dialog button select option textarea label fieldset datalist".split())
CONTAINERS = frozenset("body main article section div td blockquote center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr th caption thead tbody tfoot pre hr br address figure figcaption header details summary html".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|side|nav\w*|menu\w*|breadcrumbs?|footer|foot|masthead|topbar|toolbar|"
    r"header|comments?|replies|reply|disqus|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|subscribe|subscription|newsletter|signup|login|search\w*|"
    r"related|recommend\w*|share|sharing|social|widget|pagination|pager|tags|hidden|sr-only|visually-hidden|copyright|legal|disclaimer|skip)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())


class PageReader(HTMLParser):
    """Collects lines (texts between block tags) with their tags, links and containers."""

    def __init__(self, names: bool = True, forms: bool = True):
        super().__init__(convert_charrefs=True)
        self.names = names  # whether class, id and role count
        self.forms = forms  # whether forms are furniture
        self.named = self.passed = 0  # open elements that only their name makes furniture, and the text passed over in them
        self.formed = self.in_form = 0  # text passed over in forms alone, and open forms
        self.stack: list[tuple[str, int]] = []  # open elements: 1 starts page furniture, 2 does so by its name, 3 as a form
        self.skipping = 0
        self.open: Counter[str] = Counter()
        self.boxes: list[int] = [0]
        self.parent: list[int] = [-1]
        self.kind: list[str] = [""]  # tag of each container
        self.lines: list[tuple[str, int, int, int, bool]] = []  # text, tags, chars in links, container, in a list
        self.parts: list[str] = []
        self.tags = self.linked = self.in_link = self.in_list = self.in_article = 0
        self.box_depth: list[int] = []

    def _line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text or self.tags:
            self.lines.append((text, self.tags, self.linked, self.boxes[-1], self.in_list > 0))
        self.parts, self.tags, self.linked = [], 0, 0

    def _furniture(self, tag: str, attrs) -> int:
        if tag in HIDDEN or tag in FURNITURE and tag != "form" or tag == "header" and not self.in_article:
            return 1
        if tag in ("html", "body", "main"):
            return 0
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return 1
            if not value:
                continue
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return 1
            if self.names and name == "role" and value.lower() in ROLES:
                return 2
            if self.names and name in ("class", "id") and tag not in HEADINGS and tag != "header":
                # the heading part of an article is named header too
                found = {m.strip(" _-").lower() for m in NAMES.findall(value)}
                if name == "id" and self.in_article and (tag == "p" or value.strip().lower() not in found):
                    continue  # ids of an article's sections are slugs of their headings
                if "header" in found and (self.in_article or re.search(r"article|post|entry|content|story|title", value, re.I)):
                    found.discard("header")
                if found and (tag != "article" or re.search(r"comment|repl|related|promo|\bads?\b", value, re.I)):
                    return 2
        return 3 if tag == "form" and self.forms else 0

    def handle_starttag(self, tag, attrs):
        if tag == "body":  # an unclosed head ends here
            while self.stack and self.stack[-1][0] in ("head", "title", "style", "noscript"):
                self._pop()
        if tag in BLOCKS:
            self._line()
        self.tags += 1
        if tag in VOID:
            return
        starts = self._furniture(tag, attrs)
        self.stack.append((tag, starts))
        self.open[tag] += 1
        self.skipping += starts > 0
        self.named += starts == 2
        self.in_form += starts == 3
        if tag == "a":
            self.in_link += 1
        elif tag in ("ul", "ol"):
            self.in_list += 1
        elif tag in ("article", "main"):
            self.in_article += 1
        if tag in CONTAINERS:
            self.parent.append(self.boxes[-1])
            self.kind.append(tag)
            self.boxes.append(len(self.parent) - 1)

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self._line()
        self.tags += 1

    def _pop(self) -> None:
        tag, starts = self.stack.pop()
        self.open[tag] -= 1
        self.skipping -= starts > 0
        self.named -= starts == 2
        self.in_form -= starts == 3
        if tag == "a":
            self.in_link -= 1
        elif tag in ("ul", "ol"):
            self.in_list -= 1
        elif tag in ("article", "main"):
            self.in_article -= 1
        if tag in CONTAINERS:
            self.boxes.pop()

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._line()
        self.tags += 1
        if not self.open[tag]:
            return
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag))
        # an inline end tag does not close containers or furniture opened since
        if tag not in BLOCKS and tag not in FURNITURE and tag not in HIDDEN and any(
                t in CONTAINERS or s for t, s in self.stack[at + 1:]):
            return
        while len(self.stack) > at:
            self._pop()

    def handle_data(self, data):
        if not self.skipping:
            self.parts.append(data)
            if self.in_link:
                self.linked += len(data.strip())
        elif self.skipping == self.in_form:
            self.formed += len(data.strip())
        elif self.skipping == self.named + self.in_form:
            self.passed += len(data.strip())


def without_open_tag(html: str) -> str:
    """The page up to the first tag that never ends; the parser would look for its end again at every ``<`` from there on."""
    last = html.rfind(">") + 1
    found = re.compile("<[a-zA-Z/!?]").search(html, last)
    return html[:found.start()] if found else html


def read_lines(html: str, names: bool = True, forms: bool = True) -> PageReader:
    reader = PageReader(names, forms)
    rest = html = without_open_tag(html)
    while True:
        try:
            reader.feed(rest)
            reader.close()
            break
        except AssertionError:  # a broken declaration: read its first character as text
            rest = "&lt;" + reader.rawdata[1:] if reader.rawdata.startswith("<") else reader.rawdata[1:]
            reader.rawdata = ""
    reader._line()
    kept = sum(len(line[0]) for line in reader.lines)
    if forms and kept < 0.05 * reader.formed:
        return read_lines(html, names, False)  # a form is the wrapper of the whole page
    if names and kept < 0.05 * reader.passed:
        return read_lines(html, False, forms)  # a name fits the wrapper of the whole page
    return reader


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over lines; weights beyond the page are left out."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(ratios, kernel)[reach:reach + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[reach:reach + len(ratios)]


def _region(reader: PageReader, held: np.ndarray) -> int:
    """Container of the main text, from the clustered text that each container holds.

    It is left for one inside as long as no clustered text stays outside. Articles are whole, and
    quotations, cells and centred parts belong to the text around them.
    """
    region = 0
    full = {reader.parent[b]: b for b in range(len(held) - 1, 0, -1) if held[b] == held[0] > 0}
    while region in full and reader.kind[region] not in ("article", "main") and reader.kind[full[region]] not in ("blockquote", "td", "center"):
        region = full[region]
    return region


def main_text(html: str | None) -> str:
    """Blocks of the content region, joined by one space.

    Lines above the threshold of the smoothed text-to-tag ratio form clusters; the region is the
    innermost container that holds all their text but links, not below an article, and all its
    lines count, long or short, but for furniture and lists of links outside an article.
    """
    if not html:
        return ""
    reader = read_lines(html)
    lines = reader.lines
    if not any(text for text, *_ in lines):
        return ""
    ratios = np.array([len(text) / max(1, tags) for text, tags, *_ in lines])
    smoothed = smooth(ratios)
    chosen = smoothed >= min(LEVEL * smoothed.std(), smoothed.max())
    held = np.zeros(len(reader.parent))
    for (text, _, linked, box, _), yes in zip(lines, chosen, strict=True):
        if yes and linked < 0.5 * len(text):
            held[box] += len(text)
    for box in range(len(held) - 1, 0, -1):
        held[reader.parent[box]] += held[box]
    region = _region(reader, held)
    inside, article = {region}, {b for b, tag in enumerate(reader.kind) if tag in ("article", "main")}
    for box in range(1, len(held)):
        if reader.parent[box] in article:
            article.add(box)
    for box in range(region + 1, len(held)):
        if reader.parent[box] in inside:
            inside.add(box)
    return " ".join(text for text, _, linked, box, listed in lines if text and box in inside and not (listed and linked >= len(text) > 0 and box not in article))


def extract_pages(df: DataFrame, html_col: str = "html", name: str = "main_text") -> DataFrame:
    """All columns of ``df`` and the main text of the page (column ``name``, replaced if there).

    Null and empty pages, and pages without text, give the empty string. Whole pages are read,
    broken markup as far as it can be told. An empty table gives an empty table.
    """
    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    kept = [c for c in df.columns if c != name]
    return df.select(*kept, extract(F.coalesce(F.col(html_col), F.lit(""))).alias(name))
