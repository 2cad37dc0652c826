"""Main text of web pages by line-block distribution.

Markup is stripped into lines: one for each block of text, and ``WINDOW`` blank ones where a section opens or closes
outside the page's content containers. A line has a weight: 0 if its element, class or id is one of boilerplate
or most of it is links, else 1. The weighted lengths of every ``WINDOW`` lines in a row are summed. Text begins where
that curve leaves zero and surges to the threshold (``SHARE`` of its peak, at most ``SURGE``), and ends where it dives
back to zero; what is between, but for boilerplate lines, is the article. A stretch that never surges is
not, unless it is a list, table, quotation or the like in the very container of text that does: beside it in a container of its
own, or between two such stretches. Elements only give weights and gaps.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from newsloom.llm.common import table, with_arrow_columns

WINDOW, SHARE, SURGE = 3, 0.2, 300
#: Lines with a larger share of links weigh nothing, and are kept between others.
LINK_SHARE = 0.6

RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE = frozenset("nav footer aside form button select option dialog menu head object canvas audio video fieldset".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar alert alertdialog dialog form status".split())
SECTIONS = frozenset("article main section div header table ul ol dl body td blockquote figure details".split())
#: Sections that belong to the text around them, and elements that a class name alone doesn't make boilerplate inside of content.
WITHIN = frozenset("table ul ol dl td blockquote figure details".split())
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote figure figcaption table tbody thead tr td th li dt dd".split()) | INLINE
#: Words of class names and ids that mark what isn't the article.
_HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|comments?|commentlist|respond|replies|disqus|cookies?\w*|consent|gdpr|notice|alert"
    r"|popup|modal|overlay|newsletter|subscribe|signup|sidebar\w*|side|widget\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|toolbar|social|share|sharing"
    r"|related|recommend\w*|pagination|pager|skip|login)(?:$|[\s_-]|\d)",
    re.I,
)
#: Those that hold even beside a word for content.
_STRONG_HINT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|comments?|commentlist|respond|replies|disqus|cookies?\w*|consent|gdpr|newsletter|popup|modal)(?:$|[\s_-]|\d)", re.I)
_CONTENT_HINT = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story)(?:$|[\s_-])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+[^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
#: Closed by the start of another of its kind.
_SIBLINGS = {"li": ("li",), "p": ("p",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}


@dataclass
class Line:
    """A block's text, its characters in links, whether it is boilerplate, whether it is in a content container, and the number of its own container."""

    text: str
    links: int
    boilerplate: bool
    inside: bool
    home: int

    @property
    def linked(self) -> bool:
        return self.links > LINK_SHARE * len(self.text)


@dataclass
class _Element:
    name: str
    boilerplate: bool
    inside: bool
    link: bool
    home: int = 0


@dataclass
class _Reader:
    """Turns tags and text into lines; line None is a blank one. ``named``: whether class names count that may also name content."""

    named: bool = True
    homes: int = 0
    lines: list[Line | None] = field(default_factory=list)
    open: list[_Element] = field(default_factory=lambda: [_Element("", False, False, False)])
    parts: list[str] = field(default_factory=list)
    links: int = 0

    def text(self, raw: str) -> None:
        top = self.open[-1]
        if raw:
            piece = html.unescape(raw) if "&" in raw else raw
            self.parts.append(piece)
            if top.link:
                self.links += len(piece)

    def flush(self) -> None:
        if self.parts:
            text, top = " ".join("".join(self.parts).split()), self.open[-1]
            if text:
                last = self.lines[-1] if self.lines else None
                # boilerplate inside of content is one line, however many it has
                if not (top.boilerplate and top.inside and last is not None and last.boilerplate and last.inside):
                    self.lines.append(Line(text, self.links, top.boilerplate, top.inside, top.home))
            self.parts, self.links = [], 0

    def blank(self) -> None:
        self.flush()
        self.lines.extend([None] * WINDOW)

    def start(self, name: str, attributes: str) -> None:
        if name in _SIBLINGS:
            k = len(self.open) - 1
            while k > 0 and (self.open[k].name in INLINE or self.open[k].name in _SIBLINGS[name]):
                if self.open[k].name in _SIBLINGS[name]:
                    self.end(self.open[k].name)
                    break
                k -= 1
        elif name not in INLINE and name not in VOID and self.open[-1].name == "p":
            self.end("p")
        if name in VOID:
            if name == "br":
                self.parts.append(" ")
            elif name == "hr":
                self.flush()
            return
        top = self.open[-1]
        boilerplate = top.boilerplate or self._is_boilerplate(name, attributes, top.inside, self.named)
        if name not in INLINE or boilerplate != top.boilerplate:
            self.flush()
        inside = top.inside or not boilerplate and (name in ("article", "main") or name in SECTIONS and self._is_content(attributes))
        if not top.inside and (name in SECTIONS or boilerplate != top.boilerplate):
            self.blank()
        home = top.home
        if name in SECTIONS and name not in WITHIN and name != "body" or boilerplate != top.boilerplate:
            self.homes += 1
            home = self.homes
        self.open.append(_Element(name, boilerplate, inside, top.link or name == "a", home))

    def end(self, name: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == name:
                break
            if name in INLINE and self.open[k].name not in INLINE:
                return
        else:
            if name not in INLINE:
                self.flush()
            return
        gone = self.open[k:]
        if name not in INLINE or gone[0].boilerplate != self.open[k - 1].boilerplate:
            self.flush()
        del self.open[k:]
        if not self.open[-1].inside and (any(x.name in SECTIONS for x in gone) or gone[0].boilerplate and not self.open[-1].boilerplate):
            self.blank()

    @staticmethod
    def _is_content(attributes: str) -> bool:
        return bool(attributes) and any(key.lower() in ("class", "id") and _CONTENT_HINT.search("".join(values)) for key, *values in _ATTRIBUTE.findall(attributes))

    @staticmethod
    def _is_boilerplate(name: str, attributes: str, inside: bool, named: bool) -> bool:
        if name in BOILERPLATE or name == "header" and not inside:
            return True
        if not attributes or name in ("html", "body", "main"):
            return False
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value.lower() in BOILERPLATE_ROLES:
                return True
            if key in ("class", "id") and _HINT.search(value):
                weak = named and not (inside and name in TEXTUAL) and not _CONTENT_HINT.search(value)
                if weak or _STRONG_HINT.search(value):
                    return True
        return False


def page_lines(page: str, named: bool = True) -> list[Line | None]:
    """Lines of a page in order, with blank ones (None) for what was taken out."""
    reader, at, end = _Reader(named), 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        if found is None:
            reader.text(page[at:])
            break
        reader.text(page[at : found.start()])
        at, name = found.end(), (found[2] or "").lower()
        if not name:
            if found[0].startswith("<![CDATA["):
                reader.text(html.escape(found[0][9:].removesuffix("]]>")))
        elif found[1]:
            reader.end(name)
        elif name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if not found[3].rstrip().endswith("/") or name not in ("svg", "math"):
                at = close.end() if close else end
            if name in ("script", "style", "template", "noscript"):
                continue
            reader.flush()
        else:
            reader.start(name, found[3])
    reader.flush()
    return reader.lines


def curve(lines: list[Line | None]) -> np.ndarray:
    """The sum of weighted lengths over ``WINDOW`` lines from each line on."""
    own = np.array([0 if x is None or x.boilerplate or x.linked else len(x.text) for x in lines] + [0] * (WINDOW - 1))
    if not own.any():  # links only
        own = np.array([0 if x is None or x.boilerplate else len(x.text) for x in lines] + [0] * (WINDOW - 1))
    return np.convolve(own, np.ones(WINDOW, int))[WINDOW - 1 : WINDOW - 1 + len(lines)]


def segments(sums: np.ndarray) -> list[tuple[int, int]]:
    """(first, after last) of each stretch that surges to the threshold before it dives to zero."""
    if not len(sums):
        return []
    up = np.concatenate([[False], sums > 0, [False]])
    starts, dives = np.flatnonzero(up[1:] & ~up[:-1]), np.flatnonzero(~up[1:] & up[:-1])
    surge = min(SURGE, SHARE * sums.max())
    return [(int(a), int(b)) for a, b in zip(starts, dives, strict=True) if sums[a:b].max() >= surge]


def _kept(lines: list[Line | None], sums: np.ndarray) -> list[str]:
    """Texts of the stretches that surge, and of what belongs to them."""
    found = segments(sums)
    surging = np.zeros(len(lines), bool)
    for a, b in found:
        surging[a:b] = True
    homes = {x.home for a, b in found for x in lines[a:b] if x is not None and not x.boilerplate and not x.linked}
    first, last = (found[0][0], found[-1][1]) if found else (0, 0)
    out = []
    for i, x in enumerate(lines):
        # the root, number 0, has more than the article in it
        if x is not None and not x.boilerplate and (surging[i] or not x.linked and x.home in homes and (x.home or first < i < last)):
            out.append(x.text)
    return out


def main_text(page: str | None) -> str:
    """The article of a page; null, blank or without text: empty.

    If nothing is left and the class names alone hide a stretch that surges to ``SURGE``, they don't count.
    """
    lines = page_lines(page or "")
    kept = _kept(lines, curve(lines))
    if not kept and any(x is not None for x in lines):
        lines = page_lines(page or "", named=False)
        sums = curve(lines)
        if sums.max(initial=0) >= SURGE:
            kept = _kept(lines, sums)
    return " ".join(kept)


def extract_main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text`` (the article, blocks joined by one space) and ``n_chars`` (its code points).

    Null html, html without text, and pages that are boilerplate only: empty text, 0. Whole pages are read,
    each alone, so repeated rows and very long pages need nothing special. The html column is left out;
    a column named text or n_chars is replaced.
    """

    def make():
        def compute(batch: pa.RecordBatch) -> list:
            texts = [main_text(x) for x in batch.column(column).to_pylist()]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return compute

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return with_arrow_columns(pages, fields, make, drop=(column,))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
