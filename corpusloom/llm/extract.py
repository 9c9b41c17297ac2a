"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams over the whole page. Block-level tags cut its text
into lines; each line has the number of its characters for each tag met since the line
before. The ratios are smoothed with a Gaussian along the page, and a threshold between
the low and the high cluster (two means, in one dimension) marks the lines that look like
content. Marked lines decide by the elements around them:

- Nothing is read inside scripts, styles, forms' fields, frames, drawings, side parts and
  whatever is hidden, wherever it stands, and the text around it stays together.
- An element named as a menu, header, footer, side bar, notice, advert or form (by its tag,
  role, a whole class or id, or a class all of whose parts are such words) goes, unless it
  holds most of the marked text or the page's only <article> or <main>. One whose name only
  has such a word between hyphens, or a word that texts have too, goes if less than half of
  its text is marked, half of it or more is links, or a field to fill in stands in it.
- Reader comments (a name that begins with the word, or such an item type) go however long
  they are, unless they hold the page's heading, an article that is none, or all its text.
- The region is every <article> and <main> that is left, if they hold half of the marked text
  or more; else it is the innermost container of all marked lines and <h1> headings, less
  those of its own containers that hold none.
- Inside the region a container or list without a marked line and with two or more links,
  which are short and most of its text, is a menu and goes, unless a heading of the text's
  own (such as "References") stands right before it.

Every other line of the region is kept. Elements are numbered, and all sums run along the
links to their parents, so the work is linear in the page, however deep it nests; what
follows the last `>` holds no tag and is not searched for one.

Defined cases: a null or empty page, or one without text, gives an empty text; unclosed and
unmatched tags, and pages that break off, are read as far as they go; repeated rows are
each extracted.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base

BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset("article main section div td body html".split())
LISTS = frozenset("ul ol dl table".split())
DROPPED = frozenset("head title nav aside footer script style noscript noframes template button select datalist textarea iframe svg math canvas object dialog menu audio video map".split())
FIELDS = frozenset("input select textarea button".split())
HEADINGS = frozenset("h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TOPS = frozenset(("article", "main"))
_NAMES = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent footer menu nav navbar navigation newsletter notice popup promo promotion related share sidebar social sponsor sponsored subscribe widget".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
#: Words that say nothing of their own beside one of _NAMES, as in sign-up boxes or comment lists; words of _NAMES that texts are named by too; and headings of lists that are not the text's own.
_BESIDE = frozenset("area articles bar block box button buttons container content form group header icons inner item items links list main panel post posts section signup slot top unit wrap wrapper zone".split())
_AMBIGUOUS = frozenset("share social widget".split())
_OTHERS = frozenset("related more read popular latest share follow menu navigation tags categories topics trending recommended".split())
#: An element may be named as something else than content by a whole name, by a part of one, or as comments.
WHOLE, PART, COMMENTS = 1, 2, 3
#: Links of at least so many characters, on average, are text.
LONG_LINK = 20


def words_of(name: str) -> list[str]:
    """The parts of a class or id, between hyphens, underscores and at capitals, in lower case."""
    return [x for x in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower().replace("_", "-").split("-") if x]


def kind_of(tag: str, attributes: dict, in_article: bool) -> int:
    """What an element's tag, role, classes and id name it as."""
    if tag in ("body", "html"):
        return 0
    names = [w for x in f"{attributes.get('class') or ''} {attributes.get('id') or ''}".split() if (w := words_of(x))]
    heads = [w for w in names if w[0] in ("comment", "comments", "commentlist", "disqus")]
    if (attributes.get("itemtype") or "").lower().endswith(("/comment", "/usercomments")) or any(tag not in TOPS or len(w) == 1 or w[1].isdigit() or w[1] in ("body", "item", "content") for w in heads):
        return COMMENTS
    if tag == "form" or (tag == "header" and not in_article) or (attributes.get("role") or "").lower() in _ROLES:
        return WHOLE
    if tag in TOPS:
        return 0
    if any(w[0] in _NAMES - _AMBIGUOUS and all(x in _NAMES or x in _BESIDE for x in w) for w in names):
        return WHOLE
    return PART if any(x in _NAMES for w in names for x in w) else 0


@dataclass
class Line:
    text: str
    tags: int
    node: int
    links: int  # characters inside <a>
    anchors: int  # how many <a> began in it
    heading: bool  # in an <h1>
    title: bool  # in an <h2> to <h6>


class Lines(HTMLParser):
    """A page as lines, and its elements as numbered nodes; node 0 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.dropped, self.named = ["page"], [0], [False], [0]
        self.open = [0]
        self.opened: Counter[str] = Counter()  # open elements by tag
        self.lines: list[Line] = []
        self.part: list[str] = []
        self.tags = self.links = self.begun = self.anchors = 0
        self.fields: list[int] = []  # nodes with a field to fill in

    def cut(self) -> None:
        if text := " ".join("".join(self.part).split()):
            self.lines.append(Line(text, self.tags, self.open[-1], min(self.links, len(text)), self.begun, self.opened["h1"] > 0, any(self.opened[h] for h in HEADINGS)))
            self.tags = 0
        self.part.clear()
        self.links = self.begun = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        above = self.open[-1]
        silent = self.dropped[above]
        if tag in ("p", "li", "td", "th", "tr", "option", "dt", "dd") and self.tag[above] == tag:
            if not silent:
                self.cut()
            self.pop()  # these end an open one of their kind
            above = self.open[-1]
            silent = self.dropped[above]
        if tag in BLOCKS and not silent:
            self.cut()
        if tag == "a" and not silent:
            self.anchors += 1
            self.begun += 1
        if tag in FIELDS:
            self.fields.append(above)
        if tag in VOID:
            return
        has = dict(attrs)
        style = (has.get("style") or "").replace(" ", "").lower()
        own = tag in DROPPED or "hidden" in has or has.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        if not (own or silent or tag in BLOCKS):
            return
        self.open.append(len(self.tag))
        self.opened[tag] += 1
        self.tag.append(tag)
        self.parent.append(above)
        self.dropped.append(own or silent)
        self.named.append(kind_of(tag, has, any(self.opened[x] for x in TOPS)) if tag in BLOCKS else 0)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def pop(self) -> None:
        self.opened[self.tag[self.open.pop()]] -= 1

    def handle_endtag(self, tag):
        self.tags += 1
        silent = self.dropped[self.open[-1]]
        if tag in BLOCKS and not silent:
            self.cut()
        if tag == "a" and not silent:
            self.anchors = max(0, self.anchors - 1)
        if self.opened[tag]:
            while self.tag[self.open[-1]] != tag:
                self.pop()
            self.pop()

    def handle_data(self, data):
        if self.dropped[self.open[-1]]:
            return
        self.part.append(data)
        if self.anchors:
            self.links += len(data.strip())


def smoothed(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing along the list, the weights renormalised at its ends."""
    reach = max(1, math.ceil(3 * sigma))
    weight = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    out = []
    for k in range(len(values)):
        a, b = max(0, k - reach), min(len(values), k + reach + 1)
        w = weight[a - k + reach : b - k + reach]
        out.append(sum(x * y for x, y in zip(values[a:b], w, strict=True)) / sum(w))
    return out


def threshold(values: list[float]) -> float:
    """The middle between the means of a low and a high cluster."""
    low, high = min(values), max(values)
    for _ in range(20):
        cut = (low + high) / 2
        below, above = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not below or not above:
            return low
        new = sum(below) / len(below), sum(above) / len(above)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def marked(lines: list[Line], sigma: float) -> list[bool]:
    ratio = smoothed([len(x.text) / max(1, x.tags) for x in lines], sigma)
    cut = threshold(ratio)
    return [r >= cut for r in ratio]


class Page:
    """Sums over the nodes of a page, of lines below them."""

    def __init__(self, reader: Lines, sigma: float):
        self.tag, self.parent, self.named = reader.tag, reader.parent, reader.named
        self.lines = reader.lines
        self.fields = self.up([(k, 1) for k in reader.fields])
        self.inside = self.down([x in TOPS and n != COMMENTS for x, n in zip(self.tag, self.named, strict=True)])  # an article or main, or in one
        self.weigh(self.lines, sigma)

    def weigh(self, lines: list[Line], sigma: float) -> None:
        marks = marked(lines, sigma) if lines else []
        self.text = self.up([(x.node, len(x.text)) for x in lines])
        self.linked = self.up([(x.node, x.links) for x in lines])
        self.links = self.up([(x.node, x.anchors) for x in lines])
        self.headed = self.up([(x.node, 1) for x in lines if x.heading])
        self.heavy = self.up([(x.node, len(x.text)) for x, m in zip(lines, marks, strict=True) if m])
        self.marks = self.up([(x.node, 1) for x, m in zip(lines, marks, strict=True) if m])
        self.anchors = self.up([(x.node, 1) for x, m in zip(lines, marks, strict=True) if m or x.heading])
        self.tops = self.up([(x.node, 1) for x in lines if self.inside[x.node]])

    def up(self, own: list[tuple[int, int]]) -> list[int]:
        out = [0] * len(self.tag)
        for node, n in own:
            out[node] += n
        for k in range(len(out) - 1, 0, -1):  # children have higher numbers
            out[self.parent[k]] += out[k]
        return out

    def down(self, own: list[bool]) -> list[bool]:
        out = list(own)
        for k in range(1, len(out)):
            out[k] = out[k] or out[self.parent[k]]
        return out

    def left(self, most: float) -> list[Line]:
        """The lines outside elements named as something else."""

        def goes(k: int) -> bool:
            least = self.heavy[k] < most * self.heavy[0]
            if self.named[k] == COMMENTS:
                return not self.headed[k] and not bodies[k] and self.text[k] < self.text[0]
            if self.named[k] == PART:
                return 2 * self.heavy[k] < self.text[k] or 0 < self.text[k] <= 2 * self.linked[k] or (self.fields[k] > 0 and least)
            return self.named[k] == WHOLE and (not self.heavy[0] or self.heavy[k] < most * self.heavy[0])

        # articles that are no comments, nor inside one; a comment element itself is not counted
        bodies = self.up([(k, 1) for k, x in enumerate(self.tag) if x in TOPS and self.named[k] != COMMENTS and self.text[k]])
        own = [goes(k) for k in range(len(self.tag))]
        gone = self.down(own)
        if not any(self.inside[x.node] and not gone[x.node] for x in self.lines):
            gone = self.down([x and not self.tops[k] for k, x in enumerate(own)])
        out = [x for x in self.lines if not gone[x.node]]
        if not out:  # a page of comments
            gone = self.down([x and self.named[k] != COMMENTS for k, x in enumerate(own)])
        return out or [x for x in self.lines if not gone[x.node]]

    def region(self, lines: list[Line]) -> list[Line]:
        other = self.down([n in (WHOLE, COMMENTS) and not i for n, i in zip(self.named, self.inside, strict=True)])
        outermost = lambda of: sum(self.heavy[k] for k in range(1, len(self.tag)) if of[k] and not of[self.parent[k]])
        held = outermost(self.inside)
        if any(self.inside[x.node] for x in lines) and 2 * held >= self.heavy[0] - outermost([o and not i for o, i in zip(other, self.inside, strict=True)]):
            return [x for x in lines if self.inside[x.node]]
        least = max((k for k in range(len(self.tag)) if self.anchors[k] == self.anchors[0] and (k == 0 or self.tag[k] in CONTAINERS)), default=0)
        # the branch of a node: the outermost container below the least one, or none
        branch = [0] * len(self.tag)
        for k in range(1, len(self.tag)):
            above = branch[self.parent[k]]
            branch[k] = above or (k if self.tag[k] in CONTAINERS and k > least else 0)
        within = self.down([k == least for k in range(len(self.tag))])
        return [x for x in lines if within[x.node] and (not branch[x.node] or self.anchors[branch[x.node]])]

    def without_menus(self, lines: list[Line]) -> list[Line]:
        first = {}  # the line before the first line of a node
        for before, line in zip([None, *lines], lines, strict=False):
            k = line.node
            while k and k not in first:
                first[k] = before
                k = self.parent[k]
        own = lambda x: x is not None and x.title and not _OTHERS & set(words_of(x.text.replace(" ", "-")))
        short = lambda k: self.links[k] > 1 and 0 < self.text[k] <= 2 * self.linked[k] and self.linked[k] < LONG_LINK * self.links[k]
        menu = self.down([k > 0 and x in (CONTAINERS | LISTS) - TOPS and not self.marks[k] and short(k) and not own(first.get(k)) for k, x in enumerate(self.tag)])
        return [x for x in lines if not menu[x.node]]


def extract(html: str | None, sigma: float = 1.0, most: float = 0.7) -> str:
    """The main text of one whole page."""
    reader, html = Lines(), html or ""
    end = html.rfind(">") + 1
    reader.feed(html[:end] + re.split("<[a-zA-Z/!?]", html[end:], maxsplit=1)[0])
    reader.close()
    reader.cut()
    page = Page(reader, sigma)
    lines = page.left(most)
    page.weigh(lines, sigma)  # what is named as something else no longer counts
    return " ".join(x.text for x in page.without_menus(page.region(lines)))


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars."""
    fields = T.StructType([T.StructField("text", T.StringType())])
    got = base.add_text_columns(pages.select("page_id", "url", "html"), "html", fields, lambda: lambda texts: [(extract(x),) for x in texts])
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
