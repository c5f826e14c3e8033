"""Main text of HTML pages.

The events of the standard library's parser are gathered into lines, one for each block of the page, and into the tree of
elements that they stand in. Elements that are never an article (menus, page headers, footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments) are known by their tag, role, class or id; their lines are boilerplate. A wrapper
that holds an article, main or h1 isn't one, whatever its class says.

Each line has a text-to-tag ratio: its characters outside links, by its tags; boilerplate lines have 0. The ratios are
smoothed by a Gaussian kernel over the lines and split in two clusters by a threshold. The lines above it decide

* of a block with a doubtful class name (SOFT), whether it is boilerplate: if less than half of its text is above;
* whether the article and main elements are the content: if they hold half of the text above or more. Then all of their
  lines are kept, so that a short paragraph stays;
* else, which element is: from the body down, the one that holds MOST of the text above. All its lines are kept, and the h1
  before it, but for lists of links;
* where that is the whole page, which run of lines is: from the first to the last line above, and on over neighbours of an
  eighth of the threshold that the smoothing lifts to a quarter.

Defined cases: a null or empty html gives an empty text and 0 characters; markup without a closing tag ends with its
container; marked sections and unclosed comments are comments, to the next > or to the end; a page without any line above
the threshold gives all lines that aren't boilerplate or lists of links; repeated rows give repeated results; an empty table
gives no rows; other columns are ignored. The time is linear in the page, however many elements stay open.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Elements that begin and end a block of text.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold the article.
NEVER = frozenset("head title script style noscript template nav footer aside button select textarea option input svg iframe object canvas audio video menu dialog label fieldset datalist".split())
#: Words of a class, id or role that mark such elements.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense alert banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookiebar cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices "
    "overlay paywall popup promo promotion recommended related replies sidebar signup social sponsor sponsored subscribe toolbar".split()
)
#: Words that mark some, but also name articles; the smoothed ratio decides.
SOFT = frozenset("header hidden register reply response responses search share sharing skip tracking widget".split())
#: First words of class names that say how a page is laid out, not what an element is.
LAYOUT = frozenset("has with no without is layout page col row grid".split())
#: Elements that may be the region that holds the content, and those that hold lists.
CONTAINERS = frozenset("html body div section td center article main form".split())
LISTED = frozenset("li td th dt dd ul ol".split())
#: Lines that the smoothing reaches, as the kernel's deviation; the share of the text above the threshold that a region holds.
SIGMA, MOST = 1.0, 0.9
#: Elements that an opening block closes if they are the nearest open block.
CLOSED = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
#: How an element is marked: not, doubtfully, by its class, by its tag.
PLAIN, DOUBTFUL, NAMED, SURE = range(4)
COMMENT_END = re.compile(r"--!?>")


class Line:
    """A block's text: its parts, inline tags, characters in links, and the element that it stands in."""

    __slots__ = ("element", "links", "parts", "tags", "text")

    def __init__(self, element: int):
        self.parts, self.tags, self.links, self.element, self.text = [], 0, 0, element, ""


class Page(HTMLParser):
    """Parser events as lines and as a tree of elements: their tags, parents (-1: none) and marks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.tags, self.parents, self.marks = [], [], []
        self.open: list[tuple[int, Line | None]] = []  # element, and the line that goes on behind it
        self.where: dict[str, list[int]] = defaultdict(list)  # places in open, by tag
        self.blocks: list[int] = []  # places of blocks in open
        self.inside = 0  # open article and main elements
        self.now: Line | None = None

    def line(self) -> Line:
        if self.now is None:
            self.now = Line(self.open[-1][0] if self.open else -1)
            self.lines.append(self.now)
        return self.now

    def close_from(self, place: int) -> None:
        while len(self.open) > place:
            element, _ = self.open.pop()
            tag = self.tags[element]
            self.where[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            self.inside -= tag in ("article", "main")

    def handle_starttag(self, tag, attrs):
        block = tag in BLOCKS
        if block:
            self.now = None
            if self.blocks and tag in CLOSED.get(self.tags[self.open[self.blocks[-1]][0]], ()):
                self.close_from(self.blocks[-1])
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            elif tag not in NEVER and not block:
                self.line().tags += 1
            return
        mark = self.mark(tag, attrs)
        if not block and mark == DOUBTFUL:
            mark = PLAIN
        behind = None if block else self.now
        self.tags.append(tag)
        self.parents.append(self.open[-1][0] if self.open else -1)
        self.marks.append(mark)
        self.where[tag].append(len(self.open))
        if block:
            self.blocks.append(len(self.open))
        self.inside += tag in ("article", "main")
        self.open.append((len(self.tags) - 1, behind))
        if mark and not block:
            self.now = None
        elif not block:
            self.line().tags += 1

    def mark(self, tag, attrs) -> int:
        if tag in NEVER or tag == "header" and not self.inside:
            return SURE
        if tag in ("html", "body", "main"):
            return PLAIN
        found = NAMED if tag == "form" else PLAIN
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                for one in value.split():
                    words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", one).lower())
                    if not words or words[0] in LAYOUT or "free" in words:
                        continue
                    if one.lower() == "hidden":
                        return SURE
                    if not STRONG.isdisjoint(words):
                        found = NAMED
                    elif not SOFT.isdisjoint(words) and not (self.inside and "header" in words):
                        found = max(found, DOUBTFUL)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and "display:none" in value.replace(" ", ""):
                return SURE
        return found

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        places = self.where.get(tag)
        if not places or (tag not in BLOCKS and self.blocks and self.blocks[-1] > places[-1]):
            if tag in BLOCKS:
                self.now = None
            return
        element, behind = self.open[places[-1]]
        self.close_from(places[-1])
        if tag in BLOCKS:
            self.now = None
        elif self.marks[element]:
            self.now = behind  # what follows a marked inline element goes on with the line before it

    def handle_data(self, data):
        line = self.line()
        line.parts.append(data)
        if self.where.get("a"):
            line.links += len(data.strip())

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i, report)

    def parse_comment(self, i, report=True):
        if self.rawdata.startswith(">", i + 4) or self.rawdata.startswith("->", i + 4):
            return self.rawdata.index(">", i + 4) + 1
        end = COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    r = int(np.ceil(3 * sigma))
    if not r:
        return ratios
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    full = lambda x: np.convolve(np.concatenate((np.zeros(r), x, np.zeros(r))), kernel, "valid")
    return full(ratios) / full(np.ones(len(ratios)))  # at the page's ends the kernel is cut


def threshold(values: np.ndarray) -> float:
    """The border of two clusters: the mean of their means, repeated until it stays."""
    t = float(values.mean())
    for _ in range(100):
        low, high = values[values <= t], values[values > t]
        if not len(low) or not len(high):
            return min(t, float(values.max()) * 0.999)
        now = (float(low.mean()) + float(high.mean())) / 2
        if abs(now - t) < 1e-9:
            break
        t = now
    return t


def raised(values: list, parents: list[int]) -> list:
    """The sum of each element's value and those of all elements in it. Parents come before their children."""
    out = list(values)
    for k in range(len(out) - 1, -1, -1):
        if parents[k] >= 0:
            out[parents[k]] += out[k]
    return out


def reached(page: Page, mark_of) -> list[bool]:
    """For each element whether mark_of is true of it or of one around it."""
    out: list[bool] = []
    for k, parent in enumerate(page.parents):
        out.append((parent >= 0 and out[parent]) or mark_of(k))
    return out


def content(page: Page, lines: list[Line], sigma: float = SIGMA) -> list[bool]:
    """For each line whether it is content."""
    def by_element(values: list[int]) -> list[int]:
        sums = [0] * len(page.tags)
        for x, v in zip(lines, values, strict=True):
            if x.element >= 0:
                sums[x.element] += v
        return raised(sums, page.parents)

    def within_any(flags: list[bool]) -> list[bool]:
        return [x.element >= 0 and flags[x.element] for x in lines]

    holds = raised([t in ("article", "main", "h1") and m == PLAIN for t, m in zip(page.tags, page.marks, strict=True)], page.parents)
    never = within_any(reached(page, lambda k: page.marks[k] == SURE))
    shown = [0 if bad else len(x.text) for x, bad in zip(lines, never, strict=True)]
    parts, sum_shown = by_element(shown), sum(shown)
    hidden = within_any(reached(page, lambda k: page.marks[k] == SURE or page.marks[k] == NAMED and not (holds[k] and 2 * parts[k] >= sum_shown)))
    if all(hidden):
        return [False] * len(lines)
    ratios = np.array([0.0 if bad else max(0, len(x.text) - x.links) / max(1, x.tags) for x, bad in zip(lines, hidden, strict=True)])
    level = smoothed(ratios, sigma)
    border = threshold(level)
    above = [bool(v > border * 0.999) and not bad for v, bad in zip(level, hidden, strict=True)]

    sizes = [0 if bad else len(x.text) for x, bad in zip(lines, hidden, strict=True)]
    mass = by_element([n if up else 0 for n, up in zip(sizes, above, strict=True)])
    chars = by_element(sizes)
    doubted = reached(page, lambda k: page.marks[k] == DOUBTFUL and not holds[k] and 2 * mass[k] < chars[k])
    good = [not bad and not doubt for bad, doubt in zip(hidden, within_any(doubted), strict=True)]
    prose = [ok and not (2 * x.links >= len(x.text) and x.element >= 0 and page.tags[x.element] in LISTED) for x, ok in zip(lines, good, strict=True)]
    total = sum(n for n, up, ok in zip(sizes, above, good, strict=True) if up and ok)
    if not total:
        return prose
    article = reached(page, lambda k: page.tags[k] in ("article", "main"))
    inside = [ok and within for within, ok in zip(within_any(article), good, strict=True)]
    if 2 * sum(n for n, up, ok in zip(sizes, above, inside, strict=True) if up and ok) >= total:
        return inside
    # The element that holds most: from the outermost containers to the one of the largest share, as long as there is one.
    around, best = [-1] * len(page.tags), {}
    for k, parent in enumerate(page.parents):
        around[k] = parent if parent < 0 or page.tags[parent] in CONTAINERS else around[parent]
        if page.tags[k] in CONTAINERS and (around[k] not in best or mass[k] > mass[best[around[k]]]):
            best[around[k]] = k
    region, held = -1, total
    while region in best and mass[best[region]] >= MOST * held:
        region, held = best[region], mass[best[region]]
    its = prose if region < 0 else [ok and within for within, ok in zip(within_any(reached(page, lambda k: k == region)), prose, strict=True)]
    if sum(its) < sum(prose):
        first = its.index(True) if any(its) else 0
        return [ok or (k < first and prose[k] and x.element >= 0 and page.tags[x.element] == "h1") for k, (x, ok) in enumerate(zip(lines, its, strict=True))]
    up = [k for k, x in enumerate(above) if x and prose[k]]
    if not up:
        return prose
    a, b = up[0], up[-1]
    near = [ok and v > border / 4 and r > border / 8 for v, r, ok in zip(level, ratios, prose, strict=True)]
    while a > 0 and near[a - 1]:
        a -= 1
    while b + 1 < len(lines) and near[b + 1]:
        b += 1
    return [ok and a <= k <= b for k, ok in enumerate(prose)]


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    if not html:
        return ""
    page = Page()
    page.feed(html)
    page.close()
    for x in page.lines:
        x.text = " ".join("".join(x.parts).split())
    lines = [x for x in page.lines if x.text]
    return "\n\n".join(x.text for x, ok in zip(lines, content(page, lines, sigma) if lines else [], strict=True) if ok)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars. One pass, no shuffle."""
    common.arrow_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(common.table(spark, sf_dir, "pages"))


QUERIES = {"op5_html_extraction": op5_html_extraction}
ORACLE_SQL: dict[str, str] = {}
