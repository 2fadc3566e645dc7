"""Main text of a web page from text-to-tag ratios.

Parser events cut a page into blocks, the text between block-level tags; they stand for the
lines of the page, which may have none. A block's ratio is its number of characters by its number
of tags, smoothed over its neighbours with a Gaussian; blocks above one standard deviation of the
smoothed ratios are content. Each content block gives its characters to all elements around it,
one and a half times as many within article or main. The content region is the innermost element that gets
at least ``SHARE`` of them all, with everything in it, so short paragraphs beside long ones stay, and an
article that is a mere teaser is none. Where only the whole page gets so much, it is
the articles that hold content, if that is half of it, or else all from the first content block to the last. A heading right before a region that is no article belongs to it.

Menus, footers, forms, adverts, notices and reader comments are told by their elements and names
and don't count. A name is a whole token of class or id or the last word of one. It drops an element
that holds less than half of the page's text and neither article nor main but those so named;
comments and adverts go whatever they hold. If such elements have all of the text, none drops.

A null or empty page has an empty text. Broken markup never fails: an end tag closes what is
open inside its element, one without a beginning is passed over, and a marked section other than
CDATA is a comment up to the next ``>``. Pages of any length are parsed whole. Repeated rows give
repeated results, an empty table none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewave.llm.text import plain

#: Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
SKIPPED = frozenset(
    "head script style noscript template nav footer aside form button select textarea iframe svg object canvas dialog menu title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Tokens of class or id, or their last words, that name parts of a page other than its article.
NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comment comments commentlist disqus replies respond "
    "newsletter subscribe subscription signup login share sharing social related recommended popup modal overlay pagination pager "
    "widget toolbar masthead skip".split())
#: Those of reader comments and adverts, which go whatever they hold.
ALWAYS = frozenset("comment comments commentlist disqus replies respond ad ads adbox adslot advert adverts advertisement sponsored".split())
#: Elements that regions are made of.
BOXES = frozenset("article main section div center blockquote td table".split())
#: Only outside an article: inside, its own head may be called so.
OUTER_NAMES = frozenset("header topbar".split())
#: Elements that end where one of the same kind begins.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WHITE = re.compile(r"\s+")
NAME_PARTS = re.compile(r"[a-z]+")
#: First words of tokens that tell what an element has or lacks, not what it is.
STATES = frozenset("no not has have with without is hide show".split())
SIGMA = 1.0
SHARE, IN_ARTICLE = 0.8, 1.5


@dataclass
class Named:
    """An element with a name of ``NAMES``, within ``outer``; ``chars`` without white space."""

    outer: Named | None
    always: bool = False
    chars: int = 0
    main: bool = False
    dropped: bool = False


@dataclass
class Block:
    """``parts``: texts, each with its named element and whether it is a heading; None for an inline tag."""

    article: int
    box: int
    parts: list[tuple[str, Named | None, bool] | None] = field(default_factory=list)
    heading: bool = False
    tags: int = 1
    text: str = ""

    def finish(self) -> None:
        """Text and number of tags from the first part on that isn't dropped."""
        texts = []
        for part in self.parts:
            if part is None:
                self.tags += bool(texts)
            elif part[1] is None or not part[1].dropped:
                if not texts:
                    self.heading = part[2]
                texts.append(part[0])
        self.text = WHITE.sub(" ", "".join(texts)).strip()


def names(value: str) -> set[str]:
    """Tokens and last words of them that may be names."""
    found = set()
    for token in value.split():
        words = NAME_PARTS.findall(token)
        if words and words[0] not in STATES:
            found |= {"".join(words), words[-1]}
    return found


class Blocks(HTMLParser):
    """Collects the blocks of a page. ``open`` holds (tag, skipped, article, named, box) of the open elements.

    ``around`` has the box around each box; box 0 is the page, and inner ones come after outer ones.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, Named | None, int]] = []
        self.around = [0]
        self.articled = [False]
        self.count: Counter[str] = Counter()
        self.blocks: list[Block] = []
        self.named: list[Named] = []
        self.chars = 0
        self.articles = 0
        self.now: Block | None = None

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Python's parser raises an error on unknown sections and searches far for the end of known ones."""
        if self.rawdata[i + 3:i + 9].lower() == "cdata[" and self.rawdata.find("]]>", i + 9) >= 0:
            return super().parse_marked_section(i, report)
        return self.parse_bogus_comment(i)

    def state(self) -> tuple[bool, int, Named | None, int]:
        return self.open[-1][1:] if self.open else (False, 0, None, 0)

    def end_block(self) -> None:
        if self.now is not None:
            self.blocks.append(self.now)
            self.now = None

    def add(self, text: str) -> None:
        _, article, named, box = self.state()
        if self.now is None:
            self.now = Block(article, box)
        self.now.parts.append((text, named, any(t[0] in HEADING for t in self.open[-3:])))
        n = sum(map(len, text.split()))
        self.chars += n
        if named is not None:
            named.chars += n

    def whole(self) -> list[Block]:
        """The blocks with text, without what names drop."""
        self.end_block()
        for named in reversed(self.named):  # inner ones come after outer ones
            if named.outer is not None:
                named.outer.chars += named.chars
                named.outer.main |= named.main
        for named in self.named:
            named.dropped = (named.always or not named.main and 2 * named.chars < self.chars
                             or named.outer is not None and named.outer.dropped)
        if self.chars == sum(n.chars for n in self.named if n.dropped and not (n.outer and n.outer.dropped)):
            for named in self.named:
                named.dropped = False
        for block in self.blocks:
            block.finish()
        return [b for b in self.blocks if b.text]

    def is_named(self, attrs: list, article: int) -> tuple[bool, bool]:
        """Whether an element has a name, and whether it is one that always goes."""
        found = set().union(*(names((value or "").lower()) for name, value in attrs if name in ("class", "id")))
        return bool(found & NAMES or not article and found & OUTER_NAMES), bool(found & ALWAYS)

    def noise(self, tag: str, attrs: list, article: int) -> bool:
        if tag in SKIPPED or tag == "header" and not article:
            return True
        for name, value in attrs:
            value = (value or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
                return True
            if name == "style" and "display:none" in value.replace(" ", ""):
                return True
        return False

    def end_like(self, tags: set[str]) -> None:
        """Close the innermost open element of ``tags``, unless another block lies within it."""
        for place in range(len(self.open) - 1, -1, -1):
            tag = self.open[place][0]
            if tag in tags:
                self.close_to(place)
            if tag in BLOCK and tag != "p":
                break

    def close_to(self, place: int) -> None:
        for tag, *_ in self.open[place:]:
            self.count[tag] -= 1
        del self.open[place:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.end_block()
            self.end_like({"p"} if tag not in SIBLINGS else SIBLINGS[tag] | {"p"})
        elif self.now is not None:
            self.now.parts.append(None)
        if tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        skipped, article, named, box = self.state()
        outer = article
        if tag in ("article", "main") and not skipped and not article:
            self.articles += 1
            article = self.articles
        skipped = skipped or self.noise(tag, attrs, article)
        if not skipped and tag not in ("html", "body"):
            by_name, always = self.is_named(attrs, outer)
            if tag in ("article", "main") and not always:
                if named is not None and not by_name and not named.always:
                    named.main = True
            elif by_name:
                named = Named(named, always or named is not None and named.always)
                self.named.append(named)
        if tag in BOXES and not skipped:
            self.around.append(box)
            self.articled.append(tag in ("article", "main"))
            box = len(self.around) - 1
        self.count[tag] += 1
        self.open.append((tag, skipped, article, named, box))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("script", "style", "svg", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_block()
        place = len(self.open) - 1
        while self.count[tag] > 0 and place >= 0:
            if self.open[place][0] == tag:
                self.close_to(place)
                break
            place -= 1

    def handle_data(self, data: str) -> None:
        if not self.state()[0]:
            self.add(data)


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian mean over the neighbours; the weights at the ends are those that are there."""
    reach = int(np.ceil(3 * SIGMA))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    total = np.convolve(ratios, weights)[reach:len(ratios) + reach]
    return total / np.convolve(np.ones(len(ratios)), weights)[reach:len(ratios) + reach]


def region(blocks: list[Block], content: np.ndarray, around: list[int]) -> int:
    """The innermost box with at least ``SHARE`` of the content's characters; 0 is the page."""
    mass = np.zeros(len(around))
    for i in content:
        mass[blocks[i].box] += len(blocks[i].text) * (IN_ARTICLE if blocks[i].article else 1.0)
    total, found = mass.sum(), 0
    for box in range(len(around) - 1, 0, -1):
        if not found and mass[box] >= SHARE * total:
            found = box
        mass[around[box]] += mass[box]
    return found


def main_text(html: str | None) -> str:
    """Blocks of the content region, in page order, joined by two line ends."""
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    blocks = parser.whole()
    if not blocks:
        return ""
    ratio = smoothed(np.array([len(b.text) / b.tags for b in blocks]))
    content = np.flatnonzero(ratio >= min(ratio.std(), ratio.max()))
    box = region(blocks, content, parser.around)
    articles = {blocks[i].article for i in content} - {0}
    size = {kind: sum(len(blocks[i].text) for i in content if bool(blocks[i].article) == kind) for kind in (True, False)}
    if box:
        inside = [False] * len(parser.around)
        for k in range(box, len(parser.around)):
            inside[k] = k == box or inside[parser.around[k]]
        chosen = [i for i, b in enumerate(blocks) if inside[b.box]]
        alone = parser.articled[box]
    elif size[True] >= size[False]:
        chosen, alone = [i for i, b in enumerate(blocks) if b.article in articles], True
    else:
        chosen, alone = list(range(content[0], content[-1] + 1)), False
    first = chosen[0]
    while not alone and first and blocks[first - 1].heading:
        first -= 1
        chosen.insert(0, first)
    return "\n\n".join(blocks[i].text for i in chosen)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return plain(pages, ("page_id", "url", "html")).select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id bigint, url string, text string, n_chars bigint")
