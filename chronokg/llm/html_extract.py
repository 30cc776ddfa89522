"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags. Parts that aren't the article
(menus, forms, notices and the like) are told by their tags and by words of their
names, but no name counts that stands above most of the page's text, and a page
that marks its article has no other part. In the first pass each other block is
good, bad or undecided: by its share of linked text, its share of stop words (on
pages in a language that we have some of) and its length. In the second pass
undecided blocks take the label of their nearest decided neighbours, of those in
the same container if there are any, whatever stands in the other parts. In a
marked article only lists of links and the headings right above them are bad.

Scanning takes time in proportion to the page: a tag that never ends makes
quotes count no more from there on, and elements nested deeper than ``DEEPEST``
are taken as standing side by side, as browsers do.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronokg.llm.common import arrow_batches, as_bytes, fresh

#: Common short words of the languages at hand.
STOP_WORDS = frozenset(
    """
    a an and are as at be been but by can do for from had has have he her his how i if in into is it its more not of on one or our out she so some than that the their them then there these they this to up was we were what when which who will with you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es für hat ich ihr im in ist ja mit nach nicht noch nur oder sich sie sind so um und uns von vor war was wenn wie wir zu zum zur über
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur tout un une vous à été être
    al como con de del el ella en entre era es esta este ha hasta la las le lo los me mi muy no nos o para pero por que se ser si sin sobre son su sus también un una y ya
    """.split()
)
#: Tags that end a block; those whose text is never content; those that mark parts that aren't the article; those without end tags.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("script style noscript template head title textarea select svg math iframe object canvas audio video button map applet noframes noembed datalist".split())
OUTSIDE = frozenset("nav aside footer form menu dialog fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Whole words (cut at -, _ and lower-upper) of classes, ids and roles of parts that aren't the article.
HINTS = frozenset(
    """
    ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside rail
    footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login search form comment comments commentlist discussion disqus reply replies respond
    share sharing social related recommended recommendations widget widgets pagination pager skip copyright legal disclaimer contentinfo complementary
    """.split()
)
_MARKUP = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)"
#: A tag with quoted values, and one that ends at the next > whatever is quoted.
_TAG = re.compile(_MARKUP + r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>", re.S)
_PLAIN_TAG = re.compile(_MARKUP + r"([^>]*+)>", re.S)
_NEXT = re.compile(r"<(?:[!?]|/?[A-Za-z])")
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PARTS = re.compile(r"[^a-z]+")
_WORD = re.compile(r"[^\W\d_]+")
_P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_IN_HEAD = frozenset("html head base basefont bgsound link meta title script style noscript template noframes".split())
_RAW = frozenset("script style textarea noscript iframe noframes noembed title template svg".split())
_CONTAINERS = frozenset("article aside body div dl form html main ol section table td ul".split())
_INNER = frozenset("article td div section li p".split())
_CLOSERS = frozenset("p td th li div section article body button".split())

SHORT, LINKS, STOPS_LOW, STOPS_HIGH, DEEPEST = 70, 0.33, 0.1, 0.25, 256
GOOD, BAD, OPEN = 1, -1, 0


class Element:
    """An open element: ``outside`` by tag, ``hints`` are the hinted elements around it (within its article), ``above`` those around its article, ``home`` its container."""

    __slots__ = ("tag", "silent", "outside", "inside", "hints", "above", "home")

    def __init__(self, tag="", silent=False, outside=False, inside=False, hints=(), above=(), home=0):
        self.tag, self.silent, self.outside, self.inside, self.hints, self.above, self.home = tag, silent, outside, inside, hints, above, home


_ROOT = Element()


class Block:
    __slots__ = ("text", "linked", "outside", "inside", "hints", "above", "home", "heading", "item")

    def __init__(self, text, linked, at: Element, heading=False, item=False):
        self.text, self.linked, self.heading, self.item = text, linked, heading, item
        self.outside, self.inside, self.hints, self.above, self.home = at.outside, at.inside, at.hints, at.above, at.home


def _hinted(attributes: str, named: bool = False) -> tuple[bool, bool, bool]:
    """Of a tag's attributes: marks a part that isn't the article; marks the article; hidden. With ``named`` an id counts only if it is all hints."""
    outside = main = hidden = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "aria-label", "itemtype"):
            words = set(_PARTS.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()))
            outside |= bool(words & HINTS) and not (named and name == "id" and words - HINTS - {""})
            main |= name == "role" and value.lower() in ("main", "article")
        elif name == "style":
            hidden |= "display:none" in (flat := re.sub(r"\s", "", value.lower())) or "visibility:hidden" in flat
    bare = re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes).lower().split()
    return outside, main, hidden or "hidden" in bare


class _Page:
    """The open elements of a page while it is read, and its blocks."""

    def __init__(self):
        self.out: list[Block] = []
        self.stack: list[Element] = []
        self.held: Counter[str] = Counter()  # open elements by tag, and those beyond the deepest
        self.flat: Counter[str] = Counter()
        self.text: list[str] = []
        self.links: list[str] = []
        self.named = 0

    def top(self) -> Element:
        return self.stack[-1] if self.stack else _ROOT

    def words(self, part: str) -> None:
        if not part:
            return
        if self.top().tag == "head" and part.strip():
            self.close(len(self.stack) - 1)
        if not self.top().silent:
            self.text.append(part)
            if self.held["a"]:
                self.links.append(part)

    def flush(self) -> None:
        if self.text:
            whole = " ".join(entities.unescape("".join(self.text)).split())
            if whole:
                linked = len(" ".join(entities.unescape(" ".join(self.links)).split()))
                heading = any(e.tag in _HEADINGS for e in self.stack[-4:])
                self.out.append(Block(whole, min(1.0, linked / len(whole)), self.top(), heading, self.held["li"] > 0))
            self.text.clear()
            self.links.clear()

    def close(self, upto: int) -> None:
        for e in self.stack[upto:]:
            self.held[e.tag] -= 1
        del self.stack[upto:]

    def nearest(self, tags) -> int:
        """The place of the innermost open element of these tags, or -1."""
        if not any(self.held[t] for t in tags):
            return -1
        return next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].tag in tags)

    def open(self, tag: str, attributes: str) -> None:
        if self.top().tag == "head" and tag not in _IN_HEAD:
            self.close(len(self.stack) - 1)
        if tag in BLOCKS:
            self.flush()
            if tag in _P_ENDS and self.held["p"]:
                near = self.nearest(_CLOSERS)
                if self.stack[near].tag == "p":
                    self.close(near)
            if tag in _SAME and self.held[tag]:
                near = self.nearest((tag, *_SAME[tag]))
                if self.stack[near].tag == tag:
                    self.close(near)
        if tag in VOID or attributes.endswith("/") and attributes[-2:-1] in ("", " ", "\t", "\n", "\r", '"', "'"):
            return
        if len(self.stack) >= DEEPEST:
            self.flat[tag] += 1
            return
        up = self.top()
        hinted, main, hidden = _hinted(attributes, up.inside and tag == "section") if attributes and not attributes.isspace() else (False, False, False)
        starts = (tag in ("article", "main") or main) and not up.inside
        if tag in ("article", "main", "body", "html") or up.inside and tag in _HEADINGS:
            hinted = False  # a theme's classes on these say nothing, nor do anchors of headings
        self.named += 1
        hints, above = ((), up.hints) if starts else (up.hints, up.above)
        inner = tag == "article" and up.inside and self.held["article"] > 0
        self.stack.append(Element(
            tag, up.silent or tag in SILENT or hidden, up.outside or tag in OUTSIDE or tag == "header" and not up.inside or inner,
            up.inside or starts, (*hints, self.named) if hinted else hints, above, self.named if tag in _CONTAINERS else up.home,
        ))
        self.held[tag] += 1

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if self.flat[tag] > 0:
            self.flat[tag] -= 1
            return
        near = self.nearest((tag,))
        if near < 0:
            return
        if tag in BLOCKS or not any(e.tag in _INNER for e in self.stack[near + 1 :]):
            self.close(near)
        else:
            self.held[tag] -= 1
            del self.stack[near]


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, without empty ones."""
    own, pattern, endless, at, n = _Page(), _TAG, set(), 0, len(page)
    last = page.rfind(">")
    while at < n:
        start = _NEXT.search(page, at)
        m = pattern.match(page, start.start()) if start else None
        if start and not m and start.start() < last:  # a tag that never ends
            pattern = _PLAIN_TAG
            m = pattern.match(page, start.start())
        own.words(page[at : m.start() if m else n])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag == "br" or tag == "hr" and m[1]:
            own.text.append(" ")
        elif m[1]:
            own.end(tag)
        else:
            own.open(tag, m[3])
            if tag in _RAW and own.top().tag == tag:
                found = None if tag in endless else re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                if found:
                    at = found.start()
                else:
                    endless.add(tag)
                    at = n if tag in ("script", "style") else at
    own.flush()
    return own.out


def stop_counts(text: str) -> tuple[int, int]:
    """A text's stop words and words."""
    words = _WORD.findall(text.lower())
    return sum(map(STOP_WORDS.__contains__, words)), len(words)


def stop_share(text: str) -> float:
    stops, words = stop_counts(text)
    return stops / max(1, words)


def settle_parts(found: list[Block]) -> bool:
    """Set ``outside`` of the page's blocks by what the hints above them are worth; whether the page marks its article.

    A hinted element with over half of the text that no tag puts outside is no
    part beside the article. Hints around an article count if another one has none.
    """
    sizes, total = Counter(), 0
    for b in found:
        if not b.outside:
            total += len(b.text)
            for h in (*b.hints, *b.above):
                sizes[h] += len(b.text)
    within = sum(len(b.text) for b in found if b.inside and not b.outside)
    free = any(b.inside and not b.outside and not b.hints and not b.above for b in found)
    for b in found:
        most = within if b.inside else total
        b.outside = b.outside or any(2 * sizes[h] <= most for h in b.hints) or free and bool(b.above)
    marked = any(b.inside and not b.outside for b in found)
    if marked:
        for b in found:
            b.outside = b.outside or not b.inside
    return marked


def first_pass(found: list[Block], marked: bool) -> list[int]:
    """Each block's label by link density, stop words and length."""
    counts = [(0, 0) if b.outside else stop_counts(b.text) for b in found]
    foreign = sum(s for s, _ in counts) < STOPS_LOW * max(1, sum(w for _, w in counts))
    listed = [b.item and b.linked > 0.8 for b in found]
    out = []
    for i, b in enumerate(found):
        n = len(b.text)
        if b.outside:
            out.append(BAD)
        elif marked and listed[i] and (i and listed[i - 1] or listed[i + 1 : i + 2] == [True]):
            out.append(BAD)  # a list of links
        elif n < SHORT and (marked or b.linked <= LINKS):
            out.append(OPEN)
        else:
            stops = STOPS_HIGH if foreign else counts[i][0] / max(1, counts[i][1])
            linked = b.linked > LINKS and (n < 2 * SHORT or stops < STOPS_HIGH or b.linked > 0.8)
            good = stops >= STOPS_HIGH or stops >= STOPS_LOW and n >= 2 * SHORT
            out.append(OPEN if linked and marked else BAD if linked else GOOD if good and not (foreign and n < 2 * SHORT) else OPEN)
    return out


def second_pass(labels: list[int], found: list[Block], marked: bool) -> list[bool]:
    """Undecided blocks take the label of both nearest decided neighbours; where those differ the nearer one's, and a heading that of the next.

    Neighbours are blocks of no other part: of the same container, else of any;
    if the page has no good one, undecided blocks are good. In a marked article
    only a heading right above a list of links is bad.
    """
    n = len(labels)
    decided = [0 if b.outside else label for b, label in zip(found, labels)]
    if GOOD not in decided:
        return [not b.outside and label != BAD for b, label in zip(found, labels)]

    def sides(keys):
        before, after, last = [None] * n, [None] * n, {}
        for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
            last.clear()
            for i in order:
                side[i] = last.get(keys[i])
                if decided[i]:
                    last[keys[i]] = i
        return before, after

    near, far = sides([b.home for b in found]), sides([0] * n)
    out = []
    for i, b in enumerate(found):
        label = labels[i]
        if not label and marked:
            label = BAD if b.heading and i + 1 < n and labels[i + 1] == BAD and not found[i + 1].outside else GOOD
        if not label:
            left, right = (side[i] for side in near) if near[0][i] is not None or near[1][i] is not None else (side[i] for side in far)
            if left is None or right is None or decided[left] == decided[right]:
                label = decided[right if left is None else left]
            elif b.heading:
                label = decided[right]
            elif i - left != right - i:
                label = decided[left if i - left < right - i else right]
            else:
                label = GOOD if stop_share(b.text) >= STOPS_HIGH else BAD
        out.append(label == GOOD)
    return out


def main_text(page: str) -> str:
    """The kept blocks' texts, one to a line."""
    found = blocks(page)
    marked = settle_parts(found)
    kept = second_pass(first_pass(found, marked), found, marked)
    return "\n".join(b.text for b, keep in zip(found, kept) if keep)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without its html and with its main text (empty if it has none).

    Null html is empty; bytes that aren't UTF-8 come out as U+FFFD; an existing
    column of the output's name is replaced, and no other name clashes. Repeated
    rows come back as often as given, an empty table gives no rows, and a very
    long page is read whole, in time in proportion to its length.
    """
    arrow_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c != html and c.lower() != out.lower()]
    body = fresh(pages, "body")
    given = pages.select(*[f"`{c}`" for c in kept], as_bytes(pages, html).alias(body))

    def run(batches):
        for batch in batches:
            texts = pa.array([main_text(x.decode("utf-8", "replace")) for x in batch.column(len(kept)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*kept, out])

    return given.mapInArrow(run, given.drop(body).withColumn(out, F.lit("")).schema)
