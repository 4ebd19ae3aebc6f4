"""Main text of web pages by the maximum-scoring subsequence of words and tags."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's elements by what they do, and common names of parts of a page.
RAW = "script style iframe noembed noframes xmp textarea title".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
CELLS = frozenset(("td", "th", "br"))
#: A start tag of the first ends an open element of the second, unless one of the third lies between.
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
CONTENT_TAGS = frozenset(("article", "main"))
BOILERPLATE_TAGS = frozenset("head nav footer aside form menu button select option datalist template noscript svg object canvas audio video dialog search".split())
CONTENT_WORDS = frozenset("article main content post entry story body".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar widget".split()
)
#: Names that make an element boilerplate only where it has no name of content as well.
WEAK_WORDS = frozenset(("header", "footer", "notice", "share"))

#: Scores are thousandths, so that sums are exact. A tag seen neither inside nor outside of content costs the middle.
WORD, CHEAP, DEAR = 1000, 100, 900

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(>?)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass
class Model:
    """Costs of tags by name, and names (.class or #id) that are boilerplate or content."""

    costs: dict[str, int] = field(default_factory=dict)
    names: dict[str, bool] = field(default_factory=dict)

    def cost(self, tag: str) -> int:
        return self.costs.get(tag, (CHEAP + DEAR) // 2)


def _names(attributes: str) -> list[str]:
    """Class names with a dot, ids and others with #, in small letters."""
    out = []
    for kind, *values in _ATTRIBUTE.findall(attributes):
        mark = "." if kind.lower() == "class" else "#"
        out += [mark + x for x in "".join(values).lower().split()]
    return out


def _kind(tag: str, names: list[str], model: Model, inside: bool) -> bool | None:
    """Whether an element is content (True), boilerplate (False) or neither; inside tells whether content is around it."""
    if tag in BOILERPLATE_TAGS:
        return False
    words = {w for n in names for w in _SPLIT.split(n) if w} if names else ()
    content = tag in CONTENT_TAGS or bool(words) and not CONTENT_WORDS.isdisjoint(words)
    if words:
        bad = BOILERPLATE_WORDS.intersection(words)
        if bad and not (content and bad <= WEAK_WORDS):
            return False
        known = [model.names[n] for n in names if n in model.names]
        if known and not content:
            return all(known)
    if tag == "header" and not inside:
        return False
    return True if tag in CONTENT_TAGS else None


class Page:
    """A page as scored items in order, its blocks of text, and the spans of its content elements.

    items: (score, block), a tag's negative, a run of words' positive, or zero in boilerplate. The scan is linear: every
    end tag looks for its start tag among the open elements, and an element that is closed is never looked at again.
    """

    def __init__(self, html: str, model: Model) -> None:
        self.items: list[tuple[int, int]] = []
        self.blocks: list[list[str]] = [[]]
        self.contents: list[tuple[int, int]] = []
        self.tags: list[tuple[str, int]] = []  # start tags and their items
        self.tops: list[tuple[tuple[str, ...], int, int]] = []  # outermost elements with names: names, first and last item
        self._model = model
        self._open: list[tuple[str, bool, bool, int, tuple[str, ...], bool]] = []  # tag, boilerplate, content around, item, names, content
        self._count: Counter[str] = Counter()
        self._mains: list[tuple[int, int]] = []
        self._read(html)
        self._close_to(0)
        self.contents = self.contents or self._mains

    def _read(self, html: str) -> None:
        at = 0
        end = len(html)
        while at < end:
            m = _TAG.search(html, at)
            if m is None:
                self._text(html[at:])
                return
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            if not m[4]:  # a stray quote: the tag ends at the next >
                at = html.find(">", at) + 1
                if not at:
                    return
            tag = tag.lower()
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, m[3])
            if tag in _CLOSE:
                close = _CLOSE[tag].search(html, at)
                at = close.start() if close else end

    def _text(self, text: str) -> None:
        if "&" in text:
            text = unescape(text)
        n = len(text.split())
        hidden = bool(self._open) and self._open[-1][1]
        if not hidden:
            self.blocks[-1].append(text)
        if n:
            self.items.append((0 if hidden else n * WORD, len(self.blocks) - 1, n))

    def _tag(self, tag: str) -> None:
        self.items.append((-self._model.cost(tag), len(self.blocks) - 1, 0))

    def _break(self, tag: str) -> None:
        if tag in BLOCKS:
            if self.blocks[-1]:
                self.blocks.append([])
        elif tag in CELLS:
            self.blocks[-1].append(" ")

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS and self._count["p"]:
            self._implied(frozenset(("p",)), frozenset(("table", "td", "th", "button", "object")))
        if tag in ENDS:
            self._implied(*ENDS[tag])
        self._break(tag)
        self.tags.append((tag, len(self.items)))
        self._tag(tag)
        if tag in VOID or tag in _CLOSE:
            return
        bad, inside = self._open[-1][1:3] if self._open else (False, False)
        names = tuple(_names(attributes)) if "=" in attributes else ()
        kind = _kind(tag, names, self._model, inside)
        content = bool(kind) and not bad
        self._open.append((tag, bad or kind is False, inside or content, len(self.items), names, content))
        self._count[tag] += 1

    def _implied(self, ended: frozenset, between: frozenset) -> None:
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] in ended:
                self._close_to(i)
                return
            if self._open[i][0] in between or self._open[i][0] in BLOCKS and "p" in ended:
                return

    def _end(self, tag: str) -> None:
        if self._count[tag]:
            i = len(self._open) - 1
            while self._open[i][0] != tag:
                i -= 1
            self._close_to(i)
        self._break(tag)
        self._tag(tag)

    def _close_to(self, depth: int) -> None:
        """Close the open elements from the innermost to the one at that depth."""
        while len(self._open) > depth:
            tag, _, _, first, names, content = self._open.pop()
            self._count[tag] -= 1
            self._break(tag)
            if names:
                self.tops.append((names, first, len(self.items)))
            if content:
                (self._mains if tag == "main" else self.contents).append((first, len(self.items)))

    def region(self) -> tuple[int, int]:
        """First and last + 1 item of the main text.

        The contiguous items of the greatest sum, of equal ones the first and of these the longest; where the page has
        content elements (articles, else main ones) with words, only words inside of one count. If one of them holds all
        of the words found, the region is the smallest such element.
        """
        scores = [s for s, _, _ in self.items]
        outside = [i for i in self._outside() if scores[i] > 0] if self.contents else []
        if len(outside) < sum(s > 0 for s in scores):
            for i in outside:
                scores[i] = 0
        first, last = best_segment(scores)
        if first == last:
            return first, last
        words = [i for i in range(first, last) if scores[i] > 0]
        around = [(b - a, a, b) for a, b in self.contents if a <= words[0] and words[-1] < b]
        return min(around)[1:] if around else (first, last)

    def _outside(self) -> Iterator[int]:
        at = 0
        for a, b in sorted(self.contents):
            yield from range(at, a)
            at = max(at, b)
        yield from range(at, len(self.items))

    def text(self) -> str:
        """The blocks of the region, boilerplate inside of it left out."""
        first, last = self.region()
        if first == last:
            return ""
        seen = sorted({b for s, b, n in self.items[first:last] if s > 0})
        return "\n\n".join(" ".join("".join(self.blocks[b]).split()) for b in seen)


def best_segment(scores: list[int]) -> tuple[int, int]:
    """First and last + 1 of the contiguous scores with the greatest positive sum; (0, 0) if there is none."""
    best, found, total, start = 0, (0, 0), 0, 0
    for i, s in enumerate(scores):
        total += s
        if total < 0:
            total, start = 0, i + 1
        elif total > best:
            best, found = total, (start, i + 1)
    return found


def _counts(html: str) -> Counter:
    """Of a page with one content element: (kind, name, inside) with how often tags lie inside and outside, and words under names."""
    page = Page(html, Model())
    found = Counter()
    if len(page.contents) != 1:
        return found
    first, last = page.contents[0]
    for tag, i in page.tags:
        found["tag", tag, first <= i < last] += 1
    for names, a, b in page.tops:
        if a <= first and last <= b:
            continue  # around the content: tells nothing
        inside = first <= a and b <= last
        n = sum(x[2] for x in page.items[a:b])
        for name in names:
            found["name", name, inside] += n
            found["pages", name, inside] += 1
    return found


def fit(pages: DataFrame, sample: int = 2000, least_pages: int = 3, most: int = 10_000) -> Model:
    """The model of labelled pages: those that mark their content themselves, with exactly one article or main element.

    Tags inside the mark are cheap and those outside dear, by the share of either; class names and ids whose words lie
    outside nine times of ten, on least_pages pages or more, are boilerplate. It is fitted on the sample pages whose
    page_id and html have the smallest hashes, a bound on the work, and holds the most frequent names. Where no page is
    labelled, all tags cost the same and only the fixed names count.
    """
    marked = pages.select(F.xxhash64("page_id", "html").alias("_h"), "html").filter(F.col("html").rlike(r"(?i)<(?:article|main)[\s>]"))
    bound = marked.select("_h").orderBy("_h").limit(sample).agg(F.max("_h")).first()[0]
    chosen = marked.filter(F.col("_h") <= F.lit(bound)).select("html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter()
            for html in batch.column(0).to_pylist():
                found.update(_counts(html))
            rows = [(*k, n) for k, n in found.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(("kind", "name", "inside", "n"), r, strict=True)) for r in rows], schema=pa.schema([("kind", pa.string()), ("name", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())]))

    sums = chosen.mapInArrow(count, "kind string, name string, inside boolean, n long").groupBy("kind", "name").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("n_in"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("n_out"))
    found = {(r.kind, r.name): (r.n_in, r.n_out) for r in sums.orderBy(F.desc(F.col("n_in") + F.col("n_out")), "kind", "name").limit(most).collect()}
    model = Model()
    for (kind, name), (n_in, n_out) in found.items():
        if kind == "tag":
            model.costs[name] = CHEAP + (DEAR - CHEAP) * n_out // (n_in + n_out)
        elif kind == "name" and sum(found.get(("pages", name), (0, 0))) >= least_pages and n_out > 9 * n_in:
            model.names[name] = False
    return model


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages(page_id, url, html).

    text is the page's main text: its blocks in order, white space inside of each one space, joined by two line ends;
    empty if there is none, and so for null or empty html. Markup that is broken, left open or cut off is read as far as
    it goes. Very long pages are read whole in one linear pass; repeated rows are rows each, other columns are ignored,
    whatever their names, and an empty table gives no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(html, model).text() if html else "" for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")
