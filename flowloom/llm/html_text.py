"""Main text of web pages by the ratio of text to tags.

A page streams through the standard library's parser, whose events make lines: runs of
text between tags that start or end a block. Lines inside elements that never hold an
article (menus, adverts, forms and the like) have no text. The ratio of text to tags of
every line is smoothed with a Gaussian, so that a short line among long ones counts with
them; lines at or above the spread of the smoothed ratios cluster as content. Ratios count
up to a few times that of a typical line, so that no single long line widens the spread.
Articles and main elements with text are selected. A page without them has the nearest
containers as regions: those with most of their text in content lines are selected, or if
there are none, the one with the most such text. A selected region gives all its lines.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from flowloom.llm.texts import strings

# Characters of a page that the parser is fed at a time.
PIECE = 1 << 16
# Lines on either side that the Gaussian reaches, and its standard deviation.
REACH, SIGMA = 3, 1.5
# Ratios count up to so many times that of a typical line, and no line has a larger share
# in what is typical.
CLIP, SHARE = 3, 0.1

# Fixed values of HTML: elements without content, and elements that end a line.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li "
    "main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGIONS = frozenset(["article", "main"])
CONTAINERS = frozenset("body div section td article main".split())
# An opening tag of the key closes an open element of the values.
CLOSES = {
    "p": frozenset(["p"]),
    "li": frozenset(["li", "p"]),
    "dd": frozenset(["dd", "dt", "p"]),
    "dt": frozenset(["dd", "dt", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]),
    "td": frozenset(["td", "th", "p"]),
    "th": frozenset(["td", "th", "p"]),
    "option": frozenset(["option"]),
}
# Elements that class or id never hide, and elements whose id counts; other ids are often
# slugs of headings.
ROOTS = frozenset(["html", "body", "main"])
ID_ELEMENTS = frozenset("aside div section ul".split())
# Elements, roles and words of class or id that mark what is no part of an article.
NO_TEXT = frozenset(
    "applet aside audio button canvas datalist dialog fieldset footer form frame frameset head "
    "iframe input map menu nav noframes noscript object option script select style svg template "
    "textarea title video".split()
)
NO_TEXT_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation "
    "search toolbar".split()
)
NO_TEXT_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs byline "
    "comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal "
    "nav navbar navigation newsletter notice notices pager pagination popup promo promotion "
    "recommended related reply replies responses search share sharing sidebar signup social "
    "sponsor sponsored subscribe subscription toolbar widget".split()
)


# Words that say nothing of what an element holds, beside one of the above.
PLAIN_WORDS = frozenset("bar block bottom box container inner items left list outer right top wrapper".split())


def marks_noise(names: str) -> bool:
    """Whether one of the names holds words for what is no part of an article, and no others."""
    for name in names.split():
        words = {word for word in re.split(r"[^a-z]+", name) if word}
        if not NO_TEXT_WORDS.isdisjoint(words) and words <= NO_TEXT_WORDS | PLAIN_WORDS:
            return True
    return False


class Lines(HTMLParser):
    """Collects the lines of a page: text, tags and region."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # element, holds no text, region
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.regions: list[int] = []
        self.named: set[int] = set()  # regions that are article or main elements
        self.words: list[str] = []
        self.count = self.number = 0

    def _hidden(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    def _region(self) -> int:
        return self.open[-1][2] if self.open else 0

    def _end_line(self) -> None:
        text = " ".join("".join(self.words).split())
        if text or self.count:
            self.texts.append(text)
            self.tags.append(self.count)
            self.regions.append(self._region())
        self.words, self.count = [], 0

    def _close(self, at: int) -> None:
        if any(element in BLOCKS for element, _, _ in self.open[at:]):
            self._end_line()
        del self.open[at:]

    def _marked(self, tag: str, given: dict[str, str]) -> bool:
        """Whether the class or id of an element marks it as no part of an article."""
        within = any(element == "article" for element, _, _ in self.open)
        if tag in ROOTS or tag == "article" and not within and not self._hidden():
            return False
        # In main elements, sections have ids by their headings too.
        slugs = within or tag == "section" and self._region() in self.named
        by_id = tag in ID_ELEMENTS and not slugs
        return marks_noise(given.get("class", "")) or by_id and marks_noise(given.get("id", ""))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = {name: (value or "").lower() for name, value in attrs}
        noise = (
            ("class" in given or "id" in given)
            and self._marked(tag, given)
            or given.get("role") in NO_TEXT_ROLES
            or "hidden" in given
            or given.get("aria-hidden") == "true"
            or "display:none" in given.get("style", "").replace(" ", "")
        )
        if tag in REGIONS and not noise:
            # An article ends menus and adverts that were never closed.
            while self._hidden() and self.open[-1][0] not in ("template", "noscript"):
                self._close(len(self.open) - 1)
        elif tag in CLOSES:
            wanted = CLOSES[tag]
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] in wanted:
                    self._close(at)
                    break
                if self.open[at][0] in CONTAINERS or self.open[at][0] in ("ul", "ol", "table"):
                    break
        if tag in BLOCKS:
            self._end_line()
        self.count += 1
        if tag in VOID:
            self.words.append(" ")
            return
        region = self._region()
        inside = region in self.named
        # Inside an article, its own header may hold the title.
        header = tag == "header" and not inside
        hidden = self._hidden() or noise or header or tag in NO_TEXT
        if tag in HEADINGS and not noise and inside and self.open[-1][0] == "header":
            hidden = False
        elif tag == "header" and inside:
            hidden = True
        if tag in REGIONS and not hidden or tag in CONTAINERS and not inside:
            self.number += 1
            region = self.number
            if tag in REGIONS:
                self.named.add(region)
        self.open.append((tag, hidden, region))

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._close(at)
                break
        self.count += 1

    def handle_data(self, data: str) -> None:
        if not self._hidden():
            self.words.append(data)

    def close(self) -> None:
        super().close()
        self._end_line()


def smoothed(ratios):
    """Ratios averaged over neighbouring lines with Gaussian weights."""
    import numpy as np

    steps = np.arange(-REACH, REACH + 1)
    weights = np.exp(-(steps**2) / (2 * SIGMA**2))
    padded = np.pad(ratios, REACH)
    return np.convolve(padded, weights / weights.sum(), mode="valid")


def clipped(ratios, lengths):
    """Ratios up to `CLIP` times that of the line in the middle of the text.

    The middle is taken by length, where a line counts for at most `SHARE` of all.
    """
    import numpy as np

    weights = lengths
    for _ in range(20):
        weights = np.minimum(weights, SHARE * weights.sum())
    order = np.argsort(ratios, kind="stable")
    passed = np.cumsum(weights[order])
    middle = ratios[order[np.searchsorted(passed, passed[-1] / 2)]]
    return np.minimum(ratios, CLIP * middle)


def main_text(html: str) -> str:
    """The lines of the selected regions of a page, joined by line ends."""
    import numpy as np

    lines = Lines()
    for start in range(0, len(html), PIECE):
        lines.feed(html[start : start + PIECE])
    lines.close()
    if not any(lines.texts):
        return ""
    lengths = np.array([len(text) for text in lines.texts], dtype=np.float64)
    level = smoothed(clipped(lengths / np.maximum(lines.tags, 1), lengths))
    content = level >= min(level.std(), level[lengths > 0].max())
    inside: dict[int, float] = defaultdict(float)
    whole: dict[int, float] = defaultdict(float)
    for region, length, chosen in zip(lines.regions, lengths, content, strict=True):
        whole[region] += length
        inside[region] += length * chosen
    # Articles stand for the page where it has any with text.
    selected = {region for region in lines.named if whole[region]}
    if not selected:
        selected = {r for r in whole if whole[r] and 2 * inside[r] >= whole[r]}
    if not selected:
        selected = {max(whole, key=lambda r: (inside[r], whole[r], -r))}
    return "\n".join(
        text
        for text, region in zip(lines.texts, lines.regions, strict=True)
        if text and region in selected
    )


def extract_text(pages: DataFrame, *, html: str = "html", into: str = "text") -> DataFrame:
    """All columns of `pages` but `html`, and `into`: the main text.

    White space inside a line becomes one space. A null or empty page, or one without
    text, gives the empty text. Markup that is broken or cut off is read as far as it
    goes. Other columns pass as they are, repeated rows stay. Nothing is shuffled. A
    column named as `into` is replaced.
    """

    def extract(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            place = batch.schema.get_field_index(html)
            texts = [main_text(page) for page in strings(batch.column(place))]
            kept = [i for i in range(batch.num_columns) if i != place]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(texts, pa.string())],
                names=[*(batch.schema.names[i] for i in kept), into],
            )

    rows = pages.drop(*({into} - {html}))
    types = "".join(
        f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != html
    )
    return rows.mapInArrow(extract, f"{types}`{into}` string")
