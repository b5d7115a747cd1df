"""Main text of HTML pages by the line-block distribution.

Markup is stripped into lines, one for each block, and one for all that a menu, footer, notice or form holds. A line
weighs as much as it has text; nothing if it is one of these, one of several links in a row, or reads like a menu's
entry. Weights are summed over sliding windows of lines: text starts where the sums surge from nothing and
ends where they dive to nothing. Where a page marks its article, the distribution is searched inside it.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose content isn't page text, elements around other things than the
# article, elements that don't break a line, and class or id words of such other things.
HIDDEN = "script style noscript template svg iframe object canvas title select textarea button"
OUTSIDE = "nav footer aside form menu dialog header"
INLINE = "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr"
ASIDE_WORDS = (
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies footer "
    "header menu nav navbar navigation newsletter notice popup promo promoted related respond share sharing sidebar "
    "social sponsor sponsored subscribe toolbar widget"
)
# Words of layout that may stand beside those in one name.
LAYOUT_WORDS = "area bar block bottom box container content global inner left links list main outer page primary right row secondary section site top wrap wrapper"
VOID = "area base br col embed hr img input link meta param source track wbr"
HEADINGS = "h1 h2 h3 h4 h5 h6"

_HIDDEN, _OUTSIDE, _INLINE, _VOID, _HEADINGS = (frozenset(x.split()) for x in (HIDDEN, OUTSIDE, INLINE, VOID, HEADINGS))
_ASIDE, _LAYOUT = frozenset(ASIDE_WORDS.split()), frozenset(LAYOUT_WORDS.split())
_ENDS = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in _HIDDEN}
#: Without an end tag the code of these reaches to the page's end, as in browsers; of others the tag alone goes.
_ENDLESS = frozenset(("script", "style"))
_SELF_CLOSED = frozenset("svg iframe object canvas".split())
_NAME = re.compile(r"/?([A-Za-z][A-Za-z0-9-]*)")
_STEP = re.compile(r">|=\s*([\"'])")
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")

WINDOW = 3
#: Where no element marks the article, a run of lines is text if it has this part of the heaviest run's weight.
PART = 0.2
#: From this share of link text on, a line may be a menu's.
LINKED = 0.6
#: So many lines of links in a row are a menu.
LISTED = 3
#: So short a line, without the end of a sentence and no heading, reads like a menu's entry.
LABEL = 25


class Line(NamedTuple):
    """A block's text, how many of its characters are in links, whether it is in an article, what it stands in, and whether that is page text."""

    text: str
    linked: int
    inside: bool
    kind: str  # heading or empty
    away: bool = False


class Tag(NamedTuple):
    name: str
    end: bool
    attributes: str


def tokens(page: str) -> Iterator[str | Tag]:
    """Text and tags of a page in one pass, without comments and hidden elements.

    Every search either moves ahead to what it finds or, having found nothing, isn't made again. A tag
    that never ends hides what is left, as in browsers.
    """
    at, absent = 0, set()

    def after(what: str, start: int) -> int:
        """Where ``what`` ends, or -1."""
        if what in absent or (found := page.find(what, start)) < 0:
            absent.add(what)
            return -1
        return found + len(what)

    while (lt := page.find("<", at)) >= 0:
        if lt > at:
            yield page[at:lt]
        if page.startswith("<!--", lt):
            if (at := after("-->", lt + 4)) < 0:
                return
            continue
        if page.startswith(("<!", "<?"), lt):
            end = after("]]>", lt + 9) if page.startswith("<![CDATA[", lt) else -1
            if (at := end if end > 0 else after(">", lt)) < 0:
                return
            continue
        name = _NAME.match(page, lt + 1)
        if not name:
            yield "<"
            at = lt + 1
            continue
        end = name.end()
        while True:
            step = _STEP.search(page, end)
            if step is None:
                return
            end = step.end()
            if step[1] is None:
                break
            end = max(end, after(step[1], end))  # a quote that isn't closed is an ordinary character
        tag = Tag(name[1].lower(), page[lt + 1] == "/", page[name.end() : end - 1])
        at = end
        if tag.name not in _HIDDEN:
            yield tag
        elif not tag.end and not (tag.name in _SELF_CLOSED and tag.attributes.endswith("/")) and tag.name not in absent:
            if close := _ENDS[tag.name].search(page, at):
                if (at := after(">", close.end())) < 0:
                    return
            elif tag.name in _ENDLESS:
                return
            else:
                absent.add(tag.name)
            yield " "
    if at < len(page):
        yield page[at:]


def _is_aside(attributes: str) -> bool:
    """Whether a class, id or role names something beside the article: a whole name, or one made of such words and words of layout alone."""
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role"):
            for name in (m[2] or m[3] or m[4] or "").lower().split():
                parts = {*re.split(r"[_-]+", name)}
                if parts & _ASIDE and parts <= _ASIDE | _LAYOUT:
                    return True
    return False


def _is_link(attributes: str) -> bool:
    """A named place in the page without a target isn't a link."""
    names = {m[1].lower() for m in _ATTRIBUTE.finditer(attributes)}
    return "href" in names or names.isdisjoint(("name", "id"))


class Stack:
    """Open elements. An end tag closes its innermost element and all inside it; one without an element does nothing."""

    def __init__(self):
        self.items: list[tuple[str, object]] = []
        self.open: Counter = Counter()

    def push(self, name: str, what: object) -> None:
        self.items.append((name, what))
        self.open[name] += 1

    def pop(self) -> tuple[str, object]:
        name, what = self.items.pop()
        self.open[name] -= 1
        return name, what

    def close(self, name: str) -> list[object]:
        closed = []
        while self.open[name]:
            inner, what = self.pop()
            closed.append(what)
            if inner == name:
                break
        return closed

    def stays_open(self, name: str) -> bool:
        """p and li are often left open; the next one closes them."""
        return name in ("p", "li") and bool(self.items) and self.items[-1][0] == name


def _bounds(found: list[str | Tag]) -> tuple[set[int], set[int]]:
    """Numbers of the start tags that hold an article or main, and of links that have an end tag.

    An article that stands in another, or is a comment or teaser by its class while others aren't, makes nothing hold it.
    """
    holds, plain, ended, stack, link, any_plain = set(), set(), set(), Stack(), None, False

    def mark(into: set[int]) -> None:
        for _, k in reversed(stack.items):
            if k in into:
                break  # so is all around it
            into.add(k)

    for k, tag in enumerate(found):
        if isinstance(tag, str):
            continue
        if tag.name == "a":
            if tag.end and link is not None:
                ended.add(link)
            link = None if tag.end else k
        if tag.name in _VOID or tag.attributes.endswith("/"):
            continue
        if tag.end:
            stack.close(tag.name)
            continue
        if stack.stays_open(tag.name):
            stack.pop()
        if tag.name == "main" or tag.name == "article" and not stack.open["article"]:
            mark(holds)
            if tag.name == "main" or not _is_aside(tag.attributes):
                mark(plain)
                any_plain = True
        stack.push(tag.name, k)
    return plain if any_plain else holds, ended


def lines(page: str | None) -> list[Line]:
    """The page's blocks in order; all that stands in one menu, footer or the like is one line."""
    out: list[Line] = []
    text: list[str] = []
    linked: list[str] = []
    aside: list[str] = []
    stack, away, inside, kinds = Stack(), 0, 0, Counter()
    link = None  # of the open link: whether it has an end tag, and the number of elements open around it

    def shown(pieces: list[str]) -> str:
        return _SPACE.sub(" ", entities.unescape("".join(pieces))).strip()

    def close() -> None:
        nonlocal text, linked
        if text and (line := shown(text)):
            out.append(Line(line, len(shown(linked)), inside > 0, "heading" if kinds["heading"] else ""))
        text, linked = [], []

    def close_aside() -> None:
        nonlocal aside
        out.append(Line(shown(aside), 0, inside > 0, "", True))
        aside = []

    def drop(closed: list) -> None:
        nonlocal away, inside, link
        for kind in closed:
            kinds[kind] -= 1
        if away and not kinds["away"]:
            close_aside()
        away, inside = kinds["away"], kinds["in"]
        if link is not None and len(stack.items) < link[1]:
            link = None

    found = list(tokens(page or ""))
    holds, ended = _bounds(found)
    for k, tag in enumerate(found):
        if isinstance(tag, str):
            if away:
                aside.append(tag)
                continue
            text.append(tag)
            if link is not None:
                linked.append(tag)
            continue
        if tag.name == "a":
            link = None if tag.end or not _is_link(tag.attributes) else (k in ended, len(stack.items))
        if tag.name not in _INLINE:
            close()
            aside += [" "] * (away > 0)
            if link and not link[0]:
                link = None
        if tag.name in _VOID or tag.attributes.endswith("/"):
            continue
        if tag.end:
            drop(stack.close(tag.name))
            continue
        if stack.stays_open(tag.name):
            drop([stack.pop()[1]])
        kind = "heading" if tag.name in _HEADINGS else ""
        if tag.name in ("article", "main"):
            kind = "in"
        elif (tag.name in _OUTSIDE and not (tag.name == "header" and inside)) or _is_aside(tag.attributes):
            kind = "" if tag.name in ("html", "body") or k in holds else "away"
        if kind == "away":
            close()
        stack.push(tag.name, kind)
        kinds[kind] += 1
        away, inside = kinds["away"], kinds["in"]
    close()
    if away:
        close_aside()
    return out


def _is_linked(line: Line) -> bool:
    return line.linked >= LINKED * len(line.text)


def weights(found: list[Line], marked: bool) -> list[int]:
    """Each line's text length; 0 for what isn't page text and for one of several lines of links in a row.

    Outside a marked article a single line of links weighs nothing either, nor does a short one that is no heading and doesn't end a sentence.
    """
    out, row = [], 0
    for k, line in enumerate(found):
        row = row + 1 if not line.away and line.kind != "heading" and _is_linked(line) else 0
        label = len(line.text) < LABEL and line.kind != "heading" and line.text[-1:] not in ".!?…:;\"”»'"
        out.append(0 if line.away or not marked and (label or _is_linked(line)) else len(line.text))
        if row >= LISTED:
            out[k + 1 - row :] = [0] * row
    return out


def joined(kept: list[tuple[int, int]], found: list[Line]) -> list[tuple[int, int]]:
    """Runs with nothing but short lines of text between them are one."""
    out: list[tuple[int, int]] = []
    for a, b in kept:
        if out and all(not x.away and not _is_linked(x) for x in found[out[-1][1] : a]):
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def runs(weights: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """Where text surges and dives: [first, last) of the lines between sums of nothing over whole windows of lines."""
    ahead = [0]
    for w in weights:
        ahead.append(ahead[-1] + w)
    heavy = [i for i, w in enumerate(weights) if w]
    found, start = [], None
    for i in heavy:
        before = ahead[i] - ahead[max(0, i - window)]
        if start is None or not before:  # a surge: nothing in the window before this line
            start = i
        after = ahead[min(len(weights), i + 1 + window)] - ahead[i + 1]
        if not after:  # a dive: nothing in the window after it
            found.append((start, i + 1))
    return found


def main_text(page: str | None) -> str:
    """The page's article, blocks joined by line ends; empty if there is none.

    Inside article or main the text lies between the first surge and the last dive, all lines of page text included;
    if nothing there surges, all of it is the text. Elsewhere each surge that carries enough weight
    gives its lines, those of no weight included.
    """
    found = lines(page)
    marked = [x for x in found if x.inside]
    if any(not x.away for x in marked):
        kept = runs(weights(marked, True))
        parts = [(kept[0][0], kept[-1][1])] if kept else [(0, len(marked))]
        found = marked
    else:
        weighed = weights(found, False)
        if not any(weighed):  # a page of nothing but short lines: these are its text
            weighed = [0 if x.away or _is_linked(x) else len(x.text) for x in found]
        kept = joined(runs(weighed), found)
        size = [sum(weighed[a:b]) for a, b in kept]
        parts = [r for r, n in zip(kept, size) if n >= PART * max(size)]
    return "\n".join(found[i].text for a, b in parts for i in range(a, b) if not found[i].away)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Replace ``html`` by its main text: ``page_id, url, text, n_chars`` (code points), a row for each page.

    Null and empty pages, and pages without text, give the empty string. Every page is read whole, in
    time that grows with its length.
    """
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(t.as_py()) for t in batch.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], names=["page_id", "url", "text"])

    out = pages.select("page_id", "url", "html").mapInArrow(run, f"{kinds}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
