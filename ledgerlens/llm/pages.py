"""Main text of web pages by two passes over their blocks.

A page is read as a stream of tags and text. Block elements end blocks; white space in a block
becomes one space. Scripts, styles and form controls are skipped. Only an element whose content is no
markup (script, style, textarea, title) reaches to the end of the page without its closing tag; others
end with the element around them or, if no closing tag of theirs follows, at the next block border.

The first pass decides what a block's own figures decide. Blocks inside navigation, footers, side
bars, forms, notices, adverts or comments (by element, role, class or id) are boilerplate. Length,
link density and the density of stop words are taken of every other block: blocks made of links are
boilerplate, long ones with many stop words are text, wherever they stand. Short blocks without a
decision stay open; in the second pass they inherit the label of the nearest decided neighbours, the
nearer one where those differ, the following one on equal distance for headings and the preceding one
for others. Open blocks of a page without decided blocks are text.

A form, or a name in class, id or role, does not make an element boilerplate that holds most of the
page's text: of what stop words find and of all that links do not rule out; comments must hold all
that stop words find, and beside an article or main part elsewhere that must be long. An article, main or articleBody inside ends the mark of a form or name around it
where it holds most of the text itself, or the page has no text found by stop words and no mark elsewhere.
Hidden elements and navigation, footers, asides, menus and dialogs by their element always count.

An article, main or articleBody element is a sign besides. The region of a page is the smallest such
element that holds most of the text found by stop words (for an articleBody the article around it);
without one, all articles or all main parts where these do together, or hold most of all text that
links do not rule out. Undecided blocks inside the region are
text. Those outside are boilerplate, but for what stands between a first heading (h1) and a region
without one, and what lies nearer to a block of text outside than to the region. Without a region no
mark counts.

Null and empty pages give an empty text, pages without markup their text. Markup cut off at the end
is read as far as it goes. Repeated rows are pages of their own.
"""

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by their role in a page.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title iframe noframes".split())
SKIPPED = frozenset("noscript template svg math object applet canvas audio video select button datalist".split())
NESTED = frozenset("svg math object template".split())
VOID = frozenset("area base br col hr img input link meta param source track wbr embed".split())
OUTSIDE = frozenset("nav footer aside menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
SAME_CLOSES = frozenset("li dd dt td th tr option".split())
#: Words of class, id and role that mark what is not the article.
ALWAYS_OUT = frozenset("ad ads advert adverts advertisement advertising promo promoted sponsor sponsored cookie cookies consent gdpr comment comments reply replies disqus respond sidebar breadcrumb breadcrumbs pagination pager newsletter subscribe subscription signup login popup modal overlay share sharing social related recommended recommendations widget widgets navbar navigation complementary contentinfo banner search".split())
OFTEN_OUT = frozenset("nav menu header footer foot masthead topbar toolbar notice notices alert disclaimer copyright legal tags meta byline aside skip links dialog".split())
TEXT_WORDS = frozenset("content main article post entry story text body".split())
COMMENTS = frozenset("comment comments reply replies disqus respond".split())
#: Frequent words of the languages read most.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so what up its about into than them can only other"
    " der die das und ist von zu den mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man sein im in"
    " le la les de des du et un une est que qui dans en pour pas au sur ce il se ne par plus avec son sa ses aux ou mais nous vous elle ils sont cette été leur comme tout être"
    " el los las una que y en del se por con para su al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante uno ni contra otros".split()
)

SHORT, LONG = 70, 200
LINKED, LOOSE = 0.5, 0.2
STOP_LOW, STOP_HIGH = 0.15, 0.3

LOWER = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|$)")
OTHER = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?/][^>]*+(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
WORD = re.compile(r"[^\W\d_]+")


def _marks(tag: str, attributes: str) -> tuple[bool, int, int]:
    """Whether an element is surely no part of an article; by form or name perhaps none (1; comments 2); is one (2) or a main part (1)."""
    level = 2 if tag == "article" else 1 if tag == "main" else 0
    if not attributes:
        return tag in OUTSIDE, int(tag == "form"), level
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    names = {w.lower() for k in ("class", "id", "role") for w in NAME.findall(found.get(k, ""))}
    if found.get("itemprop") == "articleBody":
        level = 2
    elif found.get("role") in ("main", "article"):
        level = max(level, 1 if found["role"] == "main" else 2)
    hidden = found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "") or re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", ATTRIBUTE.sub(" ", attributes))
    if tag in ("body", "html") or level == 2:
        return False, 0, level
    named = bool(names & ALWAYS_OUT) or bool(names & OFTEN_OUT and not names & TEXT_WORDS)
    return tag in OUTSIDE or bool(hidden), 2 if names & COMMENTS else int(named or tag == "form"), level


class Element:
    """An element marked as an article (level 2) or main part (1), or perhaps boilerplate (doubt 1; comments 2).

    ``up`` is the marked element around it; ``levels`` has a bit for each level and ``doubted`` says whether there is a doubt, in it
    or around it. ``good`` counts characters found by stop words in it, ``plain`` those not ruled out.
    """

    __slots__ = ("tag", "doubt", "level", "up", "depth", "levels", "doubted", "good", "plain", "out", "chosen")

    def __init__(self, tag: str, doubt: int, level: int, up: "Element | None"):
        self.tag, self.doubt, self.level, self.up = tag, doubt, level, up
        self.depth = up.depth + 1 if up else 0
        self.levels = (1 << level if level else 0) | (up.levels if up else 0)
        self.doubted = bool(doubt) or (up is not None and up.doubted)
        self.good = self.plain = 0
        self.out = self.chosen = False


class Block:
    """Text between block borders; ``around`` is the innermost marked element around it; label: 1 text, 0 boilerplate, None open."""

    __slots__ = ("text", "linked", "out", "around", "heading", "label")

    def __init__(self, text: str, linked: int, out: bool, around: Element | None, heading: str):
        self.text, self.linked, self.out, self.around, self.heading, self.label = text, linked, out, around, heading, None

    def judge(self) -> int | None:
        """What links, length and stop words say."""
        density = self.linked / len(self.text)
        if density > LINKED or ("©" in self.text and len(self.text) < LONG):
            return 0
        if len(self.text) >= SHORT:
            words = WORD.findall(self.text.lower())
            stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
            if stops >= STOP_HIGH or (stops >= STOP_LOW and len(self.text) >= LONG):
                return 1
            if stops < STOP_LOW and density > LOOSE:
                return 0
        return None


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order."""
    found: list[Block] = []
    stack: list[tuple[str, bool, Element | None]] = []  # element, boilerplate, innermost marked element
    standing: dict[str, int] = {}  # how many of an element are in the stack
    parts: list[str] = []
    linked = anchors = 0
    muted: int | None = None  # the place in the stack of a skipped element
    foreign = 0  # foreignObject elements around it
    loose = False  # in a skipped element without a closing tag
    closings: dict[str, int] = {}
    low = ""

    def push(tag: str, out: bool, around: Element | None) -> None:
        stack.append((tag, out, around))
        standing[tag] = standing.get(tag, 0) + 1

    def cut(place: int) -> None:
        """Take out the elements of the stack from a place."""
        while len(stack) > place:
            standing[stack.pop()[0]] -= 1

    def place_of(tag: str) -> int:
        """The place of the innermost open element of a name, -1 without one; what is inside it is then cut, so all looks take linear time."""
        return next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag) if standing.get(tag) else -1

    def unclosed(tag: str, at: int) -> bool:
        """Whether no closing tag of a skipped element follows (before the next of its kind opens)."""
        nonlocal low
        if tag not in closings:
            low = low or page.translate(LOWER)
            closings[tag] = low.rfind(f"</{tag}")
        if closings[tag] < at:
            return True
        if tag in NESTED:
            return False
        following = re.compile(rf"<(/?){tag}(?![^\s/>])", re.I).search(page, at)
        return following is None or not following[1]

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                around = stack[-1][2] if stack else None
                heading = next((s[0] for s in stack[-3:] if s[0] in HEADINGS), "")
                found.append(Block(text, min(linked, len(text)), bool(stack and stack[-1][1]), around, heading))
            parts.clear()
        linked = 0

    at, size = 0, len(page)
    while at < size:
        opening = page.find("<", at)
        if opening != at:
            run = page[at : opening if opening >= 0 else size]
            if muted is None and not loose:
                parts.append(run)
                if anchors:
                    linked += len(run.strip())
            if opening < 0:
                break
            at = opening
        m = TAG.match(page, at)
        if m is None:
            m = OTHER.match(page, at)
            if m is None:  # a lone sign
                if muted is None and not loose:
                    parts.append("&lt;")
                at += 1
            else:
                if m[0].startswith("<![CDATA[") and muted is None and not loose:
                    parts.append(html.escape(m[0][9:].removesuffix("]]>")))
                at = m.end()
            continue
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        tag = tag.lower()
        if tag in RAW and not closing:
            if not attributes.endswith("/"):
                over = re.compile(rf"</{re.escape(tag)}\s*+>?", re.I).search(page, at)
                at = over.end() if over else size
            continue
        if muted is not None:  # only what is skipped inside it, its own end or that of an element around it count
            if closing:
                place = place_of(tag)
                if place >= muted:
                    cut(place)
                    if place == muted:
                        muted = None
                    continue
                if place < 0:
                    continue
                cut(muted)
                muted = None
            elif tag in BLOCKS and stack[muted][0] in ("svg", "math") and standing.get("foreignobject", 0) == foreign:
                cut(muted)  # neither has such elements: it lacks its end
                muted = None
            else:
                if tag not in VOID and not attributes.endswith("/"):
                    push(tag, *stack[-1][1:])
                continue
        elif tag in SKIPPED and not closing:
            if not attributes.endswith("/"):
                if unclosed(tag, at):
                    loose = True
                else:
                    muted, foreign = len(stack), standing.get("foreignobject", 0)
                    push(tag, *(stack[-1][1:] if stack else (False, None)))
            continue
        if tag == "br":
            loose = False
            parts.append(" ")
            continue
        block = tag in BLOCKS
        loose = loose and not block
        if block:
            end()
        if tag == "a":
            anchors = 0 if closing else 1
        if closing:
            place = place_of(tag)
            if place >= 0:
                if not block:
                    end()
                cut(place)
                if block:
                    anchors = 0
        elif tag not in VOID and not attributes.endswith("/"):
            if block and stack and (stack[-1][0] in CLOSED_BY_BLOCK or (tag in SAME_CLOSES and stack[-1][0] == tag)):
                cut(len(stack) - 1)
            out, doubt, level = _marks(tag, attributes)
            _, outside, above = stack[-1] if stack else ("", False, None)
            if tag == "header" and not (above and above.levels):
                out = True
            if block or out or doubt or level:
                if not block:
                    end()
                push(tag, out or outside, Element(tag, doubt, level, above) if doubt or level else above)
    end()
    return found


def _elements(found: list[Block]) -> list[Element]:
    """The marked elements around blocks, outer ones before those inside them."""
    seen: dict[Element, None] = {}
    for b in found:
        e = b.around
        while e is not None and e not in seen:
            seen[e] = None
            e = e.up
    return sorted(seen, key=lambda e: e.depth)


def _measure(found: list[Block]) -> tuple[int, int, list[Element]]:
    """Counts good and plain of elements, from the inner ones to those around them; those of the page, and the elements."""
    elements = _elements(found)
    for e in elements:
        e.good = e.plain = 0
    good = plain = 0
    for b in found:
        if b.label != 0:
            size, sure = len(b.text), len(b.text) if b.label else 0
            good, plain = good + sure, plain + size
            if b.around:
                b.around.good, b.around.plain = b.around.good + sure, b.around.plain + size
    for e in reversed(elements):
        if e.up:
            e.up.good, e.up.plain = e.up.good + e.good, e.up.plain + e.plain
    return good, plain, elements


def _settle(found: list[Block]) -> None:
    """Blocks in what forms or names make boilerplate are out, unless most of the text stands there."""
    inside = [b for b in found if not b.out]
    clear = [b for b in inside if not (b.around and b.around.doubted)]
    if len(clear) == len(inside):
        return
    good, plain, elements = _measure(inside)
    marked = any(b.around and b.around.levels for b in clear)
    free = marked or any(b.label for b in clear)
    for e in elements:
        e.out = e.up is not None and e.up.out
        most = (2 * e.good > good or not good) and 2 * e.plain > plain
        if e.doubt and not (e.level and most):
            e.out = e.out or not most or (marked and e.good < LONG) or (e.doubt == 2 and e.good < good)
        elif e.level and (most or not free):
            e.out = False
    for b in inside:
        if b.around and b.around.out:
            b.out, b.label = True, 0


def _region(found: list[Block]) -> set[Element]:
    """The marked elements that hold the article, if any do."""
    inside = [b for b in found if not b.out]
    good, plain, elements = _measure(inside)
    marked = [e for e in elements if e.level]
    most = [e for e in marked if 2 * e.good > good]
    if most:
        least = around = most[-1]  # those that hold most lie inside each other
        if least.level == 2 and least.tag != "article":
            around = least.up
            while around is not None and around.level != 2:
                around = around.up
        return {around or least}
    for total, sure in ((good, True), (plain, False)):
        for level in (2, 1):
            within = [b for b in inside if b.around and b.around.levels & 1 << level]
            held = sum(len(b.text) for b in within if (b.label if sure else b.label != 0))
            if within and 2 * held > total:
                return {e for e in marked if e.level == level}
    highest = max((e.level for e in marked), default=0)
    return set() if good else {e for e in marked if e.level == highest}


def _unlisted(found: list[Block]) -> bool:
    """Whether the long blocks that are no lists of links hold few stop words of any list: another language, or code."""
    words = [w for b in found if not b.out and len(b.text) >= LONG and b.linked <= LOOSE * len(b.text) for w in WORD.findall(b.text.lower())]
    return sum(w in STOP_WORDS for w in words) < STOP_LOW * len(words) or not words


def label(found: list[Block]) -> None:
    """Both passes, in place."""
    for b in found:
        b.label = 0 if b.out else b.judge()
    if _unlisted(found):  # stop words say nothing here: length and links alone decide long blocks
        for b in found:
            if not b.out and b.label is None and len(b.text) >= LONG and b.linked <= LOOSE * len(b.text):
                b.label = 1
    _settle(found)
    region = _region(found)
    if region:
        for e in _elements(found):
            e.chosen = e in region or (e.up is not None and e.up.chosen)
        within = [not b.out and b.around is not None and b.around.chosen for b in found]
        for b, w in zip(found, within, strict=True):
            if w and (b.linked <= LINKED * len(b.text) or len(b.text) >= LONG):
                b.label = 1 if len(b.text) >= SHORT or b.heading or not b.linked else None
        first = within.index(True)
        if not any(w and b.heading == "h1" for b, w in zip(found, within, strict=True)):
            start = next((i for i in range(first) if found[i].heading == "h1" and found[i].label is None), first)
            for b in found[start:first]:
                b.label = 1 if b.label is None else b.label
        # outside, the region itself is no neighbour that makes text
        outer = [0 if w else b.label for b, w in zip(found, within, strict=True)]
        _inherit(found, outer, [b.label is None and not w for b, w in zip(found, within, strict=True)])
    _inherit(found, [b.label for b in found], [b.label is None for b in found])


def _inherit(found: list[Block], decided: list[int | None], open_: list[bool]) -> None:
    """Open blocks take the label of the nearest decided ones."""
    before, after = _nearest(decided), _nearest(decided[::-1])[::-1]
    for b, o, (d, x), (e, y) in zip(found, open_, before, after, strict=True):
        if o:
            if x is None or y is None:
                b.label = 1 if x is None and y is None else y if x is None else x
            else:
                b.label = x if x == y or d < e or (d == e and not b.heading) else y


def _nearest(labels: list) -> list[tuple[int, int | None]]:
    """For each place the distance to the last decided label before it, and that label."""
    out, distance, last = [], 0, None
    for value in labels:
        distance += 1
        out.append((distance, last))
        if value is not None:
            distance, last = 0, value
    return out


def main_text(page: str | None) -> str:
    """The article of a page, blocks joined by an empty line."""
    found = blocks(page or "")
    label(found)
    return "\n\n".join(b.text for b in found if b.label)


def extract(pages: DataFrame, keep: list[str], markup: str = "html") -> DataFrame:
    """``keep``, text and n_chars (code points) of every page."""
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t.as_py()) for t in batch.column(len(keep))]
            arrays = [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "text", "n_chars"])

    return pages.select(*keep, F.col(markup).cast("string").alias("__markup")).mapInArrow(run, schema)
