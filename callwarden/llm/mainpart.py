"""Main text of web pages by block rules in two passes.

A page is cut at block-level tags. The first pass decides blocks by link density, stop-word density and length; short blocks, headings and
wordy blocks without stop words stay open. The second pass gives open blocks the label of their nearest decided neighbours. Neighbours
are looked for inside one zone: the blocks of one article (whose borders count as text), or the rest of the page (whose borders count as
boilerplate). Blocks in navigation, forms, comments and the like are boilerplate in both passes.
"""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwarden.llm.common import slices

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset("""
a about after all also an and any are as at be been but by can could did do does for from had has have he her him his how i if in into is it its
just like me more my no not of on one only or other our out over she so some such than that the their them then there these they this to up us was
we were what when where which who will with would you your
aber als am an auch auf aus bei bin bis das dass dem den der des die doch ein eine einem einen einer er es für hat ich ihr im in ist ja kann mit nach
nicht noch nur oder schon sein sich sie sind so über um und uns von vor war was weil wenn wer wie wir wird zu zum zur
au aux avec ce ces cette dans de des donc du elle elles en est et eux il ils je la le les leur lui mais me même mes moi ne nos notre nous on ou où par
pas pour plus qu que qui sa sans ses si son sont sur ta te tu un une vos votre vous y
al como con cuando del desde donde dos e el ella ellos era es esta está este fue ha hay la las le lo los más mi muy ni no nos o para pero por porque
que quien se ser si sin sobre son su sus también te tiene todo un una uno y ya yo
""".split())

LINKED = 0.33
SHORT = 8
STOPPED = 0.2

#: HTML elements by their part in a page.
_BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td
template textarea tfoot th thead title tr ul""".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_RAW = frozenset("script style noscript template iframe svg math object canvas audio video textarea select head title noframes xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSED_BY_NEXT = frozenset("dd dt li option td th tr".split())
_APART = frozenset("nav aside footer form button dialog menu fieldset".split())
#: Words of class, id and role that name parts beside the article.
_BESIDE = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies copyright footer gdpr header
masthead menu menus modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related recommended
share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets complementary contentinfo search""".split())
_READERS = frozenset("comment comments commentlist disqus replies reply respond".split())

PLAIN, ARTICLE, BESIDE, APART = range(4)
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_HINT = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HINT_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


class Block(NamedTuple):
    text: str
    words: int
    stopped: float
    linked: float
    heading: bool
    zone: int
    kind: int


class _Zones:
    """Open elements that decide where a block belongs; closing tags without an opening one are ignored."""

    def __init__(self):
        self.open, self.count, self.made = [("", PLAIN, 0)], {}, 0

    @property
    def now(self) -> tuple[str, int, int]:
        return self.open[-1]

    def enter(self, name: str, attributes: str) -> None:
        _, kind, zone = self.now
        hints = set()
        if attributes and name not in ("html", "body"):
            for value in _HINT.findall(attributes):
                hints.update(w.lower() for w in _HINT_WORD.findall(value))
        if kind != APART:
            if name in _APART or hints & _READERS:
                kind = APART
            elif name in ("article", "main"):
                self.made += 1
                kind, zone = ARTICLE, self.made
            elif name == "header" and kind == PLAIN or hints & _BESIDE and not (kind == ARTICLE and hints & _BESIDE <= {"header"}):
                kind = BESIDE
        self.open.append((name, kind, zone))
        self.count[name] = self.count.get(name, 0) + 1

    def leave(self, name: str) -> None:
        if self.count.get(name):
            while True:
                closed = self.open.pop()[0]
                self.count[closed] -= 1
                if closed == name:
                    return


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order, with character references decoded and white space made one space. Reads the page once."""
    zones, out = _Zones(), []
    pieces, links, in_link, heading = [], [], 0, False
    end, gone = len(page), {}

    def find(what: str, at: int) -> int:
        """``page.find`` that looks for what is not there only once."""
        if what in gone:
            return -1
        found = page.find(what, at)
        if found < 0:
            gone[what] = True
        return found

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        if text:
            words = text.split(" ")
            stopped = sum(_EDGE.sub("", w).lower() in STOP_WORDS for w in words) / len(words)
            linked = sum(len("".join(part.split())) for part in links) / len(text.replace(" ", ""))
            _, kind, zone = zones.now
            out.append(Block(text, len(words), stopped, linked, heading, zone, kind))
        pieces.clear()
        links.clear()

    def say(raw: str) -> None:
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if in_link:
                links.append(text)

    at = 0
    while at < end:
        tag = page.find("<", at)
        if tag < 0:
            say(page[at:])
            break
        say(page[at:tag])
        after = page[tag + 1:tag + 2]
        if page.startswith("<!--", tag):
            close = find("-->", tag + 4)
            at = end if close < 0 else close + 3
            continue
        closing = after == "/"
        name = _NAME.match(page, tag + 1 + closing)
        if not name:
            if after in ("!", "?", "/"):
                close = find(">", tag)
                at = end if close < 0 else close + 1
            else:
                say("<")
                at = tag + 1
            continue
        stop = find(">", name.end())
        if stop < 0:
            break
        quote = _open_quote(page, name.end(), stop)
        while quote:
            shut = find(quote, stop)
            further = find(">", shut) if shut >= 0 else -1
            if further < 0:
                break
            stop, quote = further, _open_quote(page, shut + 1, further)
        at = stop + 1
        element, attributes = name.group().lower(), page[name.end():stop]
        if not closing and element in _RAW:
            if element not in ("noscript", "svg", "math", "object", "canvas", "audio", "video"):
                flush()
            if not attributes.endswith("/"):
                shut = None if f"</{element}" in gone else re.compile(f"</{element}(?=[\\s/>])", re.I).search(page, at)
                if shut is None:
                    gone[f"</{element}"] = True
                    at = at if element in ("head", "noscript", "object") else end
                else:
                    close = find(">", shut.end())
                    at = end if close < 0 else close + 1
            continue
        if element == "a":
            in_link = 0 if closing else 1
        elif element in ("br", "wbr") or element not in _BLOCKS:
            if element == "br":
                say(" ")
            continue
        else:
            flush()
            in_link = 0
            if element in _HEADINGS:
                heading = not closing
            elif element in _VOID:
                continue
            if closing:
                zones.leave(element)
                continue
            if (open_name := zones.now[0]) == "p" or open_name == element and element in _CLOSED_BY_NEXT:
                zones.leave(open_name)
            zones.enter(element, attributes)
    flush()
    return out


def _open_quote(page: str, start: int, stop: int) -> str:
    """The quote character of an attribute value that is still open at ``stop``, or nothing."""
    at = start
    while True:
        at = page.find("=", at, stop)
        if at < 0:
            return ""
        at += 1
        while at < stop and page[at].isspace():
            at += 1
        if at < stop and page[at] in "\"'":
            shut = page.find(page[at], at + 1, stop)
            if shut < 0:
                return page[at]
            at = shut + 1


def decide(found: list[Block]) -> list[bool]:
    """For each block whether it is main text."""
    zones: dict[int, list[int]] = {}
    labels: list[bool | None] = []
    for i, b in enumerate(found):
        label = None
        if b.kind >= BESIDE:
            label = False
        else:
            zones.setdefault(b.zone, []).append(i)
            if b.linked > LINKED:
                label = False
            elif b.words >= SHORT and not b.heading:
                label = True if b.stopped >= STOPPED else None if b.kind == ARTICLE else False
        labels.append(label)
    out = [bool(label) for label in labels]
    for members in zones.values():
        inside = found[members[0]].kind == ARTICLE
        before, distance = [], [(inside, 0)] * len(members)
        last = (inside, 0)
        for at, i in enumerate(members):
            before.append(last)
            if labels[i] is not None:
                last = (labels[i], at + 1)
        last = (inside, len(members) + 1)
        for at in range(len(members) - 1, -1, -1):
            i = members[at]
            if labels[i] is not None:
                last = (labels[i], at + 1)
                continue
            (left, l), (right, r) = before[at], last
            to_left, to_right = at + 1 - l, r - at - 1
            if left == right:
                out[i] = left
            elif found[i].heading:
                out[i] = right
            else:
                out[i] = left if to_left < to_right else right if to_right < to_left else inside
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, kept in zip(found, decide(found)) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of every page, block by block, joined by blank lines.

    Null, empty and text-free pages give an empty text. Repeated rows are extracted each; nothing is compared between pages, so there is
    no shuffle and no tie. Broken markup: an unclosed script or comment hides the rest of the page, a closing tag without its opening one
    is ignored, ``<`` before anything but a name is text. Texts have no length limit; other columns are not read.
    """

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 2, rows=200):
                texts = [main_text(v) for v in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long")
