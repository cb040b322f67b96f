"""Main text of web pages by two-pass block rules.

A page becomes blocks of text.  Pass one decides the clear ones: blocks inside navigation, headers, footers, sidebars, forms,
adverts, notices or reader comments (by element, role, class or id) and blocks made of links are boilerplate; long blocks with
many stop words, and long blocks of the article element, are text.  Pass two: short blocks left over take the label of
the nearest decided neighbour of their region.  Class names and ids are evidence only: if nothing is left with them, they
mark what holds the text itself, and the page is decided without them.

Defined results: null or empty html gives an empty text; unclosed or stray tags never raise; every page is judged by itself and whole.
Of the elements whose content is never text, one that closes itself or has no end tag takes only its tag out of the page (a
script or style: all that follows); an option ends where the next tag begins.  The scan is linear in the page's length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import tidy

#: Elements whose content is never text, and those of them that go on to the end of the page if they aren't closed.
DROPPED = frozenset("script style noscript template textarea select datalist svg math iframe object canvas audio video button title".split())
ENDLESS = frozenset(("script", "style"))
TOKEN = re.compile(
    r"<!--|<option\b[^>]*>[^<]*|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in DROPPED}
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that hold blocks; others (p, h1, li, td and the like) are blocks themselves.
HOLDERS = frozenset("article aside body dialog div dl fieldset figure footer form header html head main menu nav ol section table tbody ul".split())
BOILERPLATE = frozenset("aside dialog footer form head menu nav".split())
ARTICLE = frozenset(("article", "main"))
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Parts of class names and ids that mark boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer gdpr header legal masthead menu menus modal nav navbar navigation newsletter notice notices"
    " pager pagination popup promo promotion related respond rail search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Frequent short words of the languages at hand.
STOP = frozenset(
    (
        "the of and to in a is that it for on was be with as by this are or an from at not have has but they which you we he she his her their its were will would can all there been if more when who so no out up about into than them"
        " der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man"
        " de la le et les des en un une du que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son elle aux mais comme nous cette ont ses leur fait été"
        " el que y los se del las por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde"
    ).split()
)
TEXT, JUNK, OPEN = 1, 0, -1


#: What marks boilerplate: nothing, a name, an element or role.
CLEAR, NAMED, SURE = 0, 1, 2


def _flagged(tag: str, attributes: str, inside_article: bool) -> int:
    if tag in BOILERPLATE or tag == "header" and not inside_article:
        return SURE
    found = CLEAR
    for m in NAMES.finditer(attributes):
        value = (m[1] or m[2] or m[3] or "").lower()
        if m[0][:4].lower() == "role":
            if value.strip() in ROLES:
                return SURE
        elif any(part in MARKS for part in re.split(r"[^a-z]+", value)):
            found = NAMED
    return found


def _tags(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """The text before each tag, then the tag's name ("" for what is dropped or no element), whether it is an end tag, and its attributes; at last the text that is left."""
    last, at, unclosed = page.rfind(">") + 1, 0, set()
    while m := TOKEN.search(page, at, last):
        before, at = page[at : m.start()], m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0] == "<!--":
                end = page.find("-->", at)
                at = end + 3 if end >= 0 else len(page)
            yield before, "", False, ""
            continue
        ending, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name not in DROPPED:
            yield before, name, ending, attributes
            continue
        if not ending and name not in unclosed and not attributes.endswith("/"):
            end = ENDS[name].search(page, at)
            if end:
                at = end.end()
            elif name in ENDLESS:
                at = len(page)
            else:
                unclosed.add(name)  # looked for once only
        yield before + " ", "", False, ""
        if at > last:
            break
    rest = page[at:]
    opened = rest.find("<!--")
    yield rest if opened < 0 else rest[:opened], "", False, ""


class _Block:
    __slots__ = ("text", "linked", "mark", "junk", "article", "listed", "heading")

    def __init__(self, text: str, linked: int, mark: int, article: int, listed: bool, heading: bool):
        self.text, self.linked, self.mark, self.junk, self.article, self.listed, self.heading = text, linked, mark, mark > CLEAR, article, listed, heading


def blocks(page: str) -> list[_Block]:
    """The page's text blocks in order, with what surrounds them."""
    out: list[_Block] = []
    stack: list[tuple[str, int, int]] = []  # holder, mark of boilerplate, number of the article around or 0
    parts: list[str] = []
    linked, depth, leaf_mark, heading, listed, articles = 0, 0, CLEAR, False, False, 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(raw)
            if depth:
                linked += len(raw.strip())

    def close() -> None:
        nonlocal linked
        raw = "".join(parts)
        parts.clear()
        text = " ".join(html.unescape(raw).split())
        if text:
            _, mark, article = stack[-1] if stack else ("", CLEAR, 0)
            out.append(_Block(text, min(linked, len(text)), max(mark, leaf_mark), article, listed, heading))
        linked = 0

    for before, tag, ending, attributes in _tags(page):
        add(before)
        if not tag:
            continue
        if tag == "a":
            depth = 0 if ending else 1
        elif tag == "br":
            add(" ")
        elif tag not in INLINE:
            close()
            leaf_mark, heading, depth = CLEAR, False, 0
            if tag in HOLDERS:
                if tag == "body" and not ending:
                    stack.clear()
                if ending:
                    names = [s[0] for s in stack]
                    if tag in names:
                        del stack[len(names) - 1 - names[::-1].index(tag) :]
                else:
                    _, mark, article = stack[-1] if stack else ("", CLEAR, 0)
                    if tag in ARTICLE and not article:
                        articles += 1
                        article = articles
                    own = tag != "html" and tag != "body" and (tag not in ARTICLE or bool(article))
                    stack.append((tag, max(mark, _flagged(tag, attributes, bool(article)) if own else CLEAR), article))
                listed = any(s[0] in ("ul", "ol", "dl") for s in stack)
            elif not ending:
                leaf_mark = _flagged(tag, attributes, True) if attributes else CLEAR
                heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    close()
    return out


def decide(found: list[_Block], long: int = 70, dense: float = 0.2) -> list[bool]:
    """Both passes: which blocks are text."""
    has_article = any(b.article and not b.junk for b in found)
    label = []
    for b in found:
        words = b.text.lower().split()
        stop = sum(w.strip(".,;:!?\"'()") in STOP for w in words) / len(words)
        if b.junk or has_article and not b.article:
            label.append(JUNK)
        elif b.linked > 0.5 * len(b.text) and (b.listed or not b.article):
            label.append(JUNK)
        elif len(b.text) >= long and (stop >= dense or b.article):
            label.append(TEXT)
        elif len(b.text) >= long:
            label.append(JUNK)
        else:
            label.append(OPEN)
    final = list(label)
    for i, b in enumerate(found):
        if label[i] != OPEN:
            continue
        near = []
        for step in (1,) if b.heading else (-1, 1):  # a heading goes with what follows
            k = i + step
            while 0 <= k < len(found) and found[k].article == b.article and (label[k] == OPEN or b.article and found[k].junk):
                k += step
            if 0 <= k < len(found) and found[k].article == b.article:
                near.append((abs(k - i), label[k]))
        if not near:
            final[i] = TEXT if b.article else JUNK
        else:
            closest = min(n for n, _ in near)
            votes = {v for n, v in near if n == closest}
            final[i] = votes.pop() if len(votes) == 1 else (TEXT if b.article else JUNK)
    return [f == TEXT for f in final]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    kept = decide(found)
    if not any(kept) and any(b.mark == NAMED for b in found):
        for b in found:
            b.junk = b.mark == SURE
        kept = decide(found)
    return "\n\n".join(b.text for b, keep in zip(found, kept, strict=True) if keep)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(tidy(run), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
