"""Main text of web pages by line-block distribution.

Markup becomes lines: the text of each block element is a line, boilerplate elements and the edges of article and main
leave gaps of empty lines, lines of links in a row have no length. Line lengths are summed over a sliding window; text surges where the sum rises over a threshold and dives where it falls to
nothing, and the lines in between are kept. In article and main any text is a surge and outside it takes OUTSIDE times as
much, unless more text surges outside than stands inside: then the tag counts for nothing. On pages without such tags the box
(a div, say) that holds several lines and most of the surging text takes their place.
"""

from __future__ import annotations

import html
import itertools
import re
from bisect import bisect_right
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from nilas.llm import text as t

#: Lines in a window, empty lines for a boilerplate element, and the share of the largest window sum that counts as a surge; characters that always do.
WINDOW, GAP, SURGE, ENOUGH = 3, 3, 0.2, 120
#: The sum that is a surge outside article and main where these hold the main text; the share of a line in links that makes it one of links.
OUTSIDE, LINKS = 240, 0.8

#: Elements whose content is no text: those that leave nothing, those that stand like a word, and those that reach to the end of the page if nothing closes them.
HIDDEN = frozenset("script style noscript template title".split())
EMBEDDED = frozenset("svg math iframe object canvas audio video select textarea".split())
TO_THE_END = frozenset("script style".split())
# A quote counts only right after =, as browsers have it. Possessive, so each attempt is linear.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in HIDDEN | EMBEDDED}
NAMED = re.compile(r"""(?<![\w-])(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav header footer aside form menu button fieldset dialog".split())
#: Whole class names (and roles and labels) of what isn't the article, with - for _ and capitals.
ADS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper banner-ad google-ad adsbygoogle sponsored-content".split())
PLACES = frozenset(
    "nav navbar nav-bar navigation main-nav main-navigation site-nav site-navigation primary-nav top-nav nav-menu nav-links post-navigation menu main-menu menu-bar breadcrumb breadcrumbs header site-header masthead footer site-footer page-footer post-footer sidebar side-bar sidebar-left sidebar-right left-sidebar right-sidebar primary-sidebar comments comment-list comment-form comments-area comments-section commentlist disqus disqus-thread cookie-banner cookie-bar cookie-consent cookie-notice gdpr-banner skip-link skip-links pagination pager toolbar newsletter newsletter-signup".split()
)
NAMES = ADS | PLACES | frozenset(
    "banner aside complementary contentinfo cookie cookies consent gdpr notice notices notification alert popup modal overlay subscribe signup sign-up login login-form form search search-box search-form share sharing share-bar share-buttons share-links social social-links social-media social-share comment replies responses related related-articles related-links related-posts recommended recommendations widget widget-area skip copyright legal disclaimer tags tag-list tag-cloud".split()
)
#: Ids stand on sections and headings as anchors, so only those of parts of a site count.
IDS = ADS | PLACES
#: Of these names, those that sections of an article may bear too.
TOPICS = frozenset("legal copyright disclaimer".split())
NAMES_INSIDE = NAMES - TOPICS
#: Boilerplate elements that some pages put round everything.
ROUND = frozenset("form fieldset dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags of a header in an article among which a heading is looked for.
HEAD = 64
#: An article counts if it has these shares of the longest article and of the page's text.
OF_LONGEST, OF_PAGE = 0.25, 0.1
#: Elements whose lines belong together.
BOXES = frozenset("div section article main td center".split())
_CAPITAL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Lists, which are menus where their lines are short and mostly links, and what a short line has at most on average.
LISTS, SHORT = frozenset("ul ol dl menu".split()), 40
#: Elements that end where the next block begins if they aren't closed.
LOOSE = frozenset("p li dt dd td th tr option".split())


class Tag(NamedTuple):
    start: int
    end: int  # behind its content too, if that is no text
    close: bool
    name: str  # "!" for what has no part in the structure
    attributes: str
    gap: str  # what stands for it in a line


def scan(page: str) -> list[Tag]:
    """The tags of a page, in time linear in its length: a search that finds nothing is not made again further on."""
    out, at, last, absent, tag = [], 0, page.rfind(">"), set(), TAG
    while 0 <= (at := page.find("<", at)):
        if at > last:  # a tag that nothing ends
            if page[at + 1 : at + 2].isalpha() or page[at + 1 : at + 2] in ("/", "!", "?"):
                out.append(Tag(at, len(page), True, "!", "", ""))
            break
        if page[at + 1 : at + 2] in ("!", "?"):
            mark, size = ("-->", 3) if page.startswith("<!--", at) else ("]]>", 3) if page.startswith("<![CDATA[", at) else (">", 1)
            end = -1 if mark in absent else page.find(mark, at + 2)
            if end < 0 and mark != "-->":
                absent.add(mark)
                end, size = page.find(">", at), 1
            end = len(page) if end < 0 else end + size
            out.append(Tag(at, end, True, "!", "", ""))
            at = end
            continue
        m = tag.match(page, at)
        if not m and tag is TAG and PLAIN.match(page, at):  # quotes that hide every later >
            tag = PLAIN
            m = tag.match(page, at)
        if not m:
            at += 1
            continue
        name, end = m[2].lower(), m.end()
        if name not in CLOSING or m[1]:
            out.append(Tag(at, end, bool(m[1]), "!" if name in CLOSING else name, m[3], ""))
            at = end
            continue
        if not m[3].endswith("/") or name in HIDDEN:
            found = None if name in absent else CLOSING[name].search(page, end)
            if found:
                end = found.end()
            else:
                absent.add(name)
                end = len(page) if name in TO_THE_END else max(end, page.find("<", end)) if name == "title" else end
        out.append(Tag(at, end, True, "!", "", "" if name in HIDDEN else " "))
        at = end
    return out


def _names(value: str) -> list[str]:
    return _CAPITAL.sub("-", value).lower().replace("__", "-").replace("_", "-").split()


def _boilerplate(name: str, attributes: str, inside: bool = False) -> str:
    """Why an element isn't the article: "element", "name", "ad", or "" if nothing says so. inside: of an article, where TOPICS say nothing."""
    if name in BOILERPLATE:
        return "name" if name in ROUND else "element"
    if name in ("html", "body", "article", "main"):
        return "element" if name == "article" and "comment" in attributes.lower() else ""
    why = ""
    for m in NAMED.finditer(attributes) if attributes else ():
        kind, found = m[1].lower(), _names(m[2] or m[3] or m[4] or "")
        if kind == "aria-label":
            found = ["-".join(found)]
        if not ADS.isdisjoint(found) and not (kind == "id" and name in HEADINGS):
            return "ad"
        if name not in HEADINGS and not (IDS if kind == "id" else NAMES_INSIDE if inside else NAMES).isdisjoint(found):
            why = "name"
    return why


def _kept(tags: list[Tag], page: str, ends: dict[int, int]):
    """A function that says whether an element is kept whatever its name: it holds main, a real article, or most of the page's text."""
    before = [0]  # characters before each tag, without white space at the ends
    at = 0
    for tag in tags:
        before.append(before[-1] + len(page[at : tag.start].strip()))
        at = tag.end
    before = before[1:]
    total = before[-1] + len(page[at:].strip())
    inner = [(i, ends[i], before[ends[i]] - before[i], x.name) for i, x in enumerate(tags) if not x.close and i in ends and x.name in ("article", "main") and not _boilerplate(x.name, x.attributes)]
    longest = max((n for *_, n, name in inner if name == "article"), default=0)
    inner = [(i, j) for i, j, n, name in inner if n and (name == "main" or n >= max(OF_LONGEST * longest, OF_PAGE * total))]
    held = {}  # by kind: starts, and the first end of each and all later ones
    for kind, own in (("main", [x for x in inner if tags[x[0]].name == "main"]), ("any", inner)):
        held[kind] = [i for i, _ in own], list(itertools.accumulate((j for _, j in reversed(own)), min))[::-1]

    def kept(i: int, why: str) -> bool:
        end = ends.get(i)
        if end is None:
            return False
        starts, first = held["main" if why == "element" else "any"]
        k = bisect_right(starts, i)
        if k < len(starts) and first[k] < end:
            return True
        return why == "name" and not inner and 2 * (before[end] - before[i]) > total

    return kept


def _ends(tags: list[Tag]) -> dict[int, int]:
    """For each start tag, the tag that closes it; loose ones end where a block begins, unclosed others have none."""
    ends, open_ = {}, {}
    for i, (_, _, close, name, _, _) in enumerate(tags):
        if name == "!":
            continue
        if name in LOOSE or name in BLOCK:
            for loose in LOOSE if name in BLOCK and (not close or name not in LOOSE) and name != "br" else (name,):
                if (loose == "p" or loose == name) and not (close and loose == name) and open_.get(loose):
                    ends[open_[loose].pop()] = i
        if name in VOID:
            continue
        if not close:
            open_.setdefault(name, []).append(i)
        elif open_.get(name):
            ends[open_[name].pop()] = i
    return ends


class Line(NamedTuple):
    text: str
    inside: bool  # of an article or main element
    links: float  # share of characters in links
    box: int  # the tag of the innermost element of BOXES round it
    list: int  # the tag of the innermost element of LISTS round it, -1 for none
    end: int  # the tag that ends its box
    at: int  # the tag that ends the line


EMPTY = Line("", False, 0.0, -1, -1, -1, -1)


def lines(page: str) -> list[Line]:
    """The lines of a page, empty ones for gaps."""
    tags = scan(page)
    ends, out, text, at, until, inside, main_ends = _ends(tags), [], [], 0, -1, 0, set()
    kept, linked, link_end, boxes, lists = None, 0, -1, [(-1, len(page))], [(-1, len(page))]  # boxes, lists: tag and end

    def flush(i: int):
        nonlocal linked
        if line := " ".join("".join(text).split()):
            out.append(Line(" ".join(html.unescape(line).split()), inside > 0, min(1.0, linked / len(line)), boxes[-1][0], lists[-1][0], boxes[-1][1], i))
        text.clear()
        linked = 0

    for i, (start, stop, close, name, attributes, gap) in enumerate(tags):
        if i > until:
            text.append(page[at:start])
            if i <= link_end:
                linked += len(text[-1].strip())
            text.append(gap)
        at = stop
        if i < until:
            continue
        if name in BLOCK:
            flush(i)
        if i in main_ends:
            inside -= 1
            if not inside:
                out.extend([EMPTY] * GAP)
        for kind, known in ((BOXES, boxes), (LISTS, lists)):
            while known[-1][1] <= i:
                known.pop()
            if name in kind and not close and i in ends:
                known.append((i, min(ends[i], known[-1][1])))
        if name == "a" and not close:
            link_end = ends.get(i, -1)
        why = _boilerplate(name, attributes, inside > 0) if not close and name not in VOID else ""
        if why and (kept := kept or _kept(tags, page, ends))(i, why):
            why = ""
        if why and inside and name == "header" and i in ends and any(x.name in HEADINGS for x in tags[i + 1 : min(ends[i], i + HEAD)]):
            why = ""  # the article's own headline
        if why:
            flush(i)
            end = ends.get(i)
            if end is None:  # unclosed: up to the next block
                end = next((j for j in range(i + 1, len(tags)) if tags[j].name in BLOCK), len(tags))
            until = end
            out.extend([EMPTY] * GAP)
        elif not close and name in ("article", "main"):
            if not inside:
                out.extend([EMPTY] * GAP)
            inside += 1
            main_ends.add(ends.get(i, -1))
    if len(tags) > until:
        text.append(page[at:])
    flush(len(tags))
    return out


def _lengths(rows: list[Line]) -> list[int]:
    """Characters of each line; none for WINDOW or more lines of links in a row, and none in lists of short lines that are mostly links."""
    length, run = [len(x.text) for x in rows], []
    own = {}
    for i, x in enumerate(rows):
        if x.list >= 0:
            own.setdefault(x.list, []).append(i)
    for members in own.values():
        total = sum(length[i] for i in members)
        if total <= SHORT * len(members) and 2 * sum(length[i] * rows[i].links for i in members) >= total:
            for i in members:
                length[i] = 0
    for i, x in enumerate([*rows, EMPTY]):
        if x.text and x.links >= LINKS:
            run.append(i)
            continue
        if len(run) >= WINDOW:
            for k in run:
                length[k] = 0
        run.clear()
    return length


def _surges(length: list[int], sums: list[int], least) -> list[bool]:
    """Which lines stand between a surge, a sum over least(line), and the dive after it, a window without text."""
    kept, i = [False] * len(length), 0
    while i < len(length):
        if not length[i] or sums[i] <= least(i):
            i += 1
            continue
        while i < len(length) and sums[i] > 0:
            kept[i] = length[i] > 0
            i += 1
    return kept


def _bridged(rows: list[Line], length: list[int], kept: list[bool]) -> list[bool]:
    """Lines of the boxes that hold kept text, and what stands between kept lines of a box, are kept too."""
    held, first, last = Counter(), {}, {}
    for i, (x, n, k) in enumerate(zip(rows, length, kept, strict=True)):
        if k:
            held[x.box] += n
            first.setdefault(x.box, i)
            last[x.box] = i
    boxes = {b for b, n in held.items() if n > ENOUGH}
    spans, end = [0] * (len(rows) + 1), 0
    for b in boxes:
        spans[first[b]] += 1
        spans[last[b]] -= 1
    out = []
    for i, (x, n, k) in enumerate(zip(rows, length, kept, strict=True)):
        end += spans[i]
        out.append(n > 0 and (k or x.box in boxes or end > 0))
    return out


def _boxed(rows: list[Line], length: list[int], kept: list[bool]) -> list[Line]:
    """The lines with the box that directly holds several kept lines and most of the kept text as inside, gaps at its edges; as they are if there is none."""
    held, lines_of = Counter(), Counter()
    for x, n, k in zip(rows, length, kept, strict=True):
        if k:
            held[x.box] += n
            lines_of[x.box] += 1
    box, most = max(held.items(), key=lambda x: x[1], default=(-1, 0))
    if box < 0 or lines_of[box] < 2 or 2 * most <= sum(held.values()):
        return rows
    end = next(x.end for x in rows if x.box == box)
    out, last = [], False
    for x in rows:
        inside = box < x.at <= end if x.text else last
        if inside != last:
            out.extend([EMPTY] * GAP)
        out.append(x._replace(inside=inside))
        last = inside
    return out


def between(rows: list[Line], boxed: bool = False) -> list[str]:
    """The lines from surges to dives. boxed: those of the main box are marked as inside already."""
    length = _lengths(rows)
    sums = [sum(length[i : i + WINDOW]) for i in range(len(rows))]
    level = min(ENOUGH, SURGE * max(sums, default=0))  # no long line can raise it further
    kept = _surges(length, sums, lambda i: level)
    tagged = sum(n for x, n in zip(rows, length, strict=True) if x.inside)
    if tagged and tagged >= sum(n for x, n, k in zip(rows, length, kept, strict=True) if k and not x.inside):
        kept = _surges(length, sums, lambda i: 0 if rows[i].inside else OUTSIDE)
        if not any(k and not x.inside for x, k in zip(rows, kept, strict=True)):  # nothing to bridge
            return [x.text for x, k in zip(rows, kept, strict=True) if k]
    elif not boxed and (own := _boxed(rows, length, kept)) is not rows:
        return between(own, True)
    return [x.text for x, k in zip(rows, _bridged(rows, length, kept), strict=True) if k]


def main_text(page: str | None) -> str:
    return "\n".join(between(lines(page or "")))


def _extract(batches):
    for batch in batches:
        for part in t.slices(batch, "html"):
            ids, urls, pages = (part.column(part.schema.get_field_index(c)) for c in ("page_id", "url", "html"))
            texts = [main_text(p) for p in pages.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, url, text, n_chars), a row for each row of pages.

    Null and empty pages, and pages without an article, have an empty text; ids and urls are passed on as they are, nulls too;
    further columns are left out; an empty table gives no rows.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
