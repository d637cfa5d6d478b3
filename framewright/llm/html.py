"""Main text of web pages by the line-block distribution.

A page becomes lines, one per block, with script, style, comments and markup stripped and the share of
each line that stands in page furniture (navigation, header, footer, aside, form, advert, notice,
reader comments, by element or by class and id names) or in links counted as no text. Over the
lines, text lengths are summed in a sliding window; a surge point starts a run of text, a dive point
ends it, and the run with most text is kept with those that belong to the same container. Article and main
elements are a hint: runs inside them go before other runs, and a kept run is completed to its element.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines summed in a window, and the text in a window from which a run may start.
WINDOW, SURGE = 3, 40

#: Elements that close a block, elements never shown or never text, and elements of page furniture.
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
HIDDEN = frozenset("head script style noscript template title svg math iframe object embed canvas audio video map select option button textarea".split())
FURNITURE = frozenset("nav header footer aside form menu dialog fieldset".split())
#: Elements whose runs belong together.
BOXES = frozenset("article body div main section td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the left kind is closed by the start of one of the right kind.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option", "optgroup"]), "head": frozenset(["body"]),
}
#: Names in class, id or role that mark page furniture, as whole words of the name.
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies copyright disclaimer "
    "disqus dropdown footer gdpr header login masthead menu menubar modal nav navbar navigation navmenu newsletter notice notification pager pagination popup "
    "privacy promo promoted promotion recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe tagcloud toc toolbar widget "
    "complementary contentinfo".split()
)
#: Names of readers' comments, which are furniture however long they are, and openings of names that only describe a layout.
COMMENT_NAMES = frozenset("comment comments commentlist disqus replies respond".split())
LAYOUT = ("has-", "no-", "with-", "without-", "is-", "has_", "no_", "with_", "without_", "is_")
#: A quote that no quote before white space, / or > closes is a character like any other: it doesn't swallow the text after it.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z)|[\"'])*+)(?:>|\Z)", re.S)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDE = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none", re.I)
_WORDS = re.compile(r"[a-z0-9]+")


def is_furniture(tag: str, attributes: str) -> bool:
    """Whether an element is page furniture by its kind, or hidden."""
    if tag in FURNITURE:
        return True
    return bool(attributes.strip() and tag not in ("html", "body", "article", "main") and _HIDE.search(attributes))


def furniture_words(attributes: str) -> set[str]:
    """Names of page furniture in class, id or role; has-sidebar, no-sidebar and the like only describe a layout."""
    out: set[str] = set()
    for m in _NAMED.finditer(attributes) if attributes.strip() else ():
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            if not name.startswith(LAYOUT):
                out |= FURNITURE_NAMES.intersection([name, *_WORDS.findall(name)])
    return out


def lines(page: str) -> list[tuple[str, int, int, int]]:
    """Lines of a page: (text, characters of it inside links, number of the outermost article or main element it stands in, 0 outside,
    number of the innermost element of BOXES around it, 0 outside).

    An element that only its names mark as furniture still shows if no article or main stands outside such elements and
    it holds most of the page's text (that of readers' comments left out), or an article or main with no less text than all that stands outside. The time is
    linear in the page's length.
    """
    out: list[tuple[str, int, int, int, int]] = []
    named: list[tuple[int, bool]] = []  # elements marked by their names: the marked one around (-1: none), whether by names of readers' comments
    mark = -1
    pieces: list[str] = []
    linked = articles = article = boxes = box = 0
    stack: list[tuple[str, bool, int, int, int]] = []  # element, out of sight, article, box and marked element around it
    places: dict[str, list[int]] = {}  # where elements of a kind stand in the stack
    block_at: list[int] = [-1]  # where elements of BLOCK do
    dark, links, at, end = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                out.append((text, min(linked, len(text)), article, box, mark))
            pieces.clear()
        linked = 0

    def text(s: str) -> None:
        nonlocal linked
        if s and not dark:
            pieces.append(s)
            if links:
                linked += len(s)

    def close(k: int) -> None:
        nonlocal dark, links, article, box, mark
        while len(stack) > k:
            tag, hid, *before = stack.pop()
            places[tag].pop()
            if tag in BLOCK:
                flush()
                block_at.pop()
            dark -= hid
            links -= tag == "a"
            article, box, mark = before

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1]:
                text(m[1])
            continue
        tag = tag.lower()
        if m[2]:
            here = places.get(tag)
            if here and (tag in BLOCK or here[-1] > block_at[-1]):
                close(here[-1])
            elif tag in BLOCK:
                flush()
            continue
        while stack and tag in CLOSED_BY.get(stack[-1][0], ()):
            close(len(stack) - 1)
        if tag in BLOCK:
            if block_at[-1] >= 0 and tag in CLOSED_BY.get(stack[block_at[-1]][0], ()):  # a p or li left open below inline elements
                close(block_at[-1])
            flush()
        attributes = m[4] or ""
        if tag in _RAW and not attributes.rstrip().endswith("/"):
            stop = _RAW[tag].search(page, at)
            at = stop.end() if stop else end
            continue
        if tag in VOID:
            continue
        hid = tag in HIDDEN or is_furniture(tag, attributes) and not (tag == "header" and article)
        if tag == "a":
            links += 1
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            block_at.append(len(stack))
        stack.append((tag, hid, article, box, mark))
        dark += hid
        if not dark and tag not in ("html", "body", "main") and (tag != "article" or article) and not (tag == "header" and article) and (words := furniture_words(attributes)):
            named.append((mark, not words.isdisjoint(COMMENT_NAMES)))
            mark = len(named) - 1
        if tag in BOXES:
            boxes += 1
            box = boxes
        if tag in ("article", "main") and not dark and not article:
            articles += 1
            article = articles
    flush()
    return [x[:4] for x in _shown(out, named)]


def _shown(found: list[tuple[str, int, int, int, int]], named: list[tuple[int, bool]]) -> list[tuple[str, int, int, int, int]]:
    """The lines outside elements marked by their names, but for those elements that hold the page's main text."""
    if not named:
        return found
    free = [x for x in found if x[4] < 0]
    if any(x[2] for x in free):
        return free
    readers: list[bool] = []  # stands in readers' comments
    for around, comments in named:
        readers.append(comments or around >= 0 and readers[around])
    total, outside = sum(len(t) - n for t, n, _, _, m in found if m < 0 or not readers[m]), sum(len(t) - n for t, n, *_ in free)
    text, stated = [0] * len(named), [0] * len(named)
    for t, n, a, _, m in found:
        if m >= 0:
            text[m] += len(t) - n
            stated[m] += (len(t) - n) * (a > 0)
    for m in reversed(range(len(named))):
        if (around := named[m][0]) >= 0:
            text[around] += text[m]
            stated[around] += stated[m]
    shown: list[bool] = []
    for m, (around, comments) in enumerate(named):
        shown.append(not comments and (around < 0 or shown[around]) and (2 * text[m] > total or 0 < stated[m] >= outside))
    return [x for x in found if x[4] < 0 or shown[x[4]]]


def runs(lengths: list[int], surge: int = SURGE) -> list[tuple[int, int]]:
    """Runs [start, stop) of lines between a surge point and its dive point.

    The block size of a line is the text of WINDOW lines from it on. A line surges if its block size
    reaches surge and its own text is not nothing; the run dives at the first block without text.
    """
    n = len(lengths)
    sums = [0] * (n + 1)
    for k, x in enumerate(lengths):
        sums[k + 1] = sums[k] + x
    block = [sums[min(n, k + WINDOW)] - sums[k] for k in range(n)]
    out, k = [], 0
    while k < n:
        if block[k] >= surge and lengths[k]:
            stop = k
            while stop < n and block[stop]:
                stop += 1
            out.append((k, stop))
            k = stop
        else:
            k += 1
    return out


def main_text(page: str | None) -> str:
    """The main text of a page; '' for null, empty or text-free pages.

    Lines of mostly links count as no text, and runs surge at SURGE characters, on every page. Runs that reach into
    article or main elements are all kept, each completed to its elements; where there are none, the run with most
    text, and those inside the same elements. Kept runs keep all their lines. Where nothing surges, the element
    with most text is kept, or else the page.
    """
    all_lines = lines(page or "")
    lengths = [0 if 2 * linked > len(t) else len(t) for t, linked, *_ in all_lines]
    found = runs(lengths)
    stated = {a for start, stop in found for _, _, a, _ in all_lines[start:stop] if a}
    if stated:
        keep = {k for start, stop in found if any(x[2] for x in all_lines[start:stop]) for k in range(start, stop)}
        keep |= {k for k, (_, _, a, _) in enumerate(all_lines) if a in stated}
    elif found:
        around = [{x[3] for x in all_lines[start:stop]} for start, stop in found]
        most = max(range(len(found)), key=lambda r: (sum(lengths[slice(*found[r])]), -r))
        keep = {k for r, at in enumerate(around) if not at.isdisjoint(around[most]) for k in range(*found[r])}
    else:
        weight: dict[int, int] = {}
        for t, linked, a, _ in all_lines:
            if a:
                weight[a] = weight.get(a, 0) + len(t) - linked
        best = max(weight, key=lambda a: (weight[a], -a)) if weight and max(weight.values()) > 0 else 0
        keep = {k for k, (_, _, a, _) in enumerate(all_lines) if (a == best if best else lengths[k])}
    return " ".join(all_lines[k][0] for k in sorted(keep))


def extract(pages: DataFrame) -> DataFrame:
    """One row per page row: page_id, url, text, n_chars. Null html gives an empty text; repeated rows repeat; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
