"""Main text of web pages by differencing with the page of the nearest URL.

Pages are range-sorted by host and path, so that a page's nearest URLs of its host are its neighbours. The first
and last page of each partition meet those of the partitions beside it in a second step, so partitions do not show in the result. Of the two neighbours that with the longer common path start is its pair (the earlier one on a tie). Both
pages are turned into text lines, one per block element, and aligned by the longest common subsequence of
(line, place), where the place is the path of container elements: shared lines are the template and are deleted.

Two exact checks follow, as templates also vary within a host and articles also repeat lines. A shared line inside
``article`` or ``main`` is content and stays. A line that the page itself marks as something else - navigation,
header, footer, aside, form, dialog, script, style, or a container of which a whole class, id or role name says advert, menu,
sidebar, notice, comments - goes, shared or not; an ``article`` or ``main`` ends what its wrappers' names say, and an ``article``
named as a comment is one. A ``head`` left open ends where the body begins. If a page has an ``article`` or ``main``, lines outside go too;
otherwise what the difference leaves is the text.

A hot host is spread over partitions (the sort goes on with path and page). A task holds one Arrow batch and a page.

Defined results: a null or empty page has an empty text; a page that is alone with its host has no
pair, so nothing is shared; a null or relative URL counts as a host of its own kind; equal rows pair with
each other, and only marked lines go then if they have no ``article`` or ``main``: pages equal to their pair
are compared with no one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrante.llm.common import slices, stored

#: Elements whose text is no line of the page.
_SILENT = frozenset("head script style noscript template iframe object svg canvas audio video math select option textarea button".split())
#: Elements that hold something other than the main text.
_ASIDE = frozenset("nav footer aside form dialog menu".split())
_MAIN = frozenset("article main".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an open element of the key is closed by, as its end tag may be left out.
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_LAYOUT = (
    r"(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|"
    r"sidebar|side|aside|related|widget|cookies?|consent|notice|gdpr|popup|modal|newsletter|subscribe|signup|login|search|share|sharing|social|"
    r"comments?|replies|disqus|complementary|contentinfo|pagination|pager|skip)"
)
#: Whole names; of longer ones those that say whose or where the thing is (``site-header``, but not ``entry-header`` or ``with-sidebar``).
_MARKED = re.compile(rf"(?:(?:site|global|top|bottom|left|right|user|reader|cookie|social)[_-])?{_LAYOUT}(?:[_-](?:area|bar|block|box|container|list|section|slot|thread|unit|wrapper))?", re.IGNORECASE)
#: Names that the main text's own parts have as well; there they count only for lines that the page shares with its pair.
_AMBIGUOUS = frozenset("banner header search".split())
#: Names of a reader's comment, also on an ``article``.
_COMMENT = re.compile(r"(?:(?:article|blog|post|user|reader)[_-])?(?:comments|(?:comment|reply|replies|disqus)(?:[_-](?:body|content|entry|item|list|thread))?)|comments[_-](?:body|content|list|thread)|comment", re.IGNORECASE)
#: Names of things whose own articles are teasers.
_TEASER = re.compile(r"(?:(?:left|right)[_-])?(?:related|widget|sidebar|aside|promo|sponsor(?:ed)?|ads?|adverts?|banner|newsletter)", re.IGNORECASE)
#: Elements that a ``head`` can hold; any other ends one that was left open.
_IN_HEAD = frozenset("html head title base basefont bgsound link meta script style noscript noframes template".split())
#: How strongly a line is marked: by a wrapper that any ``article`` or ``main`` ends, by one that only ``main`` ends, for good.
#: ``_DOUBTFUL``: by an ambiguous name inside the main text.
_DOUBTFUL, _WRAPPER, _SECTION, _HIDDEN = 1, 2, 3, 4
#: Elements that cannot stand in those that a page may have left open, and these.
_ENDS_CONTROL = frozenset("article blockquote footer h1 h2 h3 h4 h5 h6 header main nav ol p pre section table ul".split())
_CONTROL = frozenset("button option select".split())
_SPACE = re.compile(r"\s+")


class _Lines(HTMLParser):
    """Collects ``(text, place, marked, main, doubtful)`` for each block of text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, str, bool, bool, bool]] = []
        self.open: list[tuple[str, int, bool]] = []  # tag, marked, main
        self.parts: list[str] = []
        self.silent = 0

    def _flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            self.parts = []
            if text:
                _, marked, main = self.open[-1] if self.open else ("", 0, False)
                place = "/".join(t for t, _, _ in self.open if t in _BLOCK and t != "p")
                self.lines.append((text, place, marked > _DOUBTFUL, main, marked == _DOUBTFUL))

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag not in _IN_HEAD:
            self._close_head(tag == "body")
        if tag in _ENDS_CONTROL:
            self._close_controls()
        if tag in _BLOCK and not self.silent:
            self._flush()
            self._close_open_p()
            for k in range(len(self.open) - 1, -1, -1):
                if tag in _CLOSED_BY.get(self.open[k][0], ()):
                    self._pop(k)
                    break
                if self.open[k][0] in ("ul", "ol", "dl", "table", "article", "main", "div", "section"):
                    break
        if tag in _VOID:
            if tag == "br":
                self.parts.append("\n")
            return
        _, marked, main = self.open[-1] if self.open else ("", 0, False)
        if not main and (tag == "main" and marked <= _SECTION or tag == "article" and marked <= _WRAPPER):
            marked = 0
        main = main or tag in _MAIN
        names = [x for n, v in attrs if n in ("class", "id", "role", "itemprop") and v for x in v.split()]
        if tag in _ASIDE and tag != "form" or tag != "body" and any(map(_COMMENT.fullmatch, names)):
            marked = max(marked, _SECTION)
        elif tag == "form" or tag == "header" and not main:
            marked = max(marked, _WRAPPER)
        elif tag not in ("html", "body", "header") and tag not in _MAIN and any(map(_MARKED.fullmatch, names)):
            sure = not main or any(_MARKED.fullmatch(n) and n.lower() not in _AMBIGUOUS for n in names)
            marked = max(marked, _SECTION if any(n.lower() not in _AMBIGUOUS and _TEASER.fullmatch(n) for n in names) else _WRAPPER if sure else _DOUBTFUL)
        if any(n == "hidden" for n, _ in attrs):
            marked = _HIDDEN
        main = main or "articleBody" in names
        self.open.append((tag, marked, main))
        self.silent += tag in _SILENT

    def _close_head(self, always: bool = False) -> None:
        """The body begins, said or not."""
        if self.open and (self.open[-1][0] == "head" or always):
            k = next((k for k, (tag, _, _) in enumerate(self.open) if tag == "head"), None)
            if k is not None:
                self._pop(k)

    def _close_controls(self) -> None:
        """A block ends the button or list of options that was left open around it."""
        k = next((k for k, (tag, _, _) in enumerate(self.open) if tag in _CONTROL), None)
        if k is not None and self.silent == sum(t in _CONTROL for t, _, _ in self.open[k:]):
            self._pop(k)

    def _close_open_p(self) -> None:
        """A block ends an open paragraph, with the inline elements that it left open."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == "p":
                self._pop(k)
                return
            if self.open[k][0] in _BLOCK:
                return

    def _pop(self, k: int) -> None:
        self.silent -= sum(t in _SILENT for t, _, _ in self.open[k:])
        del self.open[k:]

    def _first_silent(self) -> int:
        return next((k for k, (tag, _, _) in enumerate(self.open) if tag in _SILENT), len(self.open))

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK and (not self.silent or any(t == tag for t, _, _ in self.open[: self._first_silent()])):
            self._flush()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._pop(k)
                return
            if tag not in _BLOCK and self.open[k][0] in _BLOCK:
                return  # the end of an inline element that a block has closed

    def handle_data(self, data: str) -> None:
        if self.silent and data.strip():
            self._close_head()
        if not self.silent:
            self.parts.append(data)

    def close(self) -> None:
        super().close()
        self._flush()


def lines_of(html: str | None) -> list[tuple[str, str, bool, bool, bool]]:
    """Text lines of a page: ``(text, place, marked as something else, inside article or main, there marked by an ambiguous name)``."""
    if not html:
        return []
    parser = _Lines()
    parser.feed(html)
    parser.close()
    return parser.lines


def shared_lines(own: list, other: list) -> set[int]:
    """Positions in ``own`` of a longest common subsequence with ``other``."""
    keys: dict = {}
    a = np.array([keys.setdefault(x, len(keys)) for x in own], np.int64)
    b = np.array([keys.setdefault(x, len(keys)) for x in other], np.int64)
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    shared = {*range(start), *range(len(a) - end, len(a))}
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    a_at, b_at = np.flatnonzero(np.isin(a, b)), np.flatnonzero(np.isin(b, a))
    shared.update(start + int(a_at[k]) for k in _subsequence(a[a_at].tolist(), b[b_at].tolist()))
    return shared


def _subsequence(a: list[int], b: list[int]) -> list[int]:
    """Hunt-Szymanski: positions in ``a``; memory grows with the matches kept, not with the product of the lengths."""
    places: dict[int, list[int]] = {}
    for j, key in enumerate(b):
        places.setdefault(key, []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i, key in enumerate(a):
        for j in reversed(places.get(key, ())):
            k = int(np.searchsorted(ends, j)) if len(ends) > 64 else next((n for n, e in enumerate(ends) if e >= j), len(ends))
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    out, link = [], links[-1] if links else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def main_text(own: list, pair: list | None) -> str:
    """The page's text, given the lines of its pair."""
    shared = shared_lines([x[:2] for x in own], [x[:2] for x in pair]) if pair and pair != own else set()
    has_main = any(main and not marked for _, _, marked, main, _ in own)
    kept = [
        text
        for k, (text, _, marked, main, doubtful) in enumerate(own)
        if not marked and (main and not (doubtful and (not pair or k in shared)) if has_main else k not in shared)
    ]
    return "\n\n".join(kept)


def _path_of(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.netloc or parts.scheme).lower(), f"{parts.path}?{parts.query}"
    except ValueError:
        return "", url or ""


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def _packed(html: str | None) -> bytes | None:
    """Pages cross the shuffle packed, which takes less disk than the shuffle's own compression."""
    return None if html is None else zlib.compress(html.encode(), 4)


def _unpacked(html: bytes | None) -> str | None:
    return None if html is None else zlib.decompress(html).decode()


_EDGES = pa.schema(
    [
        *(("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("part", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_())),
        *((n, pa.string()) for n in ("host", "path", "html", "inner_host", "inner_path", "inner_html")),
    ]
)


def extract_text(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``; ``partitions`` of the sort, if given, change no text."""

    def located(batches):
        for batch in slices(batches):
            hosts, paths = zip(*(_path_of(u) for u in batch["url"].to_pylist())) if batch.num_rows else ((), ())
            html = pa.array([_packed(x) for x in batch["html"].to_pylist()], pa.binary())
            arrays = [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), batch["page_id"], batch["url"], batch["tie"], html]
            yield pa.RecordBatch.from_arrays(arrays, ["host", "path", "page_id", "url", "tie", "html"])

    def text_of(page, previous, following):
        near = [p for p in (previous, following) if p and p[0] == page[0]]
        pair = max(near, key=lambda p: _common(p[1], page[1])) if near else None
        text = main_text(lines_of(page[4]) if page[5] is None else page[5], (lines_of(pair[4]) if pair[5] is None else pair[5]) if pair else None)
        return page[2], page[3], text

    def paired(batches):
        """Texts of the pages inside the partition; its first and last page go on with their neighbour."""
        part = TaskContext.get().partitionId()
        before = current = None  # (host, path, page_id, url, html, lines)
        rows: list[dict] = []

        def edge(page, inner, first, last):
            host, path, page_id, url, html, _ = page
            names = ("inner_host", "inner_path", "inner_html")
            own = {"page_id": page_id, "url": url, "part": part, "first": first, "last": last, "host": host, "path": path, "html": html}
            return own | (dict(zip(names, (inner[0], inner[1], inner[4] or ""))) if inner else {})

        def inside(page, previous, following):
            page_id, url, text = text_of(page, previous, following)
            return {"page_id": page_id, "url": url, "text": text}

        for batch in slices(batches):
            for host, path, page_id, url, html in zip(*(batch[n].to_pylist() for n in ("host", "path", "page_id", "url", "html"))):
                html = _unpacked(html)
                after = (host, path, page_id, url, html, lines_of(html))
                if current:
                    rows.append(inside(current, before, after) if before else edge(current, after, True, False))
                before, current = current, after
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _EDGES)
                rows = []
        if current:
            yield pa.RecordBatch.from_pylist([edge(current, before, before is None, True)], _EDGES)

    def finished(batches):
        """Texts of first and last pages, with the neighbours in other partitions."""
        for batch in slices(batches, 50):
            rows = []
            for r in batch.to_pylist():
                inner, left, right = (
                    (r[f"{n}_host"], r[f"{n}_path"], None, None, r[f"{n}_html"], None) if r[f"{n}_host"] is not None else None
                    for n in ("inner", "left", "right")
                )
                page = (r["host"], r["path"], r["page_id"], r["url"], r["html"], None)
                page_id, url, text = text_of(page, left if r["first"] else inner, right if r["last"] else inner)
                rows.append({"page_id": page_id, "url": url, "text": text})
            yield pa.RecordBatch.from_pylist(rows, pa.schema(list(_EDGES)[:3]))

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"))
    rows = rows.withColumn("tie", F.xxhash64("html")).mapInArrow(located, "host string, path string, page_id long, url string, tie long, html binary")
    order = ["host", "path", "page_id", "tie"]
    rows = rows.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    schema = "page_id long, url string, text string, part int, first boolean, last boolean, host string, path string, html string, "
    rows = stored(rows.mapInArrow(paired, schema + "inner_host string, inner_path string, inner_html string"))

    # Two rows of a partition at most. The partitions that hold rows, in order: numbers only.
    edges = rows.where("part is not null")
    parts = sorted(r["part"] for r in edges.select("part").distinct().collect())
    beside = list(zip(parts, [None, *parts[:-1]], [*parts[1:], None]))
    beside = pages.sparkSession.createDataFrame(beside, "part int, left_part int, right_part int")
    met = edges.join(beside, "part")
    for side, end in (("left", "last"), ("right", "first")):
        names = (F.col(n).alias(f"{side}_{n}") for n in ("part", "host", "path", "html"))
        met = met.join(edges.where(end).select(*names), f"{side}_part", "left")
    texts = met.mapInArrow(finished, "page_id long, url string, text string").unionByName(rows.where("part is null").select("page_id", "url", "text"))
    # Code points, as Python counts them.
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
