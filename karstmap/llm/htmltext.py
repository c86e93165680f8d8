"""Main text of web pages by nearest-URL page differencing and by structure.

A page becomes lines: the text between block-level tags, all of it but scripts, styles and the like. Pages are paired: within each
host they are ordered by URL path, and each is aligned with its neighbours by the longest common
subsequence of its lines, exact however long the pages are; lines that both share are the site's, not the page's, and are deleted. Neighbours are
the nearest pages whose text differs: copies are walked past, so they all get one text. Structure then drops what
differencing can't know: lines of one page alone in navigation, headers, footers, asides, forms, comments of readers and others by their tag,
role, class or id; where the page has an article or main element with text, all lines outside. A form or a marked element
around the page's only article doesn't drop it. One thing stays though shared: paragraphs, headings, list items
and their like inside an article or main element, as articles repeat passages of each other.

The order of host, path and id is cut into ranges at keys drawn by a hash; a pass over keys and digests of
texts finds the nearest page on each side of a range that differs from its outer one, which is sent to the range as well. Each
range streams through one task in order, which holds three pages and, of a run of copies, ids and the lines in which they differ. So no host, however large, makes a
task large, the pairs don't depend on the ranges, and text is shuffled once; lines that structure drops go as digests.

Defined results: null and empty html give an empty text; very long and very deep pages take time in proportion to their length, but for the alignment, which takes the product of the lines that two
neighbours share in part, over the bits of a number; a page without neighbours on its host keeps
what its structure tells; pages with equal URLs are neighbours by id; repeated rows give repeated
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karstmap.llm.common import by_batch, slices

RANGE_PAGES, MAX_RANGES = 1000, 100_000  #: beyond so many ranges each grows, and streams more pages
KEY = ("host", "path", "has", "id")

#: Tags whose content is never text of the page.
UNSEEN = frozenset("head script style noscript template button select option textarea iframe object svg canvas audio video dialog".split())
#: Tags whose text is not the article's.
ASIDE = frozenset("nav header footer aside menu".split())
#: Tags that end a block.
BLOCKS = frozenset("address article blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Blocks that hold an article's text.
HOLDERS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dt dd td th caption figcaption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in a class, id or role that mark what is not the article.
MARKS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments contentinfo cookie cookies consent footer header masthead menu modal nav navbar navigation newsletter notice pagination popup promo related search share sharing sidebar social sponsor sponsored subscribe toolbar widget complementary".split())
READERS = frozenset(("comment", "comments"))  #: those that no article inside lifts
WORD = re.compile(r"[a-z]+|\d+")
CUT = re.compile(r"<[a-zA-Z/!][^<>]*\Z")  # a tag that the page's end cuts
#: Tags that an opening tag of the same kind closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCKS - {"br"} | {"form", "nav", "header", "footer", "aside"}
P_STOPS = frozenset(("table", "td", "th", "li", "article", "div", "section", "body", "form", *UNSEEN, *ASIDE))
NOT_MARKED, WRAPS, ASIDE_MARK, NEVER = range(4)


class Block(NamedTuple):
    text: str
    mark: int  # NOT_MARKED, in a form or marked element, in one that is never the article
    article: bool  # in an article or main element
    holder: bool  # there in an element that holds text


class Open(NamedTuple):
    """An open element and what holds for all inside it."""

    tag: str
    mark: int
    article: bool
    block: str  # the nearest block's tag


class BlockParser(HTMLParser):
    """All text of a page in blocks. What holds inside an element is kept with it, so depth costs nothing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[Open] = [Open("", NOT_MARKED, False, "")]
        self.counts: Counter[str] = Counter()  # of open tags
        self.text: list[str] = []

    def _end_block(self) -> None:
        if text := " ".join("".join(self.text).split()):
            top = self.open[-1]
            self.blocks.append(Block(text, top.mark, top.article, top.article and top.block in HOLDERS))
        self.text.clear()

    def _close(self, tags: set[str] | frozenset[str], above: frozenset[str]) -> None:
        """Closes the innermost open one of tags, unless one of above is nearer."""
        if not any(self.counts[t] for t in tags):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                if any(x.tag in BLOCKS or x.mark != self.open[k - 1].mark for x in self.open[k:]):
                    self._end_block()
                self.counts.subtract(x.tag for x in self.open[k:])
                del self.open[k:]
                return
            if self.open[k].tag in above:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_P:
            self._close({"p"}, P_STOPS)
        if tag in CLOSES and tag != "p":
            self._close(CLOSES[tag], frozenset(("table", "ul", "ol", "dl", "select")))
        if tag == "body":
            self._close({"head"}, frozenset())
        words = {w for k, v in attrs if k in ("class", "id", "role") and v for w in WORD.findall(v.lower())} & MARKS
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        mark = NOT_MARKED
        if tag in UNSEEN or hidden:
            mark = NEVER
        elif tag in ASIDE or words & READERS and tag not in ("html", "body", "article", "main"):
            mark = ASIDE_MARK
        elif tag == "form" or words and tag not in ("html", "body", "article", "main"):
            mark = ASIDE_MARK if self.open[-1].article else WRAPS
        if tag in BLOCKS or mark:
            self._end_block()
        if tag in VOID:
            return
        top = self.open[-1]
        self.open.append(Open(tag, max(top.mark, mark), top.article or tag in ("article", "main"), tag if tag in BLOCKS else top.block))
        self.counts[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "span", "b", "i"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            if tag in BLOCKS:
                self._end_block()
            return
        self._close({tag}, frozenset(("article", "body")) - {tag} if tag in ("p", "b", "i", "em", "strong", "span", "a", "li") else frozenset())

    def handle_data(self, data: str) -> None:
        if self.open[-1].mark != NEVER:
            self.text.append(data)

    def close(self) -> None:
        super().close()
        self._end_block()


def blocks_of(html: str | None) -> tuple[list[str], list[bool], list[bool]]:
    """All blocks of the page; which of them structure leaves in: those of articles, or else those of articles in a form or a marked element, or else all outside marked elements; and which are an article's own paragraphs and the like."""
    parser = BlockParser()
    parser.feed(CUT.sub("", html or ""))
    parser.close()
    own = parser.blocks
    ways = ([b.article and b.mark == NOT_MARKED for b in own], [b.article and b.mark == WRAPS for b in own], [b.mark == NOT_MARKED for b in own])
    stays = next((w for w in ways if any(w)), [False] * len(own))
    return [b.text for b in own], stays, [s and b.holder for s, b in zip(stays, own, strict=True)]


def middle(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence with b. A row of the table is one number, whose bits say where the length doesn't grow; about
    the square root of the rows are kept, the others made again on the way back."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    every, whole = max(1, math.isqrt(len(a))), (1 << len(b)) - 1

    def rows(row: int, symbols: list[int]) -> Iterator[int]:
        for x in symbols:
            both = row & places.get(x, 0)
            row = (row + both | row - both) & whole
            yield row

    kept, row = [whole], whole
    for at in range(0, len(a), every):
        for row in rows(row, a[at : at + every]):
            pass
        kept.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        first = (i - 1) // every * every
        table = [kept[first // every], *rows(kept[first // every], a[first:i])]
        while i > first and j:
            if table[i - first] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if i == 0 or table[i - first] >> (j - 1) & 1:
                    j -= 1
                    out.append(i)
    return out[::-1]


def common(a: list[str], b: list[str]) -> list[int]:
    """Places in a of a longest common subsequence with b."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    both = {t: k for k, t in enumerate(sorted(set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])))}
    x = [i for i in range(head, len(a) - tail) if a[i] in both]
    y = [j for j in range(head, len(b) - tail) if b[j] in both]
    inner = middle([both[a[i]] for i in x], [both[b[j]] for j in y]) if x else []
    return [*range(head), *(x[i] for i in inner), *range(len(a) - tail, len(a))]


def shared_places(blocks: list[str], fixed: list[bool] | tuple[bool, ...], neighbours: list[list[str]]) -> set[int]:
    """Places of the page's blocks that a neighbour, unless all of its blocks are the same, shares in order; fixed ones aren't taken."""
    gone: set[int] = set()
    for other in neighbours:
        if other != blocks:
            gone.update(i for i in common(blocks, other) if not fixed[i])
    return gone


def url_key(url: str | None) -> tuple[str, str]:
    """Host without www and port, and path without a last slash."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").removeprefix("www."), parts.path.rstrip("/")
    except ValueError:
        return "", url or ""


def stay_texts(page: tuple[list[str], list[bool], list[bool]]) -> list[str]:
    return [t for t, stay in zip(page[0], page[1], strict=True) if stay]


def short_name(text: str) -> str:
    """Stands for a block where texts are only compared."""
    return "\0" + hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()[:22] if len(text) > 23 else text


def digest(host: str, blocks: list[str]) -> bytes:
    """Of host and blocks, which hold no line breaks."""
    return hashlib.md5("\n".join((host, *blocks)).encode("utf-8", "surrogatepass")).digest()


def beyond(found: list[tuple[int, list[tuple], list[tuple]]]) -> dict[tuple, list[int]]:
    """The ranges that each outer page goes to, from (range, its first pages, its last ones): the outer page and the nearest that differs from it, if any, as (key, digest)."""
    sent: dict[tuple, list[int]] = {}
    for ranges, outer, inner in ((found, 1, 2), (found[::-1], 2, 1)):
        last: tuple | None = None
        other: tuple | None = None  # the nearest that differs from the last
        for row in ranges:
            near = other if last is not None and last[-1] == row[outer][0][-1] else last
            if near is not None:
                sent.setdefault(near, []).append(row[0])
            end = row[inner]
            other = end[1] if len(end) > 1 else other if last is not None and last[-1] == end[0][-1] else last
            last = end[0]
    return sent


def split_keys(keys: DataFrame, ranges: int) -> list[tuple]:
    """At most ranges - 1 keys, in order, that begin a range; drawn by their hash."""
    return sorted({tuple(r) for r in keys.orderBy(F.xxhash64(*KEY), *KEY).limit(ranges - 1).collect()}) if ranges > 1 else []


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", range_pages: int = RANGE_PAGES) -> DataFrame:
    """id_col, url_col, text, n_chars, n_lines (all blocks of the page) and n_shared (those that differencing deletes) of each page."""
    kind = pages.schema[id_col].dataType.simpleString()
    missing = "" if kind == "string" else 0
    spark = pages.sparkSession

    def keys_of(batch: pa.RecordBatch) -> list[tuple]:
        ids = batch.column(id_col).to_pylist()
        return [(*url_key(u), i is not None, missing if i is None else i) for u, i in zip(batch.column(url_col).to_pylist(), ids, strict=True)]

    key_types = [pa.string(), pa.string(), pa.bool_(), pages.select(F.coalesce(id_col, F.lit(missing).cast(kind)).alias("id")).limit(0).toArrow().schema.field("id").type]
    key_schema = f"host string, path string, has boolean, id {kind}"

    def columns_of(keys: list[tuple]) -> list[pa.Array]:
        return [pa.array([k[i] for k in keys], t) for i, t in enumerate(key_types)]

    def locate(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = keys_of(batch)
        return pa.RecordBatch.from_arrays([*columns_of(keys), pa.array([bisect_right(splits, k) for k in keys], pa.int32())], [*KEY, "part"])

    splits: list[tuple] = []
    urls = pages.select(id_col, url_col)
    ranges = max(1, min(MAX_RANGES, pages.count() // range_pages))
    drawn = split_keys(urls.mapInArrow(by_batch(locate), f"{key_schema}, part int").select(*KEY), ranges)
    splits = drawn

    def outline(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = keys_of(batch)
        digests = [digest(k[0], stay_texts(blocks_of(h))) for k, h in zip(keys, batch.column(html_col).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*columns_of(keys), pa.array([bisect_right(drawn, k) for k in keys], pa.int32()), pa.array(digests, pa.binary())], [*KEY, "part", "digest"])

    beside: dict[tuple, list[int]] = {}
    if drawn:
        each = pages.select(id_col, url_col, html_col).mapInArrow(by_batch(outline), f"{key_schema}, part int, digest binary").groupBy("part", "digest")
        runs = each.agg(F.min(F.struct(*KEY)).alias("first"), F.max(F.struct(*KEY)).alias("last"))
        two = [F.slice(F.sort_array(F.collect_list(F.struct(c, "digest")), asc=c == "first"), 1, 2).alias(c) for c in ("first", "last")]
        flat = lambda pages_: [(*x[0], bytes(x[1])) for x in pages_]
        beside = beyond(sorted((r["part"], flat(r["first"]), flat(r["last"])) for r in runs.groupBy("part").agg(*two).collect()))  # one row a range
    shared = spark.sparkContext.broadcast((drawn, beside))

    def parse(batch: pa.RecordBatch) -> pa.RecordBatch:
        starts, near = shared.value
        keys = keys_of(batch)
        own = [blocks_of(h) for h in batch.column(html_col).to_pylist()]
        digests = [digest(k[0], stay_texts(o)) for k, o in zip(keys, own, strict=True)]
        rows = [(i, part, g > 0) for i, k in enumerate(keys) for g, part in enumerate((bisect_right(starts, k), *near.get((*k, digests[i]), ())))]
        at = pa.array([i for i, _, _ in rows], pa.int64())
        columns = [batch.column(id_col).take(at), batch.column(url_col).take(at), *(c.take(at) for c in columns_of(keys)), pa.array([p for _, p, _ in rows], pa.int32()), pa.array([g for _, _, g in rows], pa.bool_()), pa.array(digests, pa.binary()).take(at)]
        short = [[t if stay else short_name(t) for t, stay in zip(o[0], o[1], strict=True)] for o in own]  # what can't be in the result is only compared
        columns += [pa.array([short[i] for i, _, _ in rows], pa.list_(pa.string())), *(pa.array([own[i][k] for i, _, _ in rows], pa.list_(pa.bool_())) for k in (1, 2))]
        return pa.RecordBatch.from_arrays(columns, ["__id", "__url", *KEY, "part", "ghost", "digest", "blocks", "stays", "fixed"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: dict | None = None
        page: dict | None = None  # the first of a run of copies
        run: list[tuple] = []
        out: list[tuple] = []

        def close(after: dict | None) -> None:
            near = [x["blocks"] for x in (before, after) if run and x is not None and x["part"] == page["part"] and x["host"] == page["host"] != ""]
            made: dict[tuple, tuple[str, int]] = {}
            for i, u, *own in run:
                blocks, stays, fixed = own
                if (key := tuple(map(tuple, own))) not in made:
                    gone = shared_places(blocks, fixed, near)
                    made[key] = " ".join(t for k, (t, stay) in enumerate(zip(blocks, stays, strict=True)) if stay and k not in gone), len(gone)
                text, shared_lines = made[key]
                out.append((i, u, text, len(text), len(blocks), shared_lines))
            run.clear()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((key_types[3], pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], [id_col, url_col, "text", "n_chars", "n_lines", "n_shared"])
            out.clear()
            return made

        for batch in slices(batches):
            for row in batch.to_pylist():
                if page is None or (row["part"], row["digest"]) != (page["part"], page["digest"]):
                    close(row)
                    before, page = page, row | {"names": {}}  # of a run of copies, a text is held once
                if not row["ghost"]:
                    run.append((row["__id"], row["__url"], [page["names"].setdefault(t, t) for t in row["blocks"]], row["stays"], row["fixed"]))
            if out:
                yield flush()
        close(None)
        if out:
            yield flush()

    parsed = pages.select(id_col, url_col, html_col).mapInArrow(by_batch(parse), f"__id {kind}, __url string, {key_schema}, part int, ghost boolean, digest binary, blocks array<string>, stays array<boolean>, fixed array<boolean>")
    ordered = parsed.repartition(ranges, "part").sortWithinPartitions("part", *KEY, "digest")
    return ordered.mapInArrow(pair, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long, n_lines long, n_shared long")
