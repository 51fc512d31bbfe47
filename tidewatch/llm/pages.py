"""Main text of web pages: structure of the markup, and differencing with the page of the nearest URL.

1. Every page is cut into *lines*: the text between two block boundaries, character references decoded, white
   space (any Unicode kind) turned into one space, trimmed; empty lines do not count.  A line is *furniture*
   if it is in an element that HTML or its author names so (menus, page headers and footers, sidebars, adverts,
   notices, forms, scripts, styles, reader comments), *declared* if it is in an article, *likely* if it is in
   a main or content element, else *free*.
2. Pages are ordered by host and URL path.  Each page is paired with whichever neighbour of its host has the
   longer common path prefix (ties: the one before), and their lines are aligned by a longest common subsequence.
   The order is one range-partitioned sort, so a host of any size is spread over tasks; the last page before
   and the first after each range come from a table with one row per range.
3. Shared lines that no article declares are deleted.  A page with declared lines keeps those, else one with
   likely lines keeps what is left of those, else what is left of the free ones.  Furniture always goes.

Lines within a declared article stay though the neighbour has them too: articles quote one another.

Edge cases: null or empty html gives an empty text; a page whose URL has no host, or that is alone on its host,
has no partner; equal rows get equal results, each row one; null page_id and url are kept; other columns of
the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewatch.session import stage, unstage

FURNITURE, FREE, LIKELY, DECLARED = 0, 1, 2, 3

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>script|style|textarea|title|iframe|noframes)\b(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+(?:>.*?(?:</(?P=raw)\s*[^>]*>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.IGNORECASE | re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are furniture wherever they stand; ``header`` only outside an article.
FURNITURE_TAGS = frozenset("nav aside footer form head noscript template button select dialog menu search object svg math audio video canvas".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of a class or id that name furniture.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion menu nav navbar navigation breadcrumb "
    "breadcrumbs masthead footer sidebar cookie cookies consent gdpr notice notices banner alert popup modal overlay newsletter "
    "subscribe subscription signup login comment comments disqus respond reply replies share sharing social related recommended "
    "toolbar pagination pager skip commentlist commentform adsbygoogle topnav sidenav subnav cookiebar cookiebanner".split())
CONTENT_WORDS = frozenset("article articlebody content entry main post story".split())
#: An element that a start tag of the key closes if it is the innermost open one.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)}


def _words(value: str) -> set[str]:
    return {w.lower() for w in NAME_PARTS.findall(entities.unescape(value))} | set(value.lower().split())


def _kind(name: str, attrs: str, around: int) -> int:
    """Kind of the lines in an element, given the kind of its parent's."""
    if around == FURNITURE:
        return FURNITURE
    if name in FURNITURE_TAGS or (name == "header" and around != DECLARED):
        return FURNITURE
    named = _attributes(attrs) if attrs.strip(" /\t\n") else {}
    words = _words(named.get("class", "")) | _words(named.get("id", "")) if named else set()
    if name == "article":  # whole names only: "ad-free" is no advert
        words = set(f"{named.get('class', '')} {named.get('id', '')}".lower().split()) if named else set()
    if name not in ("html", "body", "main"):
        if words & FURNITURE_WORDS or named.get("role", "").lower() in FURNITURE_ROLES:
            return FURNITURE
        if "header" in words and around < LIKELY:
            return FURNITURE
    if name == "article" or named.get("role", "").lower() == "article" or named.get("itemprop", "").lower() == "articlebody":
        return DECLARED
    if name == "main" or named.get("role", "").lower() == "main" or (name in ("div", "section", "td") and words & CONTENT_WORDS):
        return max(around, LIKELY)
    return around


def lines_of(html: str | None) -> tuple[list[str], list[int]]:
    """The lines of a page and the kind of each."""
    lines: list[str] = []
    kinds: list[int] = []
    stack: list[tuple[str, int]] = []
    kind, run = FREE, []

    def flush() -> None:
        if run:
            line = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if line:
                lines.append(line)
                kinds.append(kind)

    for token in TOKEN.finditer(html or ""):
        text = token["text"]
        if text is not None:
            run.append(text)
            continue
        name = token["name"]
        if name is None:
            continue  # comments, declarations and raw elements leave nothing
        name = name.lower()
        block = name in BLOCKS
        if token["end"]:
            if block:
                flush()
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == name:
                    flush()
                    del stack[at:]
                    kind = stack[-1][1] if stack else FREE
                    break
            continue
        if block:
            flush()
            closed = CLOSES.get(name, ())
            while stack and (stack[-1][0] in closed or stack[-1][0] == "p"):
                stack.pop()
            kind = stack[-1][1] if stack else FREE
        elif name == "br":
            run.append(" ")
        if name in VOID:
            continue
        inner = _kind(name, token["attrs"], kind)
        # elements inside a line only matter if they change its kind
        if block or inner != kind:
            flush()
            stack.append((name, inner))
            kind = inner
    flush()
    return lines, kinds


def shared(a: list, b: list) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of ``a`` and ``b``.

    Rows of the table are bit strings; every root-of-n-th row is stored and the rows between are made
    again on the way back, so long pages take little memory.
    """
    lo, n, m = 0, len(a), len(b)
    while lo < n and lo < m and a[lo] == b[lo]:
        lo += 1
    while n > lo and m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    found = list(range(lo)) + list(range(n, len(a)))
    width = m - lo
    if not width or n == lo:
        return found
    where: dict = {}
    for j in range(width):
        where.setdefault(b[lo + j], []).append(j)
    kept = [i for i in range(lo, n) if a[i] in where]  # other rows change nothing
    masks: dict = {}

    def mask(value) -> int:
        got = masks.get(value)
        if got is None:
            got = 0
            for j in where[value]:
                got |= 1 << j
            if len(where[value]) > 16:
                masks[value] = got
        return got

    full = (1 << width) - 1

    def step(row: int, value) -> int:
        hit = row & mask(value)
        return ((row + hit) | (row - hit)) & full

    every = max(1, math.isqrt(len(kept)))
    stored, row = [], full
    for i, at in enumerate(kept):
        if i % every == 0:
            stored.append(row)
        row = step(row, a[at])
    col = width
    for block in range(len(stored) - 1, -1, -1):
        first = block * every
        rows = [stored[block]]
        for at in kept[first: first + every]:
            rows.append(step(rows[-1], a[at]))
        i = len(rows) - 1
        while i and col:
            if rows[i] >> (col - 1) & 1:
                col -= 1
            elif not rows[i - 1] >> (col - 1) & 1:
                i -= 1
            else:
                i, col = i - 1, col - 1
                found.append(kept[first + i])
        if not col:
            break
    return sorted(found)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (null if there is none) and path of a URL."""
    parts = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(parts != "", F.lower(parts)), F.coalesce(path, F.lit(""))


def _hashes(lines: list[str]) -> list[int]:
    return [hash_of(x) for x in lines]


def hash_of(line: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            made = [_hashes(lines_of(x.as_py())[0]) for x in part.column("html")]
            at = part.schema.get_field_index("html")
            yield part.set_column(at, "lines", pa.array(made, pa.list_(pa.int64())))


def _with_key(pages: DataFrame) -> DataFrame:
    """Two hashes that name a row by its content."""
    own = ["page_id", "url", "html"]
    return pages.select(*own).withColumns({"k1": F.xxhash64(*own), "k2": F.xxhash64(F.lit(7), F.reverse("html"), "page_id", "url")})


def neighbours(pages: DataFrame) -> DataFrame:
    """k1, k2, path, lines (hashes), and of the page before and after on the same host: path and lines, or null."""
    host, path = host_and_path(F.col("url"))
    rows = _with_key(pages).select("k1", "k2", host.alias("host"), path.alias("path"), "html").filter("host IS NOT NULL")
    made = rows.mapInArrow(_line_hashes, "k1 long, k2 long, host string, path string, lines array<long>")
    order = ["host", "path", "k1", "k2"]
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = made.dropDuplicates(["k1", "k2"]).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    ranges = stage(ranges, "pages_ranges")
    row = F.struct("host", "path", "lines")
    at = F.struct(*order)
    # one row per range: its first and last page, then those of the ranges beside it
    edges = ranges.groupBy("part").agg(F.min_by(row, at).alias("first"), F.max_by(row, at).alias("last"))
    by_part = W.orderBy("part")
    edges = edges.select("part", F.lag("last").over(by_part).alias("left"), F.lead("first").over(by_part).alias("right"))
    beside = W.partitionBy("part").orderBy(*order)
    near = ranges.withColumns({"before": F.lag(row).over(beside), "after": F.lead(row).over(beside)}).join(edges, "part")
    near = near.withColumns({"before": F.coalesce("before", "left"), "after": F.coalesce("after", "right")})
    same = lambda c: F.when(F.col(f"{c}.host") == F.col("host"), F.struct(f"{c}.path", f"{c}.lines"))
    out = near.select("k1", "k2", "path", "lines", same("before").alias("before"), same("after").alias("after"))
    out.ranges = ranges
    return out


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for r in batch.select(["path", "lines", "before", "after"]).to_pylist():
            near = [x for x in (r["before"], r["after"]) if x is not None]
            near = max(near, key=lambda x: len(os.path.commonprefix([x["path"], r["path"]])), default=None)
            found.append(shared(r["lines"], near["lines"]) if near else None)
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(found, pa.list_(pa.int32()))], ["k1", "k2", "shared"])


def main_text(lines: list[str], kinds: list[int], gone: set[int]) -> list[str]:
    """The lines that stay; ``gone`` are positions of shared ones."""
    best = max(kinds, default=FREE)
    if best == DECLARED:
        return [x for x, k in zip(lines, kinds) if k == DECLARED]
    level = LIKELY if best == LIKELY else FREE
    return [x for i, (x, k) in enumerate(zip(lines, kinds)) if k == level and i not in gone]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            texts, totals, counts = [], [], []
            for html, gone in zip(part.column("html"), part.column("shared")):
                lines, kinds = lines_of(html.as_py())
                gone = gone.as_py() or []
                texts.append("\n".join(main_text(lines, kinds, set(gone))))
                totals.append(len(lines))
                counts.append(len(gone))
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array(totals, pa.int64()), pa.array(counts, pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_lines", "n_shared"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, and n_lines and n_shared (lines that the paired page has too) of every row."""
    near = neighbours(pages)
    aligned = stage(near.mapInArrow(_align, "k1 long, k2 long, shared array<int>").filter(F.size("shared") > 0), "pages_shared")
    unstage(near.ranges)
    kind = pages.schema["page_id"].dataType.simpleString()
    both = _with_key(pages).join(aligned, ["k1", "k2"], "left").select("page_id", "url", "html", "shared")
    return both.mapInArrow(_texts, f"page_id {kind}, url string, text string, n_chars long, n_lines long, n_shared long")
