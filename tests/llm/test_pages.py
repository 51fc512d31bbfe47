"""Main text of pages: lines and kinds, alignment against the plain table, pairing over range edges, odd rows."""

import os
import random

import pytest

from tidewatch.llm.pages import extract, lines_of, main_text, shared

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var x = "<p>no</p>";</script></head><body class="has-comments">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu<li>Other</ul></nav><!-- <p>gone</p> -->
<div id="cookie-notice">We use cookies</div><div class="topAd">Buy</div>
<article class="post ad-free2"><header><h1>Head &amp; line</h1></header><p>One <b>bold</b>,\n\ttwo&nbsp;<i>three</i><br>four
<p>a &lt; b<script>hidden()</script> c<aside>side</aside><div class="comments"><article><p>First!</p></article></div>
<form><input value="x"><button>Go</button></form><ul><li>x<li>y</ul><table><tr><td>1<td>2</table><div class="ad">Ad</div><p title="a > b">end</p></article>
<p>stray</p><footer>&copy; Site</footer></body></html>"""


def text(html, gone=()):
    return main_text(*lines_of(html), set(gone))


def test_article_without_furniture():
    assert text(PAGE) == ["Head & line", "One bold, two three four", "a < b c", "x", "y", "1", "2", "end"]


def test_pages_without_an_article():
    assert text("<body><nav>m</nav><main><p>a</p><div class='share-links'>s</div><p>b</main><p>c") == ["a", "b"]
    assert text("<div class=content><p>a</div><div>b</div>") == ["a"]
    assert text("plain &quot;text&quot") == ['plain "text"']
    assert text("<p>a<p>b</div></p>c <unknown>d</unknown>") == ["a", "b", "c d"]
    assert text("<p>shared<p>own", [0]) == ["own"]
    assert text("<article><p>shared<p>own</article>", [0]) == ["shared", "own"]


@pytest.mark.parametrize("html", [None, "", " \n", "<", "<p", "<!--", "<script>x", "<a href='", "</p></p>", "<nav>only", "<![CDATA[x", "<p a=\"b>c"])
def test_broken_markup_ends(html):
    lines, kinds = lines_of(html)
    assert len(lines) == len(kinds) and all(lines)


def test_very_long_pages():
    lines, kinds = lines_of("<p>a" * 50_000 + "<div>" * 50_000)
    assert len(lines) == 50_000
    a = [random.Random(1).randrange(500) for _ in range(4000)]
    b = a[100:1500] + [-1] + a[1600:]
    assert len(shared(a, b)) >= len(a) - 200
    assert shared(list(range(3000)), list(range(3000))) == list(range(3000))


def plain_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b):
            diagonal, row[j + 1] = row[j + 1], diagonal + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_alignment_is_longest():
    rng = random.Random(5)
    for _ in range(500):
        k = rng.choice([1, 2, 4, 30])
        a, b = ([rng.randrange(k) for _ in range(rng.randrange(25))] for _ in "ab")
        got = shared(a, b)
        assert got == sorted(set(got)) and len(got) == plain_length(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in got)


ROWS = [(i, f"http{'s' * (i % 2)}://user@H{i % 3}.example:80/{'news' if i % 2 else 'blog'}/{i:03d}?q=1#f",
         f"<div>Top of {i % 3}</div><p>words of page {i}</p><p>more {i % 5}</p><div>All rights reserved {i % 3}</div>") for i in range(60)]
ROWS += [(None, None, "<p>x"), (None, None, "<p>x"), (7, "not a url", None), (8, "http://alone.example", "<p>kept"), (0, ROWS[0][1], ROWS[0][2])]


def plain(rows):
    """Every distinct row against the nearer of the two beside it in the order of host, path and key."""
    def place(url):
        rest = (url or "").split("://", 1)
        if len(rest) < 2:
            return None, ""
        tail = rest[1].split("#")[0].split("?")[0]
        host, _, path = tail.partition("/")
        return host.split("@")[-1].split(":")[0].lower() or None, "/" + path if "/" in tail else ""
    out = {}
    for row in set(rows):
        host, path = place(row[1])
        lines, kinds = lines_of(row[2])
        mates = sorted({(place(r[1])[1], r) for r in rows if place(r[1])[0] == host and r != row}, key=lambda x: x[0]) if host else []
        before = [m for m in mates if m[0] <= path]
        after = [m for m in mates if m[0] > path]
        near = max([m for m in (before[-1:] + after[:1])], key=lambda m: len(os.path.commonprefix([m[0], path])), default=None)
        gone = shared(lines, lines_of(near[1][2])[0]) if near else []
        out[row] = "\n".join(main_text(lines, kinds, set(gone)))
    return [(r[0], r[1], out[r]) for r in rows]


@pytest.mark.parametrize("parts", ["1", "5", "37"])
def test_differencing_deletes_what_neighbours_share(spark, parts):
    """Whatever the number of ranges; other columns, repeated rows, null ids, urls and html."""
    df = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "page_id long, url string, html string, k1 int, shared string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = [(r.page_id, r.url, r.text) for r in extract(df).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    key = lambda r: (str(r[0]), str(r[1]), r[2])
    assert sorted(got, key=key) == sorted(plain(ROWS), key=key)
    assert not any("Top of" in t or "rights" in t for _, _, t in got)


def test_counts_and_empty_table(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    rows = extract(df).collect()
    assert all(r.n_chars == len(r.text) and r.n_shared <= r.n_lines for r in rows)
    assert extract(df.filter("false")).count() == 0
