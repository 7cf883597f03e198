"""Archives read back, and rendered pages."""

import gzip
import hashlib
import io
import re
import json

import numpy as np
import pytest

from strandloom.llm import html_text, warc

ROWS = [
    (5, "http://a/1", "<p>" + "x" * 200), (2, "http://a/2 é\r\nInjected: 1", "<p>" + "x" * 200), (9, None, "<p>" + "x" * 200), (7, "u", "short"), (8, "u", "short"), (1, "u", None), (3, "u", ""),
    (None, "u", "<p>" + "x" * 200), (4, "u", "ü" * 60 + "WARC/1.1\r\n\r\n"), (4, "u", "ü" * 60 + "WARC/1.1\r\n\r\n"), (6, "u", "y" * 100), (10, "u", "y" * 100), (11, "u", "z" * 99), (12, "u", "z" * 99),
]


def expected():
    own = {}
    for p, _, h in ROWS:
        b = (h or "").encode()
        if p is not None and len(b) >= 100:
            own[b] = min(p, own.get(b, p))
    out = []
    for p, _, h in ROWS:
        b = (h or "").encode()
        again = p is not None and len(b) >= 100 and own[b] < p
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", own[b] if again else None))
    return sorted(map(repr, out))


def test_round_trip(spark, write_tables):
    d = write_tables(pages=spark.createDataFrame([(*r, "e") for r in ROWS], "page_id long, url string, html string, digest string"))
    assert sorted(map(repr, map(tuple, warc.op4_warc(spark, d).collect()))) == expected()
    d = write_tables(pages=spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.op4_warc(spark, d).count() == 0


def test_files_roll_and_come_out_the_same(spark, work, tmp_path):
    df = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}" * 300) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    p = warc.WarcParams(roll_bytes=2000)
    one, root1 = warc.write_archives(df, work, p, "one")
    two, root2 = warc.write_archives(df, work, p, "two")
    files = lambda m: sorted((r["file"], r["bytes"], r["records"], r["sha256"]) for r in m.collect())
    assert files(one) == files(two) and len(files(one)) > 4
    import os

    names = os.listdir(root1.removeprefix("file://"))
    assert not [n for n in names if n.startswith(".shard") and not n.endswith(".crc")]
    listed = [f["file"] for n in names if n.startswith("manifest-") for f in json.load(open(f"{root1.removeprefix('file://')}/{n}"))]
    assert sorted(listed) == [x[0] for x in files(one)]
    raw = gzip.open(f"{root1.removeprefix('file://')}/{files(one)[0][0]}").read()
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")


def test_damage_is_noticed(spark, work):
    df = spark.createDataFrame([(i, "u", f"<p>{i}" * 100) for i in range(5)], "page_id long, url string, html string")
    m, root = warc.write_archives(df, work, warc.WarcParams(level=0), "bad")
    f = f"{root.removeprefix('file://')}/{m.first()['file']}"
    data = bytearray(open(f, "rb").read())
    data[len(data) // 2] ^= 1
    open(f, "wb").write(data)
    with pytest.raises(Exception):
        warc.read_archives(m, root).collect()


def test_members_across_chunks():
    data = b"".join(gzip.compress(bytes([k]) * 5000) for k in range(20))
    for chunk in (7, 1 << 16):
        assert [m[:1] for m in warc.members(io.BytesIO(data), hashlib.sha256(), chunk)] == [bytes([k]) for k in range(20)]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-5]), hashlib.sha256()))


PAGES = [
    ("<p>a<p>b", "a\n\nb"),
    ("<div>a<div>b</div>c</div>d", "a\nb\nc\nd"),
    ("a <b>bold</b> word", "a bold word"),
    ("x<br>y<br/>z", "x\ny\nz"),
    ("<ul><li>one<li>two<ul><li>in</ul></ul>after", "- one\n- two\n  - in\n\nafter"),
    ("<ol start=3><li>c<li>d</ol>", "3. c\n4. d"),
    ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"),
    ("<table><tr><th>h<tr><td>x</table>tail", "h\nx\n\ntail"),
    ("<pre>  two\n   three</pre>", "  two\n   three"),
    ("<script>var a='<p>no</p>'</script>yes<style>p{}</style>", "yes"),
    ("<div hidden>no</div><p style='color:red; DISPLAY : none'>no</p>yes", "yes"),
    ("<p style=\"visibility:hidden\">no<b>no</b></p>yes", "yes"),
    ("<head><title>t</title></head><body>b", "b"),
    ("<!-- a > b --><p>x</p><!doctype html><?pi ?>", "x"),
    ("&lt;a&gt; &amp; &eacute;&#233;", "<a> & éé"),
    ("1 < 2 and 3>2", "1 < 2 and 3>2"),
    ("<a href='x>y'>l</a>", "l"),
    ("<p title=\"never ends>z", "z"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details>", "s\ns\nyes"),
    ("</p></div></x>a", "a"),
    ("<b><p>x</b>y</p>z", "x\n\ny\n\nz"),
    ("<table><tr><td colspan=2>wide<td>r<tr><td>a<td>b<td>c</table>", "wide  r\na  b  c"),
    ("<noscript>no</noscript><template><p>no</template>x", "x"),
    ("<h1>T</h1><p>p", "T\n\np"),
    ("  \n ", ""),
    ("<p>a</p>\n\n<p>b</p>", "a\n\nb"),
    ("a b  c", "a b c"),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_pages(html, text):
    if "colspan" in html:
        lines = html_text.visible_text(html).split("\n")
        assert lines[0].split() == ["wide", "r"] and lines[1].split() == ["a", "b", "c"] and lines[0].index("r") == lines[1].index("c")
    else:
        assert html_text.visible_text(html) == text


def test_no_text_is_lost_by_an_independent_reader():
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.skip, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "title")

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    page = "<html><head><title>t</title><style>x</style></head><body><nav><ul><li>a b</li><li>c</li></ul></nav><h1>H</h1><p>some <i>words</i> here.</p><table><tr><td>1</td><td>two</td></tr></table><script>f()</script></body></html>"
    p = Plain()
    p.feed(page)
    assert sorted(" ".join(p.out).split()) == sorted(html_text.visible_text(page).replace("- ", "").split())


def test_deep_and_large_pages_are_fast():
    assert html_text.visible_text("<div>" * 50_000 + "x") == "x"
    assert html_text.visible_text("<" * 100_000).count("<") == 100_000
    assert html_text.visible_text("<p a='" * 3_000) is not None


def test_query(spark, write_tables):
    d = write_tables(pages=spark.createDataFrame([(1, None, None), (None, "u", "<p>x"), (2, "u", "")], "page_id long, url string, html string"))
    assert sorted((r["page_id"] or 0, r["n_chars"], r["text"]) for r in html_text.op9_html_text(spark, d).collect()) == [(0, 1, "x"), (1, 0, ""), (2, 0, "")]
    d = write_tables(pages=spark.createDataFrame([], "page_id long, url string, html string"))
    assert html_text.op9_html_text(spark, d).count() == 0


@pytest.mark.parametrize(
    "page,text",
    [
        ("<p><svg/> Hello</p>", "Hello"),
        ("<p><math/>Hello</p>", "Hello"),
        ("<p><svg><path d='M0'/><title/><g/></svg>Hello <b>x</b></p>", "Hello x"),
        ("<p><svg><g>not shown<text>one</text><text>two <tspan>three</tspan></text></g><defs><text>no</text></defs></svg> after</p>", "one two three after"),
        ("<p><svg><foreignObject><i>in</i></foreignObject></svg> after</p>", "in after"),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds</p>", "so x=1 holds"),
        ("<head><title>t</title>Hello <a>x</a>", "Hello x"),
        ("<head><title>t</title><a>x</a> y", "x y"),
        ("<head>\n<meta a=b><script>1</script>\n<title>t</title></head><body>b", "b"),
        ("<p>say <textarea>\none  &amp; two</textarea> now</p>", "say one  & two now"),
        ("<p>pick <select><option>one<option>two</select> now</p>", "pick one two now"),
        ("<p>a <span/>b <svg width=5/>c</svg> d</p>", "a b d"),
        ("<p>x<datalist><option>no</option></datalist></p>", "x"),
    ],
)
def test_all_that_a_browser_shows(page, text):
    assert html_text.visible_text(page) == text


def test_columns_of_any_width_begin_at_one_place():
    page = "<table><tr><td>" + "x" * 70 + "<td>a<td>e<tr><td>y<td>b<td>f<tr><td colspan=2>" + "z" * 90 + "<td>g</table>"
    one, two, three = html_text.visible_text(page).split("\n")
    assert one.index("a") == two.index("b") == 72 and one.index("e") == two.index("f") == three.index("g") == 92
    assert html_text.visible_text("<object>fallback</object> x<object data=a>no</object>") == "fallback x"


def test_padding_is_bounded_by_the_table():
    page = "<table><tr><td>" + "x" * 200_000 + "<td>a" + "<tr><td>y<td>b" * 2000 + "</table>"
    text = html_text.visible_text(page)
    assert len(text) < 300_000 and text.endswith("y  b")


SAMPLE = "/root/testdata/sf0.01/pages.parquet"


@pytest.mark.skipif(not __import__("os").path.exists(SAMPLE), reason="no test tables")
def test_all_words_of_given_pages_by_an_independent_reader():
    """Python's own parser, which has no tree: elements never shown are skipped by their tags, hidden ones by a stack."""
    from html.parser import HTMLParser

    import pandas as pd

    never = {"head", "title", "script", "style", "noscript", "template", "iframe", "canvas", "video", "audio", "svg", "math"}
    void = set("area base br col embed hr img input link meta param source track wbr".split())

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.out = [], []

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            off = tag in never or "hidden" in a or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style") or "", re.I))
            if tag not in void:
                self.stack.append((tag, off))
            else:
                self.out.append(" ")

        def handle_endtag(self, tag):
            at = [k for k, (t, _) in enumerate(self.stack) if t == tag]
            if at:
                del self.stack[at[-1] :]

        def handle_data(self, data):
            if not any(off for _, off in self.stack):
                self.out.append(data)

    marks = re.compile(r"^ *(?:(?:-|[0-9]+\.) +)+", re.M)
    pages = pd.read_parquet(SAMPLE)["html"]
    assert len(pages) > 100
    for page in pages:
        p = Plain()
        p.feed(page or "")
        want = re.sub(r"\s", "", "".join(p.out))
        got = re.sub(r"\s", "", marks.sub("", html_text.visible_text(page)))
        assert sorted(want.replace("-", "")) == sorted(got.replace("-", "")), page[:300]


def test_repeated_rows_and_clashing_names(spark, write_tables):
    rows = [(1, "<p>x", "t", 5, "y")] * 2 + [(None, None, None, None, None)]
    d = write_tables(pages=spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int, `a.b` string"))
    assert sorted((r["page_id"] or 0, r["text"]) for r in html_text.op9_html_text(spark, d).collect()) == [(0, ""), (1, "x"), (1, "x")]


def occupied(rows):
    """Where cells go, by a set of taken places."""
    taken, out = set(), []
    for r, row in enumerate(rows):
        c, fresh = 0, []
        for across, down in row:
            while (r, c) in taken:
                c += 1
            out.append((r, c))
            fresh += [(r + d, x, d < down) for d in range(1, max(down, 2)) for x in range(c, c + across) if down > 1]
            c += across
        # a later cell that covers a place decides how long it is covered
        for x in {x for _, x, _ in fresh}:
            taken -= {(q, y) for q, y in taken if y == x and q > r}
        taken |= {(q, x) for q, x, ok in fresh if ok}
    return out


def test_cells_find_their_columns():
    rng = np.random.default_rng(8)
    for _ in range(300):
        rows = [[(int(rng.integers(1, 5)), int(rng.integers(1, 5))) for _ in range(rng.integers(0, 5))] for _ in range(rng.integers(1, 8))]
        grid = html_text.Grid()
        for row in rows:
            grid.row()
            for across, down in row:
                grid.cell(["x"], across, down)
        assert [(r, c) for r, row in enumerate(grid.rows) for c, _, _ in row] == occupied(rows)


def test_wide_and_deep_cells_cost_no_more():
    import time

    for page in ("<table>" + "<tr><td colspan=1000 rowspan=65534>a" * 20_000, "<table>" + "".join(f"<tr><td colspan={1 + k % 1000} rowspan={2 + k % 7}>a<td>b" for k in range(10_000))):
        began = time.process_time()
        assert html_text.visible_text(page).count("a") >= 10_000
        assert time.process_time() - began < 10


@pytest.mark.parametrize("page, want", [("a<xmp><b>raw</b> &amp;\n  x</xmp>b", "a\n\n<b>raw</b> &amp;\n  x\n\nb"), ("<ruby>k<rp>(</rp><rt>kan</rt><rp>)</rp></ruby>", "kkan"), ("x <progress value=1>half</progress><meter>low</meter> y", "x y")])
def test_raw_text_and_fallbacks(page, want):
    assert html_text.visible_text(page) == want
