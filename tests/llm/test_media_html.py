"""GIF columns and HTML extraction."""

import os
import random
import struct

import numpy as np
import pytest

from clonespark.llm import gif
from clonespark.llm import html_extract as hx

from cases import ODD


def lzw(data, size):
    """A plain GIF encoder, with widening codes and deferred clears."""
    clear = 1 << size
    table, n, width, acc, held, out = {bytes([i]): i for i in range(clear)}, clear + 2, size + 1, 0, 0, bytearray()

    def emit(code):
        nonlocal acc, held
        acc |= code << held
        held += width
        while held >= 8:
            out.append(acc & 255)
            acc >>= 8
            held -= 8

    emit(clear)
    now = b""
    for x in data:
        new = now + bytes([x])
        if new in table:
            now = new
            continue
        emit(table[now])
        if n < 4096:
            table[new] = n
            n += 1
            if n - 1 == 1 << width and width < 12:
                width += 1
        now = bytes([x])
    if now:
        emit(table[now])
    emit(clear + 1)
    if held:
        out.append(acc & 255)
    return bytes(out)


@pytest.mark.parametrize("size", [2, 4, 8])
def test_lzw(size):
    draw = random.Random(size)
    for n in (0, 1, 3, 300, 5000, 60000):
        for pick in (lambda: draw.randrange(1 << size), lambda: draw.choice([0, 0, 0, 1, 3])):
            data = bytes(pick() for _ in range(n))
            assert gif.lzw_decode(lzw(data, size), size, n) == data
    assert gif.lzw_decode(b"\xff\xff", 8, 10) == b""


def test_literals_round_trip():
    for n in (1, 253, 254, 255, 508, 5000):
        data = bytes(random.Random(n).randrange(256) for _ in range(n))
        assert gif.lzw_decode(gif.lzw_literals(data), 8, n) == data


def test_stored_streams_have_dictionary_codes():
    draw = random.Random(1)
    for n in (0, 1, 2, 255, 5000, 60000):
        for data in (bytes(draw.randrange(256) for _ in range(n)), b"the cat and the dog " * (n // 20), bytes(n)):
            assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data
    text = b"the cat sat on the mat, and the dog sat by the cat. " * 240
    text += b" " * (-len(text) % gif.WIDTH)
    media = gif.encode(text)
    assert len(media) < len(text) // 2 and b"".join(f.samples for f in gif.frames(media)) == text


def test_frames_disposal_transparency_interlace():
    palette = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
    head = b"GIF89a" + struct.pack("<HHBBB", 2, 8, 0x81, 0, 0) + palette

    def frame(rect, samples, disposal=0, transparent=-1, flags=0):
        control = b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent >= 0), 7, max(transparent, 0)) + b"\0"
        return control + b"\x2c" + struct.pack("<HHHHB", *rect, flags) + b"\x02" + gif.sub_blocks(lzw(bytes(samples), 2))

    rows = [i % 3 for i in (0, 4, 2, 6, 1, 3, 5, 7) for _ in range(2)]  # interlaced order of rows 0..7
    media = head + frame((0, 0, 2, 8), rows, flags=0x40) + frame((0, 0, 1, 2), [1, 3], 3, 3) + frame((1, 7, 1, 1), [2], 2) + frame((0, 1, 1, 1), [0]) + b"\x3b"
    shown = [(f, f.canvas.copy()) for f in gif.frames(media)]
    colour = lambda c, y, x: c[y, x].tolist()
    assert [colour(shown[0][1], y, 0) for y in range(8)] == [np.frombuffer(palette, np.uint8).reshape(4, 3)[y % 3].tolist() for y in range(8)]
    assert colour(shown[1][1], 0, 0) == [0, 255, 0] and colour(shown[1][1], 1, 0) == [0, 255, 0]  # index 3 is transparent: row 1 stays
    assert colour(shown[2][1], 0, 0) == [255, 0, 0]  # restored
    assert colour(shown[3][1], 7, 1) == [0, 0, 0]  # cleared
    assert shown[0][0].delay_ms == 70 and sum(shown[0][0].histogram()) == 16


def test_columns(odd, empty, spark):
    rows = gif.decode_media(gif.encode_texts(odd)).collect()
    assert sorted(bytes(r.samples) for r in rows) == sorted((b := (t or "").encode()) + b" " * (-len(b) % 192 or (0 if b else 192)) for _, t in ODD)
    assert all(sum(f.histogram) == rows[0].frames[0].width * min(f.height, 64) or f.height < 64 for r in rows for f in r.frames)
    bad = spark.createDataFrame([(1, bytearray(b"no gif")), (2, None)], "doc_id long, media binary")
    assert [(r.samples, r.frames) for r in gif.decode_media(bad).orderBy("doc_id").collect()] == [(b"", []), (None, None)]
    assert gif.decode_media(gif.encode_texts(empty)).count() == 0


PAGE = """<html><head><title>t</title><script>var a="</p><p>x";</script></head><body><nav><ul>{nav}</ul></nav>
<aside>buy</aside><div class="ad">spam</div>{open}<h1>{title}</h1>{body}<form>name</form><div class="comments"><p>first!</p></div>{close}
<footer>&copy; all</footer></body></html>"""


def page(i, article=True):
    body = "".join(f"<p>Para {i} {k} &amp; <b>bold</b>\n text</p>" for k in range(1 + i % 4))
    nav = "".join(f"<li><a>n{k}</a></li>" for k in range(2 + i % 3))
    want = "\n".join([f"Title {i}", *(f"Para {i} {k} & bold text" for k in range(1 + i % 4))])
    return PAGE.format(nav=nav, title=f"Title {i}", body=body, open="<article>" if article else '<div class="story">', close="</article>" if article else "</div>"), want


@pytest.mark.parametrize("article", [True, False])
def test_pages(spark, article):
    made = [page(i, article) for i in range(12)]
    rows = [(i, f"https://Host.example/{i}", h) for i, (h, _) in enumerate(made)]
    got = {r.page_id: r.text for r in hx.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(made)}


def test_wrapper_is_union_free():
    w = hx.infer([page(i)[0] for i in range(6)])
    kinds = set()

    def walk(items):
        for x in items:
            kinds.add(x[0][0])
            if x[0] in "+?":
                assert x[1]
                walk(x[1])

    walk(w)
    assert "+" in kinds and ["#", None] in [x[:2] for x in w]


def test_pages_odd(spark):
    rows = [(1, "http://a/x", None), (2, None, ""), (3, "nonsense", "plain < text & more"), (None, "http://a/y", "<p>unclosed"), (4, "http://a/z", "<article>" + "<p>w</p>" * 20000), (4, "http://a/z", "<!-- open"), (5, "http://b/", "<script>never closed <p>x")]
    got = hx.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    told = {(r.page_id, r.text) for r in got}
    assert {(1, ""), (2, ""), (3, "plain < text & more"), (None, "unclosed"), (5, "")} <= told
    assert ("\n".join(["w"] * 20000)) in {r.text for r in got if r.page_id == 4}
    assert all(r.n_chars == len(r.text) for r in got)
    assert hx.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def texts(spark, pages, **more):
    rows = [(i, f"https://{host}/{i}", h) for i, (host, h) in enumerate(pages)]
    found = hx.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    return [r.text for r in sorted(found, key=lambda r: r.page_id)]


def test_template_inside_the_article(spark):
    made = [
        f'<body><article><h1>Title {i}</h1><p>Own {i}, <i>really</i></p><div class="box"><p>Read on our app</p></div>' + (f"<blockquote>Said {i}</blockquote>" if i % 5 == 0 else "") + "<p>Thank you</p></article></body>"
        for i in range(20)
    ]
    want = [f"Title {i}\nOwn {i}, really" + (f"\nSaid {i}" if i % 5 == 0 else "") for i in range(20)]
    got = texts(spark, [("a.example", h) for h in made])
    assert got == want


def test_templates_that_few_pages_use(spark):
    story = '<body><div class="top">Site</div><div class="story"><h1>T {i}</h1><p>Text {i}</p></div></body>'
    post = '<body><div class="top">Site</div><div class="post"><h1>T {i}</h1><p>Text {i}</p></div></body>'
    broken = '<body><div class="top">Site</div><div class="a  story\n">T {i}</div></body>'
    pages = [("a.example", (post if i in (7, 31) else story).format(i=i)) for i in range(40)] + [("b.example", broken.format(i=i)) for i in range(40, 46)]
    assert texts(spark, pages) == [f"T {i}\nText {i}" for i in range(40)] + [f"T {i}" for i in range(40, 46)]


def test_more_shapes_than_one_task_merges(spark, monkeypatch):
    monkeypatch.setattr(hx, "BLOCKS", 3)
    pages = [("a.example", '<body><div class="top">Site</div><div class="story">' + "".join(f"<{t}>{t} {i}</{t}>" for k, t in enumerate(("h1", "h2", "h3", "p", "pre")) if k == 0 or i >> k - 1 & 1) + "</div></body>") for i in range(32)]
    assert texts(spark, pages) == ["\n".join(f"{t} {i}" for k, t in enumerate(("h1", "h2", "h3", "p", "pre")) if k == 0 or i >> k - 1 & 1) for i in range(32)]


def test_copies_support_no_template(spark):
    one = "<body><div><h1>Title</h1><p>First</p><p>Second</p></div></body>"
    same = "<body><div>" + "<p>again</p>" * 3 + "</div></body>"
    near = ["<body><nav>{i}</nav><div><h1>Title</h1><p>First</p></div></body>".format(i=i) for i in range(3)]
    got = texts(spark, [("a.example", one)] * 3 + [("b.example", same)] + [("c.example", h) for h in near])
    assert got == ["Title\nFirst\nSecond"] * 3 + ["again\nagain\nagain"] + ["Title\nFirst"] * 3


def test_long_streams_are_aligned():
    draw = random.Random(5)
    a, b = ([draw.choice("abcdefgh") for _ in range(n)] for n in (300, 250))
    best = [[0] * 251 for _ in range(301)]
    for i in range(299, -1, -1):
        for j in range(249, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    pairs = hx.common(a, b)
    assert len(pairs) == best[0][0] and all(a[i] == b[j] for i, j in pairs) and all(p < q and i < j for (p, i), (q, j) in zip(pairs, pairs[1:]))
    a = [f"<p x{i}" for i in range(2500)]
    assert len(hx.common(["<u", *a, "<v"], ["<w", *a, "<z"])) == 2500


def test_repeats_of_any_length():
    entry = "".join(f"<h{n}>t</h{n}><p>x</p><div>y</div>" for n in range(1, 7))
    w = hx.infer([f"<body><div class='list'>{entry * n}</div></body>" for n in (1, 4)])
    assert len([x for x in w if x[0] == "+"]) == 1 and "?" not in {x[0] for x in w}


@pytest.mark.parametrize("part", ['<a "', "<a ", "<", "<!x", "</script", "<a \"'", "<script></script", '<p class="x" '])
def test_pages_of_unclosed_tags_take_linear_time(part):
    import time

    took = []
    for n in (20_000, 160_000):
        start = time.process_time()
        hx.extract(part * n, None)
        took.append(time.process_time() - start)
    assert took[1] < 32 * took[0] + 0.5  # 64 times as much if it were quadratic


def test_tags_end_outside_quotes():
    told = hx.tokens("""a<b c="x>y" d='">'>t<e "f<!-- <i> -->g<script>1<2</SCRIPT x><!doctype z><?q>h<j""")
    assert told == [("#", "a", False), ("<b", "", False), ("#", 't<e "fg', False), ("<script", "", True), ("</script", "", False), ("#", "h<j", False)]


def test_equal_neighbours_are_found():
    draw = random.Random(4)
    for _ in range(2000):
        codes, size = np.array([draw.randrange(3) for _ in range(draw.randrange(2, 40))]), draw.randrange(1, 12)
        if len(codes) >= 2 * size:
            want = any((codes[i : i + size] == codes[i + size : i + 2 * size]).all() for i in range(len(codes) - 2 * size + 1))
            assert hx.square(codes, size) == want


def test_extra_columns(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(1, "http://h/1", "<body><p>own words here</p></body>")], "page_id long, url string, html string")
    for c in ("host", "told", "h", "n", "text", "n_chars"):
        pages = pages.withColumn(c, F.lit(1))
    assert [tuple(r) for r in hx.extract_pages(pages).collect()] == [(1, "http://h/1", "own words here", 14)]


def read_plainly(page):
    """The article's blocks by the standard library's parser: what stands in <article>, without elements of their own kind in it."""
    from html.parser import HTMLParser

    blocks = "address article aside blockquote body dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
    lines, words, state = [], [], {"article": 0, "skip": []}

    def end():
        text = " ".join("".join(words).split())
        if text:
            lines.append(text)
        words.clear()

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag in blocks:
                end()
            if state["skip"]:
                state["skip"] += [tag] * (tag == state["skip"][0])
            elif tag in ("nav", "aside", "footer", "form", "script", "style", "button", "select", "noscript", "iframe", "svg") or {"ad", "comments", "share", "related"} & set((dict(attrs).get("class") or "").split()):
                state["skip"].append(tag)
            elif tag == "article":
                state["article"] += 1
            elif tag == "br":
                words.append(" ")

        def handle_endtag(self, tag):
            if tag in blocks:
                end()
            if state["skip"]:
                if tag == state["skip"][0]:
                    state["skip"].pop()
            elif tag == "article":
                state["article"] -= 1

        def handle_data(self, data):
            if state["article"] and not state["skip"]:
                words.append(data)

    reader = Reader(convert_charrefs=True)
    reader.feed(page)
    reader.close()
    end()
    return "\n".join(lines)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_pages_of_the_tables_as_a_plain_parser_reads_them(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html or "" for r in pages.collect()}
    got = {r.page_id: r.text for r in hx.extract_pages(pages).collect()}
    assert got.keys() == html.keys() and sum(map(len, got.values())) > 10_000
    assert {i for i in html if "<article" in html[i] and got[i] != read_plainly(html[i])} == set()


@pytest.mark.parametrize("depth", [140, 160, 1000, 1900])
def test_deep_nesting_changes_nothing(spark, depth):
    inner = "<nav>menu</nav><p>Some words of the text, told in full.</p>"
    page = "<html><body><article>" + "<div>" * depth + inner + "</div>" * depth + "</article></body></html>"
    rows = [(i, f"http://h/{i}", page.replace("Some", f"Some {i}")) for i in range(4)]
    got = {r.page_id: r.text for r in hx.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Some {i} words of the text, told in full." for i in range(4)}
