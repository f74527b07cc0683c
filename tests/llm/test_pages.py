import base64
import hashlib
import random

import pytest
from conftest import rows_of  # noqa: F401

from ldaplens.llm.html_text import align, blocks, built, extract_text, flat, fold, main_path, main_text, parse, wrapper, wrappers
from ldaplens.llm.warc import load, read_archives, save, write_archives


def page(rng, host, n):
    word = lambda: "".join(rng.choices("abcdef", k=rng.randint(2, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    paragraphs = [text(rng.randint(3, 60)) for _ in range(rng.randint(1, 6))]
    menu = "".join(f"<li><a href='/{i}'>menu {i}</a></li>" for i in range(rng.randint(2, 5)))
    extra = f'<div class="cookie-notice">We use cookies {word()}</div>' if rng.random() < 0.4 else ""
    comments = f'<section id="comments"><p>{text(30)}</p></section>' if rng.random() < 0.5 else ""
    title = text(4)
    head = f"<html><head><title>{title}</title><script>var x='</p><article>';</script></head><body>{extra}<nav><ul>{menu}</ul></nav><aside><p>{text(40)}</p></aside>"
    tag, close = (("<article>", "</article>"), ('<div id="content">', "</div>"), ("<div class=x>", "</div>"))[n % 3]
    body = "".join(f"<p>{p} &amp; caf&eacute;<br>\n next" + ("</p>" if rng.random() < 0.5 else "") for p in paragraphs)
    tail = f"{comments}<form><input name=q>Search here</form><footer>&copy; {host} {text(5)}</footer>" + ("</body></html>" if rng.random() < 0.8 else "")
    return f"{head}{tag}<h1>{title}</h1>{body}{close}{tail}", "\n\n".join([title] + [p + " & café next" for p in paragraphs])


def test_extracts_articles(spark):
    rng = random.Random(1)
    rows, expected = [], {}
    for i in range(180):
        n = (0, 0, 1, 2, 3, 4, 5)[rng.randrange(7)]
        html, text = page(rng, f"h{n}.example", n)
        rows.append((i, f"https://H{n}.example:80/{i}?q=1", html, "x", 1))
        expected[i] = text
    rows += [(900, None, None, "x", 1), (901, "no host", "", "x", 1), (None, "http://h0.example/", "<p>only<p>two", "x", 1), (902, "http://lone.example/", "plain < text &lt;b&gt;", "x", 1)]
    expected |= {900: "", 901: "", None: "only\n\ntwo", 902: "plain < text <b>"}
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, n_chars int").repartition(9)
    got = {r["page_id"]: r["text"] for r in extract_text(df).collect()}
    assert got == expected
    assert all(r["n_chars"] == len(r["text"]) for r in extract_text(df).collect())
    assert extract_text(df.limit(0)).count() == 0


LAYOUTS = [  # what the body is made of, around an article's paragraphs
    '<body class="right-sidebar"><div class="sidebar"><p>{other}</p></div>{article}</body>',
    '<body><div id="content" class="with-sidebar">{article}</div><div class="sidebar"><p>{other}</p></div></body>',
    '<body><nav>menu</nav><article class="post category-social">{article}</article><footer>{other}</footer></body>',
    '<body><form id="aspnet"><div id="top">{other}</div><div class="x">{article}</div></form></body>',
    '<body><div class="no-sidebar"><main>{article}</main></div><div class="y">{other}</div></body>',
    '<body><article><h1>News</h1><div class="text social-0">{article}</div><div class="share">{other}</div></article></body>',
    '<body><div class="widget blog">{article}</div><div class="widget">{other}</div></body>',
    # these are asides, whatever they hold
    '<body><div id="x">{article}</div><section id="comments"><div class="comment-content"><p>{long}</p></div></section></body>',
    '<body><article>{article}</article><ol class="comment-list"><li><article class="comment-body"><p>{long}</p></article></li></ol></body>',
    '<body><div id="content">{article}</div><div class="related"><article class="card"><p>{other}</p></article></div></body>',
]


@pytest.mark.parametrize("pages", [1, 4])
def test_layout_words_and_page_wide_forms(spark, pages):
    rng = random.Random(7)
    text = lambda k: " ".join("".join(rng.choices("abcdef", k=6)) for _ in range(k))
    rows, expected = [], {}
    for h, layout in enumerate(LAYOUTS):
        for i in range(pages):
            lines = [text(rng.randint(40, 60)) for _ in range(3)]
            html = layout.format(article="".join(f"<p>{x}</p>" for x in lines), other=text(5), long=text(1000))
            rows.append((100 * h + i, f"http://h{h}.example/{i}", f"<html>{html}</html>"))
            expected[100 * h + i] = "\n\n".join((["News"] if "News" in layout else []) + lines)
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == expected


def test_a_page_of_comments_only():
    assert main_text('<div class="comments"><div class="comment"><p>one</p></div><div class="comment"><p>two</p></div></div>', None) == "one\n\ntwo"
    assert main_text("<nav>a</nav><footer>b</footer>", None) == ""


def test_pages_nest_as_deep_as_they_like(spark):
    rows, expected = [], {}
    deep = ["<font>" * 5000 + "{}", "<blockquote>" * 5000 + "{}" + "</blockquote>" * 5000, "<article>" + "<div><span>" * 2500 + "{}", "<p>a</p><ul>" + "<li><ul>" * 2500 + "{}"]
    for h, html in enumerate(deep):
        for i in range(3):
            rows.append((10 * h + i, f"http://h{h}.example/{i}", html.format(f"text {'abc'[i]}")))
            expected[10 * h + i] = f"text {'abc'[i]}"
    rows += [(90, "http://lone.example/", deep[1].format("alone"))]
    expected[90] = "alone"
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r["page_id"]: r["text"] for r in extract_text(df).collect()} == expected


def test_wrappers_are_kept_flat():
    w = wrapper(parse("<h1>a</h1><p>b<i>c</i></p><p>d</p><ul><li>e</li></ul><p>f</p>"))
    assert built(flat(w)) == w and flat(w)[0][:2] == ["", ""]


def test_wrapper_rounds_see_every_page(spark, monkeypatch):
    from ldaplens.llm import html_text

    monkeypatch.setattr(html_text, "FAN_IN", 2)
    rng = random.Random(2)
    rows = [(i, f"http://one.example/{i}", page(rng, "one", 0)[0]) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(13)
    got = wrappers(df).collect()
    assert [(r["host"], r["pages"]) for r in got] == [("one.example", 60)]


def test_union_free_alignment():
    t = lambda s: wrapper(parse(s))[2]
    # a text that differs is a slot, one that agrees stays
    assert align(t("<b>a</b><i>x</i>"), t("<b>a</b><i>y</i>")) == [["b", "", [["#", "", "a", 2]], 2], ["i", "", [["#", "", None, 2]], 2]]
    # what one side lacks is optional
    labels = lambda kids: [(k[0], k[1]) for k in kids]
    assert labels(align(t("<h1>a</h1><p>b</p>"), t("<p>b</p><ul></ul>"))) == [("h1", "?"), ("p", ""), ("ul", "?")]
    # repeats fold, alone and as groups
    assert labels(t("<ul></ul><p>a</p><p>b</p>")) == [("ul", ""), ("p", "+")]
    group = t("<h2>a</h2><p>b</p><h2>c</h2><p>d</p>")
    assert labels(group) == [("()", "+")] and labels(group[0][2]) == [("h2", "?"), ("p", "?")]
    assert labels(align(group, t("<h2>z</h2>"))) == [("()", "+")] or labels(align(group, t("<h2>z</h2>")))
    # a wrapper stays as small as its labels however many pages align
    rng = random.Random(3)
    w = t("<p>a</p>")
    for _ in range(300):
        w = align(w, t("".join(f"<{x}>{rng.random()}</{x}>" for x in rng.choices(["p", "h2", "ul", "pre", "table"], k=rng.randint(0, 30)))))
    assert sum(len(k[2]) if k[0] == "()" else 1 for k in w) <= 5
    assert fold([]) == []


def test_parser_bears_anything():
    rng = random.Random(4)
    bits = ["<p>", "</p>", "<div class='a", "\">", "<!--", "-->", "<script>", "</script>", "<", ">", "&amp", "&#x41;", "text", "<li>", "</ul>", "<br/>", "\x00", "é", "<table><tr><td>", "<svg/>", "<article>", "</article>"]
    for _ in range(2000):
        s = "".join(rng.choices(bits, k=rng.randint(0, 25)))
        assert isinstance(main_text(s, None), str)
        main_path(wrapper(parse(s)))
    assert blocks(parse("<p>a<b>b</b>\n c<br>d</p>e")) == ["ab c d", "e"]
    assert main_text("<div>" * 400 + "deep", None) == "deep"


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


@pytest.mark.parametrize("least", [0, 10])
def test_warc_round_trip(spark, least):
    rng = random.Random(5)
    htmls = [None, "", "<p>é</p>", "WARC/1.1\r\n\r\n", "long " * 40_000] + ["".join(rng.choices("<p>abcdef \r\n", k=rng.randint(0, 400))) for _ in range(150)]
    rows = [(i, None if i % 9 == 0 else f"http://x/{i}\r\nBad: é", rng.choice(htmls), "x") for i in range(400)]
    rows += [(None, "http://y/", "<p>é</p>", "x"), (7, rows[7][1], rows[7][2], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(6)
    files = write_archives(df, least=least)
    got = read_archives(files).collect()
    last = {}
    for i, _, h, _ in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", -1))
    expected = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        revisit = i is not None and len(b) >= least and last[h or ""] != i
        expected.append((i, "revisit" if revisit else "response", last[h or ""] if revisit else None, len(b), digest(b), None if revisit else b))
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], None if r["payload"] is None else bytes(r["payload"])) for r in got), key=str) == sorted(expected, key=str)
    assert sum(r["records"] for r in files.collect()) == len(rows)
    assert read_archives(write_archives(df.limit(0))).count() == 0


def test_archive_has_its_dictionary(tmp_path):
    rng = random.Random(6)
    records = [b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 300\r\n\r\n" + bytes(rng.choices(b"abcdefgh", k=300)) + b"\r\n\r\n" for _ in range(500)]
    n, size = save(f"{tmp_path}/a.warc.zst", iter(records))
    data = (tmp_path / "a.warc.zst").read_bytes()
    assert (n, size) == (500, len(data)) and data[:4] == bytes.fromhex("5d2a4d18")
    assert [b for _, b in load(f"file:{tmp_path}/a.warc.zst")] == [r.partition(b"\r\n\r\n")[2][:300] for r in records]
    for few in (1, 2, 5, 40):  # an archive of any size
        save(f"{tmp_path}/b.warc.zst", iter(records[:few]))
        assert (tmp_path / "b.warc.zst").read_bytes()[:4] == bytes.fromhex("5d2a4d18")
        assert len(list(load(f"{tmp_path}/b.warc.zst"))) == few
    save(f"{tmp_path}/c.warc.zst", iter([]))
    assert (tmp_path / "c.warc.zst").read_bytes() == b""
