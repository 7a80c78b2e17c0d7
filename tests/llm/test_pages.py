import html
import time
from html.parser import HTMLParser

import pytest

from ledgerlens.llm import pages

LONG = "The quick brown fox is in the middle of a long and winding story about it and that, and so on for some time. " * 2


def test_marked_article():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><script>if (a < b) "</p>"</script></head><body><nav><a href="/">Home</a></nav>'
        '<div class="ad">Buy now, it is the best of all.</div><article><header><h1>Head &amp; line</h1></header><p>One<br>two  three'
        '<p><b>Four</b> &lt;five&gt;<div class="comments"><p>What a comment on this!</p></div><form><p>Mail</p></form></article>'
        "<footer>&copy; x</footer><aside><p>" + LONG + "</p></aside></body></html>"
    )
    assert pages.main_text(page) == "Head & line\n\nOne two three\n\nFour <five>"


def test_unmarked_page():
    page = f'<body><ul><li><a href="/a">First</a></li><li><a href="/b">Second</a></li></ul><h2>Title</h2><p>{LONG}</p><p>Short one.</p><p>{LONG}</p><div>© 2020 A Company</div></body>'
    body = " ".join(LONG.split())
    assert pages.main_text(page) == f"Title\n\n{body}\n\nShort one.\n\n{body}"


def test_marks_are_one_sign_of_several():
    body, card = " ".join(LONG.split()), "<article><h3><a href=/>Teaser</a></h3><p><a href=/>Read on</a></p></article>"
    plain = f"<div><h1>Title</h1><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div>"
    whole = f"Title\n\n{body}\n\nShort one.\n\n{body}"
    assert pages.main_text(f"<body>{plain}{card}</body>") == whole
    assert pages.main_text(f"<body><main>{plain}</main>{card}</body>") == whole
    inner = f"<h1>Head</h1><p>The lead.</p><div itemprop=articleBody><p>{LONG}</p><p>Short one.</p></div>"
    for around in ("article", "div", "main"):
        assert pages.main_text(f"<body><p>Menu</p><{around}>{inner}</{around}><p>Imprint</p></body>").endswith(f"Head\n\nThe lead.\n\n{body}\n\nShort one.")
    assert pages.main_text(f"<body><article><p>{LONG * 3}</p></article><div><p>{LONG}</p></div><p>End</p></body>").count(body) == 4
    linked = "".join(f"<p><a href=/>{LONG}</a></p>" for _ in range(9))
    assert pages.main_text(f"<body><article><p>{LONG}</p></article>{linked}</body>") == body

    words, notice = "слово и дело " * 20, "<p>This is what we do with all of it, and you can say no to it at any time.</p>"
    page = f'<body>{notice}<article><p>{words}</p><p>{words}</p><p>{words}</p></article><div>© 2020 A Company</div></body>'
    assert pages.main_text(page).count(words.strip()) == 3


def test_wrappers_of_the_text_are_no_boilerplate():
    body = " ".join(LONG.split())
    for inner, text in ((f"<article><h1>Head</h1><p>Short.</p><p>{LONG}</p></article>", f"Head\n\nShort.\n\n{body}"), ("<article><h1>Head</h1><p>Short.</p></article>", "Head\n\nShort."), (f"<p>{LONG}</p><p>{LONG}</p>", f"{body}\n\n{body}"), ("<main><p>Short.</p></main>", "Short.")):
        for wrapper in ('<div class="content with-sidebar">', '<div id="modal-root">', '<div class="has-banner">', "<form method=post>", '<form class="has-comments"><div id="modal-root">', '<section class="post has-comments">'):
            page = f'<body>{wrapper}<nav><a href="/">Home</a></nav>{inner}<div class="ad">Buy now.</div></body>'
            assert pages.main_text(page) == text, page
    page = f'<body><article><p>{LONG}</p><p>{LONG}</p></article><div class="related"><article><p>{LONG}</p></article></div><div id="comments"><p>{LONG}</p></div><form><p>{LONG}</p></form></body>'
    assert pages.main_text(page) == f"{body}\n\n{body}"
    assert pages.main_text(f'<body><p>{LONG}</p><div id="comments"><p>{LONG}</p><p>{LONG}</p></div><div style="display: none"><article>{LONG * 9}</article></div></body>') == body

    junk = "Reed Reed Reed Reed " * 30
    assert pages.main_text(f'<body><div class="ad">{body}</div><article><p>{junk}</p><p>{junk}</p></article></body>') == "\n\n".join([junk.strip()] * 2)

    assert pages.main_text('<body><div class="ad">It is the best of all that there is for you, and now you can have it at home.</div><article><p>Junk.</p></article></body>') == "Junk."


def test_broken_markup():
    assert pages.main_text(None) == pages.main_text("") == pages.main_text("<!-- open") == pages.main_text("<script>x") == ""
    assert pages.main_text("just text, 1 < 2 &amp; so") == "just text, 1 < 2 & so"
    assert pages.main_text("<p>a<p class='x>b") != ""
    assert pages.main_text("<![CDATA[a < b]]>") == "a < b"
    assert pages.main_text("<" * 50_000).count("<") == 50_000
    assert pages.main_text("</p></div>x<td>y</table>z") == "x\n\ny\n\nz"


def test_skipped_elements_without_an_end():
    for tag in "button select svg math object canvas audio video datalist noscript template embed".split():
        for bad in (f"<{tag}>", f"<div><{tag}></div>", f"<div><{tag}><b></b></div>", f"<{tag}><{tag} id=a>"):
            assert pages.main_text(f"<body>{bad}<article><p>One</p><p>Two</p></article></body>") == "One\n\nTwo", bad
            assert pages.main_text(f"<body><article><p>One</p>{bad}<p>Two</p></article></body>") == "One\n\nTwo", bad
        if tag != "embed":
            assert pages.main_text(f"<article><p>One <{tag}><i>x</i>{'' if tag in ('svg', 'math') else '<p>y</p>'}< z <br></{tag.upper()}> two</p><p>Three</p></article>") == "One two\n\nThree"
            assert pages.main_text(f"<article><div><{tag}>x</div><p>One</p></article><p><{tag}>x</{tag}></p>") == "One"
    assert pages.main_text("<article><p>One<svg><title>x</title><svg>x</svg>x</svg> two</p><button>x<p>Three<button>x</button></article>") == "One two\n\nThree"
    assert pages.main_text("<article><svg><path><p>One</p><svg><foreignObject><p>x</p></foreignObject></svg><p>Two</p></article>") == "One\n\nTwo"
    assert pages.main_text("<p>One</p><object>" + "<object>" * 20_000 + "<p>Two</p>") == "One\n\nTwo"


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "clash"), (1, "u", None, "clash"), (None, None, "<article><p>ü</p></article>", "c")], "page_id long, url string, html string, text string")
    rows = pages.extract(df, ["page_id", "url"]).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in rows) == [(0, "ü", 1), (1, "", 0), (1, "", 0)]
    assert pages.extract(df.limit(0), ["page_id", "url"]).count() == 0


PARAGRAPHS = {
    "italian": "Il governo ha annunciato ieri sera che nei prossimi mesi verranno costruite nuove ferrovie nelle regioni meridionali, dove i cittadini aspettano da anni collegamenti migliori tra le città più grandi. ",
    "polish": "Rząd ogłosił wczoraj wieczorem, że w najbliższych miesiącach powstaną nowe linie kolejowe w regionach południowych, gdzie mieszkańcy od lat czekają na lepsze połączenia między miastami. ",
    "russian": "Правительство объявило вчера вечером, что в ближайшие месяцы в южных областях построят новые железные дороги, где жители уже много лет ждут лучшего сообщения между городами. ",
    "chinese": "政府昨天晚上宣布未来几个月将在南部地区修建新的铁路那里的居民多年来一直在等待城市之间更好的交通连接。",
    "code": "for (i = 0; i < n; i++) { total[i] = weight[i] * value[i]; if (total[i] > limit) { total[i] = limit; } } return total; ",
}


@pytest.mark.parametrize("language", PARAGRAPHS)
def test_unmarked_pages_in_other_languages_keep_every_paragraph(language):
    text = PARAGRAPHS[language]
    whole = [html.escape(f"{k} " + text * (1 + 260 // len(text))) for k in range(3)]
    links = "".join(f'<li><a href="/{k}">{text[: 20]}</a></li>' for k in range(8))
    page = f"<nav><ul>{links}</ul></nav><div><div>{html.escape(text[:30])}</div>{''.join(f'<p>{p}</p>' for p in whole)}</div><footer><p>© 2024 {html.escape(text[:40])}</p></footer>"
    got = pages.main_text(page)
    assert all(" ".join(html.unescape(p).split()) in got for p in whole) and "©" not in got


class Reader(HTMLParser):
    """The article element of a page, read by the standard library: blocks of text outside what is no part of it."""

    BORDERS = {"article", "p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "div", "section", "blockquote", "pre", "table", "tr", "td", "th", "figure", "figcaption", "header", "footer", "nav", "aside", "form"}
    LEFT_OUT = {"nav", "footer", "aside", "form", "script", "style", "button", "select"}

    def __init__(self, page: str):
        super().__init__()
        self.inside, self.out, self.parts, self.found = 0, [], [], []
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        text = " ".join("".join(self.parts).split())
        self.found += [text] if text else []
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BORDERS:
            self.end()
        if tag == "br":
            self.parts.append(" ")
        self.inside += tag == "article"
        names = set((dict(attrs).get("class") or "").split())
        if tag in self.LEFT_OUT or names & {"ad", "comments", "comment", "share", "related"} or self.out and self.out[-1][0] == tag:
            self.out.append((tag, tag in self.LEFT_OUT or bool(names)))

    def handle_endtag(self, tag):
        if tag in self.BORDERS:
            self.end()
        self.inside -= tag == "article"
        if self.out and self.out[-1][0] == tag:
            self.out.pop()

    def handle_data(self, data):
        if self.inside and not self.out:
            self.parts.append(data)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_pages_against_another_reader(spark, scale):
    table = spark.read.parquet(f"/root/testdata/{scale}/pages.parquet")
    got = {r.page_id: r for r in pages.extract(table, ["page_id"]).collect()}
    rows = table.collect()
    assert len(got) == len(rows) > 0
    for row in rows:
        want = "\n\n".join(Reader(row.html or "").found)
        assert (got[row.page_id].text, got[row.page_id].n_chars) == (want, len(want)), row.page_id


@pytest.mark.parametrize("opening", ["<article>", "<main>", "<div itemprop=articleBody>", '<div class="ad">', "<form>", "<svg><g>", "<button>"])
def test_deep_nesting_takes_linear_time(opening):
    tag = opening[1:].split()[0].rstrip(">")
    page = f"<body>{(opening + 'x') * 20_000}{f'</{tag}>' * 20_000}<p>{LONG}</p><p>{LONG}</p></body>"
    start = time.process_time()
    text = pages.main_text(page)
    assert time.process_time() - start < 5
    if opening in ("<svg><g>", "<button>", "<form>", '<div class="ad">'):
        assert text.endswith("\n\n".join([" ".join(LONG.split())] * 2))


def test_long_attribute_names_take_linear_time():
    start = time.process_time()
    assert pages.main_text(f"<p {'a' * 200_000}>Text</p>") == "Text"
    assert time.process_time() - start < 5
