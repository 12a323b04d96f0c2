"""Page text against a plain reading of the given pages, and by the ratios alone."""

import html.parser

import numpy as np
import pytest

from quillveil.llm import queries, tagpaths

SF = "/root/testdata/sf0.01"


class Plain(html.parser.HTMLParser):
    """Text of one element, a line a block."""

    BLOCKS = ("p", "h1", "br", "ul", "ol", "li", "article", "div")

    def __init__(self, page, tag="article"):
        super().__init__(convert_charrefs=True)
        self.tag, self.inside, self.lines = tag, False, [""]
        self.feed(page)
        self.close()
        self.text = "\n".join(x for x in (" ".join(x.split()) for x in self.lines) if x)

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == self.tag
        self.lines += [""] * (tag in self.BLOCKS)

    def handle_endtag(self, tag):
        self.inside &= tag != self.tag
        self.lines += [""] * (tag in self.BLOCKS)

    def handle_data(self, data):
        if self.inside:
            self.lines[-1] += data


@pytest.fixture(scope="module")
def pages(spark):
    return {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}


def test_whole_pages_match_a_plain_reading(spark, pages):
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op5_tag_path_text(spark, SF).collect()}
    want = {k: Plain(p or "").text for k, p in pages.items()}
    assert {k: t for k, (t, _) in got.items()} == want and all(n == len(t) for t, n in got.values())


def test_pages_without_an_article_element(pages):
    for p in pages.values():
        div = p.replace("<article", "<div").replace("</article", "</div")
        assert tagpaths.main_text(div) == Plain(p).text


def test_the_ratios_choose_the_nodes(pages, monkeypatch):
    """With one score for all paths menus, adverts and footers come along."""
    some = list(pages.values())
    right = [tagpaths.main_text(p) for p in some]
    monkeypatch.setattr(tagpaths, "scores", lambda blocks: np.ones(len(blocks)))
    flat = [tagpaths.main_text(p) for p in some]
    assert all(len(a) > len(b) for a, b in zip(flat, right))


def test_ratios_without_any_word_of_class_or_element():
    long = "A sentence of some length, with a comma, stands here. Another one follows it; it is as long. "
    links = "".join(f"<li><a href=/{k}>Item {k}</a></li>" for k in range(8))
    page = f"<body><div><ul>{links}</ul></div><div><h2>Title</h2><p>{long}</p><p>Short.</p><p>{long * 2}</p></div><div><span>All rights reserved</span></div></body>"
    assert tagpaths.main_text(page) == f"Title\n{long.strip()}\nShort.\n{(long * 2).strip()}"


@pytest.mark.parametrize("name", ["main has-sidebar", "entry-header", "no-banner"])
def test_a_layout_class_is_no_noise(name):
    assert tagpaths.main_text(f"<body><article><div class='{name}'><p>One, first.</p></div><p>Two.</p><div class='ad'>Buy.</div></article></body>") == "One, first.\nTwo."


def test_short_items_headings_and_cells_of_an_article_stay():
    page = "<body><article><h2>A</h2><p>One paragraph, of a few words.</p><ul><li>x</li><li><a href=/>linked</a></li></ul><table><tr><td>5<td>Yes</table><p>Text <span class=ad>Buy now!</span> goes on.</article><footer>Long text, with marks. More of it, too. And more.</footer></body>"
    assert tagpaths.main_text(page) == "A\nOne paragraph, of a few words.\nx\nlinked\n5\nYes\nText goes on."


def test_edges(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, quillveil_html string"
    rows = [(1, "u", None, "clash", "c", "h"), (2, None, "", "clash", "c", "h"), (3, "u", "<nav><a>Home</a></nav>", None, None, None), (None, "u", "<p>Only this, here.", "x", "y", "z"), (3, "u", "<p>Again, here.", "x", "y", "z"), (9, "u", "<article>" + "<p>Many words, one after the other.</p>" * 60_000 + "</article>", "", "", "")]
    pages = spark.createDataFrame(rows, schema)
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in tagpaths.extracted(pages).collect()), key=lambda r: r[:2])
    long = "\n".join(["Many words, one after the other."] * 60_000)
    assert got == [(0, "Only this, here.", 16), (1, "", 0), (2, "", 0), (3, "", 0), (3, "Again, here.", 12), (9, long, len(long))]
    assert tagpaths.extracted(pages.limit(0)).columns == ["page_id", "url", "text", "n_chars"] and tagpaths.extracted(pages.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ["<svg/>", "<svg class='a' />", '<math alt="x"/>', "<SVG a=b />", "<svg class=a/>x</svg>", "<svg><p>no</p></svg>"])
def test_text_after_a_self_closed_drawing_stays(tag):
    page = f"<body><article><p>One, first.</p>{tag}<p>Two, then.</p><p>Three<svg><path/></svg>, last.</p></article></body>"
    assert tagpaths.main_text(page) == "One, first.\nTwo, then.\nThree, last."
