from html.parser import HTMLParser

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<div id="cookie-notice"><p>We use cookies</p></div><nav><ul><li><a href="/x">menu {0}</a></li><li><a>more</a></li></ul></nav><!-- c --><div class="ad">buy</div>
<article><h1>Title {0}</h1>{1}<form><input><button>send</button></form><aside>side</aside><section class="comments"><p>nice post</p></section></article><footer>&copy; us</footer></body></html>"""
SF = "/root/testdata/sf0.01"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("mask", F.lit(9)).repartition(2)


class PlainArticle(HTMLParser):
    """The lines of a page's article, read plainly: no wrapper, no stream of other pages."""

    def __init__(self):
        super().__init__()
        self.inside, self.lines = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        self.lines += [""] if tag in H.BLOCKS else []
        self.lines[-1] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        self.lines += [""] if tag in H.BLOCKS else []

    def handle_data(self, data):
        self.lines[-1] += data if self.inside else ""


def test_article_without_furniture():
    bodies = ["<p>One &amp; two.</p><p><b>Bold<br>line\n here.<p>Open</p>", "<p>Only</p>", "<p>a</p><ul><li>x<li>y</ul><table><tr><td>c1<td>c2</table>"]
    got = H.extract([PAGE.format(k, b) for k, b in enumerate(bodies)])
    assert got[0] == "Title 0\nOne & two.\nBold line here.\nOpen"
    assert got[1] == "Title 1\nOnly"
    assert got[2] == "Title 2\na\nx\ny\nc1\nc2"


def test_wrapper_has_repeats_and_options_and_no_unions():
    a = H.Page("<div class=x>t</div>" + "<p>t</p>" * 3 + "<ul>" + "<li>t</li>" * 2 + "</ul>")
    b = H.Page("<p>t</p><ul>" + "<li>t</li>" * 4 + "</ul>")
    assert H.loaded(H.infer([a.skeleton, b.skeleton]))[0] == [["e", "div.x", [["#", False, 0]], True], ["r", [["e", "p", [["#", False, 1]], False]], False], ["e", "ul", [["r", [["e", "li", [["#", False, 2]], False]], False]], False]]
    w = H.infer([a.skeleton, b.skeleton])
    assert H.match(w, a.skeleton) == [0, 1, 2] and H.match(w, b.skeleton) == [1, 2]
    assert H.match(w, H.Page("<p>t</p>" * 9 + "<ul><li>t</ul>").skeleton) == [1, 2]
    assert H.match(w, H.Page("<h2>t</h2>").skeleton) == [-1]


def test_longer_units_repeat():
    one, many = H.Page("<h2>t</h2><p>t</p>"), H.Page("<h2>t</h2><p>t</p><p>t</p><h2>t</h2><p>t</p>")
    assert [n[0] for n in many.nodes] == ["r"] and many.slots == [0, 1, 1, 0, 1]
    w = H.infer([one.skeleton, many.skeleton])
    assert H.match(w, one.skeleton) == H.match(w, many.skeleton) == [0, 1]


def test_template_words_without_article():
    html = "<body><h2>Site of many pages</h2><div>{}</div></body>"
    got = H.extract([html.format(f"<p>text number {k}</p>") for k in "abcd"])
    assert got == [f"text number {k}" for k in "abcd"]


def test_the_wrapper_decides_for_the_host():
    """A short page has its main text where its host has it, though more text stands elsewhere on that page alone."""
    html = "<body><div>teaser {0}</div><div><h2>Head {0}</h2><p>{1}</p></div><div>{2}</div></body>"
    bodies = [(k, f"long text of page {k} " * 20, f"note {k}") for k in range(4)] + [(9, "brief", "a note that is longer than the page's own text")]
    assert H.extract([html.format(*b) for b in bodies]) == [f"Head {k}\n{' '.join(b.split())}" for k, b, _ in bodies]
    assert H.extract([html.format(*bodies[-1])]) != ["Head 9\nbrief"]


def test_pages_that_repeat_an_article_keep_it():
    """Copies of an article under different menus are no template; what a template puts into each article is."""
    html = '<nav><a>{0}</a></nav><article><h1>One</h1><p>the same words</p><div>share this</div></article><footer>{0}</footer>'
    assert H.extract([html.format(f"m{k}") for k in range(6)]) == ["One\nthe same words"] * 6


def test_names_count_as_a_whole_only():
    html = '<article><h1>t</h1><section class="related-work"><p>prior</p></section><section id="notice-of-appeal"><p>law</p></section><div class="ad">buy</div></article>'
    assert H.extract([html]) == ["t\nprior\nlaw"]


@pytest.mark.parametrize("html,text", [(None, ""), ("", ""), ("plain & <b>bold</b>", "plain & bold"), ("<article>a<article>b", "a\nb"), ("<p>x" * 3, "x\nx\nx"), ("<a title=\"x>y\">l</a><p>t</p>", "t"), ("<script>no", ""), ("<article><p>&lt;b&gt;&#233;&nbsp;x</p></article>", "<b>é x"), ("</p></x><p>t", "t"), ("<article><p>" + "<div>" * 3000 + "deep", "deep")])
def test_odd_pages(html, text):
    assert H.extract([html]) == [text]


def test_all_rows_come_back(spark):
    rows = [(k, f"http://host{k % 3}.example/{k}", PAGE.format(k, f"<p>body {k}</p>")) for k in range(40)] + [(40, None, None), (41, "nonsense", ""), (None, "http://host1.example/z", "<p>z</p>"), (5, "http://host2.example/5", PAGE.format(5, "<p>body 5</p>"))]
    got = H.main_text(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r for r in got}
    for k in range(40):
        assert text[k].text == f"Title {k}\nbody {k}" and text[k].n_chars == len(text[k].text)
    assert text[40].text == "" and text[None].text == "z"
    assert H.main_text(pages(spark, rows).limit(0)).count() == 0


def test_every_page_as_read_plainly_and_by_lists(spark):
    """Both ways for the masks to return, the list version and a plain reader of articles give the same text."""
    table = spark.read.parquet(f"{SF}/pages.parquet")
    rows = {r.page_id: r for r in H.rows_in(table).collect()}
    want = {}
    for k, r in rows.items():
        reader = PlainArticle()
        reader.feed(r.html)
        reader.close()
        want[k] = "\n".join(x for x in (" ".join(line.split()) for line in reader.lines) if x)
    hosts = {}
    for r in rows.values():
        hosts.setdefault(r.host, []).append(r.page_id)
    listed = {k: t for ids in hosts.values() for k, t in zip(ids, H.extract([rows[k].html for k in ids]), strict=True)}
    for broadcast in (H.BROADCAST, 0):
        assert {r.page_id: r.text for r in H.main_text(table, broadcast).collect()} == want == listed


def test_every_slot_falls_on_its_wrapper(spark):
    held = H.held_by_slots(H.rows_in(spark.read.parquet(f"{SF}/pages.parquet")))
    rows = held.where("slot = -1").join(H.host_wrappers(held), "host").collect()
    assert rows and all(-1 not in H.match(r.nodes, r.skeleton) for r in rows)


def test_sql(spark):
    got = {(r.page_id, r.text, r.n_chars) for r in H.main_text(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS FROM '{SF}/pages.parquet'")
    assert got == {(r[0], r[2], r[3]) for r in duckdb.sql(H.SQL).fetchall()}


def test_long_page():
    html = "<article>" + "<p>w</p>" * 20_000 + "</article>"
    assert H.extract([html, html])[0] == "\n".join(["w"] * 20_000)


def test_a_template_text_is_told_by_different_pages(spark):
    """Three pages of a host that share their last line drop it, two keep it, copies of a page count once; whatever the pages hash to."""
    html = "<body><h2>Head {0}</h2><div><p>long text of page {0}, and so on and on</p></div><div>the shared last line</div></body>"
    rows = []
    for h in range(70):
        n = 3 if h % 2 else 2
        rows += [(len(rows) + k, f"http://host{h}.example/{k}", html.format(f"{h} {min(k, n - 1)}")) for k in range(4)]
    got = {r.page_id: r.text for r in H.main_text(pages(spark, rows).repartition(5)).collect()}
    hosts: dict = {}
    for i, url, text in rows:
        hosts.setdefault(url.split("/")[2], []).append((i, text))
    for own in hosts.values():
        assert [got[i] for i, _ in own] == H.extract([t for _, t in own])
    assert len({"shared" in t for t in got.values()}) == 2
