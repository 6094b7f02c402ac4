import time
from html.parser import HTMLParser

import pytest

from ledgerloom.llm import pages, queries


def page(body, extra=""):
    return f"<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a='</p>'</script></head><body><nav><ul><li><a href='/x'>Home</a></li><li><a>More</a></li></ul></nav><!-- c <p>no</p> --><div class=\"ad\">Buy</div>{body}<footer>&copy; x</footer>{extra}</body></html>"


def test_articles(spark):
    rows = [(i, f"https://u@www.host{i % 2}.example/p?x={i}", page(f"<article><h1>Title {i} &amp; more</h1><p>One  <b>two</b>\n three<br>four<p>Five &lt;six&gt;</p><div class='comments'><p>me too</p></div><ul><li>a<li>b</ul></article>")) for i in range(12)]
    rows += [(50, None, None), (51, "x", ""), (52, "https://www.host0.example/q", "<p>loose text of a page <b>without</b> a frame"), (53, "not a url", "a < b & c > d &am")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.extract_main(df.selectExpr("*", "'clash' AS text")).collect()}
    for i in range(12):
        assert got[i] == f"Title {i} & more\nOne two three four\nFive <six>\na\nb"
    assert got[50] == "" and got[51] == "" and got[52] == "loose text of a page without a frame" and got[53] == "a < b & c > d &am"
    before, pages.BROADCAST_BYTES = pages.BROADCAST_BYTES, -1
    try:
        assert {r.page_id: r.text for r in pages.extract_main(df).collect()} == got
    finally:
        pages.BROADCAST_BYTES = before
    assert pages.extract_main(df.limit(0)).count() == 0


def test_hosts_without_articles_are_told_by_their_slots(spark):
    rows = [(i, "http://h.example/", page(f"<div class='top'>Always the same line here</div><div class='body'><p>{'text %d ' % i * 30}</p><p>{'again %d ' % i * 20}</p></div><div class='links'><a>one two three</a></div>")) for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in pages.extract_main(df).collect():
        assert r.text == ("text %d " % r.page_id * 30).strip() + "\n" + ("again %d " % r.page_id * 20).strip()


def test_alignment_makes_optional_and_repeated_parts():
    a = pages.wrapper(pages.parse("<div><h1>A</h1><p>x</p><p>y</p><p>z</p></div>"))
    b = pages.wrapper(pages.parse("<div><h1>A</h1><h2>s</h2><p>x</p></div>"))
    w = pages.align(a, b)["children"][0]
    assert [(c["label"], c["optional"], c["repeated"]) for c in w["children"]] == [("h1", False, False), ("h2", True, False), ("p", False, True)]
    assert w["children"][0]["constant"] == "A" and w["children"][2]["constant"] is None
    same = pages.align(pages.align(a, b), a)["children"][0]
    assert [c["label"] for c in same["children"]] == ["h1", "h2", "p"]


def test_names_around_and_inside_articles(spark):
    rows = [(i, "http://n.example/", page(f"<div class='content has-sidebar'><article><p>body {i} &am<b>p; x</b></p><section class='comments'><article class='comment'><p>first!</p></article></section></article><div class='sidebar'>side</div></div>")) for i in range(4)]
    for r in pages.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == f"body {r.page_id} &amp; x"


def texts(spark, rows):
    return {r.page_id: r.text for r in pages.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}


def test_parts_of_one_page_each_keep_their_text(spark):
    name = lambda i: "".join("abcdefghij"[int(d)] for d in str(1000 + i))
    teaser = lambda i: f"<div class='latest'><p>{f'latest of page {i} ' * 40}</p></div>"
    digits = [(i, "http://d.example/", page(f"{teaser(i)}<div id='post-{i}'><p>{f'own words {i} ' * 10}</p></div>")) for i in range(200)]
    slugs = [(1000 + i, "http://s.example/", page(f"{teaser(i)}<div id='{name(i)}'><p>{f'own words {i} ' * 10}</p></div>")) for i in range(200)]
    got = texts(spark, digits + slugs)
    for i in range(200):
        own = f"own words {i} " * 10
        assert own.strip() in got[i] and own.strip() in got[1000 + i]


def test_folded_children_lose_nothing():
    w = pages.wrapper(pages.parse("".join(f"<x{i}>{'text ' * 5}</x{i}><div class='c{chr(97 + i % 26)}{chr(97 + i // 26)}'>{'text ' * 5}</div>" for i in range(90))))
    assert len(w["children"]) <= pages.MOST_CHILDREN and sum(x["text"] for x in pages._all(w)) == 180 * 24


def test_short_articles_and_leads_stay(spark):
    rows = [(i, "http://a.example/", page(f"<article class='lead'><p>lead {i}</p></article><article class='body'><p>{f'body {i} ' * 50}</p></article>")) for i in range(5)]
    rows += [(100 + i, "http://b.example/", page(f"<div class='by'>by writer {i}</div><div class='body'><p>{f'body {i} ' * 200}</p></div>")) for i in range(5)]
    got = texts(spark, rows)
    for i in range(5):
        assert got[i] == f"lead {i}\n" + (f"body {i} " * 50).strip()
        assert f"by writer {i}\n" + (f"body {i} " * 200).strip() in got[100 + i]


@pytest.mark.parametrize("piece", ["<a", "<a ", "<a \"", "<a '", "<a \">\" ", "<", "<!", "<!--", "</", "<div>", "<div></p>", "<article>", "<script ", "<script></script ", "<a b='\"' \"", "&#", "&#1", "&", "<x><y>", "<p", "<svg/>"])
def test_hostile_pages_take_time_by_their_length(piece):
    took = []
    for n in (20_000, 40_000):
        began = time.process_time()
        e = pages.parse(piece * n)
        pages.blocks(e, pages.main_places(pages.wrapper(e)))
        took.append(time.process_time() - began)
    assert took[1] < 3 * took[0] + 1, took


def test_deep_pages_keep_parts_apart():
    deep = "<div>" * 230 + "<p>in</p><nav>menu<div>more</div></nav>tail" + "</div>" * 230
    e = pages.parse(f"<article><p>a</p>{deep}<p>b</p></article><footer>f</footer>")
    assert pages.blocks(e, pages.ARTICLES) == ["a", "in", "tail", "b"]
    e = pages.parse("<nav>" * 230 + "menu" + "</nav>" * 230 + "<p>text</p>")
    assert pages.blocks(e, [[]]) == ["text"]


def test_odd_markup():
    e = pages.parse("<svg/><p title='a > b'>x &#" + "9" * 5000 + "; y</p><svg><text>no</text></svg>z <i>1 < 2</i>")
    assert pages.blocks(e, [[]]) == ["x \ufffd y", "z 1 < 2"]


def test_long_texts_that_never_vary_belong_to_the_wrapper(spark):
    notice = "all content of this site may be read by anybody and printed by nobody without asking first " * 2
    rows = [(i, "http://n.example/", f"<div class='top'><p>{notice}</p></div><div class='post'><h2>Facts</h2><p>{f'own words {i} ' * 20}</p></div>") for i in range(6)]
    same = [(100 + i, "http://s.example/", "<div><p>one text on all pages</p></div>") for i in range(6)]
    inside = [(200 + i, "http://i.example/", f"<article><h1>T{i}</h1><div class='box'>{notice}</div><p>{f'own words {i} ' * 20}</p></article>") for i in range(6)]
    got = texts(spark, rows + same + inside)
    for i in range(6):
        own = (f"own words {i} " * 20).strip()
        assert got[i] == own and got[100 + i] == "one text on all pages" and got[200 + i] == f"T{i}\n{own}"


def test_wrappers_do_not_depend_on_how_pages_are_dealt(spark):
    import random

    r = random.Random(4)
    part = lambda i: "".join(r.choice(["<h2>x</h2>", f"<p>p{i}</p>", f"<div class='c{r.choice('abc')}'>d{i}</div>", "<ul><li>l</li></ul>"]) for _ in range(6))
    df = spark.createDataFrame([(i, "http://h.example/", part(i)) for i in range(300)], "page_id long, url string, html string")
    got = {tuple(map(tuple, pages.infer_wrappers(x, "url", "html").collect())) for x in (df.coalesce(1), df.repartition(7), df.orderBy("html"))}
    assert len(got) == 1


class Plain(HTMLParser):
    """Main text by the contract for pages whose main text is one article: blocks outside the parts that are left out."""

    BLOCKS = {"p", "h1", "h2", "h3", "li", "div", "article", "section", "blockquote", "ul", "ol", "table", "tr", "td", "header", "pre", "figure"}
    LEFT = {"nav", "footer", "aside", "form", "script", "style", "noscript", "template", "button"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.left, self.run, self.out = 0, [], [], []

    def end(self):
        text = " ".join("".join(self.run).split())
        if text:
            self.out.append(text)
        self.run = []

    def handle_starttag(self, tag, attrs):
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
        if self.left:
            self.left += [tag] * (tag == self.left[0])
        elif tag in self.LEFT or tag == "div" and any(x in names.split() for x in ("ad", "comments", "sidebar", "notice", "cookie")):
            self.end()
            self.left = [tag]
        elif tag in self.BLOCKS:
            self.end()
            self.inside += tag == "article"
        elif tag == "br":
            self.run.append(" ")

    def handle_endtag(self, tag):
        if self.left:
            if tag == self.left[0]:
                self.left.pop()
        elif tag in self.BLOCKS:
            self.end()
            self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside and not self.left:
            self.run.append(data)


def test_pages_of_the_table_match_a_plain_reading(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.page_id: r for r in queries.QUERIES["op6_html_extraction"](spark, sf).collect()}
    pages_of = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(rows) == len(pages_of) > 0
    for p in pages_of:
        plain = Plain()
        plain.feed(p.html or "")
        plain.close()
        plain.end()
        assert (rows[p.page_id].url, rows[p.page_id].text, rows[p.page_id].n_chars) == (p.url, "\n".join(plain.out), len("\n".join(plain.out)))
