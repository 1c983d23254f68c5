"""The node table against the standard library's tokenizer with a stack of its own, and what pages show."""

import random
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

from pyspark.sql import functions as F

from tessera.operators import pages as P
from tessera.sources.html import VOID, Mark, elements, node_table

MARKS = {"card": Mark("li", css="job"), "item": Mark("li"), "course": Mark(attribute="data-course-id"), "excluded": Mark("aside")}


class Plain(HTMLParser):
    def __init__(self, whole):
        super().__init__(convert_charrefs=True)
        self.rows, self.stack, self.whole = [], [], whole

    def handle_starttag(self, tag, attrs):
        given = {}
        for k, v in attrs:
            given.setdefault(k, v or "")
        self.rows.append([len(self.rows), self.stack[-1] if self.stack else None, tag, given, []])
        if tag not in VOID:
            self.stack.append(len(self.rows) - 1)

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        names = [self.rows[i][2] for i in self.stack]
        if tag in names:
            del self.stack[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data):
        words = " ".join(data.split())
        if words and self.stack and self.rows[self.stack[-1]][2] not in ("script", "style"):
            for i in self.stack:
                if i == self.stack[-1] or self.rows[i][2] in self.whole:
                    self.rows[i][4].append(words)


def plain(html, whole):
    p = Plain(whole)
    p.feed(html)
    p.close()
    return [(n, parent, tag, given, " ".join(text)) for n, parent, tag, given, text in p.rows]


def pages(n):
    r = random.Random(2)
    tags = ["p", "b", "a", "li", "ul", "div", "br", "img", "nav", "script"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(r.randrange(40)):
            t = r.choice(tags)
            attributes = "".join(r.choice([' class="job x"', " id=one", ' title="a &amp; b > c"', " data-course-id='7'", " hidden", ' class="z" class="y"', ""]) for _ in range(2))
            parts.append(r.choice([f"<{t}{attributes}>", f"<{t.upper()}{attributes}>", f"</{t}>", f"</{t}>", "words here", " &lt;x&gt; &eacute; ", "<!-- <p>no</p> -->", "\n", "1 < 2"]))
            if t == "script" and parts[-1].lower().startswith("<script"):
                parts.append("if (a < b) { '<p>' }</script>")
        out.append("".join(parts))
    return [*out, "", "no markup", "<p>open", "<div><p>a</div>b</p>c", "<!DOCTYPE html><a href=/x>t</a>", "<ul>" + "<li>item" * 400 + "</ul>", "<b>" * 3000 + "deep", "<p " * 5, "<"]


def test_elements_against_the_standard_tokenizer():
    whole = frozenset(("a", "li"))
    for html in pages(300):
        got = [(n, parent, tag, given, text) for n, parent, tag, given, _, _, _, text in elements(html, MARKS, whole)]
        assert got == plain(html, whole), html
    rows = elements(pages(1)[-3], {}, frozenset())
    assert len(rows) == 3000 and rows[-1][1] == 2998 and rows[-1][5] == [2998, 2997, 2996, 2995, 2994]


def test_node_table(spark):
    rows = [(1, "<li class='job big'><b>x</b><aside><a>y</a></aside></li>", 5), (None, "<p>z", 5), (2, None, 5), (3, "", 5)]
    df = spark.createDataFrame(rows, "id long, html string, node int")
    got = {(r.page, r.node): r for r in node_table(df, "id", "html", MARKS).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (1, 3), (None, 0)}
    a = got[1, 3]
    assert (a.marks, a.above, a.text, a.classes) == ({"card": 0, "item": 0, "excluded": 2}, [2, 0], "y", [])
    assert got[1, 0].classes == ["job", "big"] and got[None, 0].text == "z"


def test_absolute(spark):
    bases = ["https://h.example/a/b.html?q=1#f", "http://h.example", "https://h.example/a/"]
    hrefs = ["/x?y=1", "x.html", "//o.example/z", "https://o.example/", "?p=2", "#top", "mailto:a@b", "", "a:b", "x/y#z"]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    for r in df.select("b", "h", P.absolute(F.col("h"), F.col("b")).alias("u")).collect():
        assert r.u == urldefrag(urljoin(r.b, r.h))[0], (r.b, r.h)


JOBS = """<ul>
<li class="job" data-entity-urn="urn:li:jobPosting:11"><a href="/jobs/view/11?x=1"><span class="title">Data Engineer Data engineer</span></a><h4 class="sub">Acme</h4><span class="place">Here</b></span></li>
<li class="job"><a href="https://h.example/jobs/view/12" aria-label="Analyst with verification"></a><div class="sub"> </div><div class="alt">Beta</div></li>
<li><div data-entity-urn="urn:li:jobPosting:13"></div></li>
<aside><li class="job"><a href="/jobs/view/14">Left out</a></li></aside></ul><p><a href="/jobs/view/11">again</a><a href="/jobs/x">no</a>"""


def test_cards(spark):
    rows = [(1, JOBS), (2, "<li class=job>nothing named</li>"), (3, None)]
    df = spark.createDataFrame(rows, "id long, html string")
    fields = {"title": ("title",), "company": ("sub", "alt"), "place": ("place",)}
    selectors = {"n_job": F.array_contains("classes", "job"), "n_li": F.col("tag") == "li"}
    records, counts = P.cards(node_table(df, "id", "html", MARKS), df.select(F.col("id").alias("page")), r"/jobs/view/(\d+)", r"jobPosting:(\d+)", fields, selectors)
    got = {r.job_id: (r.title, r.company, r.place, r.sources, r.incomplete) for r in records.collect()}
    assert got == {
        "11": ("Data Engineer", "Acme", "Here", "card,job_href,list_item,urn", False),
        "12": ("Analyst", "Beta", None, "card,job_href,list_item", True),
        "13": ("", None, None, "list_item,urn", True),
    }
    c = {r.page: r for r in counts.collect()}
    assert (c[1].n_items, c[1].n_excluded, c[1].n_job, c[1].n_li, c[1].n_job_href, c[1].n_urn) == (4, 1, 3, 4, 4, 2)
    assert c[1].n_duplicates == c[1].n_signals - 4 and not c[1].missing_identity
    assert c[2].missing_identity and c[2].n_items == 0 and not c[3].missing_identity and c[3].n_signals == 0


def test_named_anchors(spark):
    html = """<a href="/course/view.php?id=2" title="Second"></a><div data-course-id=1><b><a href="/course/9">Nine</a></b></div>
    <a href="/course/view.php?id=1">One</a><a class="course-title" href="/course/view.php?id=1">Again</a><a href="/course/view.php?id=3"></a><a href="/other" class="course-title">Other</a><a class="course-title">x</a>"""
    df = spark.createDataFrame([(1, html, "https://m.example/my/")], "id long, html string, base string")
    href = F.element_at("attributes", F.lit("href"))
    selectors = [F.contains(href, F.lit("/course/view.php")), F.array_contains("classes", "course-title"), F.element_at("marks", F.lit("course")).isNotNull()]
    got = P.named_anchors(node_table(df, "id", "html", MARKS), df.select(F.col("id").alias("page"), "base"), selectors, F.contains("url", F.lit("/course/")))
    rows = sorted((r.selector, r.node, r.url, r.name) for r in got.collect())
    assert [r[2:] for r in rows] == [("https://m.example/course/view.php?id=2", "Second"), ("https://m.example/course/view.php?id=1", "One"), ("https://m.example/course/9", "Nine")]


def test_navigation(spark):
    html = """<nav id=main><ul><li><a href="/sport/">Sport</a><a href="/sport">Sport!</a><a href="https://www.n.example/el%mundo">El mundo</a></ul></nav>
    <div role="navigation"><p><p><p><a href="/world">World news of all the days</a></div><a href="/plain">Plain</a><div class="top-menu"><a href="/m?x=1">M</a></div>
    <a href="/">Home</a><a href="https://other.example/x">Other</a><a href="/news/2024-01-02">Dated</a><a href="/a/article-one">Article</a><a href="/login">Login</a><a href="#x">Hash</a><a href="/empty"> </a>"""
    df = spark.createDataFrame([(1, html, "https://www.n.example/front")], "id long, html string, base string")
    got = P.navigation(node_table(df, "id", "html"), df.select(F.col("id").alias("page"), "base"))
    assert {(r.title, r.url, r.area_score) for r in got.collect()} == {
        ("Sport", "https://www.n.example/sport", 8), ("El mundo", "https://www.n.example/el%mundo", 8), ("World news of all the days", "https://www.n.example/world", 7), ("Plain", "https://www.n.example/plain", 1), ("M", "https://www.n.example/m", 4),
    }
