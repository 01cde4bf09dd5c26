import pytest

from millrace.functions import htmltree as h
from millrace.operators import pages
from millrace.sources import adapters


def test_implied_tags_and_entities():
    root = h.parse("<ul><li>a<li>b &amp; c</ul><p>x<p>y<br>z<div>w</div><table><tr><td>1<td>2<tr><td>3</table>")
    assert [b.text for b in h.blocks(root)] == ["a", "b & c", "x", "y", "z", "w", "1", "2", "3"]


def test_hidden_and_raw_text():
    root = h.parse("<title>T</title><script>var a='</p>';</script><p hidden>no</p><p style='display: none'>no</p><p>yes <!-- <p>no</p> --><b>bold</p><p>more</p>")
    assert [b.text for b in h.blocks(root)] == ["yes bold", "more"]


@pytest.mark.parametrize("page", [None, "", "<", "<a", "<a href='x", "</p></div>", "<p" * 500, "<div>" * 5000 + "x", "a" * 200_000, "<a href=\"x>" * 300])
def test_never_fails(page):
    root = h.parse(page)
    h.blocks(root)
    h.render(root)


def test_select():
    root = h.parse("<div id=m class='A b'><p><a href=/x data-k='v1'>l</a></p></div><p class=c>t</p>")
    assert len(h.select(root, "div.a > p a[href]")) == 1
    assert len(h.select(root, "#m p, .c")) == 2
    assert len(h.select(root, "[data-k^=v], [class*='B']")) == 2
    assert h.first_text(root, "p.c") == "t"
    assert h.first_text(root, "p:::") is None and h.first_text(root, None) is None and h.first_text(root, "h9") is None


def test_render():
    page = "<h1>T</h1><p>a<br>b</p><p>c</p><ul><li>one<ul><li>two</ul><li>three</ul><ol><li>x<li>y</ol><table><tr><th>name<th>n</tr><tr><td>long name<td>1<tr><td><p>two</p><p>lines</p><td>22</table><div>end <span hidden>no</span></div>"
    assert h.render(h.parse(page)).split("\n") == ["T", "", "a", "b", "", "c", "", "- one", "  - two", "- three", "1. x", "2. y", "", "name       n", "long name  1", "two lines  22", "", "end"]
    assert h.render(h.parse(f"<table><tr><td>{'x' * 100_000}<td>a<tr><td>b<td>c</table>")) == f"{'x' * 100_000}  a\nb  c" and h.render(h.parse(None)) == ""


def test_html_again():
    page = "<div id=a><p class='b c'>x &lt; y<br>z</p><img src=i></div>"
    assert h.to_html(h.parse(page)) == "<div id=a><p class='b c'>x &lt; y<br>z</p><img src=i></div>"
    assert h.to_html(h.parse("<p>a<p>b")) == "<p>a</p><p>b</p>" and h.to_html(h.parse("<a href=/x/>l</a><i/>t")) == "<a href=/x/>l</a><i/></i>t"


def test_selectors_by_sets_and_one_by_one():
    root = h.parse("<div class='x Menu'><nav><a id=n>1</a></nav></div><p id=menu>2</p><span class=top-menu>3</span>")
    assert [n.tag for n in h.select(root, pages.NAVIGATION)] == ["div", "nav", "p", "span"]


def test_page_facts():
    page = "<link rel=canonical href='https://s.example/here'><nav><a href=/one/>1</a><a href='#'>x</a><a href='https://o.example/y'>y</a></nav><header><div class=menu><a href=/two>2</a></div></header><a href=/three>3</a><a href=/one>1</a><footer>f</footer><h1>T</h1>"
    got = dict(zip(pages.FACTS, pages.facts_of(page, None, list(pages.FACTS))))
    assert got["base"] == got["canonical"] == "https://s.example/here" and got["og_url"] is None and got["title"] == "T"
    # links to other sites become the page itself
    assert got["nav_links"] == ["https://s.example/one/", "https://s.example/here", "https://s.example/two"]
    assert got["header_links"] == ["https://s.example/two"]
    assert "https://s.example/three" in got["page_links"] and len(got["all_links"]) == 6 and "<footer>" not in got["kept_html"] and got["kept_chars"] == len(got["kept_html"])
    assert pages.facts_of("<a href=/x>x</a>", None, ["page_links"]) == ([],)
    assert pages.facts_of(None, "u", ["page_links", "kept_chars", "html_chars"]) == ([], 0, 0)


def test_links_and_sitemap(spark):
    page = "<nav><a href=/one/>1</a><a href=/story-1234567.html>s</a></nav><a href=/three>3</a><a href=/one>1</a><a href=/x/y>deep</a>"
    df = spark.createDataFrame([("i", "https://s.example/", page, 200), ("n", None, None, 200)], "id string, url string, raw_html string, status_code int")
    facts = pages.page_facts(df, pages.LINK_FACTS)
    assert pages.sitemap(facts).first().seeds == ["https://s.example", "https://s.example/one"]
    assert {r.url for r in pages.new_links(facts).collect()} == {"https://s.example/three", "https://s.example/story-1234567.html"}


def test_articles(spark):
    df = spark.createDataFrame([("1", "https://a.example/x", "<h1>T</h1><div class=content>C <p>c</p></div>", 200), ("2", "https://b.example/x", "<h1>T</h1><main>M</main>", 200), ("3", "https://c.example/x", "<h1>T</h1>", 200)], "id string, url string, raw_html string, status_code int")
    reg = spark.createDataFrame([("r", "b.example", "h1", "main", "p:::", None), ("s", None, "h1", "h1", None, None)], "id string, domain string, title string, content string, author string, publish_at string")
    got = {r.id: r for r in pages.articles(df, reg).collect()}
    assert got["1"].content == "C c" and got["1"].is_default and got["1"].parsed
    assert got["2"].content == "M" and not got["2"].is_default and got["2"].author is None
    assert not got["3"].parsed
    missing = pages.missing_selectors(df, reg)
    assert {r.domain for r in missing.collect()} == {"a.example", "c.example"}
    done = adapters.completed_registry(reg, missing, df, adapters.DefaultSelectors)
    assert {r.domain for r in done.where("is_default").collect()} == {"a.example", "c.example"}

    class Provider:
        """Fails twice, then knows an answer from the page that it is shown."""

        def __init__(self):
            self.calls = 0

        def selectors(self, host, text):
            self.calls += 1
            if self.calls % 3:
                raise OSError("limit")
            return {"title": "h1", "content": ".content" if "class=content" in text else None, "author": host, "publish_at": None}

    asked = {r.domain: r for r in adapters.completed_registry(reg, missing, df, Provider, sleep=lambda s: None).where("author is not null").collect()}
    assert asked["a.example"].content == ".content" and asked["c.example"].content is None and not asked["a.example"].is_default


def test_reply(spark):
    from pyspark.sql import functions as F

    replies = ['```json\n{"title": "h1.t", "content": ".c", "author": "null"}\n```', "sorry", None]
    got = [r.s for r in spark.createDataFrame([(x,) for x in replies], "r string").select(pages.reply_selectors(F.col("r")).alias("s")).collect()]
    assert got[0].title == "h1.t" and got[0].author is None
    assert got[1].content == ".content" and got[2].title == "h1"
    assert pages.json_block('x {"a": {"b": 1}} y') == '{"a": {"b": 1}}' and pages.json_block("{") is None
