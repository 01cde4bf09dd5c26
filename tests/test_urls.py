import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.functions import classify, resolve, urls


def normal(u):
    if u is None or not (n := u.strip("".join(map(chr, range(33)))).lower()):
        return None
    if n.endswith("/") and len(n) > 1 and not (n.count("/") == 3 and n.startswith(("http://", "https://"))):
        n = n[:-1]
    return n if n.startswith(("http://", "https://")) else "http://" + n


URLS = [None, "", " ", "/", "a/", "HTTP://X.org/", "https://h.com/", "https://h.com/a/", " \thttps://h.com/A/?q=/ \n", "ftp://x/", "x.com/", "https://a b/c", "HTTPs://T.example/p/Q.Html", "//h/x"]


def test_normal_form_and_id(spark):
    rows = spark.createDataFrame([(u,) for u in URLS], "u string").select("u", urls.normal_form(F.col("u")).alias("n"), urls.url_id(F.col("u")).alias("i")).collect()
    for r in rows:
        assert r.n == normal(r.u)
        assert r.i == (hashlib.sha256(r.n.encode()).hexdigest() if r.n else None)


def test_parts(spark):
    u = "HTTPS://me@Host.example:80/a/b;c?x=1&y=2#f"
    r = spark.createDataFrame([(u,)], "u string").select(urls.host(F.col("u")).alias("h"), urls.site(F.col("u")).alias("s"), urls.scheme(F.col("u")).alias("c"), urls.path(F.col("u")).alias("p"), urls.query(F.col("u")).alias("q")).first()
    assert (r.h, r.s, r.c, r.p, r.q) == ("Host.example", "host.example", "https", "/a/b;c", "x=1&y=2")


def java_hash(s):
    h = 0
    for c in s:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def test_string_hash(spark):
    words = ["", "a", "tinsangmai.news.example", "zzzzzzzzzz", "polygenelubricants"]
    for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", urls.string_hash(F.col("w")).alias("h"), urls.bucket(F.col("w"), 10).alias("b")).collect():
        assert r.h == java_hash(r.w) and r.b == abs(java_hash(r.w)) % 10


@pytest.mark.parametrize(
    "url,article,section",
    [
        ("https://a.example/story-123456.html", True, True),
        ("https://a.example/kinh-te", False, True),
        ("https://a.example/x/y", False, False),
        ("https://a.example/tag/story-123456.html", False, False),
        ("https://a.example/a.pdf", False, False),
        ("https://a.example/list?p=1&q=2", False, False),
        ("ftp://a.example/x", False, False),
        ("https://a.example/2024-01-02", True, True),
    ],
)
def test_classes(spark, url, article, section):
    r = spark.createDataFrame([(url,)], "u string").select(classify.is_article(F.col("u")).alias("a"), classify.is_section_link(F.col("u")).alias("s")).first()
    assert (r.a, r.s) == (article, section)


def test_resolve():
    base = "http://h.example/a/b/c?q=1"
    assert resolve.resolve(base, "d") == "http://h.example/a/b/d"
    assert resolve.resolve(base, "../d") == "http://h.example/a/d"
    assert resolve.resolve(base, "../../../d") == "http://h.example/d"
    assert resolve.resolve(base, "/x/./y") == "http://h.example/x/./y"
    assert resolve.resolve(base, "?z") == "http://h.example/a/b/c?z"
    assert resolve.resolve(base, "") == base
    assert resolve.resolve(base, "//o.example/z") == "http://o.example/z"
    assert resolve.resolve(base, "https://o.example/z") == "https://o.example/z"
    assert resolve.resolve(base, "https://o.example/z", same_site=True) == base
    assert resolve.resolve(base, "mailto:a@b", same_site=True) == base
    assert resolve.resolve(base, "http://h.example/z", same_site=True) == "http://h.example/z"
    assert resolve.resolve("http://h.example", "x") == "http://h.example/x"


def test_canonical():
    c = resolve.canonical
    assert c("HTTP://H.Example:80/a//b/../c?b=2&a=1&b=3#f") == "http://h.example/a/c?b=3&a=1"
    assert c("http://h.example?PHPSESSID=1") == "http://h.example/"
    assert c("http://h.example/%7Eme/a b") == "http://h.example/~me/a%20b"
    assert c("http://h.example:8080/\\x?q=a+b%20c*") == "http://h.example:8080/x?q=a%2Bb%20c%2A"
    assert c("foo://h/x") is None and c("x") is None and c(None) is None and c("http:///x") is None


def test_split_parts():
    assert resolve.split("s://l/p;m?q#f") == {"scheme": "s", "location": "l", "path": "/p", "parameters": "m", "query": "q", "fragment": "f"}
    assert resolve.split("//l?q")["location"] == "l"


def test_parts_as_columns(spark):
    specs = ["s://l/p;m?q#f", "//l?q", "//l;x", "http://a.example", "p;m;n?a?b#c#d", "", "#", "?", "mailto:x@y", "1a:b", "a/b:c", "http://h/p#s://x?y", " http://h/ ", "x:", "é:y//z"]
    df = spark.createDataFrame([(u, "k") for u in specs] + [(None, "k")], "url string, left string")
    for r in resolve.with_parts(df).collect():
        want = resolve.split(r.url.strip()) if r.url is not None else dict.fromkeys(resolve.PARTS)
        assert {n: r[n] for n in resolve.PARTS} == want, r.url
