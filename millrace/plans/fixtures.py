"""Small literal inputs for what no stored table holds: robots bodies, redirects, evaluation results, date texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import urls

#: The clock of all registered queries.
AS_OF = "2026-01-15 00:00:00"

ROBOTS = {
    "tinsangmai.news.example": "User-agent: *\nDisallow: /the-thao/\nAllow: /the-thao/ben-*.html$\nCrawl-delay: 1.5\nSitemap: https://tinsangmai.news.example/sitemap.xml\n",
    "larkhavenledger.news.example": "# own rules\nUser-agent: millrace\nDisallow: /culture\nCrawl-delay: 4\n\nUser-agent: *\nDisallow: /\n",
    "trangnuocbiec.news.example": "User-agent: *\nDisallow:\n",
    "greyholmcourier.example": "User-agent: otherbot\nDisallow: /\n\nUser-agent: *\nDisallow: /*/the-*-ferry\nDisallow: /science/*$\nCrawl-delay: soon\n",
}

NEW_HOSTS = ("tinsangmai.news.example", "new-one.example", "new-two.example", " new-one.example ")

DATES = (
    "17/02/2024 08:45 GMT+7", "2024-02-17T08:45:00Z", "2024-02-17T08:45:00-05:00", "2024-02-17T08:45:00.250+05:30", "17/02/2024 08:45", "17/02/2024", "Feb 17, 2024", "17 Feb 2024 08:45",
    "02/17/2024", "31/04/2024", "4 days ago", "1 Hour ago", "90 minutes ago", "today", "Yesterday", "later", "", "2024/02/17 08:45:09", "17-02-2024 08:45", "posted on the page of the town of rivers and bridges and long roads beyond it 5 days ago",
)

#: (model, content, field, expected, answer) and (model, content, tokens before and after filtering).
ANSWERS = (("small", "a", "title", "h1", "h1"), ("small", "a", "author", ".author", ".by"), ("large", "a", "title", "h1", "h1.title"), ("large", "a", "author", ".author", ".author"), ("small", "b", "title", "h1", None), ("large", "b", "title", "h1", "h1"))
TOKENS = (("small", "a", 1000, 80), ("large", "a", 1100, 90), ("small", "b", 400, 190), ("large", "b", 0, 0))


def as_of() -> Column:
    return F.to_timestamp(F.lit(AS_OF))


def robots_bodies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(ROBOTS.items()), "host string, body string")


def answers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ANSWERS), "model string, content string, field string, expected string, answer string")


def token_counts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TOKENS), "model string, content string, before long, after long")


def attempts(retries: DataFrame, metadata: DataFrame) -> DataFrame:
    """A log of fetch attempts (url, ts, status, html) from the stored pages and the retry messages."""
    return metadata.select("url", F.col("last_attempt").alias("ts"), F.col("status_code").alias("status"), F.col("raw_html").alias("html")).unionByName(
        retries.select("url", F.col("last_attempt").alias("ts"), F.col("http_status").alias("status"), F.lit(None).cast("string").alias("html"))
    )


def typed_attempts(metadata: DataFrame) -> DataFrame:
    """Attempts with a content type and length, which the tables lack, made from the length of the URL."""
    n = F.length("url")
    kind = F.when(n % 6 == 0, "application/json").when(n % 7 == 0, F.lit(None)).otherwise("text/html; charset=UTF-8")
    return metadata.select("url", F.col("status_code").alias("status"), kind.alias("content_type"), F.when(n % 11 == 0, 6_000_000).otherwise(n * 100).cast("long").alias("content_length"))


def redirects(retries: DataFrame) -> DataFrame:
    """Redirects (url, status, location) of one to three hops within and off the host, made from all retried URLs."""
    u = retries.select("url").distinct()
    n = F.length("url")
    first = u.select("url", F.lit(301).alias("status"), F.when(n % 3 == 0, F.lit("https://elsewhere.example/x")).otherwise(F.concat("url", F.lit("/1"))).alias("location"))
    second = u.where(n % 3 == 1).select(F.concat("url", F.lit("/1")).alias("url"), F.lit(302).alias("status"), F.concat("url", F.lit("/2")).alias("location"))
    third = u.where((n % 3 == 1) & (n % 2 == 0)).select(F.concat("url", F.lit("/2")).alias("url"), F.lit(307).alias("status"), F.concat("url", F.lit("/3")).alias("location"))
    return first.unionByName(second).unionByName(third)


def status_cache(retries: DataFrame) -> DataFrame:
    """(id, status, retry_count): a cache of all retried URLs."""
    return retries.select(urls.url_id(F.col("url")).alias("id"), F.col("http_status").alias("status"), "retry_count")


def domain_changes(domains: DataFrame) -> DataFrame:
    """One partial update for each domain: new seeds and inactive for priority 2, last crawl now for even priorities, nothing said otherwise."""
    of_two = F.col("priority") == 2
    return domains.select(
        "domain", F.when(of_two, F.array(F.concat(F.lit("https://"), "domain", F.lit("/new")))).otherwise(F.array().cast("array<string>")).alias("seed_urls"),
        F.when(F.col("priority") % 2 == 0, as_of()).alias("last_crawled"), F.when(of_two, F.lit(False)).alias("active"),
    )


# Literal inputs for operators on what no table holds, with their results written out in plans/oracles.
LINKS = (
    ("http://a.example/b/c/d;p?q", "g"), ("http://a.example/b/c/d;p?q", "./g/"), ("http://a.example/b/c/d;p?q", "/g"), ("http://a.example/b/c/d;p?q", "//g.example/h"), ("http://a.example/b/c/d;p?q", "?y"), ("http://a.example/b/c/d;p?q", "#s"),
    ("http://a.example/b/c/d;p?q", "../../g"), ("http://a.example/b/c/d;p?q", ";x"), ("http://a.example/b/c/d;p?q", "https://o.example/z"), ("http://a.example/b/c/d;p?q", "http://a.example/z"), ("http://a.example/b/c/d;p?q", "mailto:x@y"), ("http://a.example", "x"),
)
CANONICAL = (
    "HTTP://H.Example:80/a//b/../c?b=2&a=1&b=3#f", "http://h.example?PHPSESSID=1&x=", "http://h.example/%7Eme/a b", "http://h.example:8080/\\x?q=a+b%20c*", "https://h.example:443/../x", "foo://h/x", "x", "http://h.example/a?=v&&k",
)
REPLIES = ('```json\n{"title": "h1.t", "content": ".c", "author": "null"}\n```', '{"title": "h1", "content": "#main", "author": ".by", "publish_at": "time"}', "sorry", "{broken")
BODIES = (("text/plain; charset=utf-8", "User-agent: *\nDisallow: /x"), ("text/html", "<b>Disallow</b>: /y"), ("application/json", "Disallow: /z"), (None, "Disallow: /w"))
PAGES = (
    ("1", "https://a.example/x", "<h1>T</h1><div class=content>C <p>c</p></div><span class=author>A</span>"),
    ("2", "https://b.example/x", "<h1>T</h1><main>M &amp; m</main><nav>n</nav>"),
    ("3", "https://c.example/x", "<h1>T</h1><p>no content"),
    ("4", "https://d.example/x", "<header><a class=main href=/h1>h</a></header><div id=content><div class=menu><a href=/m1>m</a></div><a href=/m2>no</a></div><a class='btn' href=/p1>p</a><a class='btn' href=/2024/05/x>p</a><div class=breadcrumbs><a href=/b1/>b</a><a href='#'>b</a></div><a href=/r1>1</a><a href=/r1/>2</a><a href=/once>3</a>"),
)
SELECTORS = (("b.example", "h1", "main", "p:::", None),)


def link_cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LINKS), "base string, href string")


def canonical_cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u,) for u in CANONICAL], "url string")


def replies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(REPLIES)), "n int, reply string")


def typed_bodies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"h{k}.example", *b) for k, b in enumerate(BODIES)], "host string, content_type string, body string")


def date_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in DATES], "text string")


def small_pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*p, 200) for p in PAGES], "id string, url string, raw_html string, status_code int")


def small_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SELECTORS), "domain string, title string, content string, author string, publish_at string")
