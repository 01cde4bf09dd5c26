import random
from collections import deque
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators import domains, fetching, frontier, robots
from millrace.operators.joins import lookup_join
from millrace.operators.ranking import ranked
from millrace.plans import crawl, fixtures

DOMAINS = "id string, domain string, seed_urls array<string>, last_crawled timestamp, create_at timestamp, priority int, active boolean"


def registry(spark, rows):
    return spark.createDataFrame([(d, d, [f"https://{d}", f"https://{d}/s"], c, None, p, a) for d, c, p, a in rows], DOMAINS)


def test_admission(spark):
    reg = registry(spark, [("a.example", None, 1, True), ("b.example", None, 2, False)])
    urls = ["https://a.example/x", "https://a.example/x", "https://b.example/y", "https://c.example/z", None, "", "  ", "not-a-url", "gopher://a.example/", "https://A.example/x"]
    tasks = spark.createDataFrame(list(enumerate(urls)), "task_id long, url string")
    got = {r.url: (r.verdict, r.copies) for r in frontier.admit(tasks, reg).collect()}
    assert got["https://a.example/x"] == ("admitted", 2) and got["https://b.example/y"][0] == "admitted"
    assert got["https://c.example/z"][0] == "not_whitelisted" and got["https://A.example/x"][0] == "not_whitelisted"
    assert got[None][0] == got[""][0] == got["  "][0] == "blank"
    assert got["not-a-url"][0] == got["gopher://a.example/"][0] == "malformed"
    queued = frontier.admit(tasks, reg, queued=spark.createDataFrame([("https://b.example/y",)], "url string"))
    assert {r.url: r.verdict for r in queued.collect()}["https://b.example/y"] == "queued"


@pytest.mark.parametrize("cursor", [0, 3, 8])
def test_front_queue_against_a_simulation(spark, cursor):
    rng = random.Random(cursor)
    rows = [(f"https://h{rng.randrange(9)}.example/{k}", f"h{rng.randrange(9)}.example", rng.choice([0, 1, 2, 3, 3, 5]), None if rng.random() < 0.3 else datetime(2024, 1, 1 + rng.randrange(9))) for k in range(80)]
    df = spark.createDataFrame(rows, "url string, host string, priority int, last_crawled timestamp")
    got = [r.url for r in frontier.front_order(df, cursor).where("visit is not null").orderBy("visit").collect()]
    keyed = frontier.with_front_queue(df).collect()
    queues = {p: deque(sorted((r for r in keyed if r.priority == p), key=lambda r: (r.last_crawled is not None, r.last_crawled or datetime.min, r.subqueue, r.url))) for p in (1, 2, 3)}
    want, at = [], cursor
    while any(queues.values()):
        q = queues[frontier.SCHEDULE[at % 9]]
        if q:
            want.append(q.popleft().url)
        at += 1
    assert got == want
    assert [r.url for r in frontier.front_batch(df, 10, cursor).collect()] == want[:10]


def test_back_queue(spark):
    rows = [(f"https://h{k % 5}.example/{k}", f"H{k % 5}.example", k) for k in range(40)]
    back = frontier.back_order(spark.createDataFrame(rows, "url string, host string, visit long"), capacity=5).collect()
    by = {}
    for r in sorted(back, key=lambda r: r.place):
        by.setdefault(r.queue, []).append(r.visit)
    assert all(v == sorted(v) and len(v) <= 5 for v in by.values())


def test_statistics_and_empty(spark):
    none = spark.createDataFrame([], "url string, host string, priority int, last_crawled timestamp, visit long")
    stats = frontier.statistics(frontier.with_front_queue(none), frontier.back_order(none.select("url", "host", "visit")))
    assert frontier.is_empty(stats).first().empty
    one = spark.createDataFrame([("https://a/1", "a", 1, None, 1)], none.schema)
    stats = frontier.statistics(frontier.with_front_queue(one), frontier.back_order(one.select("url", "host", "visit")))
    assert not frontier.is_empty(stats).first().empty
    assert {(r.side, r.urls) for r in stats.where("queue is null").collect()} == {("front", 1), ("back", 1), ("all", 2), ("hosts", 1)}


def test_retries(spark):
    rows = [("u1", 1, datetime(2026, 1, 14)), ("u2", 4, datetime(2020, 1, 1)), ("u3", 0, None), ("u4", 1, datetime(2026, 1, 14, 23, 58)), (None, 1, None), ("u0", 9, None)]
    gated = frontier.retry_gate(spark.createDataFrame(rows, "url string, retry_count int, last_attempt timestamp"), fixtures.as_of())
    assert {r.url: r.route for r in gated.collect()} == {"u1": "frontier", "u2": "retry_set", "u3": "frontier", "u4": "retry_set", "u0": "retry_set"}
    assert [r.url for r in frontier.retry_drain(gated, 2).collect()] == ["u0", "u2"]


def test_domains(spark):
    reg = registry(spark, [("a.example", None, 2, True), ("b.example", None, 4, False)])
    new = domains.bootstrap(reg, domains.configured(spark, ["a.example", "n.example", " n.example ", ""]), fixtures.as_of()).collect()
    assert [(r.domain, r.priority, r.seed_urls) for r in new] == [("n.example", 1, ["https://n.example"])]
    changes = fixtures.domain_changes(reg)  # of every domain
    updated = {r.domain: r for r in domains.update(reg, changes).collect()}
    assert updated["a.example"].seed_urls == ["https://a.example/new"] and updated["a.example"].active is False and updated["b.example"].active is False
    assert updated["b.example"].priority == 4 and updated["b.example"].last_crawled is not None
    assert {r.domain: r.active for r in domains.update(reg, changes, strict=True).collect()}["b.example"] is True
    assert domains.create(reg, reg).count() == 2 and domains.delete(reg, reg.limit(1)).count() == 1
    ticks = domains.recrawl_ticks(reg, fixtures.as_of(), fixtures.as_of() + F.expr("interval 1 hour"))
    assert ticks.count() == 2 * 3


def test_ranked_spreads_one_key(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), (F.col("id") * 7919 % 1000).alias("v"))
    got = ranked(df.unionByName(spark.createDataFrame([(None, 1)], "k string, v long")), ["k"], [F.col("v")], "n").collect()
    assert all(r.n == r.v + 1 for r in got if r.k == "k") and [r.n for r in got if r.k is None] == [1]


@pytest.mark.parametrize("limit", [1 << 20, 0])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join_ways_agree(spark, limit, how):
    large = spark.range(50).select((F.col("id") % 7).alias("k"), "id").unionByName(spark.createDataFrame([(None, 99)], "k long, id long"))
    small = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, v string")
    got = lookup_join(large, small, ["k"], how, limit=limit)
    want = large.join(small, ["k"], how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_outcomes(spark):
    rows = [("https://a/", 200, "text/html", 1), ("https://a/x", 200, "text/html", 1), ("https://a/x", 404, "text/html", 1), ("https://a/x", 404, "application/json", 1), ("https://a/x", 200, None, 1), ("https://a/x", 200, "text/html", 6 << 20), (" ", 200, "text/html", 1), ("https://a/x", None, "text/html", 1)]
    got = [r.outcome for r in fetching.outcome(spark.createDataFrame(rows, "url string, status int, content_type string, content_length long")).collect()]
    assert got == ["home", "content", "retry", "skipped", "failed", "too_large", "blank", "retry"]


def test_decoded(spark):
    rows = [(b"caf\xc3\xa9", "text/html; charset=utf-8"), ("café".encode("latin-1"), "text/html; charset=ISO-8859-1"), (b"abc", "x; charset=nope"), (None, None)]
    got = fetching.decoded(spark.createDataFrame(rows, "b binary, t string"), "b", "t", 4).collect()
    assert got[1].text == "café" and got[2].text == "abc" and got[3].text is None and got[0].truncated


def test_fold_metadata(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    rows = [("https://a/x", t(1), 500, None), ("HTTPS://A/x/", t(2), 200, "one"), ("https://a/x", t(3), 200, "two"), ("https://a/x", t(4), 404, "err"), ("https://a/x", t(5), None, None), ("https://a/x", None, 200, None), (None, t(1), 200, "z"), ("https://b/", t(1), 503, None)]
    df = spark.createDataFrame(rows, "url string, ts timestamp, status int, html string")
    got = {r.url: r for r in fetching.fold_metadata(df).collect()}
    assert set(got) == {"https://a/x", "https://b/"}
    a = got["https://a/x"]
    assert (a.raw_html, a.status_code, a.retry_count, a.last_attempt) == ("one", None, 2, t(5))
    assert got["https://b/"].retry_count == 1
    assert {r.url: r.raw_html for r in fetching.fold_metadata(df, refresh=True).collect()}["https://a/x"] == "err"
    assert fetching.lookup(fetching.fold_metadata(df), " https://A/X ").count() == 1


def test_may_fetch(spark):
    meta = spark.createDataFrame([("https://a/story-1234.html", 200, 0, datetime(2024, 1, 1)), ("https://a/list", 200, 0, None), ("https://a/bad", 500, 9, datetime(2026, 1, 14, 23, 59)), ("https://a/old", 500, 9, datetime(2024, 1, 1))], "url string, status_code int, retry_count int, last_attempt timestamp")
    from millrace.functions import urls

    meta = meta.withColumn("id", urls.url_id(F.col("url")))
    links = spark.createDataFrame([(u,) for u in ["https://a/story-1234.html", "https://a/list", "https://a/bad", "https://a/old", "https://new/", None, "x"]], "url string")
    got = {r.url: r.allowed for r in fetching.may_fetch(links, meta, None, fixtures.as_of()).collect()}
    assert got == {"https://a/story-1234.html": False, "https://a/list": True, "https://a/bad": False, "https://a/old": True, "https://new/": True, None: False, "x": False}
    cache = meta.select("id", F.col("status_code").alias("status"), "retry_count")
    assert {r.url: r.allowed for r in fetching.may_fetch(links, meta, cache, fixtures.as_of(), strict=True).collect()}["https://a/bad"] is True


def test_host_flushes(spark):
    rows = [("a", datetime(2024, 1, 1, 0, 0, k)) for k in range(23)] + [("b", datetime(2024, 1, 1, 0, 0, 0)), ("b", datetime(2024, 1, 1, 0, 3, 1)), (None, datetime(2024, 1, 1)), ("c", None)]
    got = sorted((r.host, r.fetches) for r in fetching.host_flushes(spark.createDataFrame(rows, "host string, ts timestamp")).collect())
    assert got == [("a", 1), ("a", 10), ("a", 10), ("b", 1), ("b", 1)]


def test_redirects(spark):
    red = spark.createDataFrame([("https://a/1", 301, "https://a/2"), ("https://a/2", 302, "https://a/3"), ("https://a/3", 307, "https://a/4"), ("https://a/x", 301, "https://b/"), ("https://a/y", 200, "https://a/z")], "url string, status int, location string")
    got = {r.url: (r.final_url, r.hops, r.result) for r in fetching.resolve_redirects(spark.createDataFrame([(u,) for u in ("https://a/1", "https://a/2", "https://a/x", "https://a/y")], "url string"), red).collect()}
    assert got == {"https://a/1": ("https://a/3", 2, "too_many"), "https://a/2": ("https://a/4", 2, "ok"), "https://a/x": ("https://a/x", 0, "off_host"), "https://a/y": ("https://a/y", 0, "ok")}


def test_closure(spark):
    from millrace.functions import urls

    pages_ = [("https://a.example/", "<a href=/one>1</a>"), ("https://a.example/one", "<a href=/two>2</a><a href=/one>1</a>"), ("https://a.example/two", "<a href='https://z.example/'>z</a>")]
    meta = spark.createDataFrame([(u, h, 200, 0, None) for u, h in pages_], "url string, raw_html string, status_code int, retry_count int, last_attempt timestamp").withColumn("id", urls.url_id(F.col("url")))
    got = crawl.closure(spark.createDataFrame([("https://a.example/",)], "url string"), meta, registry(spark, [("a.example", None, 1, True)]), fixtures.as_of())
    assert {r.url: r.depth for r in got.collect()} == {"https://a.example/": 0, "https://a.example/one": 1, "https://a.example/two": 2}


def test_closure_goes_on_to_the_end(spark):
    from millrace.functions import urls

    words = "one two three four five six seven eight nine ten eleven".split()
    pages_ = [(f"https://a.example/{w}", f"<a href=/{n}>next</a>") for w, n in zip(words, words[1:])]
    meta = spark.createDataFrame([(u, h, 200, 0, None) for u, h in pages_], "url string, raw_html string, status_code int, retry_count int, last_attempt timestamp").withColumn("id", urls.url_id(F.col("url")))
    seeds, reg = spark.createDataFrame([("https://a.example/one",)], "url string"), registry(spark, [("a.example", None, 1, True)])
    got = crawl.closure(seeds, meta, reg, fixtures.as_of())
    assert {r.url: r.depth for r in got.collect()} == {f"https://a.example/{w}": k for k, w in enumerate(words)}
    assert crawl.closure(seeds, meta, reg, fixtures.as_of(), max_depth=2).count() == 3
    assert crawl.closure(seeds.limit(0), meta, reg, fixtures.as_of()).count() == 0


def test_robots_bodies_of_other_types_are_not_read(spark):
    got = robots.rules(fixtures.typed_bodies(spark)).collect()
    assert [(r.host, r.pattern) for r in got] == [("h0.example", "/x"), ("h1.example", "/y")]
