import http.server
import threading
import time
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import analysis
from millrace.operators import metrics, robots, store
from millrace.plans import fixtures
from millrace.sources import adapters

CONTENTS = "id string, url string, title string, content string, received_at timestamp"


def rows(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    return spark.createDataFrame([("1", "u", "old", "c", t(1)), ("2", "u", "new", "c", t(3)), ("3", "u", "mid", "c", t(2)), ("4", "v", " ", "c", t(1)), ("5", None, "t", "c", t(1)), ("6", "w", "t", "c", t(1))], CONTENTS)


def test_upsert(spark):
    got = {r.url: r for r in store.upserted(None, rows(spark), F.struct("received_at", "id")).collect()}
    assert set(got) == {"u", "w"} and (got["u"].id, got["u"].title, got["u"].is_insert) == ("1", "new", True)
    old = spark.createDataFrame([("9", "u", "stored", "c", datetime(2023, 1, 1)), ("8", "z", "kept", "c", None)], CONTENTS)
    got = {r.url: r for r in store.upserted(old, rows(spark), F.struct("received_at", "id")).collect()}
    assert (got["u"].id, got["u"].title, got["u"].is_insert) == ("9", "new", False) and got["z"].title == "kept" and got["w"].is_insert
    c = store.store_counters(rows(spark)).first()
    assert (c.stored, c.failed) == (2, 2)


def test_keyword_search(spark):
    df = spark.createDataFrame([("1", "a", "Thời sự hôm nay", "x", datetime(2024, 1, 1)), ("2", "b", "x", "THOI  SU, và", datetime(2024, 1, 2)), ("3", "c", "thoi", "su", None), ("4", "d", None, "đường thời-sự", None)], "id string, url string, title string, content string, publish_at timestamp")
    assert [r.id for r in store.keyword_search(df, "thời sự").collect()] == ["2", "1", "4"]
    assert [(r.id, r.score) for r in store.keyword_search(df, "Thoi Su", sort="score").collect()] == [("1", 3.0), ("2", 1.0), ("4", 1.0)]
    assert store.keyword_search(df, " - ").count() == 0 and store.keyword_search(df, None).count() == 0
    assert [r.id for r in store.keyword_search(df, "duong", page=0).collect()] == ["4"]
    assert store.keyword_search(df, "thoi su", page=1, size=2).count() == 1


def test_index_agrees_with_search(spark, tmp_path):
    rows = [("1", "a", "to be or not to be", "be to", datetime(2024, 1, 1)), ("2", "b", None, "not TO  be; to, be", datetime(2024, 1, 2)), ("3", "c", "be", "", None), ("4", "d", "tobe", "to\nbe", None), (None, "e", "to be", "to be", None)]
    df = spark.createDataFrame(rows, "id string, url string, title string, content string, publish_at timestamp")
    store.write_index(df, str(tmp_path / "index"))
    for index in (store.word_index(df), spark.read.parquet(str(tmp_path / "index"))):
        for phrase in ("to be", "be to", "to be to be", "be", "not", "absent", " ", None, "to be or not"):
            for sort in ("publish_at", "score"):
                want = [(r.id, r.score) for r in store.keyword_search(df.where("id is not null"), phrase, size=9, sort=sort).collect()]
                assert [(r.id, r.score) for r in store.indexed_search(index, df, phrase, size=9, sort=sort).collect()] == want, (phrase, sort)
    assert store.word_index(df.limit(0)).count() == 0


def test_semantic_search(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((50, 8))
    data = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(90, None), (91, [0.0] * 8), (92, [1.0]), (93, [])]
    df = spark.createDataFrame(data, "id long, content_embedding array<float>")
    q = vectors[7] + 0.1
    cos = vectors @ q / np.linalg.norm(vectors, axis=1) / np.linalg.norm(q)
    got = store.semantic_search(df, q.tolist(), size=6).collect()
    assert [r.id for r in got] == np.argsort(-cos)[:6].tolist() and abs(got[0].score - cos.max() - 1) < 1e-6
    assert [r.id for r in store.semantic_search(df, q.tolist(), page=1, size=3).collect()] == np.argsort(-cos)[3:6].tolist()
    assert store.semantic_total(df).first().total == 53
    one = store.with_rank(store.semantic_search(df, q.tolist(), size=3), [F.col("score").desc()]).select("id", "rank")
    assert store.reciprocal_rank([one, one]).first().id == int(np.argmax(cos))


def test_embedding(spark):
    df = spark.createDataFrame([(" T ", " c" * 9000), ("", None), (None, "x")], "t string, c string").select(analysis.embedding_text(F.col("t"), F.col("c")).alias("e"))
    got = [r.e for r in df.collect()]
    assert len(got[0]) == 8002 and got[0].startswith("T c") and got[1] == "" and got[2] == "x"
    out = adapters.embedded(df, "e", lambda: adapters.HashEmbedder(16)).collect()
    assert len(out[0].embedding) == 16 and out[1].embedding == []
    assert adapters.delays_ms() == [1000, 2000]


def test_fetched(spark):
    make = lambda: adapters.StoredPages({"a": (200, "text/html", b"abc"), "https://h.example/robots.txt": (200, "text/plain", b"User-agent: *\nDisallow: /x"), "https://j.example/robots.txt": (200, "application/json", b"Disallow: /x")})
    pages = {r.url: r for r in adapters.fetched(spark.createDataFrame([("a",), ("b",), ("a",)], "url string"), make, cap=3).collect()}
    assert (pages["a"].status, bytes(pages["a"].body), pages["a"].content_length) == (200, b"abc", 3) and pages["b"].status == 404
    large = adapters.fetched(spark.createDataFrame([("a",)], "url string"), make, cap=2).first()
    assert large.body is None and large.content_length == 3 and large.error == "too_large"
    bodies = adapters.robots_bodies(spark.createDataFrame([("h.example",), ("i.example",), ("j.example",), (None,)], "host string"), make)
    assert {r.host: r.pattern for r in robots.rules(bodies).collect()} == {"h.example": "/x"}


def test_retried_calls():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert adapters.tried(call, sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        adapters.tried(lambda: (_ for _ in ()).throw(OSError()), attempts=2, sleep=waits.append)
    with pytest.raises(adapters.TooLarge):
        adapters.tried(lambda: (_ for _ in ()).throw(adapters.TooLarge(5)), sleep=lambda s: pytest.fail("waited"), final=(adapters.TooLarge,))


class Site(http.server.BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        body = b"x" * 50
        if self.path == "/moved":
            self.send_response(301)
            self.send_header("Location", "/new")
            self.end_headers()
        elif self.path == "/gone":
            self.send_error(404)
        elif self.path == "/slow":
            time.sleep(1)
        else:
            self.send_response(200)
            self.send_header("Content-Type", "text/html")
            if self.path != "/undeclared":
                self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_http_fetcher():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    waits = []
    client = adapters.HttpFetcher(timeout_s=0.3, gap_ms=200, sleep=waits.append, clock=lambda: 0.0)
    page = client.fetch(at + "/page", 100)
    assert (page.status, page.content_type, page.body, page.length) == (200, "text/html", b"x" * 50, 50)
    moved = client.fetch(at + "/moved", 100)
    assert (moved.status, moved.location) == (301, "/new") and client.fetch(at + "/gone", 10_000).status == 404
    for path in ("/page", "/undeclared"):
        with pytest.raises(adapters.TooLarge):
            client.fetch(at + path, 10)
    with pytest.raises(OSError):
        client.fetch(at + "/slow", 10)
    assert waits == [0.2] * 5  # a gap before each request but the first
    server.shutdown()


def test_metrics(spark):
    t = lambda s: datetime(2024, 1, 1, 0, s // 60, s % 60)
    series = spark.createDataFrame([("m", None, t(0), 10), ("m", None, t(60), 70), ("m", None, t(120), 5), ("m", None, t(500), 6)], "metric string, label string, ts timestamp, value long")
    got = [round(r.rate, 6) for r in metrics.rate(series).orderBy("ts").collect()]
    assert got == [0.0, round(60 / 300, 6), round(65 / 300, 6), 0.0]
    assert metrics.last_values(series).first().value == 6 and metrics.total(series).first().total == 6 and metrics.top(series, 1).first().value == 6
    assert {(r.model, r.content): r.reduction for r in metrics.reduction(fixtures.token_counts(spark)).collect()} == {("small", "a"): 92.0, ("large", "a"): 91.82, ("small", "b"): 52.5, ("large", "b"): None}
