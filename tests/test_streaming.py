import glob
import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import fetching
from millrace.plans import fixtures, streams
from millrace.sources import kafka
from millrace.streaming import flows


def stream_of(spark, df, folder, files=3):
    df.repartition(files).write.parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_dedup(spark, tmp_path):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(f"u{k % 5}", t + timedelta(seconds=k)) for k in range(20)], "url string, ts timestamp")
    out = flows.run_available(flows.deduplicated(stream_of(spark, df, tmp_path / "in")), folder=str(tmp_path / "q"))
    assert sorted(r.url for r in out.collect()) == [f"u{k}" for k in range(5)]


def test_windows_match_a_batch(spark, tmp_path):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([("ab"[k % 2], t + timedelta(seconds=40 * k)) for k in range(30)], "kind string, ts timestamp")
    out = flows.run_available(flows.windowed_counts(stream_of(spark, df, tmp_path / "in"), "kind"), mode="complete", folder=str(tmp_path / "q"))
    want = df.groupBy(F.window("ts", "5 minutes", "15 seconds").alias("w"), "kind").count()
    assert sorted((r.kind, r.start, r.n) for r in out.collect()) == sorted((r.kind, r.w.start, r["count"]) for r in want.collect())


def test_host_counters_match_the_batch_form(spark, tmp_path):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([("h", t + timedelta(seconds=k)) for k in range(25)], "host string, ts timestamp").coalesce(1)
    out = flows.run_available(flows.host_flushes(stream_of(spark, df, tmp_path / "in", 1)), folder=str(tmp_path / "q"), once=True)
    assert [r.fetches for r in out.orderBy("us").collect()] == [r.fetches for r in fetching.host_flushes(df).orderBy("flushed_at").collect()] == [1, 10, 10]


def runs(spark, flow, batches, schema, folder, mode):
    """What a flow has written after each of several micro-batches: one run each, with one checkpoint, as state that ends by the clock doesn't end otherwise."""
    found = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/part={k}")
        flows.run_available(flow(spark.readStream.schema(schema).parquet(f"{folder}/in/part=*")), mode=mode, folder=f"{folder}/q", once=True)
        found.append(spark.read.parquet(f"{folder}/q/table"))
        found[-1] = found[-1].collect()
    return found


def test_status_cache_over_three_batches(spark, tmp_path):
    t = lambda h, m=0: datetime(2024, 1, 1, h, m)
    schema = "url string, status int, ts timestamp"
    batches = [
        [("https://A/x/", 404, t(1, 10)), ("https://a/x", 500, t(1)), (None, 200, t(1)), ("https://a/y", 200, t(1)), ("https://a/z", 500, None)],
        # x again within 20 minutes of its failure, y within an hour of its success
        [("https://a/x", 503, t(1, 25)), ("https://a/y", 200, t(1, 50)), ("https://a/y", 500, t(0))],
        # both too late by now: x after 20 minutes, y after an hour
        [("https://a/x", 503, t(1, 50)), ("https://a/y", 500, t(3))],
    ]
    got = [sorted((r.status, r.retry_count, r.known_before) for r in rows) for rows in runs(spark, flows.cached_status, batches, schema, str(tmp_path), "update")]
    assert got[0] == [(200, 0, False), (404, 2, False)]
    assert sorted(set(got[1]) - set(got[0])) == [(200, 0, True), (503, 3, True)]
    assert sorted(set(got[2]) - set(got[1])) == [(500, 1, False), (503, 1, False)]


def test_host_counters_over_batches(spark, tmp_path):
    t = datetime(2024, 1, 1)
    times = [1, 5, 60, 100, 400, 401, 402, 4000, *range(4010, 4040, 2)]
    rows = [("h", t + timedelta(seconds=s)) for s in times]
    out = runs(spark, flows.host_flushes, [rows[:3], rows[3:8], rows[8:]], "host string, ts timestamp", str(tmp_path), "append")[-1]
    batch = fetching.host_flushes(spark.createDataFrame(rows, "host string, ts timestamp"))
    assert sorted((r.us, r.fetches) for r in out) == sorted((int((r.flushed_at - datetime(1970, 1, 1)).total_seconds() * 1_000_000), r.fetches) for r in batch.collect())
    assert [r.fetches for r in batch.orderBy("flushed_at").collect()] == [1, 4, 1, 10]


def test_upserts_and_retries(spark, tmp_path):
    df = spark.createDataFrame([(str(k), f"u{k % 3}", f"t{k}", "c", datetime(2024, 1, 1) + timedelta(hours=k)) for k in range(9)], "id string, url string, title string, content string, received_at timestamp")
    table = str(tmp_path / "store")
    flows.run_batches(stream_of(spark, df, tmp_path / "in"), flows.upsert_into(table), folder=str(tmp_path / "q"))
    got = {r.url: r.title for r in flows.latest(spark, table, 3).collect()}
    assert set(got) == {"u0", "u1", "u2"}
    # a batch touches its own buckets only, and a repeated one changes nothing
    merge = flows.upsert_into(table)
    more = spark.createDataFrame([("x", "new", "t", "c", datetime(2025, 1, 1)), ("y", None, "t", "c", None)], df.schema)
    for _ in range(2):
        merge(more, 3)
        assert {r.url: r.title for r in flows.latest(spark, table, 4).collect()} == got | {"new": "t"}
    assert len(glob.glob(f"{table}/rows/batch=3/bucket=*")) == 1
    assert {r.url: r.title for r in flows.latest(spark, table, 3).collect()} == got
    merge(more.limit(0), 4)
    assert flows.latest(spark, table, 5).count() == 4
    msgs = spark.createDataFrame([('{"url":"u1","retryCount":1,"lastAttempt":"2024-01-01T00:00:00Z","httpStatus":500,"x":1}', None), ("broken", None)], "value string, ts timestamp")
    r = kafka.decoded(msgs, "retry_url_tasks").select("url", F.col("retryCount").alias("retry_count"), F.col("lastAttempt").alias("last_attempt"), F.col("httpStatus").alias("http_status"))
    ready, waiting = str(tmp_path / "ready"), str(tmp_path / "waiting")
    flows.run_batches(stream_of(spark, r, tmp_path / "in2", 1), flows.retry_router(fixtures.as_of(), ready, waiting), folder=str(tmp_path / "q2"))
    assert [x.url for x in spark.read.parquet(ready).collect()] == ["u1"] and spark.read.parquet(waiting).count() == 0


def test_waiting_set_is_drained(spark, tmp_path):
    waiting, front = str(tmp_path / "waiting"), str(tmp_path / "front")
    spark.createDataFrame([(f"u{k}",) for k in (3, 1, 2, 1, 9, 4, 7)], "url string").write.parquet(waiting + "/batch=0")
    ticks = [[r.url for r in flows.drain_waiting(spark, front, waiting, k, 3).orderBy("url").collect()] for k in (0, 1, 1, 2)]
    assert ticks == [["u1", "u2", "u3"], ["u4", "u7", "u9"], ["u4", "u7", "u9"], []]
    assert spark.read.parquet(front).count() == 6


def test_a_query_a_topic(spark, tmp_path):
    seen = {}
    streams = {t: stream_of(spark, spark.createDataFrame([(f"{t}-{k}",) for k in range(4)], "value string"), tmp_path / t, 2) for t in kafka.TEXT_TOPICS}
    handlers = {t: lambda b, n, t=t: seen.setdefault(t, []).extend(r.value for r in b.collect()) for t in kafka.TEXT_TOPICS}
    for q in flows.start_topics(streams, handlers, str(tmp_path / "checkpoints")).values():
        q.awaitTermination(120)
    assert {t: sorted(v) for t, v in seen.items()} == {t: [f"{t}-{k}" for k in range(4)] for t in kafka.TEXT_TOPICS}
    with pytest.raises(ValueError):
        flows.start_topics({}, handlers, str(tmp_path / "none"))


def test_ticks(spark, tmp_path):
    ticks = []
    query = flows.start_tick(spark, "dispatch", ticks.append, str(tmp_path), every="500 milliseconds")
    for _ in range(60):
        if len(ticks) >= 2:
            break
        time.sleep(0.5)
    query.stop()
    assert ticks[:2] == [0, 1]


def test_topics_need_the_connector(spark, tmp_path):
    options = kafka.read_options("b:9092", "new_url_tasks")
    assert options["startingOffsets"] == "earliest" and options["subscribe"] == "new_url_tasks"
    with pytest.raises(Exception, match="kafka"):
        kafka.source(spark, "b:9092", "new_url_tasks")
    stream = stream_of(spark, spark.createDataFrame([("u", 1)], "url string, retryCount int"), tmp_path / "in", 1)
    assert kafka.written(stream, "retry_url_tasks").columns == ["value"] and kafka.sink(stream, "b:9092", "retry_url_tasks", str(tmp_path / "c")) is not None
    rows = kafka.written(spark.createDataFrame([("u", 1)], "url string, retryCount int"), "retry_url_tasks").collect()
    assert rows[0].value == '{"url":"u","retryCount":1}'
    assert kafka.written(spark.createDataFrame([("u",)], "value string"), "fetching_tasks").first().value == "u"


def test_admission_stream(spark, tmp_path):
    doms = spark.createDataFrame([("d", "a.example", [], None, None, 1, True)], "id string, domain string, seed_urls array<string>, last_crawled timestamp, create_at timestamp, priority int, active boolean")
    tasks = spark.createDataFrame([(1, "https://a.example/x"), (2, "https://b.example/")], "task_id long, url string")
    flows.run_batches(stream_of(spark, tasks, tmp_path / "in", 1), flows.admission(doms, None, str(tmp_path / "out")), folder=str(tmp_path / "q"))
    assert {r.url: r.verdict for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"https://a.example/x": "admitted", "https://b.example/": "not_whitelisted"}


def in_parts(spark, small, folder, *names):
    """A folder in which these tables are folders of three files."""
    for name in names:
        spark.read.parquet(f"{small}/{name}.parquet").repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def same_in_parts(spark, small, folder, query, *names):
    shown = lambda d: sorted(map(str, streams.queries()[query](spark, d).collect()))
    found = shown(in_parts(spark, small, folder, *names))
    assert found and found == shown(small)


@pytest.mark.parametrize("query", ["stream_admission", "stream_dedup", "stream_host_flushes"])
def test_tasks_in_parts(spark, small, tmp_path, query):
    same_in_parts(spark, small, tmp_path, query, "new_url_tasks", "domains")


def test_retries_in_parts(spark, small, tmp_path):
    same_in_parts(spark, small, tmp_path, "stream_retries", "retry_url_tasks")


@pytest.mark.parametrize("column", ["http_status", "retry_count"])
def test_retries_in_folders_of_values(spark, small, tmp_path, column):
    spark.read.parquet(f"{small}/retry_url_tasks.parquet").write.partitionBy(column).parquet(f"{tmp_path}/retry_url_tasks.parquet")
    shown = lambda d: sorted(map(str, streams.queries()["stream_retries"](spark, d).collect()))
    found = shown(str(tmp_path))
    assert found and found == shown(small)


def test_upserts_in_parts(spark, small, tmp_path):
    same_in_parts(spark, small, tmp_path, "stream_upserts", "contents")


@pytest.mark.parametrize("kept", ["false", "url is null or trim(title) = ''"])
def test_upserts_of_nothing_valid(spark, small, tmp_path, kept):
    rows = spark.read.parquet(f"{small}/contents.parquet")
    blank = rows.limit(3).withColumn("title", F.lit(" "))
    rows.unionByName(blank).where(kept).write.parquet(f"{tmp_path}/contents.parquet")
    assert streams.queries()["stream_upserts"](spark, str(tmp_path)).count() == 0
