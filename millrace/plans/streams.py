"""Registered queries of the streaming flows: a stored table is streamed in, and the query is what the flow has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import urls
from millrace.operators import robots
from millrace.plans import fixtures
from millrace.sources.tables import streamed, table
from millrace.streaming import flows


def deduplicated(spark: SparkSession, d: str) -> DataFrame:
    return flows.run_available(flows.deduplicated(streamed(spark, d, "new_url_tasks").select("url", "ts"))).select("url")


def windows(spark: SparkSession, d: str) -> DataFrame:
    counted = flows.windowed_counts(streamed(spark, d, "events").select("event_type", "ts"), "event_type")
    return flows.run_available(counted, mode="complete").select("event_type", "start", "end", "n")


def host_flushes(spark: SparkSession, d: str) -> DataFrame:
    fetches = streamed(spark, d, "new_url_tasks").select(urls.site(F.col("url")).alias("host"), "ts")
    return flows.run_available(flows.host_flushes(fetches), once=True)


def upserts(spark: SparkSession, d: str) -> DataFrame:
    folder = flows.workspace(spark)
    rows = streamed(spark, d, "contents").select("id", "url", "title", "content", "received_at")
    flows.run_batches(rows, flows.upsert_into(f"{folder}/store"), f"{folder}/query")
    stored = flows.latest(spark, f"{folder}/store", 1)
    stored = table(spark, d, "contents").limit(0) if stored is None else stored
    return stored.select("id", "url", "title", F.md5("content").alias("content_md5"))


def retries(spark: SparkSession, d: str) -> DataFrame:
    folder = flows.workspace(spark)
    frontier, waiting = f"{folder}/frontier", f"{folder}/waiting"
    flows.run_batches(streamed(spark, d, "retry_url_tasks"), flows.retry_router(fixtures.as_of(), frontier, waiting), f"{folder}/query")
    sent = flows.drain_waiting(spark, frontier, waiting, 0)
    routes = {"frontier": spark.read.parquet(f"{frontier}/batch=0"), "retry_set": spark.read.parquet(f"{waiting}/batch=0"), "sent": sent}
    return _labelled(routes)


def _labelled(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.select("url", F.lit(name).alias("route")) for name, df in tables.items()]
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    return both


def admission(spark: SparkSession, d: str) -> DataFrame:
    folder = flows.workspace(spark)
    tasks = streamed(spark, d, "new_url_tasks").select("task_id", "url")
    flows.run_batches(tasks, flows.admission(table(spark, d, "domains"), robots.rules(fixtures.robots_bodies(spark)), f"{folder}/verdicts"), f"{folder}/query")
    return spark.read.parquet(f"{folder}/verdicts/batch=0").groupBy(F.lower("host").alias("host"), "verdict").agg(F.count("*").alias("urls"), F.sum("copies").alias("copies"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"stream_dedup": deduplicated, "stream_windows": windows, "stream_host_flushes": host_flushes, "stream_upserts": upserts, "stream_retries": retries, "stream_admission": admission}
