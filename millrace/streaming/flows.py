"""The operators over streams: in-flight dedup, status cache, host counters, rates, upserts, retries, the frontier loop.

Each stage is one query with its own checkpoint, so a crash repeats a micro-batch instead of losing it. State is bounded
by watermarks or time to live. ``run_available`` runs a query over what there is and returns its table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.functions import urls
from millrace.operators import frontier, store
from millrace.operators.fetching import FORGET_S, HostCounter
from millrace.session import checkpoint_dir, cut

FAILURE_TTL_S, SUCCESS_TTL_S = 20 * 60, 60 * 60
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def workspace(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, mode: str = "append", folder: str | None = None, once: bool = False) -> DataFrame:
    """Run a streaming query over all available input, or with ``once`` one micro-batch (for state with a time to live), and return what it wrote."""
    spark = stream.sparkSession
    folder = folder or workspace(spark)
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(**({"once": True} if once else {"availableNow": True}))
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/table").outputMode("append").start().awaitTermination()
    else:
        # each micro-batch overwrites the complete or updated result
        writer.outputMode(mode).foreachBatch(lambda b, n: b.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/table")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], folder: str | None = None) -> None:
    """Run ``each`` on every micro-batch of the available input."""
    folder = folder or workspace(stream.sparkSession)
    stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def deduplicated(tasks: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Tasks without those whose URL is in flight: seen within the watermark."""
    return tasks.withWatermark(ts, late).dropDuplicatesWithinWatermark(["url"])


def windowed_counts(events: DataFrame, key: str, ts: str = "ts", window: str = "5 minutes", slide: str = "15 seconds", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n, rate): events per sliding window."""
    seen = events.withColumn("__at", F.col(ts).cast("timestamp")).withWatermark("__at", late)
    counted = seen.groupBy(F.window("__at", window, slide).alias("w"), key).agg(F.count("*").alias("n"))
    seconds = F.unix_seconds("w.end") - F.unix_seconds("w.start")
    return counted.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", (F.col("n") / seconds).alias("rate"))


class StatusCache(StatefulProcessor):
    """The last status of each URL and its failures since the last success, known for SUCCESS_TTL_S after a success and FAILURE_TTL_S after a failure.

    Times are those of the attempts, so a replay gives what the first run gave; attempts older than the last known one
    change nothing. The state itself is dropped by the clock after the longer of both times. Counts that must outlive it
    stand in the metadata (fetching.fold_metadata).
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("status", "status int, retry_count int, us long", ttlDurationMs=1000 * max(SUCCESS_TTL_S, FAILURE_TTL_S))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = pd.concat([b[["status", "us"]] for b in rows]).sort_values("us", kind="stable")
        status, retries, at = self.state.get() if self.state.exists() else (None, 0, None)
        known = at is not None and len(found) > 0 and not self.expired(status, at, int(found["us"].iat[0]))
        for s, us in zip(found["status"], found["us"]):
            if at is not None and us < at:
                continue
            if at is not None and self.expired(status, at, int(us)):
                retries = 0
            status, at = (0 if pd.isna(s) else int(s)), int(us)
            retries = 0 if status == 200 else retries + 1
        if at is not None:
            self.state.update((status, retries, at))
        yield pd.DataFrame({"id": [key[0]], "status": [status], "retry_count": [retries], "known_before": [known]})

    @staticmethod
    def expired(status: int | None, at: int, now: int) -> bool:
        return now - at > 1_000_000 * (SUCCESS_TTL_S if status == 200 else FAILURE_TTL_S)

    def close(self) -> None:
        pass


def cached_status(attempts: DataFrame) -> DataFrame:
    """(id, status, retry_count, known_before) per micro-batch from (url, status, ts); attempts without a time are left out. Needs the RocksDB state store."""
    keyed = attempts.where(~urls.is_blank(F.col("url")) & F.col("ts").isNotNull()).select(urls.url_id(F.col("url")).alias("id"), "status", F.unix_micros("ts").alias("us"))
    return keyed.groupBy("id").transformWithStateInPandas(StatusCache(), "id string, status int, retry_count int, known_before boolean", "update", "processingTime")


def host_flushes(fetches: DataFrame) -> DataFrame:
    """(host, us, fetches): flushes of each host's counter, from (host, ts); the batch form is fetching.host_flushes.

    A host's state is dropped FORGET_S after its last fetch; a counter that old starts anew anyway.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, since = state.get if state.exists else (0, -1)
        counter = HostCounter(count, since if since >= 0 else None)
        rows = []
        for us in np.sort(np.concatenate([b["us"].to_numpy() for b in batches])).tolist():
            n = counter.see(us)
            if n is not None:
                rows.append((key[0], us, n))
        state.update((counter.count, -1 if counter.since is None else counter.since))
        state.setTimeoutDuration(1000 * FORGET_S)
        yield pd.DataFrame(rows, columns=["host", "us", "fetches"])

    keyed = fetches.where("host is not null and ts is not null").select("host", F.unix_micros("ts").alias("us"))
    return keyed.groupBy("host").applyInPandasWithState(fold, "host string, us long, fetches int", "count int, since long", "append", GroupStateTimeout.ProcessingTimeTimeout)


#: Buckets of a store by a hash of the URL.
STORE_BUCKETS = 64


def _versions(spark: SparkSession, folder: str, n: int) -> dict[int, int]:
    """The batch that wrote each bucket last, as it was after batch ``n``; at most one entry a bucket."""
    return {r.bucket: r.version for r in spark.read.parquet(f"{folder}/versions/batch={n}").collect()} if n >= 0 else {}


def _buckets(spark: SparkSession, folder: str, versions: dict[int, int]) -> DataFrame | None:
    paths = [f"{folder}/rows/batch={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.parquet(*paths) if paths else None


def upsert_into(folder: str, buckets: int = STORE_BUCKETS) -> Callable[[DataFrame, int], None]:
    """A micro-batch function that merges contents into a store of ``buckets`` parts by a hash of the URL.

    Only the buckets that a batch touches are read and written; the list of each bucket's version is written last, from
    that of the batch before, so a repeated batch gives the same store and a reader sees whole batches.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        versions = _versions(spark, folder, n - 1)
        bucket = F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int")
        touched = [r.bucket for r in store.validated(batch).where("valid").select(bucket.alias("bucket")).distinct().collect()]  # at most ``buckets``
        if touched:
            old = _buckets(spark, folder, {b: versions[b] for b in touched if b in versions})
            merged = store.upserted(None if old is None else old.drop("is_insert"), batch, F.struct("received_at", "id"))
            merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/rows/batch={n}")
        now = sorted((versions | dict.fromkeys(touched, n)).items())
        spark.createDataFrame(now, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/versions/batch={n}")

    return merge


def latest(spark: SparkSession, folder: str, batches: int) -> DataFrame | None:
    """The store after so many batches; none if nothing has been stored."""
    return _buckets(spark, folder, _versions(spark, folder, batches - 1))


def retry_router(as_of: Column, frontier_path: str, waiting_path: str) -> Callable[[DataFrame, int], None]:
    """A micro-batch function that sends ready retries to the frontier and others to the waiting set, each under its batch number."""

    def route(batch: DataFrame, n: int) -> None:
        gated = frontier.retry_gate(batch, as_of)
        gated.where("route = 'frontier'").select("url").distinct().write.mode("overwrite").parquet(f"{frontier_path}/batch={n}")
        gated.where("route = 'retry_set'").select("url").distinct().write.mode("overwrite").parquet(f"{waiting_path}/batch={n}")

    return route


def drain_waiting(spark: SparkSession, frontier_path: str, waiting_path: str, tick: int, n: int = frontier.RETRY_BATCH) -> DataFrame:
    """(url): the ``n`` smallest URLs of the waiting set that no tick has sent back yet, written to the frontier under this tick. A repeated tick sends the same."""
    waiting = spark.read.parquet(waiting_path).select("url").distinct()
    before = spark.read.schema("url string, tick int").parquet(f"{waiting_path}_sent") if tick else None
    left = waiting if before is None else waiting.join(before.where(F.col("tick") < tick).select("url"), "url", "left_anti")
    sent = cut(left.orderBy("url").limit(n))
    sent.write.mode("overwrite").parquet(f"{waiting_path}_sent/tick={tick}")
    sent.write.mode("overwrite").parquet(f"{frontier_path}/batch=retry-{tick}")
    return sent


def admission(domains: DataFrame, rules: DataFrame | None, folder: str) -> Callable[[DataFrame, int], None]:
    """A micro-batch function that admits tasks against a snapshot of domains and rules and writes the verdicts."""

    def admit(batch: DataFrame, n: int) -> None:
        frontier.admit(batch, domains, rules).write.mode("overwrite").parquet(f"{folder}/batch={n}")

    return admit


#: How often the crawler's own clocks tick.
TICKS = {"front_to_back": "3 seconds", "dispatch": "2 seconds", "retry": "5 minutes", "statistics": "30 seconds", "recrawl": "20 minutes"}


def start_topics(streams: Mapping[str, DataFrame], handlers: Mapping[str, Callable[[DataFrame, int], None]], folder: str, every: str | None = None) -> dict[str, StreamingQuery]:
    """One query a topic, each with its own checkpoint: its micro-batches go to the topic's handler. Without ``every`` what there is is worked off once."""
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    unknown = set(handlers) - set(streams)
    if unknown:
        raise ValueError(f"topics: {sorted(unknown)}")
    return {t: streams[t].writeStream.queryName(f"{t}-{uuid.uuid4().hex[:8]}").option("checkpointLocation", f"{folder}/{t}").trigger(**trigger).foreachBatch(h).start() for t, h in handlers.items()}


def start_tick(spark: SparkSession, name: str, each: Callable[[int], None], folder: str, every: str | None = None) -> StreamingQuery:
    """Call ``each`` with the number of the tick, at the pace of TICKS[name] or ``every``; a crash repeats a tick."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.option("checkpointLocation", f"{folder}/tick-{name}").trigger(processingTime=every or TICKS[name]).foreachBatch(lambda _, n: each(n)).start()
