"""What became of fetches: outcomes, redirects, the metadata that is kept, and whether a URL may be fetched again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import classify, urls
from millrace.operators.frontier import RETRY_DELAY_S, RETRY_LIMIT

# Statuses that redirect, hops that are followed, size caps in bytes, when a host's counter is flushed.
REDIRECTS = (300, 301, 302, 303, 307, 308)
MAX_HOPS = 2
PAGE_BYTES, ROBOTS_BYTES = 5 << 20, 500 << 10
FLUSH_FETCHES, FLUSH_GAP_S, FORGET_S = 10, 180, 1200


def outcome(attempts: DataFrame) -> DataFrame:
    """Attempts (url, status, content_type, content_length) with ``outcome``: blank, too_large, failed (no content type), skipped (no HTML), retry (status other than 200), home or content.

    The content type is looked at before the status, so an error page that isn't HTML is dropped without a retry.
    """
    o = (
        F.when(urls.is_blank(F.col("url")), "blank")
        .when(F.col("content_length") > PAGE_BYTES, "too_large")
        .when(F.col("content_type").isNull(), "failed")
        .when(~F.contains("content_type", F.lit("html")), "skipped")
        .when(~F.col("status").eqNullSafe(200), "retry")
        .when(classify.is_home(F.col("url")), "home")
        .otherwise("content")
    )
    return attempts.withColumn("outcome", o)


def fetch_counters(outcomes: DataFrame) -> DataFrame:
    """(host, fetched, failed) by site."""
    return outcomes.groupBy(urls.site(F.col("url")).alias("host")).agg(F.count_if(F.col("outcome").isin("home", "content")).alias("fetched"), F.count_if(F.col("outcome").isin("retry", "failed", "too_large")).alias("failed"))


def decoded(df: DataFrame, body: str, charset: str, cap: int) -> DataFrame:
    """Adds ``text`` and ``truncated`` of a binary body: its first ``cap`` bytes in the charset of its content type, UTF-8 if that isn't known."""
    name = F.upper(F.regexp_extract(F.col(charset), r"(?i)charset=\s*\"?([\w.:-]+)", 1))
    part = F.substring(F.col(body), 1, cap)
    known = {"US-ASCII": "US-ASCII", "ASCII": "US-ASCII", "ISO-8859-1": "ISO-8859-1", "LATIN1": "ISO-8859-1", "UTF-16": "UTF-16", "UTF-16BE": "UTF-16BE", "UTF-16LE": "UTF-16LE"}
    df = df.withColumn("__part", part)
    value = F.make_valid_utf8(F.col("__part").cast("string"))
    for label, codec in known.items():
        value = F.when(name == label, F.decode("__part", codec)).otherwise(value)
    return df.withColumn("text", value).withColumn("truncated", F.octet_length(F.col(body)) > cap).drop("__part")


def resolve_redirects(starts: DataFrame, redirects: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """(url, final_url, hops, result) of (url) over (url, status, location): ok, off_host or too_many.

    A chain is followed ``hops`` times at most, and only within its host (case as given).
    """
    table = redirects.where(F.col("status").isin(*REDIRECTS)).groupBy("url").agg(F.min("location").alias("location")).select(F.col("url").alias("at"), "location")
    rows = starts.select("url", F.col("url").alias("at"), F.lit(0).alias("hops"), F.lit("ok").alias("result"))
    for _ in range(hops):
        step = rows.join(table, "at", "left")
        follows = (F.col("result") == "ok") & F.col("location").isNotNull()
        home = urls.host(F.col("at")).eqNullSafe(urls.host(F.col("location")))
        rows = step.select("url", F.when(follows & home, F.col("location")).otherwise(F.col("at")).alias("at"), (F.col("hops") + F.when(follows & home, 1).otherwise(0)).alias("hops"), F.when(follows & ~home, "off_host").otherwise(F.col("result")).alias("result"))
    more = rows.join(table, "at", "left")
    return more.select("url", F.col("at").alias("final_url"), "hops", F.when((F.col("result") == "ok") & F.col("location").isNotNull(), "too_many").otherwise(F.col("result")).alias("result"))


def fold_metadata(attempts: DataFrame, refresh: bool = False) -> DataFrame:
    """(id, url, raw_html, status_code, retry_count, last_attempt): one row for each hashed URL of (url, ts, status, html).

    The page is that of the first attempt that had one (``refresh``: of the last), status and time those of the last
    attempt, the count that of attempts after the last 200. Attempts without time come first; equal times by status.
    Aggregated in one pass: nothing is collected per URL.
    """
    a = attempts.where(~urls.is_blank(F.col("url"))).select(urls.url_id(F.col("url")).alias("id"), urls.normal_form(F.col("url")).alias("norm"), "ts", "status", "html")
    at = F.struct(F.coalesce(F.unix_micros("ts"), F.lit(-(1 << 62))).alias("t"), F.coalesce("status", F.lit(-1)).alias("s"))
    a = a.withColumn("at", at)
    success = a.where("status = 200").groupBy("id").agg(F.max("at").alias("success"))
    page = (F.max_by if refresh else F.min_by)("html", F.when(F.col("html").isNotNull(), F.col("at")))
    last = a.groupBy("id").agg(F.min("norm").alias("url"), page.alias("raw_html"), F.max_by("status", "at").alias("status_code"), F.max("ts").alias("last_attempt"))
    failures = a.select("id", "at").join(success, "id", "left").where("success is null or at > success").groupBy("id").agg(F.count("*").cast("int").alias("retry_count"))
    return last.join(failures, "id", "left").select("id", "url", "raw_html", "status_code", F.coalesce("retry_count", F.lit(0)).alias("retry_count"), "last_attempt")


def lookup(metadata: DataFrame, url: str) -> DataFrame:
    """The metadata of one URL."""
    spark = metadata.sparkSession
    wanted = spark.range(1).select(urls.url_id(F.lit(url)).alias("id"))
    return metadata.join(F.broadcast(wanted), "id", "left_semi")


def may_fetch(links: DataFrame, metadata: DataFrame, cache: DataFrame | None, as_of: Column, strict: bool = False) -> DataFrame:
    """(url, allowed) of distinct (url): whether a found link may go to the frontier.

    Unknown URLs may. Of known ones those that failed more than RETRY_LIMIT times may after RETRY_DELAY_S, others unless
    they look like an article. ``cache`` (id, status, retry_count) comes before the metadata; ``strict`` lets everything
    pass that the cache knows.
    """
    u = links.select("url").distinct().withColumn("id", urls.url_id(F.col("url")))
    m = metadata.groupBy("id").agg(F.max_by("status_code", F.coalesce("last_attempt", F.timestamp_micros(F.lit(0)))).alias("m_status"), F.max("retry_count").alias("m_retry"), F.max("last_attempt").alias("m_at"), F.lit(True).alias("m"))
    rows = u.join(m, "id", "left")
    if cache is not None:
        c = cache.groupBy("id").agg(F.max("status").alias("c_status"), F.max("retry_count").alias("c_retry"), F.lit(True).alias("c"))
        rows = rows.join(c, "id", "left")
    else:
        rows = rows.select("*", F.lit(None).cast("int").alias("c_status"), F.lit(None).cast("int").alias("c_retry"), F.lit(None).cast("boolean").alias("c"))
    known = F.coalesce("c", "m", F.lit(False))
    status, retry = F.coalesce("c_status", "m_status"), F.coalesce("c_retry", "m_retry", F.lit(0))
    old = F.col("m_at").isNull() | (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros("m_at") >= RETRY_DELAY_S * 1_000_000)
    rule = F.when(~F.coalesce(status == 200, F.lit(False)) & (retry > RETRY_LIMIT), old).otherwise(~classify.is_article(F.col("url")))
    well = ~urls.is_blank(F.col("url")) & urls.host(F.col("url")).isNotNull()
    allowed = F.when(~well, False).when(~known, True).otherwise(rule)
    if strict:
        allowed = F.when(~well, False).when(F.coalesce("c", F.lit(False)) | ~F.coalesce("m", F.lit(False)), True).otherwise(rule)
    return rows.select("url", allowed.alias("allowed"))


class HostCounter:
    """Fetches of a host since its last flush. A fetch flushes if it is the FLUSH_FETCHES-th, or if there was no flush within FLUSH_GAP_S; what is known of a host is forgotten FORGET_S after its last flush."""

    __slots__ = ("count", "since")

    def __init__(self, count: int = 0, since: int | None = None) -> None:
        self.count, self.since = count, since

    def see(self, at_us: int) -> int | None:
        """The count that is flushed by a fetch at this time, if it is."""
        if self.since is not None and at_us - self.since > FORGET_S * 1_000_000:
            self.count, self.since = 0, None
        self.count += 1
        if self.count >= FLUSH_FETCHES or self.since is None or at_us - self.since > FLUSH_GAP_S * 1_000_000:
            flushed, self.count, self.since = self.count, 0, at_us
            return flushed
        return None


def host_flushes(fetches: DataFrame) -> DataFrame:
    """(host, flushed_at, fetches): when each host's counter is flushed, see HostCounter, from (host, ts).

    Each flush depends on the one before, so a host is read in order; rows stream through, nothing is held but the counter.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, counter = None, HostCounter()
        for b in batches:
            rows = []
            for h, t in zip(b["host"], b["us"]):
                if h != host:
                    host, counter = h, HostCounter()
                n = counter.see(int(t))
                if n is not None:
                    rows.append((h, int(t), n))
            yield pd.DataFrame(rows, columns=["host", "us", "fetches"])

    ordered = fetches.where("host is not null and ts is not null").select("host", F.unix_micros("ts").alias("us")).repartition("host").sortWithinPartitions("host", "us")
    return ordered.mapInPandas(fold, "host string, us long, fetches int").select("host", F.timestamp_micros("us").alias("flushed_at"), "fetches")


def politeness_gap(fetches: DataFrame, limit: int = 30, window_s: int = 60) -> DataFrame:
    """Requests (key, ts) with ``in_window``, those of the last ``window_s`` seconds, and whether a limiter would hold them back.

    A window reaches into one slice of time before its own at most. So rows are counted in slices, each of which also has
    the rows of the slice before, and a key with most requests is split by time. Rows without a time are a slice of their own.
    """
    width = window_s * 1_000_000
    us = F.unix_micros("ts")
    slot = F.floor(us / width)
    seats = F.when(us.isNotNull(), F.array(F.struct(slot.alias("slot"), F.lit(True).alias("own")), F.struct((slot + 1).alias("slot"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(slot.alias("slot"), F.lit(True).alias("own"))))
    seated = fetches.withColumn("__seat", F.explode(seats)).withColumn("__us", us)
    w = Window.partitionBy("key", "__seat.slot").orderBy("__us").rangeBetween(-width + 1, 0)
    counted = seated.withColumn("in_window", F.count("*").over(w)).where("__seat.own")
    return counted.drop("__seat", "__us").withColumn("held", F.col("in_window") > limit)
