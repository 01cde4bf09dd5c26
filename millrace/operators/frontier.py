"""The crawl frontier: which found URLs are admitted, and in what order they leave the queues.

Every operator is a function of its tables and, where a clock matters, of ``as_of``. Queues are ranks, not state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import urls
from millrace.operators import robots
from millrace.operators.joins import lookup_join
from millrace.operators.ranking import ranked
from millrace.session import cut

# Visits of a cycle by priority, sub-queues, back queues and their capacity, batch sizes, retry limits.
SCHEDULE = (3, 3, 3, 3, 3, 2, 2, 2, 1)
SUB_QUEUES = 3
BACK_QUEUES = 10
BACK_CAPACITY = 10_000
FRONT_BATCH, DISPATCH_BATCH, RETRY_BATCH = 50, 10, 5
RETRY_LIMIT, RETRY_DELAY_S = 3, 300
#: Schemes that the crawler can open.
SCHEMES = ("http", "https", "ftp", "file", "jar", "mailto")


def distinct_urls(tasks: DataFrame) -> DataFrame:
    """(url, first_task, copies): each URL string once, by the first task that found it; a URL in a third of all tasks is one pre-aggregated row a task."""
    return tasks.groupBy("url").agg(F.min("task_id").alias("first_task"), F.count("*").alias("copies"))


def admit(tasks: DataFrame, domains: DataFrame, rules: DataFrame | None = None, queued: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """(url, first_task, copies, host, priority, last_crawled, crawl_delay, verdict): every distinct URL with the first reason that applies.

    blank, queued (its string is in ``queued``), malformed, not_whitelisted (its host, case as given, is no known domain,
    active or not), robots_blocked, admitted. Copies of a string within ``tasks`` are queued behind the first.
    """
    url = F.col("url")
    rows = distinct_urls(tasks).withColumn("host", urls.host(url))
    known = domains.where("domain is not null").groupBy(F.col("domain").alias("host")).agg(F.max(F.struct("create_at", "priority", "last_crawled")).alias("d"))
    rows = lookup_join(rows, known.select("host", F.lit(True).alias("listed"), "d.priority", "d.last_crawled"), ["host"])
    if rules is not None:
        rows = robots.with_verdict(rows, rules, strict=strict)
    else:
        rows = rows.withColumn("robots", F.lit(robots.UNDEFINED)).withColumn("crawl_delay", F.lit(robots.DEFAULT_DELAY))
    if queued is not None:
        rows = rows.join(queued.select("url").distinct().withColumn("waiting", F.lit(True)), "url", "left")
    else:
        rows = rows.withColumn("waiting", F.lit(None).cast("boolean"))
    verdict = (
        F.when(urls.is_blank(url), "blank")
        .when(F.col("waiting"), "queued")
        .when(~F.coalesce(urls.scheme(url).isin(*SCHEMES), F.lit(False)), "malformed")
        .when(F.col("listed").isNull(), "not_whitelisted")
        .when(F.col("robots") == robots.DISALLOWED, "robots_blocked")
        .otherwise("admitted")
    )
    return rows.select("url", "first_task", "copies", "host", "priority", "last_crawled", "crawl_delay", verdict.alias("verdict"))


def counters_by_host(admitted: DataFrame) -> DataFrame:
    """(host, processed, rejected): blank and queued URLs count as neither."""
    counted = admitted.where(~F.col("verdict").isin("blank", "queued"))
    return counted.groupBy(F.lower("host").alias("host")).agg(F.count_if(F.col("verdict") == "admitted").alias("processed"), F.count_if(F.col("verdict") != "admitted").alias("rejected"))


def totals(admitted: DataFrame) -> DataFrame:
    """(scheduled, processed, rejected): all URLs that were looked at, and how many of them were admitted or not."""
    c = counters_by_host(admitted)
    n = lambda name: F.coalesce(F.sum(name), F.lit(0))
    return c.agg((n("processed") + n("rejected")).alias("scheduled"), n("processed").alias("processed"), n("rejected").alias("rejected"))


def _served(priority: Column) -> Column:
    return priority.isin(*set(SCHEDULE))


def _slots(cursor: int) -> dict[int, list[int]]:
    """Visits of a cycle that serve each priority, counted from the cursor."""
    n = len(SCHEDULE)
    return {p: sorted((k - cursor) % n for k in range(n) if SCHEDULE[k] == p) for p in set(SCHEDULE)}


def with_front_queue(admitted: DataFrame) -> DataFrame:
    """Admitted rows with ``subqueue`` (hash of the host) and ``queue_key`` (priority and sub-queue)."""
    sub = urls.bucket(F.col("host"), SUB_QUEUES)
    return admitted.withColumn("subqueue", sub).withColumn("queue_key", F.col("priority") * 10 + sub)


def _front_order() -> list[Column]:
    return [F.col("last_crawled").asc_nulls_first(), F.col("subqueue").asc(), F.col("url").asc()]


def _visit(rank: Column, priority: Column, cursor: int) -> Column:
    """The visit at which the rank-th row (from 1) of a priority leaves: cycle by cycle, at the slots that serve it."""
    visit = F.lit(None).cast("long")
    for p, slots in _slots(cursor).items():
        n = rank - 1
        slot = F.element_at(F.array(*map(F.lit, slots)), (n % len(slots) + 1).cast("int"))
        visit = F.when(priority == p, (F.floor(n / len(slots)) * len(SCHEDULE) + slot).cast("long")).otherwise(visit)
    return visit


def front_order(admitted: DataFrame, cursor: int = 0) -> DataFrame:
    """Admitted rows with ``visit``, the turn at which each leaves the front queues; null for priorities that are never served.

    Within a priority the least recently crawled leaves first. The whole order is ranked without a task per priority.
    """
    rows = cut(with_front_queue(admitted))
    served = ranked(rows.where(_served(F.col("priority"))), ["priority"], _front_order(), "rank", few_keys=True).withColumn("visit", _visit(F.col("rank"), F.col("priority"), cursor))
    starved = rows.where(~F.coalesce(_served(F.col("priority")), F.lit(False))).withColumn("rank", F.lit(None).cast("long")).withColumn("visit", F.lit(None).cast("long"))
    return served.unionByName(starved)


def front_batch(admitted: DataFrame, n: int = FRONT_BATCH, cursor: int = 0) -> DataFrame:
    """The next ``n`` rows to leave the front queues: the first n of each priority are enough to know them, so nothing is sorted whole."""
    rows = cut(with_front_queue(admitted))
    heads = None
    for p in sorted(set(SCHEDULE)):
        head = rows.where(F.col("priority") == p).orderBy(*_front_order()).limit(n)
        heads = head if heads is None else heads.unionByName(head)
    ordered = ranked(heads, ["priority"], _front_order(), "rank", few_keys=True).withColumn("visit", _visit(F.col("rank"), F.col("priority"), cursor))
    return ordered.orderBy("visit").limit(n)


def back_order(arrived: DataFrame, cursor: int = 0, capacity: int = BACK_CAPACITY) -> DataFrame:
    """Rows with ``queue`` and ``turn``, the place at which each leaves the back queues, from (url, host, visit) in order of visit.

    A host has one queue; a queue beyond ``capacity`` drops what arrives; queues are drained in turn from the cursor.
    """
    queued = arrived.withColumn("queue", urls.bucket(F.lower("host"), BACK_QUEUES))
    placed = ranked(queued, ["queue"], [F.col("visit").asc_nulls_last(), F.col("url").asc()], "place", few_keys=True).where(F.col("place") <= capacity)
    return placed.withColumn("turn", F.pmod(F.col("queue") - cursor, F.lit(BACK_QUEUES)))


def dispatch_batch(back: DataFrame, n: int = DISPATCH_BATCH) -> DataFrame:
    """The next ``n`` rows for the fetcher."""
    return back.orderBy("place", "turn").limit(n)


def statistics(front: DataFrame, back: DataFrame) -> DataFrame:
    """(side, queue, urls): sizes of all queues, totals with queue null, and the number of hosts that have a back queue."""
    f = front.groupBy(F.lit("front").alias("side"), F.col("queue_key").cast("string").alias("queue")).agg(F.count("*").alias("urls"))
    b = back.groupBy(F.lit("back").alias("side"), F.concat(F.lit("b"), F.col("queue")).alias("queue")).agg(F.count("*").alias("urls"))
    both = f.unionByName(b)
    totals = both.groupBy("side").agg(F.sum("urls").alias("urls")).select("side", F.lit(None).cast("string").alias("queue"), "urls")
    health = both.agg(F.coalesce(F.sum("urls"), F.lit(0)).alias("urls")).select(F.lit("all").alias("side"), F.lit(None).cast("string").alias("queue"), "urls")
    hosts = back.agg(F.count_distinct(F.lower("host")).alias("urls")).select(F.lit("hosts").alias("side"), F.lit(None).cast("string").alias("queue"), "urls")
    return both.unionByName(totals).unionByName(health).unionByName(hosts)


def cleared(front: DataFrame, back: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queues after they are cleared; the retry set stays."""
    return front.limit(0), back.limit(0)


def is_empty(stats: DataFrame) -> DataFrame:
    """(empty): whether no queue holds a URL."""
    return stats.where("side in ('front', 'back') and queue is not null").agg(F.coalesce(F.sum("urls") == 0, F.lit(True)).alias("empty"))


def retry_gate(retries: DataFrame, as_of: Column) -> DataFrame:
    """Retry messages with ``route``: frontier if tried at most RETRY_LIMIT times and not within RETRY_DELAY_S, else retry_set."""
    waited = F.col("last_attempt").isNull() | (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros("last_attempt") >= RETRY_DELAY_S * 1_000_000)
    ready = (F.coalesce(F.col("retry_count"), F.lit(0)) <= RETRY_LIMIT) & waited
    return retries.where(~urls.is_blank(F.col("url"))).withColumn("route", F.when(ready, "frontier").otherwise("retry_set"))


def retry_drain(gated: DataFrame, n: int = RETRY_BATCH) -> DataFrame:
    """(url): the ``n`` smallest URLs of the retry set."""
    return gated.where("route = 'retry_set'").select("url").distinct().orderBy("url").limit(n)
