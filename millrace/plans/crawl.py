"""Flows of several operators: one tick of the frontier, and the closure of a crawl over stored pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import urls
from millrace.operators import fetching, frontier, pages
from millrace.session import cut


def tick(tasks: DataFrame, domains: DataFrame, rules: DataFrame | None = None, front: int = frontier.FRONT_BATCH, dispatch: int = frontier.DISPATCH_BATCH) -> DataFrame:
    """(url, host, queue, place, turn): what one tick sends to the fetcher: admission, the front queues' next batch, the back queues' next batch."""
    admitted = frontier.admit(tasks, domains, rules).where("verdict = 'admitted'")
    moved = frontier.front_batch(admitted, front)
    return frontier.dispatch_batch(frontier.back_order(moved.select("url", "host", "visit")), dispatch).select("url", "host", "queue", "place", "turn")


def closure(seeds: DataFrame, metadata: DataFrame, domains: DataFrame, as_of: Column, rules: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(url, depth): all URLs that a crawl from (url) ``seeds`` admits over stored pages, each at the depth at which it is first found.

    A round admits new URLs, looks up their pages, takes the links that aren't navigation and asks whether they may be
    fetched; it ends when a round finds nothing new, or at ``max_depth`` if one is given. Each round's URLs are written
    once; known URLs are these tables, not a set on the driver.
    """
    links = cut(pages.new_links(pages.page_facts(metadata.where("status_code = 200"), pages.LINK_FACTS)).distinct())
    waves: list[DataFrame] = []
    wave = seeds.select("url").distinct()
    while max_depth is None or len(waves) <= max_depth:
        tasks = wave.select("url", F.lit(0).cast("long").alias("task_id"))
        new = frontier.admit(tasks, domains, rules).where("verdict = 'admitted'").select("url")
        if waves:
            new = new.join(reduce(DataFrame.unionByName, waves).select("url"), "url", "left_anti")
        new = cut(new.withColumn("depth", F.lit(len(waves))))
        if new.isEmpty():
            break
        waves.append(new)
        reached = new.select(urls.url_id(F.col("url")).alias("id")).distinct().join(links, "id").select("url").distinct()
        wave = fetching.may_fetch(reached, metadata, None, as_of).where("allowed").select("url")
    return reduce(DataFrame.unionByName, waves) if waves else wave.withColumn("depth", F.lit(0)).limit(0)
