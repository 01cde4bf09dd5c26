"""The domain registry: bootstrap, seeds, partial updates, recrawl ticks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, domain string, seed_urls array<string>, last_crawled timestamp, create_at timestamp, priority int, active boolean"
#: First tick and distance of seed recrawls, in seconds.
FIRST_TICK_S, TICK_S = 90, 1200


def configured(spark: SparkSession, hosts: Iterable[str]) -> DataFrame:
    """(domain) of a list of hosts, as it stands in a configuration file."""
    return spark.createDataFrame([(h,) for h in hosts], "domain string")


def bootstrap(domains: DataFrame, hosts: DataFrame, as_of: Column) -> DataFrame:
    """New registry rows for hosts that aren't stored: seed ``https://host``, priority 1, active."""
    new = hosts.where("domain is not null and trim(domain) != ''").select(F.trim("domain").alias("domain")).distinct().join(domains.select("domain"), "domain", "left_anti")
    return new.select(F.sha2("domain", 256).substr(1, 24).alias("id"), "domain", F.array(F.concat(F.lit("https://"), F.col("domain"))).alias("seed_urls"), F.lit(None).cast("timestamp").alias("last_crawled"), as_of.cast("timestamp").alias("create_at"), F.lit(1).alias("priority"), F.lit(True).alias("active"))


def seeds(domains: DataFrame, domain: str | None = None) -> DataFrame:
    """(domain, url): seeds of active domains, or of one domain."""
    chosen = domains.where(F.coalesce("active", F.lit(False)))
    if domain is not None:
        chosen = chosen.where(F.col("domain") == domain)
    return chosen.select("domain", F.explode("seed_urls").alias("url"))


def update(domains: DataFrame, changes: DataFrame, strict: bool = False) -> DataFrame:
    """The registry after partial updates, one per domain: seeds if not empty, last_crawled if not null, active if given; the priority never changes.

    ``strict``: a change that doesn't say active re-activates its domain.
    """
    c = changes.select("domain", F.col("seed_urls").alias("c_seeds"), F.col("last_crawled").alias("c_crawled"), F.col("active").alias("c_active"), F.lit(True).alias("c"))
    j = domains.join(c, "domain", "left")
    said = F.when(F.col("c"), F.coalesce("c_active", F.lit(True))) if strict else F.col("c_active")
    return j.select(
        "id", "domain", F.when(F.size("c_seeds") > 0, F.col("c_seeds")).otherwise(F.col("seed_urls")).alias("seed_urls"), F.coalesce("c_crawled", "last_crawled").alias("last_crawled"),
        "create_at", "priority", F.coalesce(said, "active").alias("active"),
    )


def create(domains: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with the rows of ``new`` whose domain it lacks."""
    return domains.unionByName(new.dropDuplicates(["domain"]).join(domains.select("domain"), "domain", "left_anti").select(*domains.columns))


def delete(domains: DataFrame, gone: DataFrame) -> DataFrame:
    return domains.join(gone.select("domain"), "domain", "left_anti")


def recrawl_ticks(domains: DataFrame, start: Column, end: Column) -> DataFrame:
    """(tick, url): the seeds that each recrawl between two times puts into the frontier."""
    first = F.timestamp_micros(F.unix_micros(start.cast("timestamp")) + FIRST_TICK_S * 1_000_000)
    ticks = domains.sparkSession.range(1).select(F.explode(F.sequence(first, end.cast("timestamp"), F.expr(f"interval {TICK_S} seconds"))).alias("tick"))
    # ticks of a day are 72 rows
    return seeds(domains).join(F.broadcast(ticks)).select("tick", "url")
