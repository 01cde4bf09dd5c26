"""Operational metrics: counters as a long table, rates, totals, rankings; and the evaluation of selector providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_S = 300
TOP = 10


def samples(events: DataFrame, metric: Column, ts: Column, by: Column | None = None) -> DataFrame:
    """(metric, label, ts, inc): increments per second of counters from a table of events, pre-aggregated per task."""
    second = F.date_trunc("second", ts)
    label = by if by is not None else F.lit(None).cast("string")
    return events.groupBy(metric.alias("metric"), label.alias("label"), second.alias("ts")).agg(F.count("*").alias("inc"))


def cumulative(increments: DataFrame) -> DataFrame:
    """(metric, label, ts, value): running totals of each counter; a counter has at most one row a second."""
    w = Window.partitionBy("metric", "label").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return increments.select("metric", "label", "ts", F.sum("inc").over(w).alias("value"))


def rate(series: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """(metric, label, ts, rate): growth per second over the last ``window_s`` seconds at each sample; a value below the one before is a reset and counts from zero.

    The first sample of a window has nothing before it and adds nothing; window edges aren't extrapolated.
    """
    order = Window.partitionBy("metric", "label").orderBy("ts")
    before = F.lag("value").over(order)
    grown = F.when(before.isNull(), 0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    rows = series.withColumn("grown", grown).withColumn("s", F.unix_seconds("ts"))
    w = Window.partitionBy("metric", "label").orderBy("s").rangeBetween(-window_s, 0)
    total = F.sum("grown").over(w) - F.first("grown").over(w)
    return rows.select("metric", "label", "ts", (total / window_s).alias("rate"))


def last_values(series: DataFrame) -> DataFrame:
    """(metric, label, value): the last value that isn't null of each counter."""
    return series.where("value is not null").groupBy("metric", "label").agg(F.max_by("value", "ts").alias("value"))


def top(series: DataFrame, n: int = TOP) -> DataFrame:
    """The ``n`` labels with the largest last value of a counter."""
    return last_values(series).orderBy(F.col("value").desc(), "metric", "label").limit(n)


def total(series: DataFrame) -> DataFrame:
    """(total): sum of the last values."""
    return last_values(series).agg(F.coalesce(F.sum("value"), F.lit(0)).alias("total"))


def token_pivot(counts: DataFrame, models: list[str]) -> DataFrame:
    """A row for each content with its token count per model, from (model, content, tokens)."""
    return counts.groupBy("content").pivot("model", models).agg(F.max("tokens"))


def reduction(counts: DataFrame) -> DataFrame:
    """(model, content, reduction): per cent of tokens that filtering saves, from (model, content, before, after)."""
    return counts.select("model", "content", F.round((F.col("before") - F.col("after")) / F.nullif(F.col("before"), F.lit(0)) * 100, 2).alias("reduction"))


def field_matrix(results: DataFrame) -> DataFrame:
    """(content, field, expected, answers): for each field what was expected and, per model, what came, from (model, content, field, expected, answer)."""
    return results.groupBy("content", "field").agg(F.max("expected").alias("expected"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "answer")))).alias("answers"))
