"""Row numbers over large groups without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.joins import lookup_join
from millrace.session import cut

_PARTITION_BITS = 33


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, few_keys: bool = False) -> DataFrame:
    """``df`` with ``name``: the row's number, from 1, within its keys by ``order``.

    Rows are range-partitioned by keys and order, numbered within each partition, and moved up by the sizes of the
    partitions before, so a key with a third of all rows is spread like any other. ``order`` must be total. Null keys
    form a group of their own. ``df`` is read twice, to sample the ranges and to sort, so write it first if it is costly.
    ``few_keys``: there are so few keys that a number for each key and partition may be broadcast without measuring.
    """
    keys = list(keys)
    rows = cut(df.repartitionByRange(*map(F.col, keys), *order).sortWithinPartitions(*keys, *order).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", _PARTITION_BITS)
    filled = {k: f"__k{i}" for i, k in enumerate(keys)}
    safe = [F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(s) for k, s in filled.items()]
    rows = rows.select("*", *safe, part.alias("__p"))
    groups = rows.groupBy(*filled.values(), "__p").agg(F.min("__m").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*filled.values()).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    starts = groups.select(*filled.values(), "__p", "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    on = [*filled.values(), "__p"]
    out = rows.join(F.broadcast(starts), on) if few_keys else lookup_join(rows, starts, on, "inner")
    return out.select(*df.columns, (F.col("__before") + F.col("__m") - F.col("__first") + 1).alias(name))
