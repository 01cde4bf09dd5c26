"""Problem 1: has this key been seen before?

Keys are kept as fingerprints in quotient filters. A fingerprint of ``bits`` bits is split into a quotient, which names a
slot, and a remainder, which is stored near that slot; three bits a slot (occupied, continuation, shifted) say which run
a remainder belongs to, so the fingerprint can be read back and filters can be merged in sorted order without the keys.
A growing filter is a short list of such filters of geometric sizes; adding a batch makes a small one and merges equals.

On Spark: within each input partition, in order of arrival, a filter answers for every key that the partition has seen
itself. Only first arrivals per partition, at most one row a key and partition, go on to the partition that keeps the
key's fingerprints, so a key with a third of all rows sends no more than others. There the known keys come first, then
tasks in order. What a task holds is the filter, about 6 bytes a distinct key, not the keys.

An answer is wrong only if two keys share a fingerprint ("seen" for a new key, never the reverse). Partitions are made by
fingerprint, so it doesn't matter which of them holds a key: of d new keys that meet k known ones,
d - m * ((1 - 1/m)**k - (1 - 1/m)**(k + d)) with m = 2**bits are expected to be wrong. error_rates compares this with
what exact answers show.

Null and blank URLs are no keys: their answer is null. Rows with the same task id don't count as earlier to each other.
Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import urls

#: Bits of a fingerprint: with 16 million keys in a task's filter a new key is taken for a seen one with probability 6e-8.
BITS = 48
_OCCUPIED, _CONTINUATION, _SHIFTED = np.uint8(1), np.uint8(2), np.uint8(4)
_LOAD = 0.75


class QuotientFilter:
    """A fixed set of fingerprints as remainders with run metadata."""

    __slots__ = ("bits", "q", "r", "meta", "remainders", "size")

    def __init__(self, sorted_fingerprints: np.ndarray, bits: int = BITS) -> None:
        n = len(sorted_fingerprints)
        self.bits, self.size = bits, n
        self.q = min(bits - 1, max(4, int(np.ceil(np.log2(max(1, n) / _LOAD)))))
        self.r = bits - self.q
        kind = np.uint16 if self.r <= 16 else np.uint32 if self.r <= 32 else np.uint64
        f = np.asarray(sorted_fingerprints, np.uint64)
        quotient = (f >> np.uint64(self.r)).astype(np.int64)
        step = np.arange(n)
        # a remainder stands in its own slot or behind the one before it
        at = np.maximum.accumulate(quotient - step) + step if n else step
        slots = max(1 << self.q, int(at[-1]) + 1 if n else 0) + 1
        self.meta, self.remainders = np.zeros(slots, np.uint8), np.zeros(slots, kind)
        if n:
            self.remainders[at] = (f & np.uint64((1 << self.r) - 1)).astype(kind)
            self.meta[quotient] |= _OCCUPIED
            self.meta[at[1:][quotient[1:] == quotient[:-1]]] |= _CONTINUATION
            self.meta[at[at != quotient]] |= _SHIFTED

    def fingerprints(self) -> np.ndarray:
        """All fingerprints in order, read back from remainders and metadata."""
        at = np.flatnonzero(self.meta)
        if not len(at):
            return np.empty(0, np.uint64)
        run = np.cumsum((self.meta[at] & _CONTINUATION) == 0) - 1
        quotient = np.flatnonzero(self.meta & _OCCUPIED)[run]
        return (quotient.astype(np.uint64) << np.uint64(self.r)) | self.remainders[at].astype(np.uint64)

    def contains(self, fingerprints: np.ndarray) -> np.ndarray:
        """For each fingerprint whether it is in the set; all questions walk their clusters side by side."""
        f = np.asarray(fingerprints, np.uint64)
        found = np.zeros(len(f), bool)
        quotient = (f >> np.uint64(self.r)).astype(np.int64)
        rest = (f & np.uint64((1 << self.r) - 1)).astype(self.remainders.dtype)
        ask = np.flatnonzero(self.meta[quotient] & _OCCUPIED)
        slot, skip = quotient[ask], np.zeros(len(ask), np.int64)
        # back to the start of the cluster, counting the runs that begin before this one
        back = np.flatnonzero(self.meta[slot] & _SHIFTED)
        while len(back):
            slot[back] -= 1
            here = self.meta[slot[back]]
            skip[back] += here & _OCCUPIED
            back = back[(here & _SHIFTED) != 0]
        # forward over those runs
        on = np.flatnonzero(skip)
        while len(on):
            slot[on] += 1
            skip[on] -= (self.meta[slot[on]] & _CONTINUATION) == 0
            on = on[skip[on] > 0]
        # along the run
        on = np.arange(len(ask))
        while len(on):
            hit = self.remainders[slot[on]] == rest[ask[on]]
            found[ask[on[hit]]] = True
            on = on[~hit]
            slot[on] += 1
            on = on[(self.meta[slot[on]] & _CONTINUATION) != 0]
        return found


def merge(a: QuotientFilter, b: QuotientFilter) -> QuotientFilter:
    """The union of two filters, merged in order of their fingerprints."""
    both = np.concatenate([a.fingerprints(), b.fingerprints()])
    both.sort(kind="stable")
    return QuotientFilter(both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both, a.bits)


class GrowingFilter:
    """Filters of geometric sizes; a new batch is a small one, and one that isn't much smaller than its elder is merged with it."""

    def __init__(self, bits: int = BITS) -> None:
        self.bits, self.parts = bits, []
        self.last, self.last_new = None, np.empty(0, np.uint64)

    def __len__(self) -> int:
        return sum(p.size for p in self.parts)

    def contains(self, fingerprints: np.ndarray) -> np.ndarray:
        found = np.zeros(len(fingerprints), bool)
        for p in self.parts:
            rest = np.flatnonzero(~found)
            found[rest] = p.contains(fingerprints[rest])
        return found

    def add(self, new: np.ndarray) -> None:
        """Add fingerprints that aren't in the filter."""
        if len(new):
            self.parts.append(QuotientFilter(np.unique(new), self.bits))
            while len(self.parts) > 1 and self.parts[-1].size * 3 >= self.parts[-2].size:
                last = self.parts.pop()
                self.parts[-1] = merge(self.parts[-1], last)

    def ask(self, fingerprints: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Whether each of a batch in order of arrival was seen; then the batch is in the filter. Equal ``order`` isn't earlier."""
        if not len(fingerprints):
            return np.zeros(0, bool)
        distinct, first, where = np.unique(fingerprints, return_index=True, return_inverse=True)
        known = self.contains(distinct)
        seen = known[where] | (order > order[first][where])
        if self.last is not None and order[0] == self.last:  # the order's rows began in the batch before
            seen &= ~((order == self.last) & np.isin(fingerprints, self.last_new))
        fresh = distinct[~known]
        same = self.last_new if order[-1] == self.last else np.empty(0, np.uint64)
        self.last, self.last_new = order[-1], np.concatenate([same, fresh[order[first][~known] == order[-1]]])
        self.add(fresh)
        return seen


def _fingerprint(url: F.Column, bits: int) -> F.Column:
    form = urls.normal_form(url)
    return F.when(form.isNotNull(), F.shiftrightunsigned(F.xxhash64(form), 64 - bits))


def seen_before(tasks: DataFrame, known: DataFrame, bits: int = BITS) -> DataFrame:
    """(task_id, seen): whether each task's URL is among ``known.url`` or those of tasks with a smaller task_id; null for null and blank URLs."""
    asked = tasks.select("task_id", _fingerprint(F.col("url"), bits).alias("f"))

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = GrowingFilter(bits)
        for b in batches:
            yield pd.DataFrame({"task_id": b["task_id"], "f": b["f"], "seen": kept.ask(b["f"].to_numpy().astype(np.uint64), b["task_id"].to_numpy())})

    local = asked.where("f is not null").sortWithinPartitions("task_id").mapInPandas(within, "task_id long, f long, seen boolean")
    # rows that are answered travel by their id, so that a frequent key meets no single task
    route = F.when(F.col("seen"), F.xxhash64("task_id")).otherwise(F.col("f"))
    everything = local.select("task_id", "f", "seen", route.alias("route"), F.lit(1).alias("origin")).unionByName(
        known.select(F.lit(None).cast("long").alias("task_id"), _fingerprint(F.col("url"), bits).alias("f"), F.lit(False).alias("seen"), F.lit(0).alias("origin")).where("f is not null").distinct().withColumn("route", F.col("f"))
    )

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = GrowingFilter(bits)
        for b in batches:
            stored = b["origin"].to_numpy() == 0
            if stored.any():
                f = np.unique(b["f"].to_numpy()[stored].astype(np.uint64))
                kept.add(f[~kept.contains(f)])
            b = b[~stored]
            seen = b["seen"].to_numpy(bool).copy()
            open_ = np.flatnonzero(~seen)
            seen[open_] = kept.ask(b["f"].to_numpy()[open_].astype(np.uint64), b["task_id"].to_numpy()[open_])
            yield pd.DataFrame({"task_id": b["task_id"].astype("int64"), "seen": seen})

    answered = everything.repartition("route").sortWithinPartitions("origin", "task_id").select("task_id", "f", "seen", "origin").mapInPandas(across, "task_id long, seen boolean")
    blank = asked.where("f is null").select("task_id", F.lit(None).cast("boolean").alias("seen"))
    return answered.unionByName(blank)


def exact(tasks: DataFrame, known: DataFrame) -> DataFrame:
    """(task_id, truly_seen) by comparing the URLs themselves: what the filters are measured against."""
    t = tasks.select("task_id", urls.normal_form(F.col("url")).alias("u")).where("u is not null")
    first = t.groupBy("u").agg(F.min("task_id").alias("first"))
    stored = known.select(urls.normal_form(F.col("url")).alias("u")).where("u is not null").distinct().withColumn("stored", F.lit(True))
    first = first.join(stored, "u", "left")
    return t.join(first, "u").select("task_id", (F.coalesce("stored", F.lit(False)) | (F.col("task_id") > F.col("first"))).alias("truly_seen"))


def error_rates(tasks: DataFrame, known: DataFrame, widths: tuple[int, ...] = (20, 28, BITS)) -> DataFrame:
    """(bits, asked, seen, wrong, missed, wrong_rate, expected_wrong): measured against exact answers, for fingerprints of several widths.

    ``wrong``: new keys taken for seen ones, ``missed``: the reverse; ``expected_wrong`` is derived from the numbers of keys.
    """
    truth = exact(tasks, known)
    stored = known.select(urls.normal_form(F.col("url")).alias("u")).where("u is not null").agg(F.count_distinct("u").alias("k"))
    out = None
    for bits in widths:
        both = seen_before(tasks, known, bits).where("seen is not null").join(truth, "task_id")
        row = both.agg(
            F.count("*").alias("asked"), F.count_if("seen").alias("seen"), F.count_if(~F.col("truly_seen")).alias("d"),
            F.count_if(F.col("seen") & ~F.col("truly_seen")).alias("wrong"), F.count_if(~F.col("seen") & F.col("truly_seen")).alias("missed"),
        )
        # one row each
        row = row.join(F.broadcast(stored)).withColumn("bits", F.lit(bits))
        m, step = float(2**bits), F.log1p(F.lit(-(2.0**-bits)))
        expected = F.col("d") + m * F.exp(F.col("k") * step) * F.expm1(F.col("d") * step)
        row = row.withColumn("expected_wrong", F.greatest(expected, F.lit(0.0)))
        out = row if out is None else out.unionByName(row)
    return out.select("bits", "asked", "seen", "wrong", "missed", (F.col("wrong") / F.greatest("asked", F.lit(1))).alias("wrong_rate"), "expected_wrong")
