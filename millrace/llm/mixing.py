"""Problem 9: mixing sources to target weights.

Weighted fair queueing: each source's documents stand in a queue in random order (a hash of id and round), the whole queue
again for each repeat that the source is allowed. A document's virtual finish time is the tokens of its source up to its
end, divided by the source's weight. All queues are merged by finish time and cut at the budget, so at every point of the
result each source has had its share, but for less than one document.

On Spark: only ids, sources and sizes are sorted. The running sums are made in two steps, sums of hash ranges and running
sums within a range, so a source with a third of all documents is no single task. The cut is found the same way: sums of
time slots, and a running sum in the one slot where the budget ends.

Without ``budget`` it is the largest at which no source runs out: that of the source whose allowed repeats are used up
first. Sources without documents can't have their share; it is reported as missing and the others keep their proportions.
Documents of no target source, null ids and texts without tokens aren't drawn. A source named twice counts with the sum of
its shares and the larger of its repeats; shares that are null or not positive and repeats below 1 draw nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.tokens import VOCABULARY, with_tokens
from millrace.operators.joins import lookup_join
from millrace.session import cut

#: Documents of a hash range, about.
RANGE_ROWS = 50_000
SLOTS = 4096


def targets_of(targets: DataFrame) -> DataFrame:
    valid = targets.where("source is not null and target_share > 0 and max_repeats >= 1")
    return valid.groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("max_repeats"))


def draw(documents: DataFrame, targets: DataFrame, budget: int | None = None, vocabulary: str = VOCABULARY, seed: int = 1) -> DataFrame:
    """(doc_id, source, repeat, tokens, finish_time): the chosen documents in their order, a row for each time that one is drawn."""
    goal = cut(targets_of(targets))
    sized = cut(lookup_join(with_tokens(documents, vocabulary).where("tokens > 0 and source is not null"), goal, ["source"], "inner"))
    totals = sized.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count("*").alias("n"), F.first("share").alias("share"), F.first("max_repeats").alias("max_repeats"))
    facts = totals.agg(F.min(F.col("max_repeats") * F.col("source_tokens") / F.col("share")).alias("until"), F.sum("share").alias("weights"), F.sum("n").alias("n")).first()
    if facts.n is None or not facts.n:
        return sized.select("doc_id", "source", F.lit(1).alias("repeat"), "tokens", F.lit(0.0).alias("finish_time")).limit(0)
    budget = int(facts.until * facts.weights * (1 + 1e-12)) if budget is None else budget
    # no document that finishes later than this can be drawn: by then the queues have given the budget, or are empty
    latest = facts.until if budget <= facts.until * facts.weights else None
    ranges = max(1, int(facts.n // RANGE_ROWS))

    queue = sized.select("doc_id", "source", "tokens", "share", F.explode(F.sequence(F.lit(1), "max_repeats")).alias("repeat"))
    queue = queue.withColumn("place", F.xxhash64("doc_id", "repeat", F.lit(seed))).withColumn("range", F.pmod(F.shiftrightunsigned("place", 40), F.lit(ranges)).cast("int"))
    sums = cut(queue.groupBy("source", "repeat", "range").agg(F.sum("tokens").alias("in_range")))
    before = sums.withColumn("before", F.sum("in_range").over(Window.partitionBy("source").orderBy("repeat", "range").rowsBetween(Window.unboundedPreceding, -1))).select("source", "repeat", "range", F.coalesce("before", F.lit(0)).alias("before"))
    within = F.sum("tokens").over(Window.partitionBy("source", "repeat", "range").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    timed = lookup_join(queue.withColumn("within", within), before, ["source", "repeat", "range"], "inner")
    timed = timed.select("doc_id", "source", "repeat", "tokens", ((F.col("before") + F.col("within")) / F.col("share")).alias("finish_time"))
    if latest is not None:
        timed = timed.where(F.col("finish_time") <= latest * (1 + 1e-12))
    timed = cut(timed)

    last = timed.agg(F.max("finish_time")).first()[0] or 1.0
    slot = F.least(F.floor(F.col("finish_time") / F.lit(last) * SLOTS), F.lit(SLOTS - 1)).cast("int")
    slots = timed.groupBy(slot.alias("slot")).agg(F.sum("tokens").alias("tokens")).orderBy("slot").collect()  # SLOTS rows at most
    end, taken = SLOTS, 0
    for s in slots:
        if taken + s.tokens > budget:
            end = s.slot
            break
        taken += s.tokens
    sure = timed.where(slot < end)
    edge = timed.where(slot == end).withColumn("sum", F.sum("tokens").over(Window.partitionBy(slot).orderBy("finish_time", "doc_id", "repeat"))).where(F.col("sum") <= budget - taken).drop("sum")
    return sure.unionByName(edge).orderBy("finish_time", "doc_id", "repeat")


def repeats(drawn: DataFrame) -> DataFrame:
    """(doc_id, source, repeats, tokens): each chosen document with how often it was drawn."""
    return drawn.groupBy("doc_id", "source").agg(F.count("*").alias("repeats"), F.max("tokens").alias("tokens"))


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, tokens, documents, most_repeats, off_tokens, longest): a row for each target source, also for those without documents.

    ``off_tokens``: tokens above or below the source's part of what was drawn, shares of sources with documents scaled to
    1; at most the size of ``longest``, its longest document drawn, or of the one that would come next.
    """
    by_source = repeats(drawn).groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"), F.max("tokens").alias("longest"))
    joined = targets_of(targets).join(by_source, "source", "left").fillna(0, ["tokens", "documents", "most_repeats", "longest"])
    # a row for each target source
    whole = Window.partitionBy(F.lit(1))
    total, weights = F.sum("tokens").over(whole), F.sum(F.when(F.col("documents") > 0, F.col("share"))).over(whole)
    off = F.when(F.col("documents") > 0, F.round(F.col("tokens") - total * F.col("share") / weights, 1))
    return joined.select("source", F.round("share", 6).alias("target_share"), F.round(F.col("tokens") / F.greatest(total, F.lit(1)), 6).alias("reached_share"), "tokens", "documents", "most_repeats", off.alias("off_tokens"), "longest")
