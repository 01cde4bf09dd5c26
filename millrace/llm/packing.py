"""Problem 8: filling fixed-capacity containers with items.

Sum-of-squares packing: with N(h) open containers filled up to h, the next item goes where the sum of N(h)² grows least,
so no fill level piles up and a container that an item completes is soon found. The counts are one array over levels;
an item costs one vector operation over it.

On Spark: only ids and sizes are packed. They are spread over shards by a hash of the id, ``shard_tokens`` tokens each,
and each shard and kind of container is packed on its own; a shard leaves a few open containers, so the loss is the
number of shards, not of items. Texts larger than a container fill whole ones, and only their rest is packed.

Texts without tokens take no room: they lie in the first container of their shard. Null ids are left out, repeated rows
count once, containers without a positive capacity hold nothing. Ties: the fuller container.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tokens import VOCABULARY, with_tokens
from millrace.operators.joins import lookup_join
from millrace.session import cut

#: Tokens of a shard: about twenty thousand news texts.
SHARD_TOKENS = 4_000_000


class SumOfSquares:
    """Open containers by fill level."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)  # counts[0] and counts[capacity] stay 0: neither is open
        self.open: dict[int, list[int]] = {}
        self.room: list[int] = []

    def new(self, size: int) -> int:
        self.room.append(self.capacity - size)
        return len(self.room) - 1

    def place(self, size: int) -> int:
        """The container of an item of 1 to ``capacity`` tokens."""
        c, n = self.capacity, self.counts
        best, level = (2 * n[size] + 1 if size < c else 0), 0
        if size < c:
            here = n[1 : c - size + 1]
            growth = 2 * (n[1 + size : c + 1] - here) + 2
            growth[-1] -= 1  # a container that is full is no longer counted
            growth[here == 0] = np.iinfo(np.int64).max
            k = len(growth) - 1 - int(growth[::-1].argmin())
            if growth[k] <= best:
                level = k + 1
        if level:
            box = self.open[level].pop()
            n[level] -= 1
            self.room[box] -= size
        else:
            box = self.new(size)
        if self.room[box]:
            full = c - self.room[box]
            n[full] += 1
            self.open.setdefault(full, []).append(box)
        return box


def pack_items(ids: np.ndarray, sizes: np.ndarray, capacity: int) -> pd.DataFrame:
    """(doc_id, piece, tokens, container, room_left) of one shard, items in the given order."""
    box = SumOfSquares(capacity)
    rows: list[tuple[int, int, int, int]] = []
    empty = []
    for ident, size in zip(ids.tolist(), sizes.tolist()):
        whole, rest = divmod(size, capacity)
        for piece in range(whole):
            rows.append((ident, piece, capacity, box.new(capacity)))
        if rest:
            rows.append((ident, whole, rest, box.place(rest)))
        elif not size:
            empty.append(ident)
    if empty and not box.room:
        box.new(0)
    rows += [(ident, 0, 0, 0) for ident in empty]
    out = pd.DataFrame(rows, columns=["doc_id", "piece", "tokens", "container"])
    out["room_left"] = np.asarray(box.room, np.int64)[out["container"].to_numpy(np.int64)] if len(out) else np.empty(0, np.int64)
    return out


def pack(documents: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(container_kind, container, doc_id, piece, tokens, room_left): the container of each text, or of each piece of a text larger than one."""
    sizes = cut(with_tokens(documents, vocabulary).select("doc_id", "tokens"))
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    spread = sizes.select("doc_id", "tokens", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))
    kinds = containers.where("container_kind is not null and capacity_tokens > 0").groupBy("container_kind").agg(F.max("capacity_tokens").cast("int").alias("capacity"))

    def shard(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        kind, capacity, number = key
        b = b.iloc[np.argsort(_mixed(b["doc_id"].to_numpy()), kind="stable")]
        out = pack_items(b["doc_id"].to_numpy(), b["tokens"].to_numpy(), int(capacity))
        out.insert(0, "container_kind", kind)
        out["container"] = [f"{kind}-{number}-{c}" for c in out["container"]]
        return out[["container_kind", "container", "doc_id", "piece", "tokens", "room_left"]]

    # every kind of container packs all texts
    every = F.lit(0).alias("every")
    placed = lookup_join(spread.select("*", every), kinds.select("*", every), ["every"], "inner")
    return placed.groupBy("container_kind", "capacity", "shard").applyInPandas(shard, "container_kind string, container string, doc_id long, piece int, tokens long, room_left long")


def _mixed(ids: np.ndarray) -> np.ndarray:
    """An order of arrival that has nothing to do with the ids' own."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def rooms(packed: DataFrame) -> DataFrame:
    """(container_kind, containers, tokens, room_left, unused): the containers of each kind and the share of their room that is unused."""
    each = packed.groupBy("container_kind", "container").agg(F.sum("tokens").alias("tokens"), F.max("room_left").alias("room_left"))
    return each.groupBy("container_kind").agg(
        F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum("room_left").alias("room_left"), F.round(F.sum("room_left") / F.sum(F.col("tokens") + F.col("room_left")), 6).alias("unused")
    )
