"""Joins whose small side is checked before it is broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut

#: A side is broadcast up to this many bytes, estimated from its own rows.
BROADCAST_BYTES = 32 << 20
#: Copies of the small side when it is too large to broadcast; each key of the large side is spread over as many tasks.
SALTS = 16


def estimated_bytes(df: DataFrame) -> int:
    """Bytes of ``df`` as text, 16 more for each value; one pass over it, aggregated on the executors."""
    width = sum((F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{c}`")))), F.lit(0)) + 16 for c in df.columns), F.lit(0))
    return df.agg(F.sum(width.cast("long"))).first()[0] or 0


def lookup_join(large: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left", limit: int = BROADCAST_BYTES, salts: int = SALTS) -> DataFrame:
    """Join ``small`` to every row of ``large`` on ``on``.

    ``small`` is computed once. If it measures at most ``limit`` bytes it is broadcast; beyond that each of its rows is
    repeated ``salts`` times and the join shuffles on the key and a salt, so that a key with a third of all rows is
    spread over ``salts`` tasks. Null keys match nothing; ``how`` is left, inner, left_semi or left_anti.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"how: {how}")
    small = cut(small)
    on = list(on)
    if estimated_bytes(small) <= limit:
        return large.join(F.broadcast(small), on, how)
    spread = large.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*on, "__salt"], how).drop("__salt")
