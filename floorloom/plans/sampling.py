"""Bounded samples that do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sampled(df: DataFrame, rows: int, total: int, *key: str, also: tuple[str | Column, ...] = ()) -> DataFrame:
    """At most ``rows`` of the ``total`` rows, by a hash of ``key``; ``also`` orders rows with one key.

    A threshold on the hash leaves about twice as many before they are ordered, so what reaches one task is bounded as well.
    """
    h = F.xxhash64(*key, F.lit(3))
    share = min(1.0, 2.0 * rows / max(1, total))
    kept = df if share >= 1 else df.where(F.shiftrightunsigned(h, 11) < int(share * (1 << 53)))
    return kept.orderBy(h, *key, *also).limit(rows)
