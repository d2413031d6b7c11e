"""Last value before a row, without one task per key: rows of a hot key are cut into blocks by cut points of their order.

Chunk ends first (the last value of each block, partially aggregated), then a carry over the few block ends of a key, then a
window inside each block. Keys with at most ``block_rows`` rows are one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equipledger.session import materialized

BLOCK_ROWS = 100_000
CUTS = 255


def blocks(df: DataFrame, key: str, by: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``__block``: for a key of more than ``block_rows`` rows the number of its cut points below ``by`` (a number
    that leads the order), else 0. Without such a key there is nothing to cut, and ``df`` comes back without the column. ``df`` is
    written once. The cut points are a mergeable quantile summary per hot key, written once, so that every reader has the same blocks; there
    are at most (all rows / block_rows) such keys, found by their counts alone."""
    df = materialized(df, "changes")       # read by every step below and by the caller
    hot = materialized(df.groupBy(F.col(key).alias("__hot")).agg(F.count(F.lit(1)).alias("__n"))
                       .where((F.col("__n") > block_rows) & F.col("__hot").isNotNull()).select("__hot"), "hot-keys")
    if hot.isEmpty():
        return df
    points = F.percentile_approx(by, [i / (CUTS + 1) for i in range(1, CUTS + 1)], 10_000)
    cuts = (df.select(F.col(key).alias("__hot"), by).join(hot, "__hot", "left_semi").groupBy("__hot")
            .agg(F.array_distinct(points).alias("__cuts")))
    j = df.join(materialized(cuts, "hot-cuts"), df[key] == F.col("__hot"), "left")
    below = F.size(F.filter("__cuts", lambda c: c < F.col(by)))
    j = j.withColumn("__block", F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(below)).drop("__hot", "__cuts")
    return materialized(j, "blocked")      # read for the block ends and for the rows


def last_before(df: DataFrame, keys: list[str], order: str, values: dict[str, Column]) -> DataFrame:
    """``df`` (from ``blocks``) with the last non-null of each of ``values`` in the rows of the same ``keys`` (not null) before
    it by ``order``. Uncut keys are one window. A cut key's blocks are windows of their own, and only what they carry over
    is joined, on the columns by which the windows are dealt and sorted already."""
    own = {n: f"__v_{n}" for n in values}
    df = df.withColumns({own[n]: v for n, v in values.items()})
    cut = ["__block"] if "__block" in df.columns else []
    inside = Window.partitionBy(*keys, *cut).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumns({f"__in_{n}": F.last(own[n], ignorenulls=True).over(inside) for n in values})
    if not cut:
        return out.withColumns({n: F.col(f"__in_{n}") for n in values}).drop(*own.values(), *[f"__in_{n}" for n in values])
    ends = df.groupBy(*keys, "__block").agg(
        *[F.max_by(own[n], F.when(F.col(own[n]).isNotNull(), F.col(order))).alias(f"__end_{n}") for n in values])
    over_ends = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__block").alias("__k_block"),
                        *[F.last(f"__end_{n}", ignorenulls=True).over(over_ends).alias(f"__carry_{n}") for n in values])
    on = [F.col(k) == F.col(f"__k_{k}") for k in keys] + [F.col("__block") == F.col("__k_block")]
    out = out.join(carry, on, "left").withColumns({n: F.coalesce(f"__in_{n}", f"__carry_{n}") for n in values})
    return out.drop(*own.values(), *[f"__in_{n}" for n in values], *[f"__carry_{n}" for n in values],
                    *[f"__k_{k}" for k in keys], "__k_block")
