"""Places in a total order of a whole table, by ranges and counted offsets instead of one task's window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topolake.sources.storage import written


def _looked_up(df: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """df joined to known on keys, nulls alike; known's own columns of these names go."""
    named = known.select(*[F.col(k).alias(f"known_{i}_") if k in keys else F.col(k) for i, k in enumerate(known.columns)])
    places = [known.columns.index(k) for k in keys]
    on = F.lit(True)
    for k, i in zip(keys, places, strict=True):
        on &= F.col(f"`{k}`").eqNullSafe(F.col(f"known_{i}_"))
    return df.join(named, on).drop(*[f"known_{i}_" for i in places])


def numbered(df: DataFrame, order: list[str | Column], by: list[str] = (), name: str = "place") -> DataFrame:
    """df with its 0-based long place in the order, within the values of `by` if any are named.

    The table is dealt by ranges of (by, order) and sorted within them, so a value of `by` that most rows share is many
    tasks'; a range's places start after the counts of the ranges before it, one row a range and value. Rows equal in
    the whole order get different places, in any order, and stand in one range: end the order with a column that tells
    them apart where they may be many. Nulls come first, as ascending order has them; an empty table stays empty.
    """
    by, keys = list(by), [F.col(c) if isinstance(c, str) else c for c in (*by, *order)]
    spot = F.monotonically_increasing_id()
    held = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("spot_", spot), "ranges").withColumn("range_", F.shiftright("spot_", 33))
    sizes = held.groupBy(*by, "range_").agg(F.count("*").alias("n_"), F.min("spot_").alias("least_"))
    before = F.sum("n_").over(Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*by, "range_", "least_", F.coalesce(before, F.lit(0)).alias("before_"))
    placed = (F.col("spot_") - F.col("least_") + F.col("before_")).alias(name)
    return _looked_up(held, [*by, "range_"], sizes).select(*[f"`{c}`" for c in df.columns], placed)


def dense_ranked(df: DataFrame, keys: list[str], name: str = "rank") -> DataFrame:
    """df with the 1-based dense rank of its keys: distinct keys are numbered, and each row looks its own up."""
    known = numbered(df.select(*keys).distinct(), keys, name="place_")
    return _looked_up(df, keys, known).select(*[f"`{c}`" for c in df.columns], (F.col("place_") + 1).alias(name))
