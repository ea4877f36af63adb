"""The primitive under most operators: one winner per key by a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list, order: list[Column], name: str = "_rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def pick_winner(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """The first row of each key. Spark turns this into a per-partition limit before the shuffle, so hot keys stay small."""
    return ranked(df, keys, order).where("_rank = 1").drop("_rank")


def pick_first(df: DataFrame, keys: list, order: list[Column], most: int, name: str | None = None) -> DataFrame:
    """The first `most` rows of each key, with their place where it gets a name."""
    out = ranked(df, keys, order, name or "_rank").where(F.col(name or "_rank") <= most)
    return out if name else out.drop("_rank")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], merge: dict[str, Column]) -> DataFrame:
    """`old` with the rows of `new` (one per key): inserted where the key is new, else merged by column.

    In `merge`, `o.x` and `n.x` name the columns of the two sides; columns not named keep the old value.
    """
    on = None
    for k in keys:
        same = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        on = same if on is None else on & same
    both = old.withColumn("_old", F.lit(True)).alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), on, "full_outer")
    columns = []
    for c in old.columns:
        kept = merge.get(c, F.col(f"o.{c}"))
        columns.append(F.when(F.col("o._old").isNull(), F.col(f"n.{c}")).when(F.col("n._new").isNull(), F.col(f"o.{c}")).otherwise(kept).alias(c))
    return both.select(*columns)
