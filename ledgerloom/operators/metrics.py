"""Alert rules over metric series (A1-A8): windowed rates, increases, quantiles from buckets, stalls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def increases(samples: DataFrame, keys: list[str], width: str = "5 minutes") -> DataFrame:
    """Over counter samples (keys, ts, value): the increase per tumbling window; a drop is a restart from 0."""
    w = Window.partitionBy(*keys).orderBy("ts")
    step = F.col("value") - F.lag("value").over(w)
    grown = samples.withColumn("_step", F.when(step < 0, F.col("value")).otherwise(F.coalesce(step, F.lit(0))))
    return grown.groupBy(*keys, F.window("ts", width).alias("w")).agg(F.sum("_step").alias("increase")).select(*keys, F.col("w.start").alias("window_start"), "increase")


def rate_alerts(samples: DataFrame, keys: list[str], over: float, width_s: int = 300) -> DataFrame:
    """A1-A3: windows whose rate per second is over a threshold."""
    return increases(samples, keys, f"{width_s} seconds").withColumn("rate", F.col("increase") / F.lit(width_s)).where(F.col("rate") > over)


def increase_alerts(samples: DataFrame, keys: list[str], over: float, width: str) -> DataFrame:
    """A6 and A7."""
    return increases(samples, keys, width).where(F.col("increase") > over)


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """A4 over cumulative buckets (keys, le double with infinity, n): the quantile by linear interpolation in its bucket; in the last
    bucket the bound below it."""
    w = Window.partitionBy(*keys).orderBy("le")
    rows = buckets.withColumns({"_total": F.max("n").over(Window.partitionBy(*keys)), "_below": F.coalesce(F.lag("n").over(w), F.lit(0)), "_from": F.coalesce(F.lag("le").over(w), F.lit(0.0))})
    rank = F.col("_total") * F.lit(q)
    hit = rows.where((F.col("n") >= rank) & (F.col("_below") < rank))
    inside = F.col("_from") + (F.col("le") - F.col("_from")) * (rank - F.col("_below")) / (F.col("n") - F.col("_below"))
    return hit.select(*keys, F.when(F.col("le") == float("inf"), F.col("_from")).otherwise(inside).alias("quantile"))


def stalled(samples: DataFrame, keys: list[str], width: str = "10 minutes") -> DataFrame:
    """A5 over gauge samples (keys, ts, value): windows in which the value never changed."""
    w = Window.partitionBy(*keys).orderBy("ts")
    changed = samples.withColumn("_changed", (F.col("value") != F.lag("value").over(w)).cast("int"))
    out = changed.groupBy(*keys, F.window("ts", width).alias("w")).agg(F.sum(F.coalesce("_changed", F.lit(0))).alias("changes"))
    return out.select(*keys, F.col("w.start").alias("window_start"), "changes").where("changes = 0")


def pool_alert(in_use: Column, opened: Column, over: float = 0.9) -> Column:
    """A8."""
    return F.when(opened > 0, in_use / opened > over).otherwise(False)
