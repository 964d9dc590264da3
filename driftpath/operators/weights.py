"""Normalised cumulative exponential weights over timestamp groups, for the whole graph and by node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _raw(low: Column, high: Column, bound: float) -> tuple[Column, Column]:
    span = (high - low).cast("double")
    scale = F.when((F.lit(bound) > 0) & (span > 0), F.lit(float(bound)) / span).otherwise(F.lit(1.0))
    n = F.col("n_edges").cast("double")
    forward = n * F.exp((low - F.col("ts")).cast("double") * scale)
    return forward, n * F.exp((F.col("ts") - high).cast("double") * scale)


def node_weights(groups: DataFrame, bound: float = -1) -> DataFrame:
    """groups with w_fwd, w_bwd (normalised) and cum_fwd, cum_bwd (running sums by node). bound <= 0: raw units."""
    w = Window.partitionBy("node")
    upto = w.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    forward, backward = _raw(F.min("ts").over(w), F.max("ts").over(w), bound)
    out = groups.withColumn("rf", forward).withColumn("rb", backward)
    out = out.withColumn("w_fwd", F.col("rf") / F.sum("rf").over(w)).withColumn("w_bwd", F.col("rb") / F.sum("rb").over(w))
    return out.withColumn("cum_fwd", F.sum("w_fwd").over(upto)).withColumn("cum_bwd", F.sum("w_bwd").over(upto)).drop("rf", "rb")


def global_weights(ts_groups: DataFrame, bound: float = -1) -> DataFrame:
    """ts_groups with the same columns over all groups."""
    from .graph import running

    ends = ts_groups.agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    forward, backward = _raw(F.col("low"), F.col("high"), bound)
    raw = ts_groups.join(F.broadcast(ends), F.lit(True)).withColumn("rf", forward).withColumn("rb", backward)
    sums = raw.agg(F.sum("rf").alias("sf"), F.sum("rb").alias("sb"))
    out = raw.join(F.broadcast(sums), F.lit(True)).withColumn("w_fwd", F.col("rf") / F.col("sf")).withColumn("w_bwd", F.col("rb") / F.col("sb"))
    return running(out, ["ts"], {"cum_fwd": "w_fwd", "cum_bwd": "w_bwd"}).drop("low", "high", "rf", "rb", "sf", "sb")


def group_weight(cum: Column, over: Window) -> Column:
    """A group's own weight from the running sums."""
    return cum - F.coalesce(F.lag(cum).over(over), F.lit(0.0))
