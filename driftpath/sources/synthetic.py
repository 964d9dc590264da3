"""A synthetic temporal graph of three strata (few mega hubs, warm nodes, a long tail), made by Spark from row numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stratum:
    nodes: int
    degree: int
    stamps: int


# The strata's sizes (nodes, edges a node, timestamps a node) and the mixing matrix.
STRATA = (Stratum(600, 25_000, 1_500), Stratum(4_000, 2_500, 300), Stratum(20_000, 100, 10))
MIXING = ((0.85, 0.15, 0.0), (0.60, 0.40, 0.0), (0.55, 0.45, 0.0))
SPAN = 1_000_000


def _u(*parts: Column | int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), 11).cast("double") * F.lit(2.0**-53)


def edges(spark: SparkSession, strata: tuple[Stratum, ...] = STRATA, mixing: tuple = MIXING, span: int = SPAN, seed: int = 42) -> DataFrame:
    """u, i, ts: each node has its own set of timestamps; targets follow the mixing matrix, uniform in a stratum."""
    starts = [sum(s.nodes for s in strata[:k]) for k in range(len(strata))]
    out = None
    for k, s in enumerate(strata):
        rows = spark.range(s.nodes * s.degree).select((F.floor(F.col("id") / s.degree) + starts[k]).alias("u"), F.col("id").alias("n"))
        r = _u(F.col("u"), F.col("n"), seed)
        to = F.lit(len(strata) - 1)
        for j in reversed(range(len(strata) - 1)):
            to = F.when(r < sum(mixing[k][: j + 1]), j).otherwise(to)
        size = F.element_at(F.array(*[F.lit(x.nodes) for x in strata]), to + 1)
        first = F.element_at(F.array(*[F.lit(x) for x in starts]), to + 1)
        i = first + F.floor(_u(F.col("u"), F.col("n"), seed + 1) * size)
        slot = F.floor(_u(F.col("u"), F.col("n"), seed + 2) * s.stamps)
        own = rows.select("u", i.cast("long").alias("i"), F.floor(_u(F.col("u"), slot, seed + 3) * span).cast("long").alias("ts"))
        out = own if out is None else out.union(own)
    return out


def describe(df: DataFrame) -> DataFrame:
    """nodes, edges and the least, median and greatest ts."""
    nodes = df.select(F.col("u").alias("n")).union(df.select("i")).distinct().agg(F.count(F.lit(1)).alias("nodes"))
    return df.agg(F.count(F.lit(1)).alias("edges"), F.min("ts").alias("ts_min"), F.percentile_approx("ts", 0.5).alias("ts_median"), F.max("ts").alias("ts_max")).join(F.broadcast(nodes), F.lit(True))
