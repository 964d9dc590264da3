"""Features of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import TemporalGraph


def upsert(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """node, features: new rows win; all features have one length."""
    new = new.select(F.col("node").cast("long").alias("node"), F.col("features").cast("array<float>").alias("features"))
    sizes = {r[0] for r in new.select(F.size("features")).distinct().collect()}
    if old is not None:
        sizes |= {r[0] for r in old.select(F.size("features")).distinct().collect()}
    if len(sizes) > 1:
        raise ValueError(f"node features must have one length; found {sorted(sizes)}")
    return new if old is None else new.unionByName(old.join(new, "node", "left_anti"))


def dense(graph: TemporalGraph, features: DataFrame | None, dim: int | None = None) -> DataFrame:
    """node, features for 0 .. the greatest node id, zeros where unset; no rows without features or nodes."""
    spark = graph.spark
    top = graph.nodes().agg(F.max("node")).first()[0]
    if features is None or top is None:
        return spark.createDataFrame([], "node long, features array<float>")
    dim = dim or features.agg(F.max(F.size("features"))).first()[0] or 0
    every = spark.range(top + 1).select(F.col("id").alias("node"))
    return every.join(features, "node", "left").select("node", F.coalesce("features", F.array_repeat(F.lit(0.0).cast("float"), dim)).alias("features"))


def with_edge_features(graph: TemporalGraph, walks: DataFrame) -> DataFrame:
    """walks with edge_features: those of the edge to the next node, in the order of edge_ids."""
    ids = walks.select("walk_id", F.posexplode("edge_ids").alias("at", "edge_id"))
    own = graph.positioned().select("edge_id", "features")
    lists = ids.join(own, "edge_id", "left").groupBy("walk_id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("features", F.array_repeat(F.lit(0.0).cast("float"), graph.feature_dim or 0)).alias("x")))).alias("l"))
    return walks.join(lists, "walk_id", "left").withColumn("edge_features", F.coalesce(F.transform("l", lambda y: y.x), F.array().cast("array<array<float>>"))).drop("l")
