"""The walk index: the as-of search of each hop as an equi-join.

Each directed end (node -> nbr at ts) knows its group g, its place k in the group, and `succ`: how many groups of nbr
are at or before ts (forward: the next walk's first valid group) or before ts (backward: the end of its valid groups).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged
from .graph import IN, OUT, TemporalGraph
from .weights import node_weights


@dataclass(frozen=True)
class WalkIndex:
    ends: DataFrame  # node, g, k, nbr, ts, edge_id, succ
    stats: DataFrame  # node, n_groups, sizes array<long>, stamps array<long>, cum array<double>
    forward: bool
    directed: bool
    n_ends: int = 1 << 62
    _held: dict = field(default_factory=dict, compare=False)

    def shared(self):
        """The index as broadcast arrays; only asked for where n_ends has been checked."""
        if "arrays" not in self._held:
            from .vector_walks import arrays

            self._held["arrays"] = self.ends.sparkSession.sparkContext.broadcast(arrays(self))
        return self._held["arrays"]


def side_of(directed: bool, forward: bool) -> str:
    return OUT if forward or not directed else IN


def successor_ranks(groups: DataFrame, arrivals: DataFrame, forward: bool) -> DataFrame:
    """node, ts, succ for each distinct arrival (node, ts): groups of the node at or before ts, or strictly before it."""
    both = groups.select("node", "ts", F.lit(1).alias("own"), F.lit(0).alias("asked")).union(
        arrivals.select("node", "ts", F.lit(0), F.lit(1)).distinct()
    ).groupBy("node", "ts").agg(F.max("own").alias("own"), F.max("asked").alias("asked"))
    frame = Window.partitionBy("node").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0 if forward else -1)
    return both.withColumn("succ", F.coalesce(F.sum("own").over(frame), F.lit(0)).cast("int")).where("asked = 1").select("node", "ts", "succ")


def build(graph: TemporalGraph, forward: bool, bound: float = -1) -> WalkIndex:
    def make():
        side = side_of(graph.directed, forward)
        groups, ends = graph.groups(side), graph.ends(side)
        place = Window.partitionBy("node", "ts").orderBy("edge_id", "flip")
        ranked = ends.withColumn("k", (F.row_number().over(place) - 1).cast("int")).join(groups.select("node", "ts", "g"), ["node", "ts"])
        succ = successor_ranks(groups, ends.select(F.col("nbr").alias("node"), "ts"), forward).withColumnRenamed("node", "nbr")
        out = ranked.join(succ, ["nbr", "ts"]).select("node", "g", "k", "nbr", "ts", "edge_id", "succ")
        cum = "cum_fwd" if forward else "cum_bwd"
        rows = F.array_sort(F.collect_list(F.struct("g", "n_edges", "ts", F.col(cum).alias("c"))))
        stats = node_weights(groups, bound).groupBy("node").agg(rows.alias("x")).select(
            "node", F.size("x").alias("n_groups"), F.transform("x", lambda y: y.n_edges).alias("sizes"),
            F.transform("x", lambda y: y.ts).alias("stamps"), F.transform("x", lambda y: y.c).alias("cum"),
        )
        ends_table = staged(out)
        return WalkIndex(ends_table, staged(stats), forward, graph.directed, ends_table.count())

    return graph._kept(("index", forward, bound), make)
