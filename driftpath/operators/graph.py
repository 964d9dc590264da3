"""The temporal multigraph: edges (u, i, ts), their sliding window, and what is counted from them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import staged

EDGES = "u long, i long, ts long, batch int, idx long, features array<float>"
OUT, IN = "out", "in"
#: Retained edges are written anew every so many batches, which ends the chain of unions.
COMPACT = 8


def global_rank(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with the place of each row in the order `by`, from 0, without one task that sorts all.

    Rows are dealt by range and sorted there; the number of rows before each range is a sum over one row a partition.
    """
    dealt = staged(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()).withColumn(
        "_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ))
    sizes = dealt.groupBy("_part").count()
    before = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def running(df: DataFrame, by: list, sums: dict[str, str]) -> DataFrame:
    """df with running sums in the order `by` (the row itself included): new column by summed column. No task has all rows.

    Rows are dealt by range and summed there; what lies before each range is a sum over one row a partition.
    """
    dealt = staged(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    order = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_part", *[F.coalesce(F.sum(f"_{n}").over(order), F.lit(0)).alias(f"_{n}") for n in sums])
    upto = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumns({n: F.sum(c).over(upto) for n, c in sums.items()}).join(F.broadcast(before), "_part")
    return own.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_part", *[f"_{n}" for n in sums])


@dataclass(frozen=True)
class TemporalGraph:
    """Immutable: adding a batch gives a new graph.

    capacity > 0 keeps edges with ts > latest - capacity alone, latest being the largest ts ever seen (from 0 on).
    last_batch holds the raw rows of the last batch that was not empty. Node ids are any longs; null ids are refused.
    """

    spark: SparkSession
    directed: bool
    capacity: int = -1
    edges: DataFrame | None = None
    latest: int = 0
    batches: int = 0
    feature_dim: int | None = None
    last_batch: DataFrame | None = None
    _held: dict = field(default_factory=dict, compare=False)

    def _kept(self, key, make):
        if key not in self._held:
            self._held[key] = make()
        return self._held[key]

    def _edges(self) -> DataFrame:
        return self.edges if self.edges is not None else self.spark.createDataFrame([], EDGES)

    def add(self, batch: DataFrame, check: bool = True) -> TemporalGraph:
        """batch: u, i, ts, optionally idx (order of arrival; else the order of rows as read) and features."""
        has = "features" in batch.columns
        rows = batch.select(
            F.col("u").cast("long").alias("u"), F.col("i").cast("long").alias("i"), F.col("ts").cast("long").alias("ts"), F.lit(self.batches).alias("batch"),
            (F.col("idx").cast("long") if "idx" in batch.columns else F.monotonically_increasing_id()).alias("idx"),
            (F.col("features").cast("array<float>") if has else F.lit(None).cast("array<float>")).alias("features"),
        )
        rows = staged(rows)
        seen = rows.agg(
            F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"), F.min(F.size("features")).alias("low"), F.max(F.size("features")).alias("high"),
            F.count_if(F.col("u").isNull() | F.col("i").isNull() | F.col("ts").isNull()).alias("gaps"),
        ).first()
        if not seen.n:
            return self
        if check and seen.gaps:
            raise ValueError(f"{seen.gaps} edges lack a node or a timestamp")
        dim = seen.high if has else 0
        if has and (seen.low != seen.high or seen.low < 1):
            raise ValueError("edge features must all have one length, of 1 or more")
        if self.feature_dim is not None and dim != self.feature_dim:
            raise ValueError(f"edge features have length {dim}; the graph's have {self.feature_dim}")
        latest = max(self.latest, seen.latest)
        merged = rows if self.edges is None else self.edges.unionByName(rows)
        if self.capacity > 0:
            merged = merged.where(F.col("ts") > latest - self.capacity)
        if self.batches % COMPACT == COMPACT - 1:
            merged = staged(merged)  # what the window has dropped is not read again
        return replace(self, edges=merged, latest=latest, batches=self.batches + 1, feature_dim=dim, last_batch=rows.select("u", "i"), _held={})

    def clear(self) -> TemporalGraph:
        return TemporalGraph(self.spark, self.directed, self.capacity)

    # Edges and nodes.

    def positioned(self) -> DataFrame:
        """Edges with edge_id, their place by (ts, batch, order of arrival)."""
        return self._kept("positioned", lambda: staged(global_rank(self._edges(), ["ts", "batch", "idx"], "edge_id")))

    def nodes(self) -> DataFrame:
        e = self._edges()
        return e.select(F.col("u").alias("node")).union(e.select("i")).distinct()

    def edge_count(self) -> int:
        return self._edges().count()

    def node_count(self) -> int:
        return self.nodes().count()

    def is_active(self, asked: DataFrame) -> DataFrame:
        """asked(node) with `active`."""
        return asked.join(self.nodes().withColumn("active", F.lit(True)), "node", "left").withColumn("active", F.coalesce("active", F.lit(False)))

    def ends(self, side: str = OUT) -> DataFrame:
        """node, nbr, ts, edge_id, flip: one row for each edge (two if undirected, of self-loops too)."""
        e = self.positioned()
        out = e.select(F.col("u").alias("node"), F.col("i").alias("nbr"), "ts", "edge_id", F.lit(0).alias("flip"))
        back = e.select(F.col("i").alias("node"), F.col("u").alias("nbr"), "ts", "edge_id", F.lit(1).alias("flip"))
        if not self.directed:
            return out.union(back) if side == OUT else out.limit(0)
        return out if side == OUT else back.withColumn("flip", F.lit(0))

    def degrees(self, side: str = OUT) -> DataFrame:
        """node, degree. Undirected: all ends, on either side."""
        e = self._edges()
        own = {OUT: e.select(F.col("u").alias("node")), IN: e.select(F.col("i").alias("node"))}
        rows = own[side] if self.directed else own[OUT].union(own[IN])
        return rows.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))

    def degrees_of(self, asked: DataFrame, side: str = OUT) -> DataFrame:
        """asked(pos, node) with degree, 0 for unknown nodes; repeated nodes stay."""
        return asked.join(self.degrees(side), "node", "left").select("pos", "node", F.coalesce("degree", F.lit(0)).alias("degree"))

    def neighbours(self) -> DataFrame:
        """node, nbr: distinct pairs, both ways."""
        e = self._edges()
        return e.select(F.col("u").alias("node"), F.col("i").alias("nbr")).union(e.select("i", "u")).distinct()

    # Timestamp groups.

    def ts_groups(self) -> DataFrame:
        """ts, gg, n_edges, first_edge_id: the distinct timestamps in order."""
        def make():
            sizes = self._edges().groupBy("ts").agg(F.count(F.lit(1)).alias("n_edges"))
            ranked = global_rank(sizes, ["ts"], "gg")
            first = self.positioned().groupBy("ts").agg(F.min("edge_id").alias("first_edge_id"))
            return staged(ranked.join(first, "ts"))

        return self._kept("ts_groups", make)

    def groups(self, side: str = OUT) -> DataFrame:
        """node, g, ts, n_edges, first_pos: by node its distinct timestamps in order. Edges are summed first."""
        def make():
            sizes = self.ends(side).groupBy("node", "ts").agg(F.count(F.lit(1)).alias("n_edges"))
            w = Window.partitionBy("node").orderBy("ts")
            before = F.coalesce(F.sum("n_edges").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            return staged(sizes.withColumn("g", (F.row_number().over(w) - 1).cast("int")).withColumn("first_pos", before).select("node", "g", "ts", "n_edges", "first_pos"))

        return self._kept(("groups", side), make)

    def group_count(self, side: str = OUT) -> DataFrame:
        return self.groups(side).groupBy("node").agg(F.count(F.lit(1)).alias("n_groups"))

    def group_range(self, asked: DataFrame) -> DataFrame:
        """asked(gg) with start and stop, the edge ids of the group; 0 and 0 out of range."""
        own = self.ts_groups().select("gg", F.col("first_edge_id").alias("start"), (F.col("first_edge_id") + F.col("n_edges")).alias("stop"))
        return asked.join(own, "gg", "left").select("gg", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("stop", F.lit(0)).alias("stop"))

    def _counted(self, table: DataFrame, asked: DataFrame, on: list[str], less: bool) -> DataFrame:
        """asked(on, t), distinct, with n: rows of table (on, ts) below t, or above it; 0 for a null t.

        Questions and rows are put in one order and counted by a running sum, so work grows with rows, not with pairs.
        """
        asked = asked.distinct()
        rows = table.select(*on, F.col("ts").alias("t"), F.lit(1).alias("own"))
        both = rows.unionByName(asked.where("t is not null").select(*on, "t", F.lit(0).alias("own")))
        order = [F.col("t") if less else F.desc("t"), F.col("own")]  # a question stands before rows of its own time
        if on:
            upto = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
            counted = both.withColumn("n", F.sum("own").over(upto))
        else:
            counted = running(both, order, {"n": "own"})
        nothing = asked.where("t is null").withColumn("n", F.lit(0).cast("long"))
        return counted.where("own = 0").select(*asked.columns, "n").unionByName(nothing)

    def count_ts_less(self, asked: DataFrame) -> DataFrame:
        """asked(t), distinct, with n, the distinct timestamps below t."""
        return self._counted(self.ts_groups().select("ts"), asked.select("t"), [], True)

    def count_ts_greater(self, asked: DataFrame) -> DataFrame:
        return self._counted(self.ts_groups().select("ts"), asked.select("t"), [], False)

    def count_node_ts_less(self, asked: DataFrame) -> DataFrame:
        """asked(node, t): groups below t, inbound ones of directed graphs; 0 for unknown nodes."""
        side = IN if self.directed else OUT
        return self._counted(self.groups(side).select("node", "ts"), asked.select("node", "t"), ["node"], True)

    def count_node_ts_greater(self, asked: DataFrame) -> DataFrame:
        return self._counted(self.groups(OUT).select("node", "ts"), asked.select("node", "t"), ["node"], False)

    def asof(self, asked: DataFrame, forward: bool) -> DataFrame:
        """asked(t): gg of the first group after t, or of the last before it (-1 if none; the number of groups if past all)."""
        if forward:
            total = self.ts_groups().count()
            return self.count_ts_greater(asked).select("t", (F.lit(total) - F.col("n")).alias("gg"))
        return self.count_ts_less(asked).select("t", (F.col("n") - 1).alias("gg"))

    def last_batch_nodes(self) -> DataFrame:
        """Sources of the last batch as it came; undirected: sources and targets."""
        if self.last_batch is None:
            return self.spark.createDataFrame([], "node long")
        own = self.last_batch.select(F.col("u").alias("node"))
        return (own if self.directed else own.union(self.last_batch.select("i"))).distinct()

    def memory_used(self, weights: bool = False) -> int:
        """Bytes of a columnar store of these edges and indexes: a formula over counts, not a heap size."""
        e, n = self.edge_count(), self.node_count()
        sides = [OUT, IN] if self.directed else [OUT]
        g = [self.groups(s).count() for s in sides]
        ends = e * (1 if self.directed else 2)
        tg = self.ts_groups().count()
        return e * (4 + 4 + 8 + 4 * (self.feature_dim or 0)) + tg * 16 + n * 4 + len(sides) * (ends * 8 + 2 * n * 8) + sum(g) * 8 + (sum(g) * 8 * 2 + tg * 16 if weights else 0)
