"""Time-respecting random walks: each hop is two equi-joins and a few Column expressions over all walkers at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pickers as P
from ..functions.rng import EDGE, ENDPOINT, GROUP, MODES
from ..functions.scalars import beta, bounded, either
from ..storage import staged
from . import index as ix
from . import vector_walks as vw
from .graph import TemporalGraph, running
from .weights import global_weights

FIRST_TS, LAST_TS = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class WalkOptions:
    """beta_from: the hop (1 is the start edge) from which node2vec's beta holds. cut_every: hops between staged tables.

    broadcast_ends: an index of at most so many rows goes to all executors as arrays (some 60 bytes a row), and walkers hop
    there; beyond it, and for node2vec, each hop is joins. Both give the same walks.
    """

    max_len: int
    bias: str
    start_bias: str | None = None
    direction: str = P.FORWARD
    seed: int = 0
    rng: str = "hashed"
    bound: float = -1
    p: float = 1.0
    q: float = 1.0
    beta_from: int = 2
    cut_every: int = 6
    broadcast_ends: int = 2_000_000

    def __post_init__(self) -> None:
        P.parse_picker(self.bias)
        P.parse_picker(self.start_bias or self.bias)
        P.parse_direction(self.direction)
        if self.max_len < 1:
            raise ValueError("a walk has at least one node")
        if self.p <= 0 or self.q <= 0:
            raise ValueError("p and q must be above 0")

    @property
    def forward(self) -> bool:
        return self.direction == P.FORWARD


def repeat_seeds(seeds: DataFrame, per_node: int) -> DataFrame:
    """seeds(pos, node[, cutoff]) -> walk_id, node, cutoff; walk_id = pos * per_node + j."""
    cutoff = F.col("cutoff").cast("long") if "cutoff" in seeds.columns else F.lit(None).cast("long")
    return seeds.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1)))).select(
        (F.col("pos") * per_node + F.col("j")).cast("long").alias("walk_id"), F.col("node").cast("long").alias("node"), cutoff.alias("cutoff")
    )


_STEPS = "array<struct<node:bigint,ts:bigint,edge_id:bigint>>"


def _step(node: Column, ts: Column, edge_id: Column) -> Column:
    return F.struct(node.cast("long").alias("node"), ts.cast("long").alias("ts"), edge_id.cast("long").alias("edge_id"))


def _ranged(f: DataFrame, index: ix.WalkIndex, cutoffs: bool) -> DataFrame:
    """f with stats and the valid groups [lo, hi)."""
    met = f.join(index.stats.withColumnRenamed("node", "at"), f["key"] == F.col("at"), "left").drop("at")
    at = F.col("rank")
    lo = F.when(F.lit(index.forward), F.coalesce(at, F.lit(0))).otherwise(F.lit(0))
    hi = F.when(F.lit(index.forward) | at.isNull(), F.col("n_groups")).otherwise(at)
    if cutoffs:
        early = F.size(F.filter("stamps", lambda t: t < F.col("cutoff")))
        hi = F.when(F.col("cutoff").isNull(), hi).otherwise(F.least(hi, early))
    return met.withColumn("lo", lo).withColumn("hi", F.coalesce(hi, F.lit(0)))


def _hop(f: DataFrame, index: ix.WalkIndex, step: int, bias: str, o: WalkOptions, cutoffs: bool, adjacent: DataFrame | None) -> DataFrame:
    """f: walk_id, key (node, null once ended), rank, cutoff, prev, steps -> the same one hop on."""
    u = MODES[o.rng]
    r1, r2 = u(F.col("walk_id"), step, GROUP, o.seed), u(F.col("walk_id"), step, EDGE, o.seed)
    base = ["walk_id", "key", "rank", "cutoff", "prev", "steps"]
    met = _ranged(f, index, cutoffs)
    ends = index.ends.withColumnsRenamed({"node": "e_node", "g": "e_g", "k": "e_k", "ts": "e_ts"})
    if bias == P.NODE2VEC and step + 1 >= o.beta_from and adjacent is not None:
        own = F.get("cum", F.col("e_g")) - F.when(F.col("e_g") > 0, F.get("cum", F.col("e_g") - 1)).otherwise(F.lit(0.0))
        valid = met.where("hi > lo").join(ends, (F.col("key") == F.col("e_node")) & (F.col("e_g") >= F.col("lo")) & (F.col("e_g") < F.col("hi")))
        near = adjacent.select(F.col("node").alias("a_node"), F.col("nbr").alias("a_nbr"), F.lit(True).alias("near"))
        valid = valid.join(near, (F.col("prev") == F.col("a_node")) & (F.col("nbr") == F.col("a_nbr")), "left")
        weight = own / F.get("sizes", F.col("e_g")) * beta(F.col("prev"), F.col("nbr"), F.coalesce("near", F.lit(False)), o.p, o.q)
        from pyspark.sql import Window

        w = Window.partitionBy("walk_id").orderBy("e_g", "e_k")
        valid = valid.withColumn("wt", weight).withColumn("upto", F.sum("wt").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        all_ = Window.partitionBy("walk_id")
        valid = valid.withColumn("target", r1 * F.max("upto").over(all_)).where(F.col("upto") >= F.col("target"))
        picked = valid.groupBy("walk_id").agg(F.min_by(F.struct("nbr", "e_ts", "edge_id", "succ"), F.struct("e_g", "e_k")).alias("x")).select("walk_id", "x.*")
        out = f.join(picked, "walk_id", "left")
    else:
        kind = P.EXPONENTIAL_WEIGHT if bias == P.NODE2VEC else bias
        g = P.pick(kind, F.col("lo"), F.col("hi"), r1, not index.forward, F.col("cum"))
        met = met.withColumn("g", g)
        size = F.get("sizes", F.col("g"))
        k = (F.lit(0) if kind in (P.FIRST, P.LAST) else bounded(size, r2)).cast("int")
        met = met.withColumn("k", k).select(*base, "g", "k")
        out = met.join(ends, (F.col("key") == F.col("e_node")) & (F.col("g") == F.col("e_g")) & (F.col("k") == F.col("e_k")), "left")
    went = F.col("nbr").isNotNull()
    return out.select(
        "walk_id", F.col("nbr").alias("key"), F.col("succ").alias("rank"), "cutoff", F.col("key").alias("prev"),
        F.when(went, F.concat("steps", F.array(_step(F.col("nbr"), F.col("e_ts"), F.col("edge_id"))))).otherwise(F.col("steps")).alias("steps"),
    )


def _finished(f: DataFrame, forward: bool) -> DataFrame:
    """walk_id, nodes, timestamps, edge_ids, walk_len; a walk that only has its seed is empty."""
    nodes, stamps = F.transform("steps", lambda x: x.node), F.transform("steps", lambda x: x.ts)
    ids = F.transform(F.slice("steps", 2, F.greatest(F.size("steps"), F.lit(1))), lambda x: x.edge_id)
    turn = (lambda c: c) if forward else F.reverse
    return f.select("walk_id", turn(nodes).alias("nodes"), turn(stamps).alias("timestamps"), turn(ids).alias("edge_ids"), F.size("steps").alias("walk_len"))


def _run(f: DataFrame, index: ix.WalkIndex, o: WalkOptions, done: int, cutoffs: bool, adjacent: DataFrame | None) -> DataFrame:
    """done: hops that f already has."""
    last = o.max_len - 1 if o.max_len > 1 else 1
    if P.NODE2VEC not in (o.bias, o.start_bias) and index.n_ends <= o.broadcast_ends:
        return vw.run(f, index.shared(), o, index.forward, done, last, _STEPS)
    for step in range(done, last):
        bias = o.bias if step else o.start_bias or o.bias
        f = _hop(f, index, step, bias, o, cutoffs, adjacent if step else None)
        if (step + 1) % o.cut_every == 0 and step + 2 < o.max_len:
            f = staged(f)
    return f


def walks(graph: TemporalGraph, seeds: DataFrame, o: WalkOptions, per_node: int = 1) -> DataFrame:
    """seeds(pos, node[, cutoff]): per_node walks from each, packed. A cutoff is an exclusive upper bound on all times."""
    index = ix.build(graph, o.forward, o.bound)
    adjacent = graph.neighbours() if o.bias == P.NODE2VEC else None
    start = repeat_seeds(seeds, per_node)
    bare = F.array(_step(F.col("node"), F.lit(FIRST_TS if o.forward else LAST_TS), F.lit(None)))
    f = start.select("walk_id", F.col("node").alias("key"), F.lit(None).cast("int").alias("rank"), "cutoff", F.lit(None).cast("long").alias("prev"), bare.alias("steps"))
    f = _run(f, index, o, 0, "cutoff" in seeds.columns, adjacent)
    # A walk begins with its first edge: without one it is empty.
    f = f.withColumn("steps", F.when(F.size("steps") > 1, F.slice("steps", 1, o.max_len)).otherwise(F.array().cast(_STEPS)))
    return _finished(f, o.forward)


def node_seeds(graph: TemporalGraph) -> DataFrame:
    from .graph import global_rank

    return global_rank(graph.nodes(), ["node"], "pos")


def last_batch_seeds(graph: TemporalGraph) -> DataFrame:
    from .graph import global_rank

    return global_rank(graph.last_batch_nodes(), ["node"], "pos")


def start_edges(graph: TemporalGraph, asked: DataFrame, picker: str, forward: bool, o: WalkOptions) -> DataFrame:
    """asked(walk_id[, t]): an edge of the whole graph by the picker over all groups (after t, or before it), uniform in it."""
    u = MODES[o.rng]
    groups, total = graph.ts_groups(), graph.ts_groups().count()
    r1, r2 = u(F.col("walk_id"), 0, GROUP, o.seed), u(F.col("walk_id"), 0, EDGE, o.seed)
    kind = P.EXPONENTIAL_WEIGHT if picker == P.NODE2VEC else picker
    met = asked.withColumn("lo", F.lit(0).cast("long")).withColumn("hi", F.lit(total).cast("long"))
    if "t" in asked.columns:
        times = asked.select("t").distinct()
        counts = graph.count_ts_greater(times) if forward else graph.count_ts_less(times)
        met = met.join(counts, met["t"].eqNullSafe(counts["t"]), "left").drop(counts["t"])
        known = F.col("t").isNotNull()
        met = met.withColumn("lo", F.when(known, F.lit(total) - F.col("n")).otherwise(F.col("lo"))) if forward else met.withColumn("hi", F.when(known, F.col("n")).otherwise(F.col("hi")))
        met = met.drop("n")
    if kind == P.EXPONENTIAL_WEIGHT:
        met = _weighted_groups(met, global_weights(groups, o.bound).select(F.col("gg").cast("long").alias("gg"), F.col("cum_fwd" if forward else "cum_bwd").alias("cum")), r1)
    else:
        met = met.withColumn("g", P.pick(kind, F.col("lo"), F.col("hi"), r1, not forward).cast("long"))
    own = groups.select(F.col("gg").cast("long").alias("g"), "n_edges", "first_edge_id")
    met = met.join(own, "g", "left")
    k = F.lit(0).cast("long") if kind in (P.FIRST, P.LAST) else bounded(F.col("n_edges"), r2)
    met = met.withColumn("edge_id", F.col("first_edge_id") + k).drop("lo", "hi", "g", "n_edges", "first_edge_id")
    return met.join(graph.positioned().select("edge_id", "u", "i", "ts"), "edge_id", "left")


def _weighted_groups(met: DataFrame, cum: DataFrame, r: Column) -> DataFrame:
    """met(walk_id, lo, hi) with g, the first group of [lo, hi) whose cumulative weight reaches the target drawn by r.

    The search is a running count over weights and targets in one order.
    """
    at = lambda name, key: cum.select((F.col("gg") + 1).alias(key), F.col("cum").alias(name))
    met = met.join(at("c_lo", "lo"), "lo", "left").join(at("c_hi", "hi"), "hi", "left")
    start = F.coalesce("c_lo", F.lit(0.0))
    drawn = staged(met.withColumn("target", F.when(F.col("hi") > F.col("lo"), start + r * (F.col("c_hi") - start))).drop("c_lo", "c_hi"))
    both = cum.select(F.col("cum").alias("x"), F.lit(1).alias("own"), F.lit(None).cast("long").alias("walk_id"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi")).unionByName(
        drawn.where("target is not null").select(F.col("target").alias("x"), F.lit(0).alias("own"), "walk_id", "lo", "hi")
    )
    found = running(both, ["x", "own", "walk_id"], {"below": "own"}).where("own = 0")
    found = found.select("walk_id", F.least(F.greatest("below", "lo"), F.col("hi") - 1).cast("long").alias("g"))
    return drawn.drop("target").join(found, "walk_id", "left")


def free_walks(graph: TemporalGraph, total: int, o: WalkOptions) -> DataFrame:
    """total walks from edges drawn from the whole graph."""
    index = ix.build(graph, o.forward, o.bound)
    adjacent = graph.neighbours() if o.bias == P.NODE2VEC else None
    first = start_edges(graph, graph.spark.range(total).select(F.col("id").alias("walk_id")), o.start_bias or o.bias, o.forward, o)
    if graph.directed:
        start = F.col("u") if o.forward else F.col("i")
    else:
        start = either(F.col("u"), F.col("i"), MODES[o.rng](F.col("walk_id"), 0, ENDPOINT, o.seed))
    first = first.withColumn("start", start)
    own = index.ends.groupBy(F.col("node").alias("start"), "edge_id").agg(F.min("nbr").alias("nbr"), F.min("succ").alias("succ"))
    f = first.join(own, ["start", "edge_id"], "left")
    two = F.array(_step(F.col("start"), F.lit(FIRST_TS if o.forward else LAST_TS), F.lit(None)), _step(F.col("nbr"), F.col("ts"), F.col("edge_id")))
    f = f.select(
        "walk_id", F.col("nbr").alias("key"), F.col("succ").alias("rank"), F.lit(None).cast("long").alias("cutoff"), F.col("start").alias("prev"),
        F.when(F.col("nbr").isNull(), F.array().cast(_STEPS)).otherwise(F.slice(two, 1, o.max_len)).alias("steps"),
    )
    if o.max_len > 2:
        f = _run(f, index, o, 1, False, adjacent)
    return _finished(f, o.forward)


def long_form(packed: DataFrame) -> DataFrame:
    """walk_id, step, node, ts, edge_id (of the way to the next node, null at the end)."""
    rows = packed.select("walk_id", "timestamps", "edge_ids", F.posexplode("nodes").alias("step", "node"))
    return rows.select("walk_id", "step", "node", F.get("timestamps", F.col("step")).alias("ts"), F.get("edge_ids", F.col("step")).alias("edge_id"))


def statistics(packed: DataFrame) -> DataFrame:
    """walks, non_empty, steps and avg_len (over those that are not empty)."""
    n = F.col("walk_len")
    return packed.agg(F.count(F.lit(1)).alias("walks"), F.count_if(n > 0).alias("non_empty"), F.coalesce(F.sum(n), F.lit(0)).alias("steps"), F.avg(F.when(n > 0, n)).alias("avg_len"))
