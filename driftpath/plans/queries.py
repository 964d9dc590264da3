"""Queries over the driver's tables, each with the SQL it is held against. Graphs are built once a session and scale."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..engine import WalkEngine
from ..functions import pickers as P
from ..functions import scalars
from ..functions.rng import portable
from ..operators import features as fx
from ..operators import index as ix
from ..operators import walks as wx
from ..operators.graph import IN, OUT, TemporalGraph, global_rank
from ..operators.weights import global_weights, node_weights
from ..sources import readers, sinks, synthetic
from ..storage import staged_path
from ..streaming.ingest import ingest, replay
from . import oracles as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_GRAPHS: dict[tuple, TemporalGraph] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chain(spark: SparkSession, sf: str, directed: bool = True, features: bool = False) -> TemporalGraph:
    """The chain of users in the order of events."""
    key = (spark.sparkContext.applicationId, sf, directed, features)
    if key not in _GRAPHS:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        edges = readers.from_events(spark, read(spark, sf, "events"))
        if features:
            values = global_rank(read(spark, sf, "events").select("ts", "event_id", "value"), ["ts", "event_id"], "idx")
            edges = edges.join(values.select("idx", F.array(F.col("value").cast("float")).alias("features")), "idx")
        _GRAPHS[key] = TemporalGraph(spark, directed).add(edges)
    return _GRAPHS[key]


def bipartite(spark: SparkSession, sf: str) -> TemporalGraph:
    key = (spark.sparkContext.applicationId, sf, "orders")
    if key not in _GRAPHS:
        _GRAPHS[key] = TemporalGraph(spark, False).add(readers.from_orders(read(spark, sf, "orders"), read(spark, sf, "lineitem")))
    return _GRAPHS[key]


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(n).cast("long").alias(n) for n in names])


def one(spark: SparkSession, value: int, name: str) -> DataFrame:
    return spark.createDataFrame([(value,)], f"{name} long")


# Counts and nodes.

query("edge_count", f"WITH {O.EDGES} SELECT count(*) AS edges FROM e")(lambda s, d: one(s, chain(s, d).edge_count(), "edges"))
query("node_count", f"WITH {O.EDGES} SELECT count(*) AS nodes FROM (SELECT u FROM e UNION SELECT i FROM e)")(lambda s, d: one(s, chain(s, d).node_count(), "nodes"))
query("node_ids", f"WITH {O.EDGES} SELECT u AS node FROM e UNION SELECT i FROM e")(lambda s, d: chain(s, d).nodes())
query("latest_ts", f"WITH {O.EDGES} SELECT greatest(0, max(ts)) AS latest FROM e")(lambda s, d: one(s, chain(s, d).latest, "latest"))
query("positional_edge_id", f"WITH {O.EDGES} SELECT edge_id, u, i, ts FROM e")(lambda s, d: longs(chain(s, d).positioned(), "edge_id", "u", "i", "ts"))
for _name, _side, _directed in (("out", OUT, True), ("in", IN, True), ("undirected", OUT, False)):
    query(f"degrees_{_name}", f"WITH {O.ends(_side, _directed)} SELECT node, count(*) AS degree FROM ends GROUP BY node")(
        lambda s, d, side=_side, directed=_directed: chain(s, d, directed).degrees(side)
    )
    query(f"node_ts_groups_{_name}", f"""WITH {O.ends(_side, _directed)}
SELECT node, CAST(g AS BIGINT) AS g, ts, n AS n_edges, CAST(coalesce(sum(n) OVER (PARTITION BY node ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_pos FROM grp""")(
        lambda s, d, side=_side, directed=_directed: longs(chain(s, d, directed).groups(side), "node", "g", "ts", "n_edges", "first_pos")
    )
    query(f"group_count_{_name}", f"WITH {O.ends(_side, _directed)} SELECT node, count(DISTINCT ts) AS n_groups FROM ends GROUP BY node")(
        lambda s, d, side=_side, directed=_directed: chain(s, d, directed).group_count(side)
    )
query("orders_degrees", """SELECT node, count(*) AS degree FROM (
SELECT o_custkey AS node FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION ALL SELECT l_suppkey + 1000000 FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY node""")(
    lambda s, d: bipartite(s, d).degrees()
)

# Timestamp groups.

query("ts_groups_global", f"WITH {O.EDGES} SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS gg, count(*) AS n_edges, min(edge_id) AS first_edge_id FROM e GROUP BY ts")(
    lambda s, d: longs(chain(s, d).ts_groups(), "ts", "gg", "n_edges", "first_edge_id")
)
_ASKED = "SELECT lo + (hi - lo) * k // 20 AS t FROM (SELECT min(ts) - 10 AS lo, max(ts) + 10 AS hi FROM e), generate_series(0, 20) x(k)"


def asked(s: SparkSession, d: str) -> DataFrame:
    ends = chain(s, d)._edges().agg((F.min("ts") - 10).alias("lo"), (F.max("ts") + 10).alias("hi"))
    return ends.select(F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k"), "lo", "hi").select(F.expr("lo + (hi - lo) * k div 20").alias("t"))


query("count_ts_less", f"WITH {O.EDGES}, q AS ({_ASKED}) SELECT t, count(DISTINCT ts) AS n FROM q LEFT JOIN e ON ts < t GROUP BY t")(lambda s, d: chain(s, d).count_ts_less(asked(s, d)))
query("count_ts_greater", f"WITH {O.EDGES}, q AS ({_ASKED}) SELECT t, count(DISTINCT ts) AS n FROM q LEFT JOIN e ON ts > t GROUP BY t")(lambda s, d: chain(s, d).count_ts_greater(asked(s, d)))
query("asof_after", f"WITH {O.EDGES}, q AS ({_ASKED}) SELECT t, (SELECT count(DISTINCT ts) FROM e) - count(DISTINCT ts) AS gg FROM q LEFT JOIN e ON ts > t GROUP BY t")(lambda s, d: chain(s, d).asof(asked(s, d), True))
query("asof_before", f"WITH {O.EDGES}, q AS ({_ASKED}) SELECT t, count(DISTINCT ts) - 1 AS gg FROM q LEFT JOIN e ON ts < t GROUP BY t")(lambda s, d: chain(s, d).asof(asked(s, d), False))


# The window, late data, batches.


def _batched(s: SparkSession, d: str, capacity: int, directed: bool = True) -> TemporalGraph:
    """Three batches; the last holds late edges."""
    e = chain(s, d)._edges().select("u", "i", "ts", "idx")
    g = TemporalGraph(s, directed, capacity)
    for k in (0, 2, 1):
        g = g.add(e.where(F.pmod(F.col("idx"), F.lit(3)) == k) if k else e.where(F.pmod(F.col("idx"), F.lit(3)) == 0))
    return g


query("window_evict", f"WITH {O.EDGES} SELECT u, i, ts FROM e WHERE ts > (SELECT max(ts) FROM e) - 100")(lambda s, d: longs(_batched(s, d, 100).edges, "u", "i", "ts"))
query("late_data_merge", f"WITH {O.EDGES} SELECT row_number() OVER (ORDER BY ts, CASE idx % 3 WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END, idx) - 1 AS edge_id, u, i, ts FROM e")(
    lambda s, d: longs(_batched(s, d, -1).positioned(), "edge_id", "u", "i", "ts")
)
query("last_batch_sources", f"WITH {O.EDGES} SELECT DISTINCT u AS node FROM e WHERE idx % 3 = 1")(lambda s, d: _batched(s, d, 50).last_batch_nodes())
query("last_batch_union", f"WITH {O.EDGES} SELECT u AS node FROM e WHERE idx % 3 = 1 UNION SELECT i FROM e WHERE idx % 3 = 1")(lambda s, d: _batched(s, d, 50, False).last_batch_nodes())

# Weights.


def rounded(df: DataFrame, keys: tuple, names: tuple) -> DataFrame:
    return df.select(*[F.col(k).cast("long").alias(k) for k in keys], *[F.round(n, 6).alias(n) for n in names])


_W = ("w_fwd", "w_bwd", "cum_fwd", "cum_bwd")
_WSQL = ", ".join(f"round({x}, 6) AS {x}" for x in _W)
for _b in (-1, 0, 50):
    _tag = str(_b).replace("-", "raw")
    query(f"weights_global_{_tag}", f"WITH {O.EDGES}, tg AS (SELECT ts, count(*) AS n FROM e GROUP BY ts), {O.weights(_b, 'tg', '')} SELECT ts, {_WSQL} FROM wts")(
        lambda s, d, b=_b: rounded(global_weights(chain(s, d).ts_groups(), b), ("ts",), _W)
    )
    for _side, _directed in ((OUT, True), (IN, True), (OUT, False)):
        query(f"weights_node_{_side if _directed else 'undirected'}_{_tag}", f"WITH {O.ends(_side, _directed)}, {O.weights(_b)} SELECT node, ts, {_WSQL} FROM wts")(
            lambda s, d, b=_b, side=_side, directed=_directed: rounded(node_weights(chain(s, d, directed).groups(side), b), ("node", "ts"), _W)
        )

# Neighbours, node2vec's beta, successors.

query("adjacency_set", f"WITH {O.EDGES} SELECT u AS node, i AS nbr FROM e UNION SELECT i, u FROM e")(lambda s, d: chain(s, d).neighbours())
query("adjacency_lists", f"WITH {O.EDGES} SELECT node, count(*) AS n, min(nbr) AS first, max(nbr) AS last FROM (SELECT u AS node, i AS nbr FROM e UNION SELECT i, u FROM e) GROUP BY node")(
    lambda s, d: chain(s, d).neighbours().groupBy("node").agg(F.sort_array(F.collect_set("nbr")).alias("l")).select("node", F.size("l").cast("long").alias("n"), F.get("l", F.lit(0)).alias("first"), F.element_at("l", -1).alias("last"))
)


for _name, _directed, _forward in (("fwd", True, True), ("bwd", True, False), ("undirected_fwd", False, True), ("undirected_bwd", False, False)):
    _side = "out" if _forward or not _directed else "in"
    query(f"successor_rank_{_name}", f"""WITH {O.ends(_side, _directed)}
SELECT a.node, a.nbr, a.ts, a.edge_id, (SELECT count(*) FROM grp x WHERE x.node = a.nbr AND x.ts {'<=' if _forward else '<'} a.ts) AS succ FROM ends a""")(
        lambda s, d, directed=_directed, forward=_forward: longs(ix.build(chain(s, d, directed), forward).ends, "node", "nbr", "ts", "edge_id", "succ")
    )

# Pickers on a grid, random numbers, scalar functions.

for _p in (P.UNIFORM, P.LINEAR, P.EXPONENTIAL_INDEX):
    for _late in (True, False):
        query(f"picker_{_p}_{'late' if _late else 'early'}", f"SELECT n, j, {O.pick(_p, '0', 'n', '((j + 0.5) / 200.0)', _late)} AS k FROM generate_series(1, 60) a(n), generate_series(0, 199) b(j)")(
            lambda s, d, p=_p, late=_late: s.range(1, 61).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(199).cast("long"))).alias("j")).select(
                "n", "j", P.pick(p, F.lit(0), F.col("n"), (F.col("j") + 0.5) / 200.0, late).cast("long").alias("k")
            )
        )
query("portable_uniforms", "SELECT w, " + ", ".join(f"{O.uniform('w', a, b, 7)} AS u{a}{b}" for a in range(3) for b in range(3)) + " FROM generate_series(0, 4999) t(w)")(
    lambda s, d: s.range(5000).select(F.col("id").alias("w"), *[portable(F.col("id"), a, b, 7).alias(f"u{a}{b}") for a in range(3) for b in range(3)])
)
query("scalar_functions", "SELECT n, CAST(least(floor(0.37 * n), n - 1) AS BIGINT) AS bounded, n % 10 / 10.0 >= 0.5 AS bool, CASE WHEN n % 10 / 10.0 >= 0.5 THEN n ELSE -n END AS either, CASE WHEN n % 2 = 0 THEN n + 1 ELSE n END AS other, CASE WHEN n <= 1 THEN 1 ELSE CAST(pow(2, length(bin(n - 1))) AS BIGINT) END AS pow2 FROM generate_series(1, 300) t(n)")(
    lambda s, d: s.range(1, 301).select(
        F.col("id").alias("n"), scalars.bounded(F.col("id"), F.lit(0.37)).cast("long").alias("bounded"), scalars.boolean(F.col("id") % 10 / 10.0).alias("bool"),
        scalars.either(F.col("id"), -F.col("id"), F.col("id") % 10 / 10.0).alias("either"),
        scalars.other(F.col("id"), F.col("id") + 1, F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + 1)).alias("other"),
        scalars.next_power_of_two(F.col("id")).alias("pow2"),
    )
)

# Single picks of edges.

for _p in (P.FIRST, P.LAST):
    for _forward in (True, False):
        _lo, _hi = ("(SELECT count(*) FROM tg x WHERE x.ts <= t)", "(SELECT count(*) FROM tg)") if _forward else ("0", "(SELECT count(*) FROM tg x WHERE x.ts < t)")
        query(f"start_edge_{_p.lower()}_{'fwd' if _forward else 'bwd'}", f"""WITH {O.EDGES}, q AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS walk_id FROM ({_ASKED})),
tg AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS gg, min(edge_id) AS f FROM e GROUP BY ts), r AS (SELECT walk_id, t, {_lo} AS lo, {_hi} AS hi FROM q)
SELECT r.t, coalesce(e.edge_id, -1) AS edge_id, coalesce(e.u, -1) AS u, coalesce(e.i, -1) AS i, coalesce(e.ts, -1) AS ts FROM r LEFT JOIN tg ON hi > lo AND gg = {'lo' if _p == P.FIRST else 'hi - 1'} LEFT JOIN e ON e.edge_id = tg.f""")(
            lambda s, d, p=_p, forward=_forward: wx.start_edges(chain(s, d), asked(s, d).withColumn("walk_id", F.col("t")), p, forward, wx.WalkOptions(2, p)).select("t", *[F.coalesce(x, F.lit(-1)).cast("long").alias(x) for x in ("edge_id", "u", "i", "ts")])
        )

# Walks.

_ALL = "SELECT row_number() OVER (ORDER BY node) - 1 AS pos, node, CAST(NULL AS BIGINT) AS cutoff FROM (SELECT u AS node FROM e UNION SELECT i FROM e)"


def long_rows(packed: DataFrame) -> DataFrame:
    return longs(wx.long_form(packed), "walk_id", "step", "node", "ts")


def walk_query(name: str, bias: str, forward: bool = True, directed: bool = True, max_len: int = 6, per_node: int = 2, start: str | None = None, p: float = 1, q: float = 1) -> None:
    # Each twice, so that both ways of walking are held against the SQL: hops as joins, and over a small index as arrays.
    for tag, ends in ((name, 0), (f"{name}_arrays", 2_000_000)):
        o = wx.WalkOptions(max_len, bias, start, P.FORWARD if forward else P.BACKWARD, 11, "portable", 50, p, q, broadcast_ends=ends)
        if ends and bias == P.NODE2VEC:
            continue  # always joins
        query(tag, O.walks(_ALL, max_len, bias, start, forward, directed, per_node, 11, 50, p, q))(
            lambda s, d, o=o: long_rows(wx.walks(chain(s, d, directed), wx.node_seeds(chain(s, d, directed)), o, per_node))
        )


walk_query("walk_first_fwd", P.FIRST)
walk_query("walk_last_bwd", P.LAST, forward=False)
walk_query("walk_first_undirected", P.FIRST, directed=False)
walk_query("walk_last_bwd_undirected", P.LAST, forward=False, directed=False)
for _p in (P.UNIFORM, P.LINEAR, P.EXPONENTIAL_INDEX, P.EXPONENTIAL_WEIGHT):
    walk_query(f"walk_{_p}_fwd", _p)
    walk_query(f"walk_{_p}_bwd", _p, forward=False)
walk_query("walk_weight_undirected", P.EXPONENTIAL_WEIGHT, directed=False)
walk_query("walk_node2vec_fwd", P.NODE2VEC, max_len=4, per_node=1, p=2, q=0.5)
walk_query("walk_node2vec_bwd", P.NODE2VEC, forward=False, max_len=4, per_node=1, p=0.5, q=2)
walk_query("walk_start_bias", P.UNIFORM, start=P.EXPONENTIAL_INDEX)

@query("walk_free", f"""WITH {O.EDGES}, tg AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS g, count(*) AS n, min(edge_id) AS f FROM e GROUP BY ts),
w AS (SELECT walk_id, {O.uniform('walk_id', 0, 0, 9)} AS r1, {O.uniform('walk_id', 0, 1, 9)} AS r2, (SELECT count(*) FROM tg) AS hi FROM generate_series(0, 499) t(walk_id)),
p AS (SELECT *, {O.pick(P.LINEAR, '0', 'hi', 'r1', False)} AS gg FROM w)
SELECT walk_id, e.u AS first, e.i AS second, e.ts FROM p JOIN tg ON tg.g = p.gg JOIN e ON e.edge_id = tg.f + CAST(least(floor(r2 * tg.n), tg.n - 1) AS BIGINT)""")
def walk_free(s, d):
    rows = wx.free_walks(chain(s, d), 500, wx.WalkOptions(2, P.LINEAR, seed=9, rng="portable"))
    return rows.select("walk_id", F.get("nodes", F.lit(0)).alias("first"), F.get("nodes", F.lit(1)).alias("second"), F.get("timestamps", F.lit(1)).alias("ts"))


@query("walk_free_backward")
def walk_free_backward(s, d):
    return long_rows(wx.free_walks(chain(s, d, False), 500, wx.WalkOptions(6, P.EXPONENTIAL_WEIGHT, None, P.BACKWARD, 9, "portable", 50)))


@query("walk_statistics", f"SELECT count(*) AS non_empty, CAST(sum(n) AS BIGINT) AS steps, round(avg(n), 6) AS avg_len FROM (SELECT walk_id, count(*) AS n FROM ({O.walks(_ALL, 6, P.FIRST, None, True, True, 2, 11, 50)}) GROUP BY walk_id)")
def walk_statistics(s, d):
    rows = wx.walks(chain(s, d), wx.node_seeds(chain(s, d)), wx.WalkOptions(6, P.FIRST, seed=11, rng="portable", bound=50), 2)
    return wx.statistics(rows).select("non_empty", F.col("steps").cast("long").alias("steps"), F.round("avg_len", 6).alias("avg_len"))


# Features, sinks.


@query("walk_edge_features", f"""WITH w AS ({O.walks(_ALL, 4, P.FIRST, None, True, True, 1, 11, 50)}), {O.EDGES},
f AS (SELECT u, i, ts, value, row_number() OVER (PARTITION BY u, ts ORDER BY edge_id) AS nth FROM e)
SELECT a.walk_id, a.step, round(CAST(CAST(f.value AS FLOAT) AS DOUBLE), 3) AS feature FROM w a JOIN w b ON a.walk_id = b.walk_id AND b.step = a.step + 1 JOIN f ON f.u = a.node AND f.ts = b.ts AND f.nth = 1""")
def walk_edge_features(s, d):
    g = chain(s, d, True, True)
    rows = fx.with_edge_features(g, wx.walks(g, wx.node_seeds(g), wx.WalkOptions(4, P.FIRST, seed=11, rng="portable", bound=50)))
    long = rows.select("walk_id", F.posexplode("edge_features").alias("step", "x"))
    return long.select("walk_id", F.col("step").cast("long").alias("step"), F.round(F.get("x", F.lit(0)).cast("double"), 3).alias("feature"))


@query("node_features_dense", f"""WITH {O.EDGES} SELECT node, round(CAST(coalesce(m.embedding[1], 0) AS DOUBLE), 4) AS first, coalesce(len(m.embedding), 64) AS dim
FROM generate_series(0, (SELECT max(greatest(u, i)) FROM e)) t(node) LEFT JOIN embeddings m ON m.vec_id = node""")
def node_features_dense(s, d):
    rows = read(s, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("features"))
    out = fx.dense(chain(s, d), fx.upsert(None, rows))
    return out.select("node", F.round(F.get("features", F.lit(0)).cast("double"), 4).alias("first"), F.size("features").cast("long").alias("dim"))


query("collapsed_directed", f"WITH {O.EDGES} SELECT u, i, max(ts) AS ts FROM e GROUP BY u, i")(lambda s, d: sinks.collapsed(chain(s, d)))
query("collapsed_undirected", f"WITH {O.EDGES} SELECT least(u, i) AS u, greatest(u, i) AS i, max(ts) AS ts FROM e GROUP BY 1, 2")(lambda s, d: sinks.collapsed(chain(s, d, False)))
query("walk_lines", f"SELECT string_agg(node, ' ' ORDER BY step) AS value FROM ({O.walks(_ALL, 6, P.FIRST, None, True, True, 2, 11, 50)}) GROUP BY walk_id")(
    lambda s, d: sinks.walk_lines(wx.walks(chain(s, d), wx.node_seeds(chain(s, d)), wx.WalkOptions(6, P.FIRST, seed=11, rng="portable", bound=50), 2)).where("value <> ''")
)
query("group_weight_from_cumulative", f"WITH {O.ends('out')}, {O.weights(50)} SELECT node, ts, round(w_fwd, 6) AS w FROM wts")(
    lambda s, d: node_weights(chain(s, d).groups(OUT), 50).select("node", "ts", F.round(F.col("cum_fwd") - F.coalesce(F.lag("cum_fwd").over(Window.partitionBy("node").orderBy("ts")), F.lit(0.0)), 6).alias("w"))
)


# All nodes, groups and adjacent pairs asked, and a few that are absent.

_NODES = "n AS (SELECT u AS node FROM e UNION SELECT i FROM e), q AS (SELECT node FROM n UNION SELECT -k FROM generate_series(1, 3) x(k) UNION SELECT (SELECT max(node) FROM n) + k FROM generate_series(1, 3) x(k))"


def all_asked(s: SparkSession, d: str) -> DataFrame:
    """Each node of the graph and three ids below zero and above the greatest."""
    own = chain(s, d).nodes().select("node")
    k = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long")))
    above = own.agg(F.max("node").alias("m")).select(k.alias("k"), "m").select((F.col("m") + F.col("k")).alias("node"))
    return own.union(s.range(-3, 0).select(F.col("id").alias("node"))).union(above).distinct()


query("active_nodes", f"WITH {O.EDGES}, {_NODES} SELECT q.node, n.node IS NOT NULL AS active FROM q LEFT JOIN n ON q.node = n.node")(lambda s, d: chain(s, d).is_active(all_asked(s, d)))
query("degrees_for_list", f"WITH {O.ends('out')}, {_NODES} SELECT q.node AS pos, q.node, count(ends.node) AS degree FROM q LEFT JOIN ends ON q.node = ends.node GROUP BY q.node")(
    lambda s, d: chain(s, d).degrees_of(all_asked(s, d).select(F.col("node").alias("pos"), "node"))
)
query("group_ranges", f"""WITH {O.EDGES}, t AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS gg, min(edge_id) AS a, max(edge_id) + 1 AS b FROM e GROUP BY ts)
SELECT q.gg, coalesce(a, 0) AS start, coalesce(b, 0) AS stop FROM generate_series(-2, (SELECT count(*) FROM t) + 2) q(gg) LEFT JOIN t ON q.gg = t.gg""")(
    lambda s, d: chain(s, d).group_range(s.range(-2, chain(s, d).ts_groups().count() + 3).select(F.col("id").alias("gg")))
)
for _name, _directed, _less in (("node_ts_less", True, True), ("node_ts_greater", True, False), ("node_ts_less_undirected", False, True), ("node_ts_greater_undirected", False, False)):
    query(f"count_{_name}", f"WITH {O.ends('in' if _less else 'out', _directed)}, {_NODES}, a AS ({_ASKED}) SELECT q.node, t, count(DISTINCT ts) AS n FROM q CROSS JOIN a LEFT JOIN ends ON ends.node = q.node AND ts {'<' if _less else '>'} t GROUP BY q.node, t")(
        lambda s, d, directed=_directed, less=_less: (chain(s, d, directed).count_node_ts_less if less else chain(s, d, directed).count_node_ts_greater)(all_asked(s, d).crossJoin(asked(s, d)))
    )


@query("n2v_beta", f"""WITH {O.EDGES}, n AS (SELECT u AS a, i AS b FROM e UNION SELECT i, u FROM e), q AS (SELECT a AS prev, b AS w FROM n UNION SELECT a, a FROM n UNION SELECT a, -1 FROM n)
SELECT prev, w, CASE WHEN w = prev THEN 0.5 WHEN n.a IS NOT NULL THEN 1.0 ELSE 2.0 END AS beta FROM q LEFT JOIN n ON n.a = prev AND n.b = w""")
def n2v_beta(s, d):
    own = chain(s, d).neighbours().select(F.col("node").alias("prev"), F.col("nbr").alias("w"))
    near = own.withColumn("near", F.lit(True))
    pairs = own.union(own.select("prev", "prev")).union(own.select("prev", F.lit(-1).cast("long"))).distinct()
    return pairs.join(near, ["prev", "w"], "left").select("prev", "w", scalars.beta(F.col("prev"), F.col("w"), F.coalesce("near", F.lit(False)), 2.0, 0.5).alias("beta"))


_CUT_ALL = "SELECT pos, node, CASE WHEN pos % 5 = 0 THEN NULL ELSE (SELECT min(ts) FROM e) + pos * 3 END AS cutoff FROM (SELECT row_number() OVER (ORDER BY node) - 1 AS pos, node FROM (SELECT u AS node FROM e UNION SELECT i FROM e))"
for _forward in (True, False):
    query(f"walk_cutoffs_{'fwd' if _forward else 'bwd'}", O.walks(_CUT_ALL, 5, P.LINEAR, None, _forward, True, 2, 3, 50))(
        lambda s, d, forward=_forward: long_rows(wx.walks(
            chain(s, d), global_rank(chain(s, d).nodes().select("node"), ["node"], "pos").crossJoin(chain(s, d)._edges().agg(F.min("ts").alias("m"))).select(
                "pos", "node", F.when(F.col("pos") % 5 != 0, F.col("m") + F.col("pos") * 3).alias("cutoff")
            ), wx.WalkOptions(5, P.LINEAR, None, P.FORWARD if forward else P.BACKWARD, 3, "portable", 50), 2,
        ))
    )
_LAST_ALL = "SELECT row_number() OVER (ORDER BY node) - 1 AS pos, node, CAST(NULL AS BIGINT) AS cutoff FROM (SELECT DISTINCT u AS node FROM e WHERE ts >= (SELECT min(ts) + (max(ts) - min(ts)) * 2 // 3 FROM e))"


@query("walk_last_batch", O.walks(_LAST_ALL, 5, P.UNIFORM, None, False, True, 3, 5, 50))
def walk_last_batch(s, d):
    """Two batches by time; walks from the sources of the second, the last third of the span."""
    e = chain(s, d)._edges().select("u", "i", "ts", "idx")
    cut = e.agg(F.expr("min(ts) + (max(ts) - min(ts)) * 2 div 3")).first()[0]
    g = TemporalGraph(s, True).add(e.where(F.col("ts") < cut)).add(e.where(F.col("ts") >= cut))
    return long_rows(wx.walks(g, wx.last_batch_seeds(g), wx.WalkOptions(5, P.UNIFORM, None, P.BACKWARD, 5, "portable", 50), 3))


# The surface: ways in and out, the engine, streaming. In-memory arrays and tuples are on the driver by their nature.

_UIT = f"WITH {O.EDGES} SELECT u, i, ts FROM e"


def _uit(s: SparkSession, d: str) -> DataFrame:
    return chain(s, d)._edges().select("u", "i", "ts", "idx")


@query("source_arrays", f"WITH {O.EDGES} SELECT edge_id, u, i, ts FROM e")
def source_arrays(s, d):
    """The driver has three arrays, filled row by row."""
    import numpy as np

    n = chain(s, d).edge_count()
    u, i, ts = (np.empty(n, np.int64) for _ in range(3))
    for k, r in enumerate(_uit(s, d).orderBy("idx").toLocalIterator()):
        u[k], i[k], ts[k] = r.u, r.i, r.ts
    return longs(TemporalGraph(s, True).add(readers.from_arrays(s, u, i, ts)).positioned(), "edge_id", "u", "i", "ts")


@query("source_tuples", f"WITH {O.EDGES} SELECT edge_id, u, i, ts FROM e")
def source_tuples(s, d):
    rows = ((r.u, r.i, r.ts) for r in _uit(s, d).orderBy("idx").toLocalIterator())
    return longs(TemporalGraph(s, True).add(readers.from_tuples(s, rows)).positioned(), "edge_id", "u", "i", "ts")


@query("source_csv", _UIT)
def source_csv(s, d):
    path = staged_path(s)
    sinks.write_csv(_uit(s, d).select("u", "i", "ts"), path)
    return readers.read_csv(s, path)


@query("source_csv_row_count", f"WITH {O.EDGES} SELECT least(100, count(*)) AS rows FROM e")
def source_csv_row_count(s, d):
    path = staged_path(s)
    sinks.write_csv(_uit(s, d).select("u", "i", "ts"), path)
    return readers.read_csv(s, path, row_count=100).agg(F.count(F.lit(1)).alias("rows"))


@query("source_parquet", _UIT)
def source_parquet(s, d):
    path = staged_path(s)
    _uit(s, d).write.parquet(path)
    return readers.read_parquet(s, path)


@query("source_shards", _UIT)
def source_shards(s, d):
    """Three shards by arrival: two of Parquet, one of CSV."""
    path, e = staged_path(s), _uit(s, d)
    for k in range(3):
        own = e.where(F.pmod("idx", F.lit(3)) == k)
        if k == 1:
            sinks.write_csv(own.select("u", "i", "ts"), f"{path}/data_{k}.csv")
        else:
            own.write.parquet(f"{path}/data_{k}.parquet")
    return readers.read_shards(s, path, 0, 3)


query("edge_features_stored", f"WITH {O.EDGES} SELECT edge_id, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 3) AS feature FROM e")(
    lambda s, d: chain(s, d, True, True).positioned().select(F.col("edge_id").cast("long").alias("edge_id"), F.round(F.get("features", F.lit(0)).cast("double"), 3).alias("feature"))
)
query("cleared", "SELECT 0 AS edges, 0 AS latest")(lambda s, d: s.createDataFrame([(g.edge_count(), g.latest) for g in [chain(s, d).clear()]], "edges long, latest long"))
query("memory_used", f"""WITH {O.EDGES}, c AS (SELECT (SELECT count(*) FROM e) AS m, (SELECT count(*) FROM (SELECT u FROM e UNION SELECT i FROM e)) AS n, (SELECT count(DISTINCT ts) FROM e) AS tg,
(SELECT count(*) FROM (SELECT DISTINCT u, ts FROM e)) + (SELECT count(*) FROM (SELECT DISTINCT i, ts FROM e)) AS g) SELECT m * 16 + tg * 16 + n * 4 + 2 * (m * 8 + 2 * n * 8) + g * 8 AS bytes FROM c""")(
    lambda s, d: one(s, chain(s, d).memory_used(), "bytes")
)


@query("padded_arrays", f"SELECT walk_id, step, node, ts FROM ({O.walks(_ALL, 6, P.LINEAR, None, True, True, 2, 11, 50)})")
def padded_arrays(s, d):
    """NumPy arrays as the driver gets them, as rows."""
    packed = wx.walks(chain(s, d), wx.node_seeds(chain(s, d)), wx.WalkOptions(6, P.LINEAR, seed=11, rng="portable", bound=50), 2)
    nodes, stamps, lengths, _ = sinks.padded(packed, 6, padding=-7)
    rows = [(w, k, int(nodes[w, k]), int(stamps[w, k])) for w in range(len(lengths)) for k in range(int(lengths[w]))]
    return s.createDataFrame(rows, "walk_id long, step long, node long, ts long")


def _engine(s: SparkSession, **kw) -> WalkEngine:
    return WalkEngine(True, enable_weight_computation=True, timescale_bound=50, global_seed=11, rng="portable", spark=s, **kw)


for _p, _forward in ((P.LINEAR, True), (P.EXPONENTIAL_INDEX, False)):
    query(f"engine_walks_{'fwd' if _forward else 'bwd'}", O.walks(_ALL, 6, _p, P.UNIFORM, _forward, True, 2, 11, 50))(
        lambda s, d, p=_p, forward=_forward: long_rows(_engine(s).add_edges(_uit(s, d)).get_random_walks_and_times_for_all_nodes(6, p, 2, P.UNIFORM, P.FORWARD if forward else P.BACKWARD))
    )


@query("stream_ingest", f"WITH {O.EDGES} SELECT u, i, ts FROM e WHERE ts > (SELECT max(ts) FROM e) - 200")
def stream_ingest(s, d):
    """Three micro-batches, with state beside the checkpoint; late edges inside the window stay."""
    path = staged_path(s)
    for k in range(3):
        _uit(s, d).where(F.pmod("idx", F.lit(3)) == k).coalesce(1).write.mode("append").parquet(f"{path}/in")
    e = _engine(s, max_time_capacity=200)
    stream = s.readStream.schema("u long, i long, ts long, idx long").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    ingest(stream, e, checkpoint=f"{path}/checkpoint").awaitTermination()
    return longs(e.graph.edges, "u", "i", "ts")


@query("replay_counts", f"""WITH {O.EDGES}, w AS (SELECT min(ts) AS low, (max(ts) - min(ts)) // 4 + 1 AS width FROM e)
SELECT k AS step, (SELECT count(*) FROM e WHERE ts < low + (k + 1) * width) AS edges FROM generate_series(0, 3) t(k), w""")
def replay_counts(s, d):
    e = _engine(s)
    return s.createDataFrame([(k, e.get_edge_count()) for k in replay(_uit(s, d), e, 4)], "step long, edges long")


for _p, _class in ((P.UNIFORM, P.UniformRandomPicker), (P.LINEAR, P.LinearRandomPicker), (P.EXPONENTIAL_INDEX, P.ExponentialIndexRandomPicker)):
    query(f"picker_class_{_p}", f"SELECT n, j, {O.pick(_p, '0', 'n', '((j + 0.5) / 50.0)', True)} AS k FROM generate_series(1, 40) a(n), generate_series(0, 49) b(j)")(
        lambda s, d, c=_class: s.createDataFrame([(n, j, c().pick_with(0, n, True, (j + 0.5) / 50)) for n in range(1, 41) for j in range(50)], "n long, j long, k long")
    )
query("picker_class_weighted", "SELECT n, j, least(CAST(ceil((j + 0.5) / 64.0 * n) AS BIGINT), n) - 1 AS k FROM generate_series(1, 32) a(n), generate_series(0, 63) b(j)")(
    lambda s, d: s.createDataFrame([(n, j, P.WeightBasedRandomPicker().pick_with([float(x + 1) for x in range(n)], 0, n, (j + 0.5) / 64)) for n in range(1, 33) for j in range(64)], "n long, j long, k long")
)
query("beta_max", "SELECT p / 4.0 AS p, q / 4.0 AS q, greatest(1.0, 4.0 / p, 4.0 / q) AS m FROM generate_series(1, 16) a(p), generate_series(1, 16) b(q)")(
    lambda s, d: s.createDataFrame([(p / 4, q / 4, scalars.beta_max(p / 4, q / 4)) for p in range(1, 17) for q in range(1, 17)], "p double, q double, m double")
)


@query("parsed_names", "SELECT name, known FROM (VALUES " + ", ".join(f"('{x}', true)" for x in P.ALL) + ", ('uniform', false), ('', false)) t(name, known)")
def parsed_names(s, d):
    def known(name):
        try:
            return P.parse_picker(name) == name
        except ValueError:
            return False

    return s.createDataFrame([(x, known(x)) for x in (*P.ALL, "uniform", "")], "name string, known boolean")


@query("synthetic_strata", "SELECT u_stratum, count(*) AS edges, CAST(0 AS BIGINT) AS to_tail FROM (SELECT 0 AS u_stratum FROM generate_series(1, 600) UNION ALL SELECT 1 FROM generate_series(1, 300) UNION ALL SELECT 2 FROM generate_series(1, 200)) GROUP BY u_stratum")
def synthetic_strata(s, d):
    strata = (synthetic.Stratum(3, 200, 20), synthetic.Stratum(10, 30, 5), synthetic.Stratum(50, 4, 2))
    at = F.when(F.col("u") < 3, 0).when(F.col("u") < 13, 1).otherwise(2).cast("int")
    return synthetic.edges(s, strata).groupBy(at.alias("u_stratum")).agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("i") >= 13).alias("to_tail"))


@query("walk_hashed")
def walk_hashed(s, d):
    """The default random numbers; they have no SQL. Every step is an edge, in order of time."""
    return long_rows(wx.walks(chain(s, d), wx.node_seeds(chain(s, d)), wx.WalkOptions(6, P.EXPONENTIAL_WEIGHT, seed=11, bound=50, broadcast_ends=0), 2))
