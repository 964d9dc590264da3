"""The engine's face: a graph that takes batches of edges and gives walks. Results are DataFrames or, on request, arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import pickers as P
from .operators import features as fx
from .operators import walks as wx
from .operators.graph import IN, OUT, TemporalGraph
from .sources import readers, sinks

_DEFAULT_SEED = 0


class WalkEngine:
    """use_gpu, cuda_device_id and kernel_launch_type are accepted and have no effect: Spark deals out the work."""

    def __init__(
        self, is_directed: bool, use_gpu: bool = False, max_time_capacity: int | None = None, enable_weight_computation: bool | None = None,
        enable_temporal_node2vec: bool | None = None, timescale_bound: float | None = None, temporal_node2vec_p: float | None = None,
        temporal_node2vec_q: float | None = None, walk_padding_value: int | None = None, global_seed: int | None = None,
        shuffle_walk_order: bool | None = None, cuda_device_id: int | None = None, spark: SparkSession | None = None, rng: str = "hashed",
    ) -> None:
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.graph = TemporalGraph(self.spark, is_directed, -1 if max_time_capacity is None else max_time_capacity)
        self.node2vec = bool(enable_temporal_node2vec)
        self.weights = bool(enable_weight_computation) or self.node2vec
        self.bound = -1 if timescale_bound is None else timescale_bound
        self.p, self.q = (1.0 if x is None else float(x) for x in (temporal_node2vec_p, temporal_node2vec_q))
        if self.p <= 0 or self.q <= 0:
            raise ValueError("p and q must be above 0")
        self.padding = -1 if walk_padding_value is None else walk_padding_value
        self.seed = _DEFAULT_SEED if global_seed is None else global_seed
        self.shuffle = True if shuffle_walk_order is None else shuffle_walk_order
        self.rng = rng
        self.node_features: DataFrame | None = None

    # Edges in.

    def add_edges(self, edges: DataFrame) -> WalkEngine:
        self.graph = self.graph.add(edges)
        return self

    def add_multiple_edges(self, sources, targets=None, timestamps=None, edge_features=None) -> WalkEngine:
        """Arrays, or a list of (u, i, ts)."""
        if targets is None:
            return self.add_edges(readers.from_tuples(self.spark, sources))
        return self.add_edges(readers.from_arrays(self.spark, sources, targets, timestamps, edge_features))

    def add_edges_from_networkx(self, graph) -> WalkEngine:
        return self.add_edges(readers.from_networkx(self.spark, graph))

    def clear(self) -> WalkEngine:
        self.graph, self.node_features = self.graph.clear(), None
        return self

    # Node features.

    def set_node_features(self, node_ids, node_features=None) -> WalkEngine:
        """Ids and rows, or a DataFrame (node, features)."""
        if node_features is not None:
            if len(node_ids) != len(node_features):
                raise ValueError("as many rows of features as node ids")
            node_ids = self.spark.createDataFrame([(int(n), [float(v) for v in x]) for n, x in zip(node_ids, node_features, strict=True)], "node long, features array<float>")
        self.node_features = fx.upsert(self.node_features, node_ids)
        return self

    def get_node_features(self) -> DataFrame:
        return fx.dense(self.graph, self.node_features)

    # What the graph holds.

    def get_node_count(self) -> int:
        return self.graph.node_count()

    def get_edge_count(self) -> int:
        return self.graph.edge_count()

    def get_node_ids(self) -> DataFrame:
        return self.graph.nodes().orderBy("node")

    def get_edges(self) -> DataFrame:
        return sinks.edge_tuples(self.graph)

    def get_node_degrees(self, nodes: Sequence[int], direction: str = P.FORWARD) -> list[int]:
        asked = self.spark.createDataFrame([(k, int(n)) for k, n in enumerate(nodes)], "pos long, node long")
        side = OUT if P.parse_direction(direction) == P.FORWARD else IN
        return [r.degree for r in self.graph.degrees_of(asked, side).orderBy("pos").collect()]

    def get_is_directed(self) -> bool:
        return self.graph.directed

    def get_latest_timestamp(self) -> int:
        return self.graph.latest

    def get_memory_used(self) -> int:
        return self.graph.memory_used(self.weights)

    def to_networkx(self):
        return sinks.to_networkx(self.graph)

    # Walks.

    def _options(self, max_walk_len, walk_bias, initial_edge_bias, walk_direction) -> wx.WalkOptions:
        for bias in (walk_bias, initial_edge_bias or walk_bias):
            if bias == P.NODE2VEC and not self.node2vec:
                raise ValueError("node2vec walks need enable_temporal_node2vec")
            if bias in P.WEIGHTED and not self.weights:
                raise ValueError("weighted walks need enable_weight_computation")
        return wx.WalkOptions(max_walk_len, walk_bias, initial_edge_bias, walk_direction, self.seed, self.rng, self.bound, self.p, self.q)

    def _out(self, walks: DataFrame) -> DataFrame:
        if self.graph.feature_dim:
            walks = fx.with_edge_features(self.graph, walks)
        return walks.orderBy(F.xxhash64("walk_id", F.lit(self.seed))) if self.shuffle else walks.orderBy("walk_id")

    def get_random_walks_and_times_for_all_nodes(self, max_walk_len, walk_bias, num_walks_per_node, initial_edge_bias=None, walk_direction=P.FORWARD, kernel_launch_type="NODE_GROUPED") -> DataFrame:
        o = self._options(max_walk_len, walk_bias, initial_edge_bias, walk_direction)
        return self._out(wx.walks(self.graph, wx.node_seeds(self.graph), o, num_walks_per_node))

    def get_random_walks_and_times_for_last_batch(self, max_walk_len, walk_bias, num_walks_per_node, initial_edge_bias=None, walk_direction=P.FORWARD, kernel_launch_type="NODE_GROUPED") -> DataFrame:
        o = self._options(max_walk_len, walk_bias, initial_edge_bias, walk_direction)
        return self._out(wx.walks(self.graph, wx.last_batch_seeds(self.graph), o, num_walks_per_node))

    def get_random_walks_and_times_for_nodes(self, seed_nodes, max_walk_len, walk_bias, num_walks_per_node, initial_edge_bias=None, walk_direction=P.FORWARD, kernel_launch_type="NODE_GROUPED", cutoff_times=None) -> DataFrame:
        """seed_nodes: a list, or a DataFrame (pos, node[, cutoff]). A cutoff of -1 or None is none."""
        o = self._options(max_walk_len, walk_bias, initial_edge_bias, walk_direction)
        if not isinstance(seed_nodes, DataFrame):
            if cutoff_times is not None and len(cutoff_times) != len(seed_nodes):
                raise ValueError("as many cutoff times as seed nodes")
            cut = [None if c is None or c == -1 else int(c) for c in cutoff_times] if cutoff_times is not None else [None] * len(seed_nodes)
            rows = [(k, int(n), c) for k, (n, c) in enumerate(zip(seed_nodes, cut, strict=True))]
            seed_nodes = self.spark.createDataFrame(rows, "pos long, node long, cutoff long")
            seed_nodes = seed_nodes.drop("cutoff") if cutoff_times is None else seed_nodes
        return self._out(wx.walks(self.graph, seed_nodes, o, num_walks_per_node))

    def get_random_walks_and_times(self, max_walk_len, walk_bias, num_walks_total, initial_edge_bias=None, walk_direction=P.FORWARD, kernel_launch_type="NODE_GROUPED") -> DataFrame:
        o = self._options(max_walk_len, walk_bias, initial_edge_bias, walk_direction)
        return self._out(wx.free_walks(self.graph, num_walks_total, o))

    def to_arrays(self, walks: DataFrame, max_walk_len: int):
        """NumPy: nodes, timestamps, lengths, edge features (None without), padded, by walk_id."""
        return sinks.padded(walks, max_walk_len, self.padding, self.graph.feature_dim or None)
