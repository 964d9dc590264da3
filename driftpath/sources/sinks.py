"""Where results go: text, CSV, padded arrays, collapsed graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import TemporalGraph


def edge_tuples(graph: TemporalGraph) -> DataFrame:
    """u, i, ts in order of time."""
    return graph.positioned().orderBy("edge_id").select("u", "i", "ts")


def collapsed(graph: TemporalGraph) -> DataFrame:
    """u, i, ts: one row for each pair, with its latest time; undirected pairs with the lesser node first."""
    e = graph.positioned()
    u, i = (F.col("u"), F.col("i")) if graph.directed else (F.least("u", "i"), F.greatest("u", "i"))
    return e.groupBy(u.alias("u"), i.alias("i")).agg(F.max("ts").alias("ts"))


def to_networkx(graph: TemporalGraph):
    """A DiGraph or Graph on the driver, of one edge for each pair (the latest)."""
    import networkx as nx

    out = nx.DiGraph() if graph.directed else nx.Graph()
    for r in collapsed(graph).toLocalIterator():
        out.add_edge(r.u, r.i, timestamp=r.ts)
    return out


def walk_lines(walks: DataFrame) -> DataFrame:
    """One line a walk, its nodes set off by blanks; an empty walk is an empty line."""
    return walks.select(F.array_join(F.transform("nodes", lambda x: x.cast("string")), " ").alias("value"))


def write_walks(walks: DataFrame, path: str) -> None:
    walk_lines(walks).write.text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header, quotes doubled where needed; an empty path writes nothing."""
    if path:
        df.write.option("header", True).option("escape", '"').csv(path)


def show_walks(walks: DataFrame, n: int = 20) -> None:
    walks.show(n, truncate=False)


def padded(walks: DataFrame, max_len: int, padding: int = -1, feature_dim: int | None = None):
    """NumPy arrays on the driver, in the order of walk_id: nodes, timestamps, lengths, features (None without)."""
    import numpy as np

    rows = walks.orderBy("walk_id").collect()
    nodes = np.full((len(rows), max_len), padding, np.int64)
    stamps = np.full((len(rows), max_len), -1, np.int64)
    lengths = np.array([r.walk_len for r in rows], np.int64)
    feats = np.zeros((len(rows), max(max_len - 1, 0), feature_dim), np.float32) if feature_dim else None
    for k, r in enumerate(rows):
        nodes[k, : len(r.nodes)] = r.nodes
        stamps[k, : len(r.timestamps)] = r.timestamps
        if feats is not None:
            for j, x in enumerate(r.edge_features or []):
                feats[k, j] = x
    return nodes, stamps, lengths, feats
