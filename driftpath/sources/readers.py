"""Where edges come from: tuples, arrays, files, shards, graphs of other libraries."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import staged_path


#: Edges that the driver turns into a table at once.
BLOCK = 1 << 18


def _written(spark: SparkSession, blocks: Iterable[pa.Table], schema: str) -> DataFrame:
    """Arrow tables as one table in the shared folder, added one by one: the driver holds no more than a block beside its input."""
    path = None
    for block in blocks:
        if path is None:
            path = staged_path(spark)
        spark.createDataFrame(block, schema).coalesce(1).write.mode("append").parquet(path)  # one file, in the order given
    return spark.createDataFrame([], schema) if path is None else spark.read.schema(schema).parquet(path)


def from_tuples(spark: SparkSession, edges: Iterable[Sequence]) -> DataFrame:
    """(u, i, ts) triples in order of arrival; of any iterable, read once and never held as a whole."""
    def blocks() -> Iterator[pa.Table]:
        rest, at = iter(edges), 0
        while own := [(int(u), int(i), int(ts)) for u, i, ts in islice(rest, BLOCK)]:
            yield pa.table([pa.array(range(at, at + len(own)), pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*own, strict=True))], ["idx", "u", "i", "ts"])
            at += len(own)

    return _written(spark, blocks(), "idx long, u long, i long, ts long")


def from_arrays(spark: SparkSession, sources, targets, timestamps, edge_features=None) -> DataFrame:
    """One-dimensional arrays of one length; features one- or two-dimensional, a multiple of it."""
    import numpy as np

    u, i, ts = (np.asarray(x) for x in (sources, targets, timestamps))
    if u.ndim != 1 or i.ndim != 1 or ts.ndim != 1:
        raise ValueError("sources, targets and timestamps must be one-dimensional")
    if not len(u) == len(i) == len(ts):
        raise ValueError("sources, targets and timestamps must have one length")
    schema, x = "idx long, u long, i long, ts long", None
    if edge_features is not None:
        x = np.asarray(edge_features, "f4")
        if x.ndim not in (1, 2) or (x.ndim == 2 and len(x) != len(u)) or (len(u) and x.size % len(u)):
            raise ValueError("edge features must be one- or two-dimensional, with as many rows as edges")
        x = x.reshape(len(u), -1) if len(u) else x
        schema += ", features array<float>"

    def blocks() -> Iterator[pa.Table]:
        for at in range(0, len(u), BLOCK):
            own = slice(at, at + BLOCK)
            cols = {"idx": np.arange(at, min(at + BLOCK, len(u)))} | {n: c[own].astype("i8") for n, c in (("u", u), ("i", i), ("ts", ts))}
            if x is not None:
                cols["features"] = pa.array(list(x[own]), pa.list_(pa.float32()))
            yield pa.table(cols)

    return _written(spark, blocks(), schema)


def read_csv(spark: SparkSession, path: str | list[str], delimiter: str = ",", row_count: int | None = None) -> DataFrame:
    """The first three columns u, i, ts of files with a header; row_count rows of them if given."""
    out = spark.read.schema("u long, i long, ts long").csv(path, header=True, sep=delimiter, enforceSchema=True)
    return out.limit(row_count) if row_count is not None else out


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Columns u, i, ts by name, and no others."""
    out = spark.read.parquet(*([path] if isinstance(path, str) else path))
    lacking = {"u", "i", "ts"} - set(out.columns)
    if lacking:
        raise ValueError(f"no column {', '.join(sorted(lacking))}")
    return out.select("u", "i", "ts")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def shard_path(spark: SparkSession, folder: str, minute: int) -> str:
    """data_<minute>.parquet, else .csv."""
    for kind in ("parquet", "csv"):
        path = f"{folder}/data_{minute}.{kind}"
        if _exists(spark, path):
            return path
    raise FileNotFoundError(f"{folder}/data_{minute}.parquet or .csv")


def read_shards(spark: SparkSession, folder: str, first: int, count: int) -> DataFrame:
    """One step of a replay: `count` shards from minute `first` on."""
    paths = [shard_path(spark, folder, m) for m in range(first, first + count)]
    out = None
    for read, own in ((read_parquet, [p for p in paths if p.endswith(".parquet")]), (read_csv, [p for p in paths if p.endswith(".csv")])):
        if own:
            rows = read(spark, own)
            out = rows if out is None else out.unionByName(rows)
    return out


def numbered_files(folder: str, pattern: str = r"processed_data_(\d+)\.csv") -> list[str]:
    """Files of a folder by the number in their name."""
    found = [(int(m[1]), x) for x in os.listdir(folder) if (m := re.fullmatch(pattern, x))]
    return [os.path.join(folder, x) for _, x in sorted(found)]


def from_networkx(spark: SparkSession, graph) -> DataFrame:
    """Edges of a graph with the attribute `timestamp` (KeyError without)."""
    return from_tuples(spark, [(u, v, data["timestamp"]) for u, v, data in graph.edges(data=True)])


def from_events(spark: SparkSession, events: DataFrame, unit_us: int = 3_600_000_000) -> DataFrame:
    """A chain of users: each event's user to the next event's, at the event's time in units."""
    from ..operators.graph import global_rank

    ranked = global_rank(events.select("ts", "event_id", "user_id"), ["ts", "event_id"], "pos")
    later = ranked.select((F.col("pos") - 1).alias("pos"), F.col("user_id").alias("i"))
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(unit_us)).cast("long")
    return ranked.join(later, "pos").select(F.col("user_id").alias("u"), "i", at.alias("ts"), F.col("pos").alias("idx"))


def from_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Customers to suppliers (shifted by a million) at the day of the order."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return orders.join(lineitem, orders.o_orderkey == lineitem.l_orderkey).select(
        F.col("o_custkey").alias("u"), (F.col("l_suppkey") + 1_000_000).alias("i"), day.alias("ts"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("idx")
    )
