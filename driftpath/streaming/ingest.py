"""Micro-batches of edges into the engine by Structured Streaming, with walks after each; and a replay of a batch table.

The window's end is the largest ts seen, this batch included, so late edges inside the window are merged and others
dropped at once; a watermark, which trails by a batch, would not do that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import WalkEngine
from ..operators.graph import EDGES, TemporalGraph


def _folder(spark, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def saved(spark, folder: str) -> list[int]:
    """The batches whose state is complete, in order."""
    p, fs = _folder(spark, folder)
    if not fs.exists(p):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(p)]
    done = [int(x[6:]) for x in names if x.startswith("batch=") and fs.exists(_folder(spark, f"{folder}/{x}/head/_SUCCESS")[0])]
    return sorted(done)


def save(graph: TemporalGraph, folder: str, batch_id: int, keep: int = 2) -> TemporalGraph:
    """Write the retained edges, the last batch and the head of the graph; the graph that reads them. Older states go.

    The head is written last: without it a state does not count.
    """
    spark, path = graph.spark, f"{folder}/batch={batch_id}"
    graph._edges().write.mode("overwrite").parquet(f"{path}/edges")
    last = graph.last_batch if graph.last_batch is not None else spark.createDataFrame([], "u long, i long")
    last.write.mode("overwrite").parquet(f"{path}/last")
    spark.createDataFrame([(graph.latest, graph.batches, graph.feature_dim)], "latest long, batches int, feature_dim int").coalesce(1).write.mode("overwrite").parquet(f"{path}/head")
    for old in saved(spark, folder)[:-keep]:
        p, fs = _folder(spark, f"{folder}/batch={old}")
        fs.delete(p, True)
    return restore(graph, folder, batch_id)


def restore(graph: TemporalGraph, folder: str, batch_id: int) -> TemporalGraph:
    """The graph as it was after the batch; directed and capacity are the given graph's."""
    spark, path = graph.spark, f"{folder}/batch={batch_id}"
    head = spark.read.parquet(f"{path}/head").first()
    return replace(
        graph, edges=spark.read.schema(EDGES).parquet(f"{path}/edges"), latest=head.latest, batches=head.batches, feature_dim=head.feature_dim,
        last_batch=spark.read.schema("u long, i long").parquet(f"{path}/last"), _held={},
    )


def ingest(stream: DataFrame, engine: WalkEngine, after: Callable[[WalkEngine, int], None] | None = None, checkpoint: str | None = None, once: bool = True) -> StreamingQuery:
    """Each micro-batch (u, i, ts[, idx, features]) joins engine's graph; then after(engine, batch_id).

    With a checkpoint, the graph's state is written beside it after every batch, and a new engine takes up the last state
    before it goes on: retained edges outlive a restart, and a batch that comes again is taken once. Batches whose state
    is kept but after() had not been reached run after() again. Without a checkpoint nothing outlives the query.
    """
    spark, seen = engine.spark, -1
    folder = f"{checkpoint}/driftpath-state" if checkpoint else None
    done = saved(spark, folder) if folder else []
    if done:
        seen = done[-1]
        engine.graph = restore(engine.graph, folder, seen)

    def take(batch: DataFrame, batch_id: int) -> None:
        nonlocal seen
        if batch_id > seen:
            engine.add_edges(batch)
            if folder:
                engine.graph = save(engine.graph, folder, batch_id)
            seen = batch_id
        elif batch_id < seen:
            return
        if after:
            after(engine, batch_id)

    writer = stream.writeStream.foreachBatch(take)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def replay(edges: DataFrame, engine: WalkEngine, batches: int) -> Iterator[int]:
    """Cuts the span of time into `batches` even parts and adds them in order; yields after each."""
    ends = edges.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    if ends.low is None:
        return
    width = (ends.high - ends.low) // batches + 1
    for k in range(batches):
        low = ends.low + k * width
        engine.add_edges(edges.where((F.col("ts") >= low) & (F.col("ts") < low + width)))
        yield k
