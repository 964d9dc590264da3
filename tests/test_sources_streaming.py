import numpy as np
import pytest

from driftpath.engine import WalkEngine
from driftpath.functions import pickers as P
from driftpath.sources import readers, sinks, synthetic
from driftpath.streaming.ingest import ingest, replay

from .test_graph import graph


def test_files(spark, tmp_path):
    (tmp_path / "data_0.csv").write_text("u,i,ts,extra\n1,2,10,x\n2,3,20,y\n")
    spark.createDataFrame([(9, 30, 3, 4)], "z long, ts long, u long, i long").write.parquet(str(tmp_path / "data_1.parquet"))
    assert sorted(map(tuple, readers.read_shards(spark, str(tmp_path), 0, 2).collect())) == [(1, 2, 10), (2, 3, 20), (3, 4, 30)]
    assert readers.read_csv(spark, str(tmp_path / "data_0.csv"), row_count=1).count() == 1
    with pytest.raises(FileNotFoundError):
        readers.shard_path(spark, str(tmp_path), 7)
    with pytest.raises(ValueError):
        spark.range(2).write.parquet(str(tmp_path / "bad"))
        readers.read_parquet(spark, str(tmp_path / "bad"))
    for k in (10, 2):
        (tmp_path / f"processed_data_{k}.csv").write_text("")
    assert [x[-7:-4] for x in readers.numbered_files(str(tmp_path))] == ["a_2", "_10"]


def test_arrays_are_checked(spark):
    for bad in (([[1]], [2], [3]), ([1, 2], [2], [3])):
        with pytest.raises(ValueError):
            readers.from_arrays(spark, *bad)
    assert readers.from_arrays(spark, [1, 2], [3, 4], [5, 6], np.arange(4)).first().features == [0.0, 1.0]
    assert readers.from_arrays(spark, [], [], []).count() == 0


class FakeGraph:
    def __init__(self, edges):
        self._edges = edges

    def edges(self, data):
        return [(u, v, {"timestamp": t} if t else {}) for u, v, t in self._edges]


def test_other_graphs_and_collapsed_pairs(spark):
    e = WalkEngine(True, spark=spark).add_multiple_edges([(0, 1, 50), (1, 2, 150), (4, 5, 600)])
    e.add_edges_from_networkx(FakeGraph([(0, 1, 100), (1, 2, 200), (2, 3, 300), (3, 0, 400)]))
    assert (e.get_node_count(), e.get_edge_count()) == (6, 7)
    assert {tuple(r) for r in sinks.collapsed(e.graph).collect()} == {(0, 1, 100), (1, 2, 200), (2, 3, 300), (3, 0, 400), (4, 5, 600)}
    with pytest.raises(KeyError):
        e.add_edges_from_networkx(FakeGraph([(0, 1, None)]))
    u = graph(spark, [(1, 2, 5), (2, 1, 9)], directed=False)
    assert [tuple(r) for r in sinks.collapsed(u).collect()] == [(1, 2, 9)]


def test_sinks(spark, tmp_path):
    e = WalkEngine(True, spark=spark).add_multiple_edges([(0, 1, 10), (1, 2, 20)])
    w = e.get_random_walks_and_times_for_all_nodes(3, P.UNIFORM, 1)
    sinks.write_walks(w, str(tmp_path / "walks"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "walks")).collect()) == ["", "0 1 2", "1 2"]
    df = spark.createDataFrame([('a "b", c', 1)], "s string, n int")
    sinks.write_csv(df, "")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').first().s == 'a "b", c'
    sinks.show_walks(w)


def test_synthetic(spark):
    strata = (synthetic.Stratum(3, 200, 20), synthetic.Stratum(10, 30, 5), synthetic.Stratum(50, 4, 2))
    e = synthetic.edges(spark, strata)
    d = synthetic.describe(e).first()
    assert d.edges == 600 + 300 + 200 and d.nodes <= 63 and 0 <= d.ts_min <= d.ts_median <= d.ts_max < synthetic.SPAN
    assert e.where("u < 3").select("u", "ts").distinct().count() <= 60
    assert sorted(map(tuple, e.collect())) == sorted(map(tuple, synthetic.edges(spark, strata).collect()))
    # Nothing flows back to the tail; hubs mostly point to hubs, and walks circulate.
    assert e.where("i >= 13").count() == 0 and 0.8 < e.where("u < 3 and i < 3").count() / 600 < 0.9
    assert 0.5 < e.where("u >= 13 and i < 3").count() / 200 < 0.6 and 0.53 < e.where("u >= 3 and u < 13 and i < 3").count() / 300 < 0.67
    from driftpath.operators import walks as wx
    from driftpath.operators.graph import TemporalGraph

    g = TemporalGraph(spark, True).add(e)
    out = wx.statistics(wx.walks(g, wx.node_seeds(g), wx.WalkOptions(8, P.EXPONENTIAL_INDEX), 4)).first()
    assert out.avg_len > 6


def test_stream_equals_one_batch(spark, tmp_path):
    edges = [(k % 7, (k * 3 + 1) % 7, (k * 37) % 50) for k in range(60)]
    for k in range(3):
        part = [(20 * k + n, *e) for n, e in enumerate(edges[20 * k : 20 * k + 20])]
        spark.createDataFrame(part, "idx long, u long, i long, ts long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for capacity in (None, 20):
        e, seen = WalkEngine(True, max_time_capacity=capacity, spark=spark), []
        stream = spark.readStream.schema("idx long, u long, i long, ts long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = ingest(stream, e, lambda x, n: seen.append((n, x.get_edge_count())), str(tmp_path / f"ck{capacity}"))
        q.awaitTermination()
        want = [x for x in edges if capacity is None or x[2] > max(t for _, _, t in edges) - capacity]
        assert sorted((r.u, r.i, r.ts) for r in e.graph.edges.collect()) == sorted(want) and len(seen) == 3
        assert e.get_random_walks_and_times_for_last_batch(4, P.UNIFORM, 1).count() == len({x.u for x in e.graph.last_batch.collect()})


def test_state_outlives_the_engine(spark, tmp_path):
    """An engine that dies between batches: another takes up its edges and walks as one that saw all batches."""
    edges = [(k % 7, (k * 3 + 1) % 7, (k * 37) % 50) for k in range(60)]

    def put(k):
        part = [(20 * k + n, *e) for n, e in enumerate(edges[20 * k : 20 * k + 20])]
        spark.createDataFrame(part, "idx long, u long, i long, ts long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def go(e, seen):
        stream = spark.readStream.schema("idx long, u long, i long, ts long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ingest(stream, e, lambda x, n: seen.append(n), str(tmp_path / "ck")).awaitTermination()

    seen: list[int] = []
    put(0)
    put(1)
    go(WalkEngine(True, max_time_capacity=30, spark=spark), seen)
    put(2)
    again = WalkEngine(True, max_time_capacity=30, spark=spark)
    go(again, seen)
    whole = WalkEngine(True, max_time_capacity=30, spark=spark)
    for k in range(3):
        whole.add_edges(spark.createDataFrame([(20 * k + n, *e) for n, e in enumerate(edges[20 * k : 20 * k + 20])], "idx long, u long, i long, ts long"))
    rows = lambda e: sorted((r.u, r.i, r.ts, r.batch, r.idx) for r in e.graph.edges.collect())
    assert rows(again) == rows(whole) and seen == [0, 1, 2] and again.get_latest_timestamp() == whole.get_latest_timestamp()
    walks = lambda e: sorted((r.walk_id, r.nodes, r.timestamps) for r in e.get_random_walks_and_times_for_last_batch(5, P.UNIFORM, 2).collect())
    assert walks(again) == walks(whole)
    idle = WalkEngine(True, max_time_capacity=30, spark=spark)
    go(idle, seen)
    assert rows(idle) == rows(whole) and seen == [0, 1, 2]


def test_batches_are_compacted(spark, monkeypatch):
    from driftpath.operators import graph

    monkeypatch.setattr(graph, "COMPACT", 2)
    g = graph.TemporalGraph(spark, True, 3)
    for t in range(6):
        g = g.add(readers.from_tuples(spark, [(t, t + 1, t)]))
    assert sorted(r.ts for r in g.edges.collect()) == [3, 4, 5] and len(g.edges.inputFiles()) <= 4


def test_replay(spark):
    e = WalkEngine(True, spark=spark)
    edges = readers.from_tuples(spark, [(k % 5, k % 3, k) for k in range(30)])
    counts = [e.get_edge_count() for _ in replay(edges, e, 4)]
    assert counts[-1] == 30 and counts == sorted(counts)


def test_edges_come_in_blocks(spark, monkeypatch):
    """The driver makes rows of a block at a time, of a generator as well; order of arrival goes on over blocks."""
    import numpy as np

    from driftpath.sources import readers

    monkeypatch.setattr(readers, "BLOCK", 4)
    rows = [(k % 3, k % 5, k // 2) for k in range(10)]
    want = [(k, *r) for k, r in enumerate(rows)]
    sizes = []
    made = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: (sizes.append(len(data)), made(self, data, *a, **b))[1])
    assert sorted(tuple(r) for r in readers.from_tuples(spark, iter(rows)).collect()) == want
    u, i, ts = (np.array(c) for c in zip(*rows, strict=True))
    got = readers.from_arrays(spark, u, i, ts, np.arange(20).reshape(10, 2))
    assert sorted((r.idx, r.u, r.i, r.ts, *r.features) for r in got.collect()) == [(*w, 2.0 * k, 2.0 * k + 1) for k, w in enumerate(want)]
    assert sizes == [4, 4, 2] * 2
    assert readers.from_tuples(spark, iter(())).count() == 0
