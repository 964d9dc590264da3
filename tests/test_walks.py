from collections import Counter

import numpy as np
import pytest

from driftpath.engine import WalkEngine
from driftpath.functions import pickers as P
from driftpath.operators import features as fx
from driftpath.operators import walks as wx

from .test_graph import graph

BIG = (1 << 63) - 1
CHAIN = [(0, 1, 10), (1, 2, 20), (2, 3, 30)]
MIXED = [(1, 2, 100), (2, 3, 101), (3, 5, 101), (1, 5, 110), (2, 5, 120), (2, 4, 110), (3, 4, 130), (4, 5, 130), (4, 1, 140), (5, 1, 140), (3, 1, 150), (2, 1, 150), (5, 3, 160), (3, 2, 160), (4, 2, 170)]


def seeds(spark, *rows, cut=False):
    rows = [(k, r[0], r[1]) if cut else (k, r) for k, r in enumerate(rows)]
    return spark.createDataFrame(rows, "pos long, node long" + (", cutoff long" if cut else ""))


def go(spark, g, s, n, bias=P.UNIFORM, direction=P.FORWARD, per=1, **kw):
    return wx.walks(g, s, wx.WalkOptions(n, bias, direction=direction, **kw), per).orderBy("walk_id").collect()


def test_chain(spark):
    g = graph(spark, CHAIN)
    (w,) = go(spark, g, seeds(spark, 0), 4)
    assert (w.nodes, w.timestamps, w.edge_ids, w.walk_len) == ([0, 1, 2, 3], [-(1 << 63), 10, 20, 30], [0, 1, 2], 4)
    (w,) = go(spark, g, seeds(spark, 3), 4, direction=P.BACKWARD)
    assert (w.nodes, w.timestamps, w.edge_ids) == ([0, 1, 2, 3], [10, 20, 30, BIG], [0, 1, 2])
    assert [w.walk_len for w in go(spark, g, seeds(spark, 3, 77), 4)] == [0, 0]
    (w,) = go(spark, g, seeds(spark, (0, 20), cut=True), 4)
    assert w.nodes == [0, 1]
    (w,) = go(spark, g, seeds(spark, 0), 1)
    assert w.nodes == [0] and w.edge_ids == []


def test_node_picks_with_cutoffs(spark):
    g = graph(spark, [(10, 20, 100), (10, 30, 101), (10, 40, 102), (10, 50, 103), (10, 60, 104)])
    cut = seeds(spark, (10, 104), (10, 103), (10, 101), (10, 100), (10, 50), (10, 1000), (10, None), cut=True)
    assert [w.timestamps[1] if w.walk_len else None for w in go(spark, g, cut, 2, P.LAST)] == [103, 102, 100, None, None, 104, 104]
    assert [w.timestamps[1] if w.walk_len else None for w in go(spark, g, cut, 2, P.FIRST)] == [100, 100, 100, None, None, 100, 100]
    g = graph(spark, [(20, 10, 100), (30, 10, 101), (40, 10, 102), (50, 10, 103)])
    (w,) = go(spark, g, seeds(spark, 10), 2, P.LAST, P.BACKWARD)
    assert (w.nodes, w.timestamps) == ([50, 10], [103, BIG])


@pytest.mark.parametrize("directed", [True, False])
@pytest.mark.parametrize("direction", [P.FORWARD, P.BACKWARD])
@pytest.mark.parametrize("bias", [P.UNIFORM, P.EXPONENTIAL_WEIGHT, P.NODE2VEC])
def test_invariants(spark, directed, direction, bias):
    g = graph(spark, MIXED, directed=directed)
    edges = {r.edge_id: r for r in g.positioned().collect()}
    rows = go(spark, g, wx.node_seeds(g), 5, bias, direction, per=6, seed=5, bound=10, p=0.5, q=2.0)
    assert len(rows) == 30
    forward = direction == P.FORWARD
    for w in rows:
        assert w.walk_len == len(w.nodes) == len(w.timestamps) and w.walk_len <= 5 and w.walk_len != 1
        assert all(a < b for a, b in zip(w.timestamps, w.timestamps[1:], strict=False))
        for k, e in enumerate(w.edge_ids):
            ends = {edges[e].u, edges[e].i} if not directed else None
            a, b = w.nodes[k], w.nodes[k + 1]
            assert (edges[e].u, edges[e].i) == (a, b) if directed else {a, b} == ends
            assert edges[e].ts == w.timestamps[k + 1 if forward else k]
        if 0 < w.walk_len < 5:
            node, t = (w.nodes[-1], w.timestamps[-1]) if forward else (w.nodes[0], w.timestamps[0])
            own = [e for e in edges.values() if (node == (e.u if forward else e.i) if directed else node in (e.u, e.i))]
            assert not [e for e in own if (e.ts > t if forward else e.ts < t)]


def test_repeatable_and_staged_alike(spark):
    g = graph(spark, MIXED)
    a = go(spark, g, wx.node_seeds(g), 5, per=4, seed=9)
    assert a == go(spark, g, wx.node_seeds(g), 5, per=4, seed=9, cut_every=1)
    assert a != go(spark, g, wx.node_seeds(g), 5, per=4, seed=10)


@pytest.mark.parametrize("rng", ["hashed", "portable"])
@pytest.mark.parametrize("bias", [P.UNIFORM, P.LINEAR, P.EXPONENTIAL_INDEX, P.EXPONENTIAL_WEIGHT, P.FIRST, P.LAST])
def test_arrays_and_joins_give_the_same_walks(spark, bias, rng):
    g = graph(spark, [(k * 7 % 23, k * 11 % 19, k * 5 % 41) for k in range(300)], directed=bias != P.LINEAR)
    s = seeds(spark, *[(k % 25, None if k % 4 else 20 + k) for k in range(50)], cut=True)
    for d in (P.FORWARD, P.BACKWARD):
        got = [go(spark, g, s, 6, bias, d, per=3, seed=5, rng=rng, bound=10, broadcast_ends=n) for n in (0, 1000)]
        assert got[0] == got[1] and any(w.walk_len > 3 for w in got[0])


def test_free_walks(spark):
    for directed in (True, False):
        g = graph(spark, MIXED, directed=directed)
        for d in (P.FORWARD, P.BACKWARD):
            rows = wx.free_walks(g, 40, wx.WalkOptions(4, P.LINEAR, direction=d, seed=2)).collect()
            assert len(rows) == 40 and all(2 <= w.walk_len <= 4 for w in rows)
            assert all(a < b for w in rows for a, b in zip(w.timestamps, w.timestamps[1:], strict=False))
    assert all(w.walk_len == 1 for w in wx.free_walks(g, 5, wx.WalkOptions(1, P.LINEAR)).collect())


def test_node2vec_distribution(spark):
    """From node 1 to 0, then by 1/7, 2/7 and 4/7 to 1 (back), 2 (a neighbour of 1) and 3."""
    g = graph(spark, [(1, 0, 10), (0, 1, 100), (0, 2, 100), (0, 3, 100), (1, 2, 50)])
    rows = go(spark, g, seeds(spark, (1, None), cut=True), 3, P.NODE2VEC, per=6000, start_bias=P.FIRST, p=2.0, q=0.5)
    c = Counter(w.nodes[2] for w in rows)
    assert all(abs(c[k] / 6000 - x / 7) < 0.03 for k, x in ((1, 1), (2, 2), (3, 4)))


def test_exponential_weight_distribution(spark):
    import math

    g = graph(spark, [(1, 2, 0), (1, 3, 1), (1, 4, 2)])
    c = Counter(w.nodes[1] for w in go(spark, g, seeds(spark, 1), 2, P.EXPONENTIAL_WEIGHT, per=6000))
    z = sum(math.exp(-k) for k in range(3))
    assert all(abs(c[2 + k] / 6000 - math.exp(-k) / z) < 0.03 for k in range(3))


def test_edge_features_follow_the_sort(spark):
    from driftpath.sources.readers import from_arrays
    from driftpath.operators.graph import TemporalGraph

    feats = np.arange(1, 46).reshape(15, 3) / 10
    u, i, ts = zip(*MIXED, strict=True)
    g = TemporalGraph(spark, True).add(from_arrays(spark, u, i, ts, feats))
    of = {e: f for e, f in zip(MIXED, feats.tolist(), strict=True)}
    for w in fx.with_edge_features(g, wx.walks(g, wx.node_seeds(g), wx.WalkOptions(5, P.UNIFORM), 2)).collect():
        assert len(w.edge_features) == max(w.walk_len - 1, 0)
        for k, x in enumerate(w.edge_features):
            assert np.allclose(x, of[(w.nodes[k], w.nodes[k + 1], w.timestamps[k + 1])])
    with pytest.raises(ValueError):
        g.add(from_arrays(spark, [1], [2], [900]))
    with pytest.raises(ValueError):
        g.add(from_arrays(spark, [1], [2], [900], [[1.0, 2.0]]))


def test_engine(spark):
    e = WalkEngine(True, walk_padding_value=1_000_000, global_seed=4, spark=spark, enable_weight_computation=True)
    e.add_multiple_edges([0, 1, 2], [1, 2, 3], [10, 20, 30], [[1, 1.5], [2, 2.5], [3, 3.5]])
    assert (e.get_node_count(), e.get_edge_count(), e.get_latest_timestamp(), e.get_is_directed()) == (4, 3, 30, True)
    assert [r.node for r in e.get_node_ids().collect()] == [0, 1, 2, 3]
    assert [tuple(r) for r in e.get_edges().collect()] == CHAIN
    assert e.get_node_degrees([1, 9, 1, 3]) == [1, 0, 1, 0] and e.get_node_degrees([0, 3], P.BACKWARD) == [0, 1]
    nodes, stamps, lens, feats = e.to_arrays(e.get_random_walks_and_times_for_all_nodes(4, P.EXPONENTIAL_WEIGHT, 1), 4)
    assert lens.tolist() == [4, 3, 2, 0] and feats.shape == (4, 3, 2)
    assert all((nodes[k, n:] == 1_000_000).all() and (nodes[k, :n] != 1_000_000).all() for k, n in enumerate(lens))
    assert feats[1].tolist() == [[2, 2.5], [3, 3.5], [0, 0]]
    assert e.get_memory_used() > 0
    assert e.get_random_walks_and_times(3, P.UNIFORM, 7).count() == 7
    assert e.get_random_walks_and_times_for_last_batch(3, P.UNIFORM, 2).count() == 6
    assert [r.walk_len for r in e.get_random_walks_and_times_for_nodes([0, 0, 1], 4, P.UNIFORM, 1, cutoff_times=[20, -1, 20]).orderBy("walk_id").collect()] == [2, 4, 0]
    e.set_node_features([1, 3], [[1, 2], [3, 4]])
    e.set_node_features([0, 1], [[9, 9], [5, 6]])
    assert [r.features for r in e.get_node_features().orderBy("node").collect()] == [[9, 9], [5, 6], [0, 0], [3, 4]]
    with pytest.raises(ValueError):
        e.set_node_features([2], [[1, 2, 3]])
    assert e.clear().get_edge_count() == 0 and e.get_node_features().count() == 0
    for bad in (lambda: WalkEngine(True, spark=spark).get_random_walks_and_times(3, P.EXPONENTIAL_WEIGHT, 1), lambda: e.get_random_walks_and_times(3, P.NODE2VEC, 1), lambda: WalkEngine(True, temporal_node2vec_p=0, spark=spark), lambda: e.get_random_walks_and_times_for_nodes([1], 3, P.UNIFORM, 1, cutoff_times=[1, 2])):
        with pytest.raises(ValueError):
            bad()
