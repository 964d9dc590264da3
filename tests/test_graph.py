"""Counts, order, windows and groups on small graphs, with values worked out by hand."""

import pytest

from driftpath.operators.graph import IN, OUT, TemporalGraph
from driftpath.sources.readers import from_tuples


def graph(spark, *batches, directed=True, capacity=-1):
    g = TemporalGraph(spark, directed, capacity)
    for b in batches:
        g = g.add(from_tuples(spark, b))
    return g


def ask(spark, *rows, schema="t long"):
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


def test_order_over_batches(spark):
    g = graph(spark, [(10, 20, 200), (20, 30, 100)], [(30, 40, 150), (40, 50, 250)], [(50, 60, 150), (60, 70, 200), (70, 80, 175)])
    rows = g.positioned().orderBy("edge_id").collect()
    assert [r.ts for r in rows] == [100, 150, 150, 175, 200, 200, 250]
    assert [(r.u, r.edge_id) for r in rows if r.ts == 150] == [(30, 1), (50, 2)]
    assert {r.n for r in g.count_node_ts_greater(ask(spark, (30, 50), schema="node long, t long")).collect()} == {1}


def test_window_over_batches(spark):
    want = [(7, 6), (8, 9), (8, 8), (7, 7)]
    batches = [
        [(0, 2, 1), (2, 3, 3), (1, 9, 2), (2, 4, 3), (2, 4, 1), (1, 5, 4)], [(5, 6, 4), (2, 5, 4), (4, 3, 5)], [(1, 7, 6)], [(1, 5, 7), (4, 7, 8)],
    ]
    g = TemporalGraph(spark, True, 5)
    for b, w in zip(batches, want, strict=True):
        g = g.add(from_tuples(spark, b))
        assert (g.node_count(), g.edge_count()) == w
    g = graph(spark, [(1, 2, 100), (2, 3, 100), (3, 1, 100)], [(4, 5, 250)], capacity=100)
    assert {r.node for r in g.nodes().collect()} == {4, 5}


def test_edge_cases(spark):
    g = TemporalGraph(spark, True)
    assert g.edge_count() == 0 and g.node_count() == 0 and g.add(from_tuples(spark, [])) is g
    g = g.add(from_tuples(spark, [(1, 2, 5), (1, 2, 5), (3, 4, 5), (1, 2, (1 << 63) - 1), (-7, 2, -3)]))
    assert g.edge_count() == 5 and g.latest == (1 << 63) - 1
    assert graph(spark, [(1, 2, -5)]).latest == 0
    with pytest.raises(ValueError):
        g.add(spark.createDataFrame([(None, 1, 2)], "u long, i long, ts long"))
    assert g.clear().edge_count() == 0


def test_global_counts_and_ranges(spark):
    g = graph(spark, [(1, 2, 100), (2, 3, 100), (1, 3, 200), (2, 4, 300), (3, 4, 300), (4, 1, 400)])
    ts = (50, 100, 150, 200, 300, 400, 500)
    assert {r.t: r.n for r in g.count_ts_less(ask(spark, *ts)).collect()} == dict(zip(ts, (0, 0, 1, 1, 2, 3, 4), strict=True))
    assert {r.t: r.n for r in g.count_ts_greater(ask(spark, *ts)).collect()} == dict(zip(ts, (4, 3, 3, 2, 1, 0, 0), strict=True))
    h = graph(spark, [(1, 2, 100), (1, 3, 200), (2, 3, 300)])
    assert {r.t: r.gg for r in h.asof(ask(spark, 50, 100, 150, 200, 300, 350), True).collect()} == {50: 0, 100: 1, 150: 1, 200: 2, 300: 3, 350: 3}
    assert {r.t: r.gg for r in h.asof(ask(spark, 50, 150, 200, 300, 350), False).collect()} == {50: -1, 150: 0, 200: 0, 300: 1, 350: 2}
    k = graph(spark, [(1, 2, 100), (1, 2, 100), (1, 3, 200), (2, 3, 300), (3, 1, 300)])
    assert {r.gg: (r.start, r.stop) for r in k.group_range(ask(spark, 0, 1, 2, 3, schema="gg long")).collect()} == {0: (0, 2), 1: (2, 3), 2: (3, 5), 3: (0, 0)}


def test_node_counts(spark):
    g = graph(spark, [(1, 2, 100), (1, 3, 100), (2, 1, 200), (1, 2, 300), (3, 1, 300), (1, 4, 400)])
    pairs = [(1, t) for t in (50, 100, 200, 300, 400)] + [(5, 50), (-1, 50)]
    more = {(r.node, r.t): r.n for r in g.count_node_ts_greater(ask(spark, *pairs, schema="node long, t long")).collect()}
    assert [more[p] for p in pairs] == [3, 2, 2, 1, 0, 0, 0]
    pairs = [(1, t) for t in (50, 200, 250, 400, 500)] + [(2, 400)]
    less = {(r.node, r.t): r.n for r in g.count_node_ts_less(ask(spark, *pairs, schema="node long, t long")).collect()}
    assert [less[p] for p in pairs] == [0, 0, 1, 2, 2, 2]
    g = graph(spark, [(2, 1, 100), (3, 1, 100), (1, 2, 200), (4, 1, 300), (1, 3, 300)], directed=False)
    less = {(r.node, r.t): r.n for r in g.count_node_ts_less(ask(spark, (1, 50), (1, 150), (1, 400), (2, 250), schema="node long, t long")).collect()}
    assert less == {(1, 50): 0, (1, 150): 1, (1, 400): 3, (2, 250): 2}


def test_groups_and_degrees(spark):
    g = graph(spark, [(10, 20, 100), (10, 30, 100), (10, 20, 200), (20, 30, 300), (20, 10, 300)])
    assert [(r.ts, r.n_edges) for r in g.groups(OUT).where("node = 10").orderBy("g").collect()] == [(100, 2), (200, 1)]
    assert {r.node: r.degree for r in g.degrees(IN).collect()}[20] == 2
    u = graph(spark, [(100, 200, 1000), (100, 300, 1000), (100, 200, 2000), (200, 300, 3000), (7, 7, 1)], directed=False)
    assert {r.node: r.degree for r in u.degrees().collect()} == {100: 3, 200: 3, 300: 2, 7: 2}
    asked = ask(spark, (0, 100), (1, 999), (2, 100), schema="pos long, node long")
    assert [r.degree for r in u.degrees_of(asked).orderBy("pos").collect()] == [3, 0, 3]
    assert u.groups(IN).count() == 0


def test_last_batch(spark):
    batches = [(1, 2, 100), (2, 3, 101), (3, 4, 102)], [(5, 6, 103), (7, 8, 104), (5, 9, 105)]
    assert {r.node for r in graph(spark, *batches).last_batch_nodes().collect()} == {5, 7}
    assert {r.node for r in graph(spark, *batches, directed=False).last_batch_nodes().collect()} == {5, 6, 7, 8, 9}
    assert {r.node for r in graph(spark, *batches, []).last_batch_nodes().collect()} == {5, 7}
