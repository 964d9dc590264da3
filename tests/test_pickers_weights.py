import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftpath.functions import pickers as P
from driftpath.functions.rng import portable, portable_value
from driftpath.operators.graph import OUT
from driftpath.operators.weights import global_weights, node_weights

from .test_graph import graph


def test_single_picks():
    assert [P.LinearRandomPicker().pick_with(0, 4, True, r) for r in (0, 0.35, 0.95)] == [0, 2, 3]
    assert P.UniformRandomPicker().pick_with(0, 4, True, 0.5) == 2
    assert P.ExponentialIndexRandomPicker().pick_with(0, 4, True, 0.5) == 3
    for kind in (P.LinearRandomPicker, P.ExponentialIndexRandomPicker, P.UniformRandomPicker):
        k = kind(seed=1)
        assert all(5 <= k.pick_random(5, 10) < 10 for _ in range(200))
        assert k.pick_random(5, 6) == 5 and k.pick_random(3, 3) == -1
    n = 20_000
    for kind, late in ((P.LinearRandomPicker, 2 / 3), (P.ExponentialIndexRandomPicker, math.e / (math.e + 1))):
        k = kind(seed=2)
        assert abs(sum(k.pick_random(0, 2) for _ in range(n)) / n - late) < 0.02
        assert abs(sum(k.pick_random(0, 2, False) for _ in range(n)) / n - (1 - late)) < 0.02


def test_weight_based_picks():
    k = P.WeightBasedRandomPicker(seed=3)
    assert [k.pick_random([0.2, 0.5, 0.7, 1], a, b) for a, b in ((-1, 2), (2, 2), (2, 1), (0, 5), (1, 2))] == [-1, -1, -1, -1, 1]
    c = Counter(k.pick_random([0.25, 0.5, 0.75, 1], 0, 4) for _ in range(20_000))
    assert all(abs(v / 20_000 - 0.25) < 0.015 for v in c.values())
    c = Counter(k.pick_with([0.3, 1, 0.25, 1], 2, 4, (i + 0.5) / 1000, base=2) for i in range(1000))
    assert c == {2: 250, 3: 750}


@pytest.mark.parametrize("name", [P.UNIFORM, P.LINEAR, P.EXPONENTIAL_INDEX])
def test_columns_equal_single_picks(spark, name):
    kind = {P.UNIFORM: P.UniformRandomPicker, P.LINEAR: P.LinearRandomPicker, P.EXPONENTIAL_INDEX: P.ExponentialIndexRandomPicker}[name]()
    grid = [(a, a + n, (j + 0.5) / 37) for a in (0, 5) for n in (0, 1, 2, 7, 100, 709, 710, 5000) for j in range(37)]
    df = spark.createDataFrame(grid, "a int, b int, r double")
    for late in (True, False):
        got = df.select("*", P.pick(name, F.col("a"), F.col("b"), F.col("r"), late).alias("k")).collect()
        assert [(r.k if r.k is not None else -1) for r in got] == [kind.pick_with(a, b, late, r) for a, b, r in grid]


def test_portable_numbers(spark):
    rows = spark.range(50).select("id", portable(F.col("id"), 3, 1, 42).alias("u")).collect()
    assert [r.u for r in rows] == [portable_value(r.id, 3, 1, 42) for r in rows]


def test_global_weights(spark):
    g = graph(spark, [(1, 2, 10), (1, 3, 10), (2, 3, 20), (2, 4, 20), (3, 4, 30), (4, 1, 40)])
    rows = global_weights(g.ts_groups()).orderBy("ts").collect()
    for c in ("cum_fwd", "cum_bwd"):
        v = [r[c] for r in rows]
        assert len(v) == 4 and v == sorted(v) and abs(v[-1] - 1) < 1e-6
    rows = global_weights(graph(spark, [(1, 2, 10), (1, 3, 20), (1, 4, 30)]).ts_groups()).orderBy("ts").collect()
    assert abs(math.log(rows[1].w_fwd / rows[0].w_fwd) + 10) < 1e-6 and abs(math.log(rows[2].w_bwd / rows[1].w_bwd) - 10) < 1e-6


def test_node_weights(spark):
    for edges, bound, step in (([(1, 2, 10), (1, 3, 20), (1, 4, 30)], -1, 10), ([(1, 2, 100), (1, 3, 300), (1, 4, 500)], 2, 1)):
        rows = node_weights(graph(spark, edges).groups(OUT), bound).orderBy("ts").collect()
        assert all(abs(math.log(b.w_fwd / a.w_fwd) + step) < 1e-6 and abs(math.log(b.w_bwd / a.w_bwd) - step) < 1e-6 for a, b in zip(rows, rows[1:], strict=False))
        assert abs(rows[-1].cum_fwd - 1) < 1e-6


def test_names_are_checked():
    for f, x in ((P.parse_picker, "Best"), (P.parse_direction, "Sideways")):
        with pytest.raises(ValueError):
            f(x)
