"""Queries that ask about whole tables, on fixtures where a part of them would show."""

from driftpath.operators import features as fx
from driftpath.operators.graph import TemporalGraph
from driftpath.plans.queries import QUERIES
from driftpath.sources.readers import from_tuples

SF = "/root/testdata/sf0.001"


def test_dense_features_of_all_nodes(spark):
    held = {r.vec_id: round(float(r.embedding[0]), 4) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = {r.node: r["first"] for r in QUERIES["node_features_dense"](spark, SF).collect()}
    assert len(got) > 3 and all(abs(x - held.get(n, 0)) < 1e-4 for n, x in got.items())
    assert any(n % 3 and x for n, x in got.items())


def test_zeros_for_unset_nodes(spark):
    g = TemporalGraph(spark, True).add(from_tuples(spark, [(0, 3, 5)]))
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "node long, features array<float>")
    got = {r.node: r.features for r in fx.dense(g, fx.upsert(None, rows)).collect()}
    assert got == {0: [0, 0], 1: [1, 2], 2: [0, 0], 3: [0, 0]}


def test_all_nodes_are_asked(spark, tmp_path):
    """More users than any fixed range: the queries name each of them and some that are absent."""
    rows = [(k, k * 7, float(k)) for k in range(450)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, value double")
    df.selectExpr("event_id", "user_id", "value", "timestamp_micros(event_id * 3600000000) AS ts").write.parquet(str(tmp_path / "events.parquet"))
    users = {k * 7 for k in range(450)}
    for name in ("active_nodes", "degrees_for_list", "count_node_ts_less"):
        named = {r.node for r in QUERIES[name](spark, str(tmp_path)).select("node").distinct().collect()}
        assert named == users | {-3, -2, -1} | {max(users) + k for k in (1, 2, 3)}, name
