"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from driftpath.functions import pickers as P
from driftpath.operators import index as ix
from driftpath.operators import walks as wx
from driftpath.operators.graph import TemporalGraph
from driftpath.operators.weights import node_weights
from driftpath.plans.queries import read
from driftpath.sources import readers
from driftpath.storage import release


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    steps: dict[str, int] = {}

    def timed(name, f):
        began = time.perf_counter()
        out = f()
        took[name] = round(time.perf_counter() - began, 3)
        return out

    g = timed("ingest", lambda: TemporalGraph(spark, True).add(readers.from_events(spark, read(spark, sf, "events"))))
    u = TemporalGraph(spark, False).add(g.edges.select("u", "i", "ts", "idx"))
    timed("degrees", lambda: g.degrees().agg(F.sum("degree")).collect())
    timed("node_weights", lambda: node_weights(g.groups(), 50).agg(F.sum("w_fwd")).collect())
    timed("index_forward", lambda: ix.build(g, True, 50))
    timed("index_backward", lambda: ix.build(g, False, 50))
    timed("index_undirected", lambda: ix.build(u, True, 50))
    seeds = wx.node_seeds(g)
    for bias in (P.UNIFORM, P.LINEAR, P.EXPONENTIAL_INDEX, P.EXPONENTIAL_WEIGHT, P.NODE2VEC):
        for direction in (P.FORWARD, P.BACKWARD):
            n2v = bias == P.NODE2VEC
            o = wx.WalkOptions(5 if n2v else 20, bias, direction=direction, bound=50, p=0.5, q=2.0)
            name = f"walk_{bias}_{direction.split('_')[0].lower()}"
            steps[name] = timed(name, lambda: wx.walks(g, seeds, o, 2 if n2v else 10).agg(F.sum("walk_len")).first()[0])
    timed("walk_undirected", lambda: wx.walks(u, seeds, wx.WalkOptions(20, P.EXPONENTIAL_INDEX, bound=50), 10).agg(F.sum("walk_len")).first())
    release(spark)
    spark.stop()
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": took, "steps_per_s": {k: round(v / took[k]) for k, v in steps.items()}, "sf": os.path.basename(sf)}))


if __name__ == "__main__":
    main()
