"""Queries on a standalone cluster, whose executors get the package from the driver."""

import json
import os
import signal
import socket
import subprocess
import sys
import time
from pathlib import Path

import duckdb
import pyspark
import pytest

from driftpath.plans.queries import SQL

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
NAMES = [
    "walk_ExponentialIndex_bwd_arrays",
    "walk_ExponentialWeight_fwd_arrays",
    "walk_Uniform_bwd_arrays",
    "walk_cutoffs_fwd",
    "walk_first_undirected_arrays",
    "walk_last_bwd_arrays",
    "walk_start_bias_arrays",
    "engine_walks_fwd",
    "walk_ExponentialIndex_fwd_arrays",
    "walk_Linear_bwd_arrays",
    "walk_Uniform_fwd_arrays",
    "walk_edge_features",
    "walk_last_bwd_undirected_arrays",
    "walk_statistics",
    "padded_arrays",
    "walk_ExponentialWeight_bwd_arrays",
    "walk_Linear_fwd_arrays",
    "walk_cutoffs_bwd",
    "walk_first_fwd_arrays",
    "walk_free_backward",
]
#: The driver: a line of JSON for each query, its rows or its error.
DRIVER = """
import json, sys
from pyspark.sql import SparkSession
from driftpath.plans.queries import QUERIES

s = SparkSession.builder.getOrCreate()
s.sparkContext.setLogLevel("ERROR")
for name in sys.argv[2:]:
    try:
        rows = QUERIES[name](s, sys.argv[1])
        cols = sorted(rows.columns)
        print(json.dumps({"name": name, "rows": [list(r) for r in rows.select(*cols).collect()], "cols": cols}))
    except Exception as e:
        print(json.dumps({"name": name, "error": str(e)}))
s.stop()
"""


def _port():
    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def _open(port):
    with socket.socket() as s:
        return s.connect_ex(("127.0.0.1", port)) == 0


@pytest.fixture(scope="module")
def answers(tmp_path_factory):
    """name -> what the driver says of it. A master, a worker of two cores and the driver are processes of their own."""
    d = tmp_path_factory.mktemp("cluster")
    home, port = Path(pyspark.__file__).parent, _port()
    own = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_", "_PYSPARK"))}
    own |= {"SPARK_HOME": str(home), "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_DIRS": str(d), "TZ": "UTC"}
    conf = {
        "spark.master": f"spark://127.0.0.1:{port}", "spark.executor.memory": "1g", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1",
        "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": f"file://{d}/shared", "spark.sql.warehouse.dir": f"{d}/warehouse",
    }
    submit = " ".join(f"--conf {k}={v}" for k, v in conf.items())
    began = []
    try:
        for kind, args in (("master.Master", ["--host", "127.0.0.1", "--port", str(port)]), ("worker.Worker", [f"spark://127.0.0.1:{port}", "--cores", "2", "--memory", "2g", "--work-dir", f"{d}/work"])):
            with (d / kind).open("w") as log:
                began.append(subprocess.Popen([home / "bin/spark-class", f"org.apache.spark.deploy.{kind}", *args, "--webui-port", "0"], env=own, cwd=d, stdout=log, stderr=log))
            for _ in range(120):
                if _open(port):
                    break
                time.sleep(0.5)
        done = subprocess.run(
            [sys.executable, "-c", DRIVER, SF, *NAMES], cwd=d, timeout=600, capture_output=True, text=True,
            env=own | {"PYTHONPATH": str(ROOT), "PYSPARK_SUBMIT_ARGS": f"--driver-memory 750m {submit} pyspark-shell"},
        )
        assert done.returncode == 0, done.stderr[-3000:]
        return {x["name"]: x for x in map(json.loads, filter(lambda y: y.startswith("{"), done.stdout.splitlines()))}
    finally:
        for p in reversed(began):
            p.send_signal(signal.SIGTERM)
            p.wait(60)


@pytest.mark.parametrize("name", NAMES)
def test_query_on_a_cluster(answers, name):
    got = answers[name]
    assert "error" not in got, got["error"][:2000]
    if name in SQL:
        c = duckdb.connect()
        c.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
        want = c.sql(f"SELECT {', '.join(got['cols'])} FROM ({SQL[name]})").fetchall()
        assert sorted(map(tuple, got["rows"]), key=str) == sorted(want, key=str)
    else:
        assert got["rows"]
