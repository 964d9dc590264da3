"""Tables staged in the folder that all executors share, to cut lineage in a way that outlives a lost executor."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_STAGED: list[tuple[SparkSession, str]] = []
_PACKAGE = Path(__file__).resolve().parent
_ROOT = str(_PACKAGE.parent)
_SHIPPED: set[str] = set()


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package, on machines that do not have the driver's folders too."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    env = sc.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH")) if x)
    if not _local(spark):
        folder = tempfile.mkdtemp(prefix="driftpath-")  # the driver serves the file from here to each executor, also to those that come later
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = Path(folder) / f"{_PACKAGE.name}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(_PACKAGE.rglob("*.py")):
                z.write(p, p.relative_to(_PACKAGE.parent))
        sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)


def _local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder if all runs on this machine; on a cluster an error."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not _local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp(prefix="driftpath-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get()


def staged_path(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/driftpath-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    return path


def staged(df: DataFrame) -> DataFrame:
    path = staged_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._dp_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again."""
    path = getattr(df, "_dp_path", None)
    if path:
        p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _STAGED[:] = [x for x in _STAGED if x[1] != path]


def release(spark: SparkSession) -> None:
    """Delete what this session has staged; for when the results are consumed."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for own, path in list(_STAGED):
        if own is spark:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
            _STAGED.remove((own, path))


@atexit.register
def _at_exit() -> None:
    for spark in {id(s): s for s, _ in _STAGED}.values():
        try:
            if spark.sparkContext._jsc is not None:
                release(spark)
        except Exception:  # noqa: BLE001  the JVM may have gone first
            return
