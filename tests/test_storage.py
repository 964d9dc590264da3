"""The package as executors get it."""

import zipfile

from driftpath import storage


def test_the_shipped_package_stays(spark, monkeypatch):
    """Executors fetch it from the driver with their first task, long after it was added."""
    added = []
    monkeypatch.setattr(storage, "_local", lambda s: False)
    monkeypatch.setattr(storage, "_SHIPPED", set())
    monkeypatch.setattr(spark.sparkContext, "addPyFile", added.append, raising=False)
    storage.importable(spark)
    storage.importable(spark)
    assert len(added) == 1
    assert "driftpath/operators/vector_walks.py" in zipfile.ZipFile(added[0]).namelist()
