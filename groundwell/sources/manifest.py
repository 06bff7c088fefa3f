"""Numbered manifests in a folder: the state of a table is what its last manifest says.

A manifest is put in place by one rename, so readers see the old state or the new one; of two changes
that start from the same state, the later rename fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it is missing."""
    fs = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(_path(spark, path))] if fs.exists(_path(spark, path)) else []


def delete(spark: SparkSession, path: str) -> None:
    _fs(spark, path).delete(_path(spark, path), True)


def names(spark: SparkSession, path: str) -> list[str]:
    """The manifests of the table at `path`, oldest first."""
    return sorted(f for f in listed(spark, f"{path}/manifest") if f.endswith(".json") and not f.startswith("."))


def state(spark: SparkSession, path: str, name: str) -> dict:
    stream = _fs(spark, path).open(_path(spark, f"{path}/manifest/{name}"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def latest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Version and state of the table at `path`."""
    found = names(spark, path)
    if not found:
        raise FileNotFoundError(f"no table at {path}")
    return int(found[-1][: -len(".json")]), state(spark, path, found[-1])


def commit(spark: SparkSession, path: str, version: int, state: dict) -> None:
    """Make `state` the state number `version`. Fails if another change has made this version."""
    jvm, made = spark._jvm, f"{path}/manifest/.{uuid.uuid4().hex}"
    out = _fs(spark, path).create(_path(spark, made))
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context.rename(_path(spark, made), _path(spark, f"{path}/manifest/{version:020d}.json"), none)
