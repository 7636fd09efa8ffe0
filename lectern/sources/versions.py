"""Versions of a stored thing, one small file each.

A version's file is named by its number and created only if it isn't there, so
of two writers that both saw version n one gets n + 1 and the other a
`Conflict`; readers take the highest number whose file is complete.  All goes
through Hadoop, wherever the folder is.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Somebody else has written this version."""


def _folder(spark: SparkSession, root: str):  # noqa: ANN202
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_versions")
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, root: str) -> list[int]:
    path, files = _folder(spark, root)
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def read(spark: SparkSession, root: str, number: int) -> dict | None:
    """What a version holds; None while its file is being written."""
    path, files = _folder(spark, root)
    stream = files.open(spark._jvm.org.apache.hadoop.fs.Path(path, f"{number:012d}.json"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return json.loads(text)
    except ValueError:
        return None


def latest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """The last complete version and its number; 0 and nothing at first."""
    for number in reversed(numbers(spark, root)):
        held = read(spark, root, number)
        if held is not None:
            return number, held
    return 0, {}


def publish(spark: SparkSession, root: str, held: dict, after: int) -> int:
    """Write version `after` + 1, or raise Conflict if it is there."""
    path, files = _folder(spark, root)
    name = spark._jvm.org.apache.hadoop.fs.Path(path, f"{after + 1:012d}.json")
    try:
        stream = files.create(name, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception):
            raise Conflict(f"version {after + 1} of {root} is there") from None
        raise
    try:
        stream.write(bytearray(json.dumps(held).encode()))
    finally:
        stream.close()
    return after + 1
