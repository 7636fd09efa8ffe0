"""A stored index that follows changes, as segments.

A change writes one segment: the new rows, and the keys whose older rows are
gone (deleted or replaced).  Rows count unless a later segment names their key.
Merging writes what is left of several segments as one; the names of the
segments that count are a version (see `versions`), so readers see a change
whole or not at all, and what a reader has begun to read stays.

Layout: rows/segment=N/<partitions>/ and gone/segment=N/.  A segment's number is
never used again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.sources import versions

Write = Callable[[DataFrame, str], None]


def names(spark: SparkSession, root: str) -> tuple[int, list[dict]]:
    """The version, and its segments: number, folder, whether it has rows, how
    many keys are gone."""
    number, held = versions.latest(spark, root)
    return number, held.get("segments", [])


def _read(spark: SparkSession, root: str, kind: str, segments: list[dict]) -> DataFrame:
    parts = [spark.read.option("basePath", f"{root}/{kind}/{s['folder']}").parquet(f"{root}/{kind}/{s['folder']}").withColumn("segment", F.lit(s["number"]).cast("long")) for s in segments]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def live(spark: SparkSession, root: str, key: str, schema: T.StructType, segments: list[dict] | None = None) -> DataFrame:
    """Rows that count, with their segment.  Filters on the rows reach the
    files of every segment; the keys that are gone are few after a merge."""
    segments = names(spark, root)[1] if segments is None else segments
    with_rows = [s for s in segments if s["rows"]]
    if not with_rows:
        return spark.createDataFrame([], T.StructType([*schema, T.StructField("segment", T.LongType())]))
    rows = _read(spark, root, "rows", with_rows)
    first = min(s["number"] for s in with_rows)
    later = [s for s in segments if s["gone"] and s["number"] > first]
    if not later:
        return rows
    gone = _read(spark, root, "gone", later).groupBy(key).agg(F.max("segment").alias("_gone"))
    return rows.join(gone, (rows[key] == gone[key]) & (F.col("_gone") > F.col("segment")), "left_anti")


def append(spark: SparkSession, root: str, key: str, rows: DataFrame | None, gone: DataFrame | None, write: Write) -> int:
    """A segment of `rows` that replaces what earlier segments have of the keys
    in `gone`; returns the version."""
    version, segments = names(spark, root)
    number = max((s["number"] for s in segments), default=0) + 1
    folder = f"{number:08d}-{uuid.uuid4().hex[:8]}"
    n = 0
    if gone is not None:
        gone.select(key).where(F.col(key).isNotNull()).distinct().write.parquet(f"{root}/gone/{folder}")
        n = spark.read.parquet(f"{root}/gone/{folder}").count()
    has = rows is not None and _written(spark, rows, f"{root}/rows/{folder}", write)
    entry = {"number": number, "folder": folder, "rows": has, "gone": n}
    return versions.publish(spark, root, {"segments": [*segments, entry]}, version)


def _written(spark: SparkSession, rows: DataFrame, path: str, write: Write) -> bool:
    """Whether there were any rows."""
    write(rows, path)
    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException:  # no file, so no schema
        return False


def merge(spark: SparkSession, root: str, key: str, schema: T.StructType, write: Write, last: int | None = None) -> int:
    """What counts of the `last` segments (all) becomes one segment.  Keys that
    are gone still go from the segments before them, if there are any."""
    version, segments = names(spark, root)
    last = len(segments) if last is None else min(last, len(segments))
    if last < 2 and not (last and not segments[:-1] and segments[-1]["gone"]):
        return version
    old, own = segments[: len(segments) - last], segments[len(segments) - last :]
    number = own[-1]["number"] + 1
    folder = f"{number:08d}-{uuid.uuid4().hex[:8]}"
    n, held = 0, [s for s in own if s["gone"]]
    if old and held:
        _read(spark, root, "gone", held).select(key).distinct().write.parquet(f"{root}/gone/{folder}")
        n = spark.read.parquet(f"{root}/gone/{folder}").count()
    has = _written(spark, live(spark, root, key, schema, own).drop("segment"), f"{root}/rows/{folder}", write)
    return versions.publish(spark, root, {"segments": [*old, {"number": number, "folder": folder, "rows": has, "gone": n}]}, version)


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete the folders that the last version doesn't name, for when nobody
    reads older versions or writes a new one; returns how many went."""
    keep = {s["folder"] for s in names(spark, root)[1]}
    count = 0
    for kind in ("rows", "gone"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{kind}")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for s in files.listStatus(path) if files.exists(path) else []:
            if s.getPath().getName() not in keep:
                count += files.delete(s.getPath(), True)
    return count
