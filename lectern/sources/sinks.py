"""Writers.  A table is written beside the old one and named by a pointer, so
a reader sees all of a run or nothing of it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from lectern.sources import versions


def shared_folder(spark: SparkSession, label: str) -> str:
    """The name of a new folder where all executors see it: under
    `spark.checkpoint.dir`, or for a local session without it under its own
    temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/lectern/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared folder and read back: what follows starts from
    the files, which outlive any executor."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FOLDERS = 64


def keyed(df: DataFrame, path: str, key: str) -> None:
    """Rows in folders by a hash of their key, sorted by it, for `lookup`."""
    folder = F.pmod(F.xxhash64(key), F.lit(FOLDERS)).cast("int")
    df.withColumn("_folder", folder).repartition("_folder").sortWithinPartitions("_folder", key).write.partitionBy("_folder").parquet(path)


def lookup(spark: SparkSession, path: str, found: DataFrame, key: str) -> DataFrame:
    """`found`, a few rows such as a search gives, with the stored columns of
    their keys: only the folders of those keys are read."""
    folder = F.pmod(F.xxhash64(key), F.lit(FOLDERS)).cast("int")
    few = found.withColumn("_folder", folder)
    folders = [r[0] for r in few.select("_folder").distinct().collect()]
    rows = spark.read.parquet(path).where(F.col("_folder").isin(folders) if folders else F.lit(False))
    return few.join(rows, ["_folder", key], "left").drop("_folder")


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats that have none."""
    nested = {f.name for f in df.schema if isinstance(f.dataType, ArrayType | MapType | StructType)}
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])


def csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).csv(path)


def report(df: DataFrame, path: str) -> None:
    """Rows as indented JSON text, one file: for summaries of a few rows."""
    df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def markdown(df: DataFrame, path: str, title: str, body: str) -> None:
    """A header block and a body for each row."""
    df.select(F.concat_ws("\n", F.concat(F.lit("# "), F.col(title).cast("string")), F.lit(""), F.col(body)).alias("value")).write.mode("overwrite").text(path)


def images(df: DataFrame, path: str) -> None:
    """Rows by visibility and type, as folders."""
    df.write.mode("overwrite").partitionBy("visibility", "type").parquet(path)


def staged(tables: dict[str, DataFrame], root: str, run_id: str, attempts: int = 20) -> int:
    """Write several tables under one run, then name the run: its version is
    written last, so a failed run is never read, and a writer that comes at the
    same time takes the next number.  Returns the run's number."""
    spark = next(iter(tables.values())).sparkSession
    folder = f"run={run_id}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}/{folder}")
    for n in range(attempts):
        last = max(versions.numbers(spark, root), default=0)
        try:
            return versions.publish(spark, root, {"run_id": run_id, "folder": folder, "tables": sorted(tables)}, last)
        except versions.Conflict:
            if n == attempts - 1:
                raise
    return 0


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table of the last run that was named with it."""
    for number in reversed(versions.numbers(spark, root)):
        held = versions.read(spark, root, number)
        if held and name in held["tables"]:
            return spark.read.parquet(f"{root}/{name}/{held['folder']}")
    raise LookupError(f"no run in {root} has a table {name}")
