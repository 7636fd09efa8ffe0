"""What several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte for byte, the words of the contracts: runs without these are words.
WORD_BREAKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    `spark.checkpoint.dir` names it on a cluster.  Only a local session without
    that setting gets a folder of its own, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/lectern"


def cut(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write `df` to the shared folder and read it back: later jobs start from
    the files, which outlive any executor.  Whoever owns the folder clears it."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def md5_key(column: Column) -> Column:
    """60 bits of the MD5 of a string, as a non-negative long (null: of '')."""
    return F.conv(F.substring(F.md5(F.coalesce(column, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def utf8_bytes(column: Column) -> Column:
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")


def word_count(column: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Whole texts go to Python `rows` at a time, not 10,000, and about `size`
    bytes at a time, unless the session already asks for fewer: a batch is held
    in memory on both sides.  This sets two settings of the session."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(name)
        if not 0 < int(now if now.lstrip("-").isdigit() else 0) <= most:
            spark.conf.set(name, most)
