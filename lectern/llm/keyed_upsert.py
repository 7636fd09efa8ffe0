"""Keyed upserts into sorted files, copy on write.

A table lies in files of one folder, sorted by its key.  The file that a key
falls into is its home; changes go to the homes of their keys, and only files
whose rows then differ are written anew.

1. Starting files.  Rows are dealt by ranges of (key, hash of the row), so that
   copies of one key are divided too; the counts of the ranges give each row
   its rank, and the rank its file.  A file is written by one task.
2. Changes.  The last change of each key is found by a maximum that is combined
   before it is shuffled, so a key with a third of all changes arrives as a row
   for each task.
3. Replay.  Changes and the rows of their homes go by
   `repartitionAndSortWithinPartitions` to ranges of keys: quantiles of the
   keys themselves, so a home that gets most of the rows is divided among
   tasks.  A generator folds the changes of a key and applies them to its rows
   as they pass by; nothing is held but the state of one key.
4. Cutting.  The rows are spooled into the shared folder with their places.
   Counts by home and range give every row its place among all new rows, and
   the sizes of the new files follow from arithmetic.  They are written beside
   the old ones, and the files they replace are deleted last.

What comes to the driver or is broadcast: names, counts and first keys of files
and of ranges.  The files have a number set by the caller, the ranges one set by
the session.

Defined results: rows with a null key are not stored, changes with a null key
are ignored; copies of a key in the table all take its change, each in the file
in which it lies (a key that begins several files has the last of them as its
home, and copies in earlier files stay as they are); repeated changes count
once; of changes equal in sequence and id the one with the larger values wins;
without starting files nothing is written.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate, groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import cut, shared_folder

HOME, RANGE, PLACE, DIFFERS, RANK, FILE = "_lx_home", "_lx_range", "_lx_place", "_lx_differs", "_lx_rank", "_lx_file"
CHANGE, ROW = 0, 1
LEAST = -(2**63)


class Stored(NamedTuple):
    """A file: its name in the folder, its first key and its rows."""

    name: str
    first: int
    rows: int


def ranges(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def file_number(bounds: list[int]) -> Column:
    """Of a rank, the number of `bounds` at or below it."""
    stops = np.array(bounds, dtype=np.int64)

    @F.pandas_udf(T.IntegerType())
    def find(rank: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(stops, rank.to_numpy(np.int64), "right").astype(np.int32))

    return find(RANK)


def write_files(ranked: DataFrame, columns: list[str], stops: list[int], folder: str) -> None:
    """Rows below stops[0] to the first file, those below stops[1] to the next,
    and so on, each in the order of its ranks."""
    dealt = ranked.withColumn(FILE, file_number(stops[:-1])).repartitionById(len(stops), F.col(FILE)).sortWithinPartitions(RANK)
    dealt.select(*columns).write.option("maxRecordsPerFile", 0).mode("append").parquet(folder)


def stored(spark: SparkSession, folder: str, key: str) -> list[Stored]:
    """The files of a folder in the order of their keys."""
    rows = spark.read.parquet(folder).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n"))
    # names begin with the number of the task that wrote the file
    return sorted((Stored(r["name"], r["first"], r["n"]) for r in rows.collect()), key=lambda f: (f.first, f.name))


def write_sorted(rows: DataFrame, key: str, per_file: int, folder: str) -> list[Stored]:
    """`rows` in files of `per_file` rows, the last with what is left."""
    spark = rows.sparkSession
    rows = rows.where(F.col(key).isNotNull())
    tie = F.xxhash64(*rows.columns)
    dealt = rows.repartitionByRange(ranges(spark), F.col(key), tie).sortWithinPartitions(F.col(key), tie)
    place = F.monotonically_increasing_id()
    dealt = cut(dealt.select("*", F.spark_partition_id().alias(RANGE), place.bitwiseAND((1 << 33) - 1).alias(PLACE)), "upsert-sorted")
    held = {r[0]: r[1] for r in dealt.groupBy(RANGE).count().collect()}
    total = sum(held.values())
    if not total:
        return []
    order = sorted(held)
    first = dict(zip(order, accumulate((held[k] for k in order), initial=0), strict=False))
    offset = F.element_at(F.array(*[F.lit(first.get(k, 0)).cast("long") for k in range(order[-1] + 1)]), F.col(RANGE) + 1)
    write_files(dealt.withColumn(RANK, offset + F.col(PLACE)), rows.columns, [*range(per_file, total, per_file), total], folder)
    return stored(spark, folder, key)


def home_of(files: list[Stored], key: str) -> Column:
    """The number of the last file that begins at or below a key, or 0."""
    firsts = np.array([f.first for f in files], dtype=np.int64)

    @F.pandas_udf(T.IntegerType())
    def find(keys: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(firsts, keys.to_numpy(np.int64), "right") - 1, 0).astype(np.int32))

    return find(F.col(key).cast("long"))


def last_changes(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each key the change that comes last by `order`."""
    rest = [c for c in changes.columns if c != key and c not in order]
    last = F.max(F.struct(*order, *rest)).alias("_lx_last")
    return changes.where(F.col(key).isNotNull()).groupBy(key).agg(last).select(key, *[F.col(f"_lx_last.{c}").alias(c) for c in (*order, *rest)])


def same(a: object, b: object) -> bool:
    """Nulls are equal, and so are NaNs."""
    return a == b or (a is not None and a != a and b is not None and b != b)


def replay(key_at: int, set_at: list[int], width: int) -> Callable[[int, Iterator], Iterator[tuple]]:
    """A generator over sorted ((home, key, tag, seq, change_id), values): gives
    (home, range, place, differs, row), place and row null for a row that goes."""

    def run(part: int, items: Iterator) -> Iterator[tuple]:
        for home, of_home in groupby(items, key=lambda x: x[0][0]):
            place = 0
            for key, of_key in groupby(of_home, key=lambda x: x[0][1]):
                change, rows = None, 0
                for (_, _, tag, *_), values in of_key:
                    if tag == CHANGE:  # they come first, the last one last
                        change = values
                        continue
                    rows += 1
                    if change is None:
                        row, differs = tuple(values), False
                    elif change[0]:
                        yield (home, part, None, True, *[None] * width)
                        continue
                    else:
                        row = list(values)
                        differs = not all(same(row[at], v) for at, v in zip(set_at, change[1], strict=True))
                        for at, v in zip(set_at, change[1], strict=True):
                            row[at] = v
                    yield (home, part, place, differs, *row)
                    place += 1
                if not rows and change is not None and not change[0]:
                    row = [None] * width
                    row[key_at] = key
                    for at, v in zip(set_at, change[1], strict=True):
                        row[at] = v
                    yield (home, part, place, True, *row)
                    place += 1

    return run


def balanced(rows: int, most: int) -> list[int]:
    """The fewest sizes of up to `most`, at most one apart, larger first."""
    n = -(-rows // most)
    return [rows // n + (i < rows % n) for i in range(n)]


def new_files(sizes: list[tuple[bool, int]], most: int) -> list[int]:
    """sizes: (is new, rows) of all files in order.  A new file joins the file
    before it, as grown, if that is new too and both have room in one."""
    out: list[list] = []
    for new, rows in sizes:
        if new and out and out[-1][0] and out[-1][1] + rows <= most:
            out[-1][1] += rows
        else:
            out.append([new, rows])
    return [rows for new, rows in out if new]


def upsert(spark: SparkSession, folder: str, files: list[Stored], schema: T.StructType, changes: DataFrame, key: str, order: list[str], set_columns: list[str], per_file: int, deletes: str) -> list[Stored]:
    """Apply `changes` (home, key, order, `deletes`, set_columns; one of each
    key) to a folder of `files`; the files that are there afterwards."""
    touched = sorted(r[0] for r in changes.select(HOME).distinct().collect())
    if not touched:
        return files
    columns = schema.fieldNames()
    names = spark.createDataFrame([(files[h].name, h) for h in touched], f"_lx_name string, {HOME} int")
    old = spark.read.schema(schema).parquet(*[f"{folder}/{files[h].name}" for h in touched]).select("*", F.col("_metadata.file_name").alias("_lx_name"))
    old = old.join(F.broadcast(names), "_lx_name").select(HOME, *columns)
    n = ranges(spark)
    keys = old.select(F.col(key).cast("double").alias("k")).unionAll(changes.select(F.col(key).cast("double").alias("k")))
    bounds = sorted(set(keys.approxQuantile("k", [i / n for i in range(1, n)], 1 / (4 * n))))
    k, seq, change_id = columns.index(key), *order
    rows = old.rdd.map(lambda r: ((r[0], r[k + 1], ROW, 0, 0), tuple(r[1:])))
    plus = changes.rdd.map(lambda r: ((r[HOME], r[key], CHANGE, LEAST if r[seq] is None else r[seq], LEAST if r[change_id] is None else r[change_id]), (r[deletes], tuple(r[c] for c in set_columns))))
    dealt = rows.union(plus).repartitionAndSortWithinPartitions(n, lambda x: bisect.bisect_right(bounds, x[1]))
    out = dealt.mapPartitionsWithIndex(replay(k, [columns.index(c) for c in set_columns], len(columns)))
    nullable = [T.StructField(f.name, f.dataType, True) for f in schema]
    marks = [T.StructField(HOME, T.IntegerType()), T.StructField(RANGE, T.IntegerType()), T.StructField(PLACE, T.LongType()), T.StructField(DIFFERS, T.BooleanType())]
    spool = cut(spark.createDataFrame(out, T.StructType([*marks, *nullable]), verifySchema=False), "upsert-spool")

    held = spool.groupBy(HOME, RANGE).agg(F.count(PLACE).alias("n"), F.max(DIFFERS).alias("differs")).orderBy(HOME, RANGE).collect()
    changed = {r[HOME] for r in held if r["differs"]}
    if not changed:
        return files
    now = {h: 0 for h in changed}
    starts, before = [], 0
    for r in held:
        if r[HOME] in changed:
            starts.append((r[HOME], r[RANGE], before))
            now[r[HOME]] += r["n"]
            before += r["n"]
    sizes = [x for h, f in enumerate(files) for x in ([(True, s) for s in balanced(now[h], per_file)] if h in changed else [(False, f.rows)])]
    stops = list(accumulate(new_files(sizes, per_file)))
    if stops:
        offsets = spark.createDataFrame(starts, f"{HOME} int, {RANGE} int, _lx_start long")
        ranked = spool.where(F.col(PLACE).isNotNull()).join(F.broadcast(offsets), [HOME, RANGE]).withColumn(RANK, F.col("_lx_start") + F.col(PLACE))
        write_files(ranked, columns, stops, folder)
    delete(spark, [f"{folder}/{files[h].name}" for h in sorted(changed)])
    return stored(spark, folder, key) if stops or len(changed) < len(files) else []


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Through Hadoop, which knows the shared folder's file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    for name in paths:
        where = path(name)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, False)


def file_digests(spark: SparkSession, folder: str, files: list[Stored], key: str, sums: dict[str, Column]) -> DataFrame:
    """_lx_name, first_key, n_rows, `sums` and the SHA-256 of the keys, joined
    by commas in the order of the file: read back, a file a task, streaming."""
    listed = spark.createDataFrame([(f.name, i) for i, f in enumerate(files)], f"_lx_name string, {FILE} int")
    if not files:
        return listed.select("_lx_name", *[F.lit(None).cast("long").alias(c) for c in ("first_key", "n_rows", *sums)], F.lit(None).cast("string").alias("keys_sha256"))
    n = min(len(files), ranges(spark))
    rows = spark.read.parquet(folder).select(F.col("_metadata.file_name").alias("_lx_name"), F.col("_metadata.row_index").alias(PLACE), F.col(key).cast("long").alias("_lx_key"), *[c.cast("long").alias(name) for name, c in sums.items()])
    rows = rows.join(F.broadcast(listed), "_lx_name").repartitionById(n, F.floor(F.col(FILE).cast("long") * n / len(files)).cast("int")).sortWithinPartitions(FILE, PLACE)
    names = list(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, first, n, digest, totals = None, 0, 0, None, [0] * len(names)

        def done() -> pa.RecordBatch:
            values = [file, first, n, digest.hexdigest(), *totals]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * len(names)), strict=True)], [FILE, "first_key", "n_rows", "keys_sha256", *names])

        for batch in batches:
            of, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            columns = [batch.column(2 + i).to_numpy() for i in range(len(names))]
            at = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(at[:-1], at[1:], strict=True):
                if a == b:
                    continue
                if of[a] != file:
                    if digest is not None:
                        yield done()
                    file, first, n, digest, totals = int(of[a]), int(keys[a]), 0, hashlib.sha256(), [0] * len(names)
                digest.update((b"," if n else b"") + ",".join(map(str, keys[a:b].tolist())).encode())
                n += b - a
                totals = [t + int(c[a:b].sum()) for t, c in zip(totals, columns, strict=True)]
        if digest is not None:
            yield done()

    found = rows.select(FILE, "_lx_key", *names).mapInArrow(run, f"{FILE} int, first_key long, n_rows long, keys_sha256 string, " + ", ".join(f"{c} long" for c in names))
    return found.join(F.broadcast(listed), FILE).drop(FILE)


def crc32(text: Column) -> Column:
    return F.crc32(text.cast("string").cast("binary"))


def upsert_clients(clients: DataFrame, changes: DataFrame, folder: str, most_files: int = 1500) -> tuple[list[Stored], list[Stored], int]:
    """`clients` with crc32(client_id) % 7 > 3 in files of M rows in `folder`,
    then `changes` into them: files at first, files now, and M."""
    spark = clients.sparkSession
    per_file = 1 + clients.count() // most_files
    files = write_sorted(clients.where(crc32(F.col("client_id")) % 7 > 3), "client_id", per_file, folder)
    if not files:
        return [], [], per_file
    mode = F.element_at(F.array(*[F.lit(zlib.crc32(str(f.first).encode()) % 10) for f in files]), F.col(HOME) + 1)
    set_columns = ["source", "segment", "city", "balance"]
    last = last_changes(changes.select("client_id", "seq", "change_id", "op", *set_columns), "client_id", ["seq", "change_id"])
    placed = last.withColumn(HOME, home_of(files, "client_id")).withColumn("_lx_mode", mode).where("_lx_mode <= 7")
    gone = F.coalesce((F.col("op") == "D") | (crc32(F.col("change_id")) % 8 < F.col("_lx_mode")), F.lit(False))
    plan = cut(placed.select(HOME, "client_id", "seq", "change_id", gone.alias("_lx_gone"), *set_columns), "upsert-changes")
    now = upsert(spark, folder, files, clients.schema, plan, "client_id", ["seq", "change_id"], set_columns, per_file, "_lx_gone")
    return files, now, per_file
