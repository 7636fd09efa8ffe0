"""Sharding by sampled splitters.

Records are ordered by (MD5 of the text, doc_id), so equal texts lie side by
side.  A size-weighted sample of keys gives quantile boundaries of many fine
ranges, more for a larger input; ranges that turn out overfull are divided again by a sample of their
own.  With the exact bytes of each range known, every range has its exact
place on the byte line from 0 to the total; records of a range take their
places inside it, and equal stretches of the line are the shards.  So shards
differ by about one record's size, whatever the sample drew, and a large
group of equal texts is divided by doc_id among neighbouring shards.

Defined results: a null text counts as empty, a null doc_id sorts before all
others; equal records take neighbouring places.  Extra columns stay; input
columns named like a result are replaced.  An empty table has no shards.
The input is read twice and must give the same rows both times (a table or a
cut of one).
"""

from __future__ import annotations

import bisect
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.llm.common import cut, md5_key, utf8_bytes

Key = tuple[int, int]
KEY, TIE, SIZE, RANGE, BYTE, ROW, FIRST_BYTE, FIRST_ROW = "_lx_key", "_lx_tie", "_lx_size", "_lx_range", "_lx_byte", "_lx_row", "_lx_first_byte", "_lx_first_row"
NULL_ID = -(2**63)
#: What the driver holds: this many boundaries, and 24 sampled keys for each.
MOST_RANGES = 32_768


def key_columns(docs: DataFrame, record_bytes: int) -> DataFrame:
    return docs.withColumns({
        KEY: md5_key(F.col("text")),
        TIE: F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)),
        SIZE: utf8_bytes(F.col("text")) + F.lit(record_bytes),
    })


def range_of(boundaries: list[Key]) -> Column:
    """Number of boundaries at or below a record's key."""
    keys = np.array([k for k, _ in boundaries], dtype=np.int64)
    ties = np.array([t for _, t in boundaries], dtype=np.int64)

    @F.pandas_udf(T.IntegerType())
    def find(key: pd.Series, tie: pd.Series) -> pd.Series:
        k, t = key.to_numpy(np.int64), tie.to_numpy(np.int64)
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        out = low.astype(np.int32)
        for at in np.unique(low[low < high]):
            own = (low == at) & (low < high)
            out[own] = at + np.searchsorted(ties[at : high[own][0]], t[own], "right")
        return pd.Series(out)

    return find(KEY, TIE)


def draw(keys: DataFrame, total: int, samples: int, seed: int) -> list[Key]:
    """About `samples` keys, each record drawn as often as its size asks for:
    the whole part of size * samples / total, and one more by a coin that the
    key itself tosses."""
    expected = F.col(SIZE) * F.lit(samples / max(1, total))
    coin = F.pmod(F.xxhash64(F.lit(seed), KEY, TIE), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = keys.select(KEY, TIE, F.floor(expected + coin).cast("int").alias("n")).where("n > 0")
    return sorted((r[0], r[1]) for r in drawn.collect() for _ in range(r[2]))


def quantiles(sample: list[Key], ranges: int) -> list[Key]:
    return sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []


def weigh(keys: DataFrame, boundaries: list[Key]) -> dict[int, tuple[int, int, bool]]:
    """Bytes and rows of each range, and whether keys in it differ."""
    rows = keys.withColumn(RANGE, range_of(boundaries)).groupBy(RANGE).agg(F.sum(SIZE), F.count("*"), F.min(F.struct(KEY, TIE)) != F.max(F.struct(KEY, TIE)))
    return {r[0]: (r[1], r[2], r[3]) for r in rows.collect()}


def find_boundaries(keys: DataFrame, total: int, ranges: int, per_range: int = 24, overfull: float = 2.0, rounds: int = 4) -> tuple[list[Key], dict]:
    """Boundaries of about `ranges` ranges, and what they hold.  The sample,
    the boundaries and the weights have sizes set by the parameters alone."""
    boundaries = quantiles(draw(keys, total, ranges * per_range, 0), ranges)
    held = weigh(keys, boundaries)
    for again in range(1, rounds + 1):
        large = {k: w[0] for k, w in held.items() if w[0] * ranges > overfull * total and w[2]}
        if not large:
            break
        own = keys.withColumn(RANGE, range_of(boundaries)).where(F.col(RANGE).isin(list(large))).drop(RANGE)
        pieces = sum(-(-w * ranges // total) for w in large.values())
        more: set[Key] = set()
        by_range: dict[int, list[Key]] = {}
        for key in draw(own, sum(large.values()), pieces * per_range, again):
            by_range.setdefault(bisect.bisect_right(boundaries, key), []).append(key)
        for at, sample in by_range.items():
            more.update(quantiles(sample, -(-large.get(at, 0) * ranges // total)))
        if more <= set(boundaries):
            break
        boundaries = sorted({*boundaries, *more})
        held = weigh(keys, boundaries)
    return boundaries, held


def range_count(total: int, shards: int, range_bytes: int) -> int:
    """Ranges of about `range_bytes`, 16 for each shard at least, so that they
    stay as large when the input grows, up to `MOST_RANGES`."""
    return max(16 * shards, min(MOST_RANGES, -(-total // range_bytes)))


def shard_records(docs: DataFrame, shards: int, record_bytes: int = 16, range_bytes: int = 256 << 20) -> DataFrame:
    """`docs` with size, shard and slot (gapless from 0 in each shard)."""
    result = {"size", "shard", "slot"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in result])
    keyed = key_columns(docs, record_bytes)
    keys = cut(keyed.select(KEY, TIE, SIZE), "shard-keys")
    total = keys.agg(F.sum(SIZE)).first()[0] or 0
    boundaries, held = find_boundaries(keys, total, range_count(total, shards, range_bytes))
    ids = sorted(held)
    bytes_before = accumulate((held[i][0] for i in ids), initial=0)
    rows_before = accumulate((held[i][1] for i in ids), initial=0)
    # a row for each range
    starts = F.broadcast(docs.sparkSession.createDataFrame(list(zip(ids, bytes_before, rows_before, strict=False)), f"{RANGE} int, {FIRST_BYTE} long, {FIRST_ROW} long"))

    def shard_of(start: Column, size: Column) -> Column:
        # by a record's middle; twice the middle keeps to whole numbers
        wide = "decimal(38,0)" if 2 * total * shards >= 2**62 else "long"
        middle = (start * 2 + size).cast(wide) * F.lit(shards).cast(wide)
        return F.least(F.lit(shards - 1), whole_division(middle, F.lit(2 * max(1, total)).cast(wide)))

    def placed(rows: DataFrame) -> DataFrame:
        inside = Window.partitionBy(RANGE).orderBy(KEY, TIE, SIZE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn(RANGE, range_of(boundaries)).withColumns({BYTE: F.sum(SIZE).over(inside) - F.col(SIZE), ROW: F.count(F.lit(1)).over(inside) - 1})
        rows = rows.join(starts, RANGE).withColumns({BYTE: F.col(BYTE) + F.col(FIRST_BYTE), ROW: F.col(ROW) + F.col(FIRST_ROW)})
        return rows.withColumn("shard", shard_of(F.col(BYTE), F.col(SIZE)))

    firsts = {r[0]: r[1] for r in placed(keys).groupBy("shard").agg(F.min(ROW)).collect()}
    first = F.element_at(F.array(*[F.lit(firsts.get(i, 0)).cast("long") for i in range(shards)]), F.col("shard") + 1)
    return placed(keyed).withColumns({"size": F.col(SIZE), "slot": F.col(ROW) - first}).select(*docs.columns, "size", "shard", "slot")


def whole_division(column: Column, by: Column) -> Column:
    """The rest goes first, so that the quotient is whole and exact."""
    return ((column - F.pmod(column, by)) / by).cast("int")
