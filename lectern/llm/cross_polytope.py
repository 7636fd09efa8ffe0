"""Nearest vectors by cross-polytope hashing, with exact reranking.

A table turns unit vectors by a fast pseudo-rotation (random signs and a
Hadamard transform, three times) and files each under the signed axis that it
is nearest to.  A query looks into the buckets of the `probes` axes nearest to
it in each of `tables` tables, and all that it finds there is ranked by the
exact inner product.  Several `hashes` to a table make finer buckets for more
rows: a bucket is then a tuple of axes, and tuples are probed by what they lose
against the best.

Equal vectors are one vector with its smallest ids, since no query needs more
of them than it returns; the index holds every distinct vector in each table.
Buckets are searched as blocks of rows against blocks of queries, each pair of
blocks in one group, so a bucket of any size is many groups of bounded size.
A group's scores come from one matrix product; what could be among the best is
scored again in a fixed order of sums, so that equal vectors have equal scores
and ties go to the smaller id.

Queries that found fewer vectors than they may return, where there are more,
look into all buckets of one table, which is every row.

Vectors of different lengths are compared by inner product too: all are divided
by the longest norm and get one more coordinate that makes them unit vectors,
after which the nearest angle is the largest inner product.

Defined results: vectors that are null, empty, zero or hold nulls or non-finite
components take no part, nor do rows without an id, nor vectors with another
number of components than most have (of equally frequent numbers, the larger).
Rows of one id and one vector count once; a query never gets its own id.  Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.llm.common import cut

#: Buckets up to which their sizes go to all executors: 24 bytes each.
BROADCAST_BUCKETS = 100_000
#: Rows and queries of a group, about.
BLOCK, QUERY_BLOCK = 4096, 8192
#: Norms this far apart count as equal.
EVEN = 1e-3
SLACK = 1e-9


def width_of(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


def hadamard(x: np.ndarray) -> np.ndarray:
    """The transform of each row, orthonormal."""
    rows, width = x.shape
    half = 1
    while half < width:
        x = x.reshape(rows, -1, 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        half *= 2
    return x.reshape(rows, width) / np.sqrt(width)


class Rotations:
    """Pseudo-rotations drawn from a seed: one for each table and hash."""

    def __init__(self, dim: int, tables: int, hashes: int, seed: int) -> None:
        self.dim, self.width, self.tables, self.hashes = dim, width_of(dim), tables, hashes
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, hashes, 3, self.width))

    def turned(self, x: np.ndarray, table: int, at: int) -> np.ndarray:
        """x: (rows, dim) to (rows, 2 width): how far along each signed axis."""
        y = np.zeros((len(x), self.width))
        y[:, : self.dim] = x
        for signs in self.signs[table, at]:
            y = hadamard(y * signs)
        return np.concatenate([y, -y], axis=1)

    def bucket(self, x: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)
        for at in range(self.hashes):
            out = out * (2 * self.width) + self.turned(x, table, at).argmax(axis=1)
        return out

    def probe(self, x: np.ndarray, table: int, probes: int) -> np.ndarray:
        """(rows, up to `probes`): the nearest buckets."""
        axes = 2 * self.width
        found, loss = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1))
        for at in range(self.hashes):
            y = self.turned(x, table, at)
            order = np.argsort(-y, axis=1, kind="stable")[:, :probes]
            lost = (y.max(axis=1, keepdims=True) - np.take_along_axis(y, order, 1)) ** 2
            loss = (loss[:, :, None] + lost[:, None, :]).reshape(len(x), -1)
            found = (found[:, :, None] * axes + order[:, None, :]).reshape(len(x), -1)
            best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
            found, loss = np.take_along_axis(found, best, 1), np.take_along_axis(loss, best, 1)
        return found


def usable(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id, v: rows that take part."""
    e = F.transform(vector, lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    good = F.col("id").isNotNull() & F.col("v").isNotNull()
    good &= ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    own = rows.select(F.col(id_column).cast("long").alias("id"), e.alias("v")).where(F.coalesce(good, F.lit(False)))
    sizes = own.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    return own.where(F.size("v") == (sizes[0]["dim"] if sizes else 0))


def distinct_vectors(own: DataFrame, every: int, keep: int) -> DataFrame:
    """vid, id (the smallest), ids (the `keep` smallest), asked (whether one
    asks), v of each distinct vector."""
    key = [F.xxhash64("v").alias("one"), F.xxhash64(F.lit(1), "v").alias("two")]
    rows = own.select("id", "v", *key)
    low = Window.partitionBy("one", "two").orderBy("id")
    few = rows.select("one", "two", "id").distinct().withColumn("at", F.row_number().over(low)).where(F.col("at") <= keep).groupBy("one", "two").agg(F.collect_list("id").alias("ids"))
    whole = rows.groupBy("one", "two").agg(F.first("v").alias("v"), F.min("id").alias("id"), F.max(F.col("id") % every == 0).alias("asked"))
    return cut(whole.join(few, ["one", "two"]).withColumn("vid", F.monotonically_increasing_id()), "vectors")


def matrix(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), dim).astype(np.float64)


def lengths(v: np.ndarray) -> np.ndarray:
    most = np.abs(v).max(axis=1, keepdims=True)
    return most * np.linalg.norm(v / most, axis=1, keepdims=True)


def filed(vectors: DataFrame, rotations: Rotations, norm: float, lift: bool, kind: str, tables: int, probes: int = 0) -> DataFrame:
    """vid, id, v (bytes), place, bucket: a row for each table, or for each of
    `probes` probes of each table.  place is the table."""
    dim = rotations.dim - lift

    def unit(v: np.ndarray) -> np.ndarray:
        if not lift:
            return v / lengths(v)
        if probes:
            return np.concatenate([v / lengths(v), np.zeros((len(v), 1))], axis=1)
        x = v / norm
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                own = batch.slice(at, 512)
                v = np.asarray(own.column(2).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
                raw, x = pa.array([row.tobytes() for row in v.astype(kind)], pa.binary()), unit(v)
                for table in range(tables):
                    found = rotations.probe(x, table, probes) if probes else rotations.bucket(x, table)[:, None]
                    again = pa.array(np.repeat(np.arange(len(x)), found.shape[1]))
                    yield pa.RecordBatch.from_arrays([own.column(0).take(again), own.column(1).take(again), raw.take(again), pa.array(np.full(found.size, table, dtype=np.int32)), pa.array(found.reshape(-1))], ["vid", "id", "v", "place", "bucket"])

    return vectors.select("vid", "id", "v").mapInArrow(run, "vid long, id long, v binary, place int, bucket long")


def best_of(q: np.ndarray, x: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and rows, and scores, of the `keep` best rows of each
    query: exact inner products, ties to the smaller id."""
    rough = q @ x.T
    if x.shape[0] > keep:
        bar = np.partition(rough, x.shape[0] - keep, axis=1)[:, x.shape[0] - keep, None]
        size = np.abs(bar) + np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1).max()
        i, j = np.nonzero(rough >= bar - SLACK * size)
    else:
        i, j = np.nonzero(np.ones(rough.shape, dtype=bool))
    score = np.zeros(len(i))
    for k in range(x.shape[1]):
        score += q[i, k] * x[j, k]
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.searchsorted(i, i, "left")
    good = np.arange(len(i)) - first < keep
    return i[good], j[good], score[good]


def search_buckets(index: DataFrame, asked: DataFrame, dim: int, kind: str, buckets: int, keep: int) -> DataFrame:
    """qid, vid, id, score: of each query and bucket block the `keep` best."""
    sizes = index.groupBy("place", "bucket").agg(F.count(F.lit(1)).alias("n"))
    askers = asked.groupBy("place", "bucket").agg(F.count(F.lit(1)).alias("nq"))
    blocks = cut(sizes.join(askers, ["place", "bucket"]).select("place", "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"), F.ceil(F.col("nq") / QUERY_BLOCK).cast("int").alias("turns")), "bucket-blocks")
    if buckets <= BROADCAST_BUCKETS:
        blocks = F.broadcast(blocks)

    def dealt(rows: DataFrame, kind: int, own: str, other: str) -> DataFrame:
        rows = rows.join(blocks, ["place", "bucket"])
        block = F.pmod(F.xxhash64("vid"), F.col(own)).cast("int")
        rows = rows.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return rows.select("place", "bucket", "parts", "turns", F.lit(kind).alias("kind"), "vid", "id", "v")

    key = ["place", "bucket", "parts", "turns"]
    both = dealt(index, 0, "parts", "turns").unionByName(dealt(asked, 1, "turns", "parts"))
    both = both.repartition(*key).sortWithinPartitions(*key, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, x, ids, vids = None, [], None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(5)], axis=1)
            at = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(at[:-1], at[1:], strict=True):
                own, rows = tuple(keys[a, :4]), batch.slice(a, b - a)
                if own != group:
                    group, held, x = own, [], None
                if not keys[a, 4]:
                    held.append((rows.column(5).to_numpy(), rows.column(6).to_numpy(), matrix(rows.column(7), dim, kind)))
                    continue
                if x is None:
                    if not held:
                        continue
                    vids, ids, x = (np.concatenate([h[i] for h in held]) for i in range(3))
                    held = []
                for first in range(0, rows.num_rows, 256):
                    some = rows.slice(first, 256)
                    i, j, score = best_of(matrix(some.column(7), dim, kind), x, ids, keep)
                    yield pa.RecordBatch.from_arrays([some.column(5).take(pa.array(i)), pa.array(vids[j]), pa.array(ids[j]), pa.array(score)], ["qid", "vid", "id", "score"])

    return both.mapInArrow(run, "qid long, vid long, id long, score double")


def nearest(rows: DataFrame, k: int = 20, every: int = 20, id_column: str = "vec_id", vector: str = "embedding", tables: int = 12, probes: int = 10, hashes: int = 1, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose id is divisible by
    `every`, the `k` rows of the largest inner product that are found."""
    spark = rows.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    own = cut(usable(rows, id_column, vector), "usable-vectors")
    vectors = distinct_vectors(own, every, k + 1)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    facts = vectors.agg(F.min(norm), F.max(norm), F.max(F.size("v")), F.count(F.lit(1))).first()
    if not facts[3]:
        return none
    low, high, dim, n = facts
    lift = high > low * (1 + EVEN)
    rotations = Rotations(dim + lift, tables, hashes, seed)
    buckets = tables * (2 * rotations.width) ** hashes
    keep = k + 1  # a query may find itself
    # the numbers go to the buckets as the table has them
    kind = "<f4" if isinstance(rows.schema[vector].dataType.elementType, T.FloatType) else "<f8"
    index = filed(vectors, rotations, high, lift, kind, tables)
    asking = vectors.where("asked")
    found = search_buckets(index, filed(asking, rotations, high, lift, kind, tables, probes), dim, kind, buckets, keep)

    def best(found: DataFrame) -> DataFrame:
        nearest_first = Window.partitionBy("qid").orderBy(F.desc("score"), "id", "vid")
        return found.dropDuplicates(["qid", "vid"]).withColumn("at", F.row_number().over(nearest_first)).where(F.col("at") <= keep).drop("at")

    top = cut(best(found), "nearest")
    few = asking.join(top.groupBy("qid").agg(F.count(F.lit(1)).alias("held")), F.col("vid") == F.col("qid"), "left").where(F.coalesce("held", F.lit(0)) < min(keep, n)).select("vid", "id", "v")
    few = cut(few, "short-queries")
    if not few.isEmpty():
        every_bucket = (2 * rotations.width) ** hashes
        one_table = filed(vectors, rotations, high, lift, kind, 1)
        all_rows = search_buckets(one_table, filed(few, rotations, high, lift, kind, 1, every_bucket), dim, kind, buckets, keep)
        top = cut(best(top.unionByName(all_rows)), "nearest-of-all")
    answers = top.select("qid", "vid", "score").join(vectors.select("vid", "ids"), "vid").select("qid", "score", F.explode("ids").alias("vec_id"))
    queries = own.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.xxhash64("v").alias("one"), F.xxhash64(F.lit(1), "v").alias("two")).distinct()
    queries = queries.join(vectors.where("asked").select("one", "two", F.col("vid").alias("qid")), ["one", "two"]).select("query_id", "qid")
    in_order = Window.partitionBy("query_id", "qid").orderBy(F.desc("score"), "vec_id")
    pairs = queries.join(answers, "qid").where("vec_id <> query_id")
    return pairs.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
