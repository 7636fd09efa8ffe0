"""A stored vector index with inverted lists.

Centroids are fitted once, by k-means on a bounded sample; every vector lies in
the folder of the list of its nearest centroid, so a query reads the lists it
looks into and no other files.  Nearness is the cosine; a vector of length zero
is not stored.

`search` looks into the `probes` nearest lists of each query.  `search_exact`
goes on from there: a list whose members can't be nearer than the k-th found,
by the angle between query and centroid and the widest angle in the list, is
left out, all others are read too, so its results are those of a scan.

The index follows changes by segments (see `sources.segments`): new vectors go
to the lists of the old centroids.  `recall` tells when to fit anew.

Defined results: of rows with one key the vector that comes last in order
counts; null vectors and null keys are not stored; equal cosines, rounded to
six digits, go by key; an empty index finds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.operators.retrieval import dot
from lectern.sources import segments

#: Rows of a file of a list: a list with more lies in several.
FILE_ROWS = 200_000
#: Queries up to which they go to all executors.
BROADCAST_QUERIES = 10_000
DIGITS = 6


def own_rows(vectors: DataFrame, key: str, value: str) -> DataFrame:
    """key, vector, norm; of a key's rows the last."""
    one = vectors.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.max(value).alias("vector"))
    return one.withColumn("norm", F.sqrt(dot(F.col("vector"), F.col("vector")))).where("norm > 0")


def fit(vectors: DataFrame, lists: int, sample: int = 50_000, seed: int = 1, key: str = "vec_id", value: str = "embedding") -> np.ndarray:
    """Centroids of length one, from about `sample` rows at most."""
    rows = own_rows(vectors, key, value).select(key, F.transform("vector", lambda x: x.cast("double") / F.col("norm")).alias("vector"))
    n = rows.count()
    few = rows if n <= sample else rows.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < F.lit(math.ceil(1_000_000 * sample / n)))
    model = KMeans(k=lists, seed=seed, maxIter=15, featuresCol="features", distanceMeasure="cosine").fit(few.select(array_to_vector("vector").alias("features")))
    found = np.array(model.clusterCenters())
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def placed(rows: DataFrame, key: str, centroids: np.ndarray) -> DataFrame:
    """rows (key, vector, norm) with list and cosine to its centroid."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near = np.stack(batch["vector"]).astype(float) / batch["norm"].to_numpy()[:, None] @ centroids.T
                yield batch.assign(list=near.argmax(axis=1).astype(np.int32), near=near.max(axis=1))

    return rows.select(key, "vector", "norm").mapInPandas(run, stored_schema(rows.schema[key], rows.schema["vector"].dataType))


def stored_schema(key: T.StructField, vector: T.DataType) -> T.StructType:
    """list comes last, as the folders have it."""
    return T.StructType([key, T.StructField("vector", vector), T.StructField("norm", T.DoubleType()), T.StructField("near", T.DoubleType()), T.StructField("list", T.IntegerType())])


def _write(key: str):  # noqa: ANN202
    def write(rows: DataFrame, path: str) -> None:
        # lists are dealt by size: Spark splits and joins them to files of about this many rows
        dealt = rows.hint("rebalance", F.col("list"))
        dealt.sortWithinPartitions("list", key).write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("list").parquet(path)

    return write


class VectorIndex:
    """An index in a folder; `key` names the column of ids."""

    def __init__(self, spark: SparkSession, path: str, key: str = "vec_id") -> None:
        self.spark, self.path, self.key = spark, path, key

    @classmethod
    def create(cls, vectors: DataFrame, path: str, lists: int = 100, sample: int = 50_000, seed: int = 1, key: str = "vec_id", value: str = "embedding") -> VectorIndex:
        """Fit the centroids and write all vectors."""
        index = cls(vectors.sparkSession, path, key)
        centroids = fit(vectors, lists, sample, seed, key, value)
        rows = [(i, c.tolist()) for i, c in enumerate(centroids)]
        index.spark.createDataFrame(rows, "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        index.spark.createDataFrame([], stored_schema(vectors.schema[key], vectors.schema[value].dataType)).write.parquet(f"{path}/schema")
        index.upsert(vectors, value)
        return index

    def centroids(self) -> np.ndarray:
        """A number of rows that was set when the index was made."""
        return np.array([r["centroid"] for r in sorted(self.spark.read.parquet(f"{self.path}/centroids").collect(), key=lambda r: r["list"])])

    def _schema(self) -> T.StructType:
        return self.spark.read.parquet(f"{self.path}/schema").schema

    def upsert(self, vectors: DataFrame, value: str = "embedding") -> int:
        """Add vectors; those that are there under the same keys are replaced."""
        rows = placed(own_rows(vectors, self.key, value), self.key, self.centroids())
        return segments.append(self.spark, self.path, self.key, rows, vectors if segments.names(self.spark, self.path)[1] else None, _write(self.key))

    def delete(self, keys: DataFrame) -> int:
        return segments.append(self.spark, self.path, self.key, None, keys, _write(self.key))

    def merge(self, last: int | None = None) -> int:
        return segments.merge(self.spark, self.path, self.key, self._schema(), _write(self.key), last)

    def rows(self) -> DataFrame:
        """key, vector, norm, near, list, segment of what is in the index."""
        return segments.live(self.spark, self.path, self.key, self._schema())

    def sizes(self) -> DataFrame:
        """list, n and least cosine to the centroid."""
        return self.rows().groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("least"))

    def _queries(self, queries: DataFrame, value: str) -> DataFrame:
        doubles = F.transform("vector", lambda x: x.cast("double"))
        return own_rows(queries, self.key, value).select(F.col(self.key).alias("query"), doubles.alias("asked"), F.col("norm").alias("length"))

    def _lists(self, queries: DataFrame, probes: int) -> DataFrame:
        """query, asked, length, list, toward: the nearest lists of each query."""
        centroids = self.centroids()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    near = np.stack(batch["asked"]) / batch["length"].to_numpy()[:, None] @ centroids.T
                    order = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                    n = order.shape[1]
                    yield pd.DataFrame({c: np.repeat(batch[c].to_numpy(), n) for c in ("query", "asked", "length")} | {"list": order.ravel().astype(np.int32), "toward": np.take_along_axis(near, order, 1).ravel()})

        return queries.mapInPandas(run, T.StructType([*queries.schema, T.StructField("list", T.IntegerType()), T.StructField("toward", T.DoubleType())]))

    def _best(self, asked: DataFrame, k: int) -> DataFrame:
        """query, key, cosine: the k best of the lists asked for.  Which lists those are is known before the vectors are read."""
        asked = asked.select("query", "asked", "length", "list")
        wanted = sorted(r[0] for r in asked.select("list").distinct().collect())  # at most the number of lists
        rows = self.rows().where(F.col("list").isin(wanted) if wanted else F.lit(False))
        few = asked.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
        pairs = rows.join(F.broadcast(asked) if few else asked, "list")
        scored = pairs.select("query", self.key, F.round(dot(F.col("vector"), F.col("asked")) / (F.col("norm") * F.col("length")), DIGITS).alias("cosine"))
        return self._top(scored, k)

    def _top(self, scored: DataFrame, k: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), self.key))
        return scored.withColumn("place", place).where(F.col("place") <= k).select("query", "place", self.key, "cosine")

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, value: str = "embedding") -> DataFrame:
        """query, place, key, cosine from the `probes` nearest lists."""
        return self._best(self._lists(self._queries(queries, value), probes), k)

    def search_exact(self, queries: DataFrame, k: int = 10, probes: int = 8, value: str = "embedding") -> DataFrame:
        """What a scan of all vectors would find."""
        lists = self._lists(self._queries(queries, value), len(self.centroids()))
        in_order = Window.partitionBy("query").orderBy(F.desc("toward"), "list")
        lists = lists.withColumn("nth", F.row_number().over(in_order)).join(F.broadcast(self.sizes()), "list")
        first = self._best(lists.where(F.col("nth") <= probes), k)
        bars = first.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("cosine")).alias("bar"))
        # no member is nearer than the angle to the centroid less the widest angle in the list

        def angle(cosine: str) -> Column:
            return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))

        reach = F.cos(F.greatest(F.lit(0.0), angle("toward") - angle("least"))) + 10.0 ** (1 - DIGITS)
        rest = lists.where(F.col("nth") > probes).join(bars, "query", "left").where(F.col("bar").isNull() | (reach >= F.col("bar")))
        more = self._best(rest, k)
        return self._top(first.unionByName(more).select("query", self.key, "cosine"), k)


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> float:
    """The share of the rows of `exact` that are in `found`."""
    both = exact.join(found, ["query", key], "left_semi").count()
    return both / max(1, exact.count())
