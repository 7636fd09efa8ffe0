"""Vector index and numeric image kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.retrieval import cosine, dot


def unit(vectors: DataFrame, value: str = "embedding") -> DataFrame:
    """Vectors of length one; zero vectors stay as they are."""
    norm = F.sqrt(dot(F.col(value), F.col(value)))
    return vectors.withColumn(value, F.transform(value, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0)))


class NearIndex:
    """Random projections over unit vectors: candidates share a bucket of one
    of the tables, and are ranked by their exact cosine.  The exact scan is
    `retrieval.vector_search`."""

    def __init__(self, vectors: DataFrame, key: str = "vec_id", tables: int = 8, width: float = 0.6, seed: int = 1) -> None:
        self.key = key
        self.rows = unit(vectors).select(key, "embedding", array_to_vector("embedding").alias("features"))
        self.model = BucketedRandomProjectionLSH(inputCol="features", outputCol="buckets", bucketLength=width, numHashTables=tables, seed=seed).fit(self.rows)

    def search(self, probes: DataFrame, k: int) -> DataFrame:
        """probe, key, cosine: the k nearest found for each probe."""
        from pyspark.sql.window import Window

        own = self.model.transform(self.rows).select(self.key, "embedding", F.posexplode("buckets").alias("t", "b")).withColumn("b", F.col("b").cast("string"))
        asked = self.model.transform(unit(probes).select(F.col(self.key).alias("probe"), F.col("embedding").alias("asked"), array_to_vector("embedding").alias("features"))).select("probe", "asked", F.posexplode("buckets").alias("t", "b")).withColumn("b", F.col("b").cast("string"))
        pairs = own.join(asked, ["t", "b"]).dropDuplicates([self.key, "probe"]).select("probe", self.key, F.round(cosine(F.col("embedding"), F.col("asked")), 6).alias("cosine"))
        place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("cosine"), self.key))
        return pairs.withColumn("place", place).where(F.col("place") <= k).drop("place")


def average_hash(grey: np.ndarray, side: int = 8) -> str:
    """Hex of which cells of a side x side grid are brighter than their mean;
    leading zeros are lost, as in a number."""
    h, w = grey.shape
    rows, cols = np.linspace(0, h, side + 1).astype(int), np.linspace(0, w, side + 1).astype(int)
    cells = np.array([[grey[rows[i] : max(rows[i + 1], rows[i] + 1), cols[j] : max(cols[j + 1], cols[j] + 1)].mean() for j in range(side)] for i in range(side)])
    return f"{int(''.join('1' if x else '0' for x in (cells > cells.mean()).ravel()), 2):x}"


def image_hashes(images: DataFrame) -> DataFrame:
    """id, hash of grey images given as (id, width, height, pixels)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [average_hash(np.frombuffer(p, dtype=np.uint8).reshape(h, w).astype(float)) for w, h, p in zip(batch["width"], batch["height"], batch["pixels"], strict=True)]
            yield pd.DataFrame({"id": batch["id"], "hash": found})

    return images.select("id", "width", "height", "pixels").mapInPandas(run, "id long, hash string")
