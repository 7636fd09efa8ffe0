"""Texts come to the workers of an index in small batches."""

import pyarrow as pa
from lectern.operators import fulltext
from pyspark.sql import functions as F


def test_batches_are_small(spark):
    names = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    was = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], 10_000)
        docs = spark.range(3_000).coalesce(1).select(F.col("id").alias("chunk_id"), F.repeat(F.lit("a b c "), 20).alias("text"))
        found = fulltext.postings(docs, config="simple")
        assert found.agg(F.count("*"), F.sum("tf"), F.countDistinct("chunk_id")).first()[:] == (9_000, 180_000, 3_000)
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
        assert max(r.n for r in sizes) <= 500
        spark.conf.set(names[0], 7)
        fulltext.small_batches(spark)
        assert spark.conf.get(names[0]) == "7"
    finally:
        for n, v in zip(names, was, strict=True):
            spark.conf.set(n, v)
