"""Pages that arrive over time, kept as chunks.

Three tables grow by micro-batch, each batch in a folder of its own, so a
batch that is run again after a failure writes the same folders again:

* pages: as they came, dealt to folders by a hash of their document;
* documents: the documents that a batch touched;
* chunks: of these documents, made from all their pages so far; of a page that
  came more than once the last batch's version counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators import chunking, merge

BUCKETS = 64


def ingest(spark: SparkSession, pages_folder: str, folder: str, checkpoint: str, key: str = "doc_id", schema: str = "doc_id long, page int, text string") -> StreamingQuery:
    """Runs over all files that are there, then stops."""
    pages = spark.readStream.schema(schema).parquet(pages_folder)

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        now = f"batch_id={batch_id}"
        bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
        # within a batch, equal pages go by their text, so that a second run decides alike
        own = merge.latest(batch, [key, "page"], ["text"])
        own.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/pages/{now}")
        batch.select(F.col(key).alias("document_id")).distinct().write.mode("overwrite").parquet(f"{folder}/documents/{now}")
        touched = batch.sparkSession.read.parquet(f"{folder}/documents/{now}")
        buckets = [r[0] for r in touched.select(F.pmod(F.xxhash64("document_id"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
        stored = batch.sparkSession.read.parquet(f"{folder}/pages").where(F.col("bucket").isin(buckets) & (F.col("batch_id") <= batch_id))
        held = stored.join(touched, stored[key] == touched["document_id"], "left_semi")
        last = merge.latest(held, [key, "page"], ["batch_id"]).drop("batch_id", "bucket")
        chunking.chunks(last, key, "page").write.mode("overwrite").parquet(f"{folder}/chunks/{now}")

    return pages.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of each document's last batch."""
    last = spark.read.parquet(f"{folder}/documents").groupBy("document_id").agg(F.max("batch_id").alias("batch_id"))
    return spark.read.parquet(f"{folder}/chunks").join(last, ["document_id", "batch_id"], "left_semi").drop("batch_id")


def late_counts(events: DataFrame, width: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Events by type and window; what comes later than `late` is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
