"""Scans.  Schemas are declared, so no pass over the data infers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lectern import schemas


def jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One object a line; blank lines are skipped, broken ones raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def ocr_pages(spark: SparkSession, folder: str) -> DataFrame:
    """All `*_ocr.json` below a folder as pages; broken files are left out.  A
    page without a number gets its place among the files of its folder."""
    raw = StructType([*schemas.OCR_PAGE.fields, StructField("_corrupt_record", StringType())])
    rows = spark.read.schema(raw).option("recursiveFileLookup", True).option("pathGlobFilter", "*_ocr.json").option("multiLine", True).option("mode", "PERMISSIVE").json(folder)
    rows = rows.select("*", F.col("_metadata.file_path").alias("path")).where("_corrupt_record IS NULL").drop("_corrupt_record")
    from pyspark.sql.window import Window

    folder_of = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    place = F.row_number().over(Window.partitionBy(folder_of).orderBy("path")) - 1
    return rows.select(folder_of.alias("folder"), F.coalesce("page_number", place).alias("page_number"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "path")


def first_text(spark: SparkSession, pattern: str) -> DataFrame:
    """The text of the first file of a pattern, by path."""
    rows = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.orderBy("path").limit(1)


def image_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Image records of JSON reports, one row each, keyed by page."""
    return spark.read.schema(schemas.IMAGE_REPORT).option("multiLine", True).json(path).select(F.explode("images").alias("image")).select("image.*")


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, extension, bytes of the files below a folder; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return rows.select("path", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extension"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def manifest(listing: DataFrame) -> DataFrame:
    """Count and bytes by extension."""
    return listing.groupBy("extension").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def reports(spark: SparkSession, folder: str, pattern: str, schema: StructType) -> DataFrame:
    """Report files of one kind; the document id of the path wins over the
    one in the body."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("multiLine", True).json(folder)
    found = F.regexp_extract(F.col("_metadata.file_path"), r"/documents/([^/]+)/", 1)
    return rows.withColumn("document_id", F.coalesce(F.nullif(found, F.lit("")), F.col("document_id")) if "document_id" in schema.names else found)


def jdbc(spark: SparkSession, url: str, name: str, partition: str | None = None, bounds: tuple[int, int] = (0, 1), parts: int = 8) -> DataFrame:
    """A table of a database, read in parallel by ranges of a column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if partition:
        reader = reader.option("partitionColumn", partition).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()
