"""English full-text search over stored postings.

The index has one row for each stem and chunk.  It is written in folders by a
hash of the stem, sorted by stem, so a query reads the row groups of its own
stems and no texts; a stem's rows lie in several files, so a frequent one is
no single task.  Rank is cover density: each shortest stretch that holds all
stems counts .1 / (1 + other words in it).  If no chunk has all stems, each
occurrence of any counts .1.

`TextIndex` follows changes by segments (see `sources.segments`): a chunk that
is written again or deleted leaves the results with the same version in which
its new text enters them, and no other chunk is read.

Defined results: null and empty texts have no rows, and as a chunk's new text
they take it out of the index; a query of stop words alone finds nothing; equal
ranks go by key; a key that occurs in several rows is several texts under one
name and counts as one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.functions.stemming import STOP_WORDS, stem
from lectern.sources import segments

BUCKETS, PARTS, WEIGHT = 64, 8, 0.1
WORDS = re.compile(r"\w+")


def stems_of(text: str, known=stem) -> dict[str, list[int]]:  # noqa: ANN001
    """Stems and their places; stop words take a place but are left out."""
    found: dict[str, list[int]] = {}
    for at, word in enumerate(WORDS.findall(text.lower())):
        if word not in STOP_WORDS:
            found.setdefault(known(word), []).append(at)
    return found


def words_of(text: str, known=None) -> dict[str, list[int]]:  # noqa: ANN001
    """Words as they are, in lower case, and their places."""
    found: dict[str, list[int]] = {}
    for at, word in enumerate(WORDS.findall(text.lower())):
        found.setdefault(word, []).append(at)
    return found


#: What a word of a text becomes in an index.
CONFIGS = {"english": stems_of, "simple": words_of}


def small_batches(spark: SparkSession, rows: int = 500, size: int = 4 << 20) -> None:
    """Texts go to Python `rows` at a time and about `size` bytes at a time, not
    10,000, unless the session asks for fewer: a worker holds a batch, however
    large the table is.  This sets two settings of the session."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(name)
        if not 0 < int(now if now.lstrip("-").isdigit() else 0) <= most:
            spark.conf.set(name, most)


def postings(chunks: DataFrame, key: str = "chunk_id", value: str = "text", config: str = "english") -> DataFrame:
    """stem, key, tf, positions.  Each text is taken apart where it lies; there
    is no shuffle."""

    take_apart = CONFIGS[config]
    small_batches(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(100_000)(stem)
        for batch in batches:
            keys = batch.column(0)
            words, rows, places, ends = [], [], [], [0]

            def made() -> pa.RecordBatch:
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
                return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), keys.take(pa.array(rows, pa.int64())), pa.array(np.diff(ends), pa.int32()), lists], ["stem", key, "tf", "positions"])

            for at, text in enumerate(batch.column(1)):
                for word, found in take_apart(text.as_py(), known).items():
                    words.append(word)
                    rows.append(at)
                    places += found
                    ends.append(len(places))
                # by places too: those of one word can be as many as a text has words
                if len(words) >= 50_000 or len(places) >= 100_000:
                    yield made()
                    words, rows, places, ends = [], [], [], [0]
            yield made()

    return chunks.select(key, value).where(F.col(value) != "").mapInArrow(run, postings_schema(chunks.schema[key]))


def postings_schema(key: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("stem", T.StringType()), key, T.StructField("tf", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def write_index(chunks: DataFrame, path: str, key: str = "chunk_id", value: str = "text") -> None:
    write_postings(postings(chunks, key, value), path, key)


def write_postings(rows: DataFrame, path: str, key: str) -> None:
    rows = rows.select("stem", key, "tf", "positions", bucket(F.col("stem")).alias("bucket"))
    part = F.pmod(F.xxhash64(key), F.lit(PARTS))
    rows.repartition("bucket", part).sortWithinPartitions("bucket", "stem").write.partitionBy("bucket").mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class TextIndex:
    """Stored postings in a folder that follow upserts and deletes of chunks."""

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", value: str = "text") -> None:
        self.spark, self.path, self.key, self.value = spark, path, key, value
        self.schema = spark.read.parquet(f"{path}/schema").schema
        self.config = self.schema["stem"].metadata["config"]

    @classmethod
    def create(cls, chunks: DataFrame, path: str, key: str = "chunk_id", value: str = "text", config: str = "english") -> TextIndex:
        fields = postings_schema(chunks.schema[key]).fields
        fields[0] = T.StructField("stem", T.StringType(), True, {"config": config})
        chunks.sparkSession.createDataFrame([], T.StructType([*fields, T.StructField("bucket", T.IntegerType())])).write.parquet(f"{path}/schema")
        index = cls(chunks.sparkSession, path, key, value)
        index._append(chunks, None)
        return index

    def _write(self, rows: DataFrame, path: str) -> None:
        write_postings(rows, path, self.key)

    def _append(self, chunks: DataFrame | None, gone: DataFrame | None) -> int:
        rows = None if chunks is None else postings(chunks.where(F.col(self.key).isNotNull()), self.key, self.value, self.config)
        return segments.append(self.spark, self.path, self.key, rows, gone, self._write)

    def upsert(self, chunks: DataFrame) -> int:
        """Chunks with new texts, or new ones; returns the version."""
        return self._append(chunks, chunks)

    def delete(self, keys: DataFrame) -> int:
        return self._append(None, keys)

    def merge(self, last: int | None = None) -> int:
        """The last segments (all) become one, without what is gone."""
        return segments.merge(self.spark, self.path, self.key, self.schema, self._write, last)

    def tidy(self, ratio: int = 4) -> int:
        """Merge as long as the last segments together are not `ratio` times
        smaller than the one before them, so a row is written again only when
        the index has grown by a share of its size: segments stay few."""
        held = segments.names(self.spark, self.path)[1]
        sizes = {}
        for s in held:
            sizes[s["number"]] = self.spark.read.parquet(f"{self.path}/rows/{s['folder']}").count() + s["gone"] if s["rows"] else s["gone"]
        last, total = 1, sizes[held[-1]["number"]] if held else 0
        while last < len(held) and total * ratio >= sizes[held[-1 - last]["number"]]:
            total += sizes[held[-1 - last]["number"]]
            last += 1
        return self.merge(last) if last > 1 else segments.names(self.spark, self.path)[0]

    def postings(self) -> DataFrame:
        """stem, key, tf, positions, bucket, segment of what is in the index."""
        return segments.live(self.spark, self.path, self.key, self.schema)

    def of(self, words: list[str]) -> DataFrame:
        """The postings of some words or stems: their folders and row groups."""
        return chosen(self.postings(), words)

    def search(self, query: str, k: int) -> DataFrame:
        return search(self.postings(), query, k, self.key, self.config)


def search(index: DataFrame, query: str, k: int, key: str = "chunk_id", config: str = "english") -> DataFrame:
    """key, rank: the k chunks of highest rank."""
    wanted = sorted(CONFIGS[config](query))
    if not wanted:
        return index.limit(0).select(key, F.lit(0.0).alias("rank"))
    own = chosen(index, wanted)
    counted = own.groupBy(key).agg(F.countDistinct("stem").alias("n"), F.sum("tf").alias("tf"))
    # what a query's chunks are is settled by counts; places are read for those that have all stems
    loose = counted.select(key, F.lit(False).alias("every"), (F.col("tf") * WEIGHT).alias("rank"))
    full = covers(own.join(counted.where(F.col("n") == len(wanted)).select(key), key, "left_semi"), wanted, key).select(key, F.lit(True).alias("every"), "rank")
    best = full.unionByName(loose).select(key, "every", F.round("rank", 6).alias("rank")).orderBy(F.desc("every"), F.desc("rank"), key).limit(k)
    some = F.max("every").over(Window.partitionBy())
    return best.withColumn("some", some).where(F.col("every") | ~F.col("some")).select(key, "rank")


def chosen(index: DataFrame, wanted: list[str]) -> DataFrame:
    own = index.where(F.col("stem").isin(wanted) if wanted else F.lit(False))
    if "bucket" in index.columns and wanted:
        # known to the driver, so that other folders are not listed as input
        folders = index.sparkSession.range(1).select(F.explode(F.array(*[F.lit(w) for w in wanted])).alias("w")).select(bucket(F.col("w"))).distinct().collect()
        own = own.where(F.col("bucket").isin([r[0] for r in folders]))
    return own


def covers(own: DataFrame, wanted: list[str], key: str) -> DataFrame:
    """key, rank of chunks that have all of `wanted`."""
    by_place = Window.partitionBy(key).orderBy("pos")
    places = own.select(key, "stem", F.explode("positions").alias("pos")).withColumn("nth", F.row_number().over(by_place))
    seen = by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = [F.max(F.when(F.col("stem") == w, F.struct("pos", "nth"))).over(seen) for w in wanted]
    starts = places.withColumn("last", F.array(*last)).where(F.forall("last", lambda x: x.isNotNull()))
    spans = starts.withColumn("start", F.array_min("last")).groupBy(key, "start").agg(F.min(F.struct("pos", "nth")).alias("stop"))
    others = (F.col("stop.pos") - F.col("start.pos")) - (F.col("stop.nth") - F.col("start.nth"))
    return spans.groupBy(key).agg(F.sum(WEIGHT / (1 + others)).alias("rank"))
