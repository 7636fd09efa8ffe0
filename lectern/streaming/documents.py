"""Documents from pages that arrive over time, with the pages as state.

Each document's pages are keyed state: a batch reads and writes the state of the
documents that it has pages of, however many came before.  A document is
finished when the watermark has passed its last page's time by `idle`: all its
pages go out together, whatever order they came in, and are chunked in that
batch.  A page after that is a change: the document goes out again as a whole.
State is forgotten when nothing has come for `retain`.

Defined results: of a page that came more than once the latest counts, of equal
times the larger text; rows without a document or a page number are left out; a
page without a time counts as the oldest; pages behind the watermark, which
stays `idle` behind the latest page of all, are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lectern.operators import chunking

PAGES = "doc_id long, page int, text string, ts timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Pages(StatefulProcessor):
    """doc_id to its pages; two times: when it goes out (0 if it has), when it is
    forgotten.  The timer is for the first of them."""

    def __init__(self, idle: timedelta, retain: timedelta) -> None:
        self.idle, self.retain = (int(x.total_seconds() * 1000) for x in (idle, max(idle, retain)))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page int", "text string, at long")
        self.times = handle.getValueState("times", "out long, forget long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        # each call to the state is a message to the JVM: pages of a document that is new are not asked for
        old = self.times.get()
        new: dict[int, tuple[int, str]] = {}
        last = None
        for row in rows:
            page = (row["at"], "" if row["text"] is None else row["text"])
            new[row["page"]] = max(page, new.get(row["page"], page))
            last = page[0] if last is None else max(last, page[0])
        if last is None:
            return iter(())
        for number, (at, text) in new.items():
            held = self.pages.getValue((number,)) if old else None
            if held is None or (at, text) > (held[1], "" if held[0] is None else held[0]):
                self.pages.updateValue((number,), (text, at))
        # a change to a finished document ends it again, after the same time
        seen = max(last, timerValues.getCurrentWatermarkInMs() - self.idle)
        now = (max(seen + self.idle, old[0] if old and old[0] else 0), max(seen + self.retain, old[1] if old else 0))
        if old is None or tuple(old) != now:
            # one timer at a time: a document that has gone out waits to be forgotten
            was = (old[0] or old[1]) if old else None
            if was != now[0]:
                if was:
                    self.handle.deleteTimer(was)
                self.handle.registerTimer(now[0])
            self.times.update(now)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        times = self.times.get()
        if times is None:
            return
        out, forget = times
        at = expiredTimerInfo.getExpiryTimeInMs()
        if out and at >= out:
            for page, text in sorted((page[0], value[0]) for page, value in self.pages.iterator()):
                yield Row(doc_id=key[0], page=page, text=text)
            if at < forget:
                self.times.update((0, forget))
                self.handle.registerTimer(forget)
        if at >= forget:
            self.pages.clear()
            self.times.clear()

    def close(self) -> None:
        pass


def finished(pages: DataFrame, idle: timedelta = timedelta(minutes=10), retain: timedelta = timedelta(days=30)) -> DataFrame:
    """doc_id, page, text of documents as they are finished; `pages` streams."""
    # the first watermark is 0, and what lies at it is late
    first = F.timestamp_millis(F.lit(1))
    own = pages.where("doc_id IS NOT NULL AND page IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), "text", F.coalesce("ts", first).alias("ts"))
    timed = own.withWatermark("ts", f"{int(idle.total_seconds() * 1000)} milliseconds").withColumn("at", F.unix_millis("ts"))
    return timed.groupBy("doc_id").transformWithState(Pages(idle, retain), "doc_id long, page int, text string", "append", "eventTime")


def ingest(spark: SparkSession, pages_folder: str, folder: str, checkpoint: str, idle: timedelta = timedelta(minutes=10), retain: timedelta = timedelta(days=30), files: int = 1000) -> StreamingQuery:
    """Chunks of finished documents, a folder for each batch; runs over all
    files that are there, `files` to a batch, then stops."""
    return start(spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files).parquet(pages_folder), folder, checkpoint, idle, retain)


def start(pages: DataFrame, folder: str, checkpoint: str, idle: timedelta = timedelta(minutes=10), retain: timedelta = timedelta(days=30)) -> StreamingQuery:
    """`ingest`, from any stream of doc_id, page, text, ts."""
    pages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def chunked(batch: DataFrame, batch_id: int) -> None:
        # the state is read and written by the first of these; the rest starts from its files
        now = f"batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(f"{folder}/pages/{now}")
        own = batch.sparkSession.read.parquet(f"{folder}/pages/{now}")
        own.select(F.col("doc_id").alias("document_id")).distinct().write.mode("overwrite").parquet(f"{folder}/documents/{now}")
        chunking.chunks(own, "doc_id", "page").write.mode("overwrite").parquet(f"{folder}/chunks/{now}")

    return finished(pages, idle, retain).writeStream.foreachBatch(chunked).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of each document as it was last finished; AnalysisException
    before any batch."""
    last = spark.read.parquet(f"{folder}/documents").groupBy("document_id").agg(F.max("batch_id").alias("batch_id"))
    return spark.read.parquet(f"{folder}/chunks").join(last, ["document_id", "batch_id"], "left_semi").drop("batch_id")
