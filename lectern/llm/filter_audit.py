"""How document filters overlap, by incidence matrices.

Which filters a document fails is a mask of n bits, and all that an audit asks
of it follows from the mask.  So documents are first counted by part and mask,
all of them and those with either label; these histograms, stacked as rows,
times integer matrices of 2^n rows and a column for each step of each order
give every count of every order at once.  Documents are read once, however
many orders there are.

The last filter is identity: a document fails it if its text is that of a
smaller doc_id anywhere in the table.  Equal texts fail the same filters
otherwise, so rows are counted by text, id, part and labels before they meet:
a text that a third of all rows have arrives as a row for each task and part.

Defined results: a null text is empty, and empty texts are equal; a null part
is the empty string; a null doc_id is neither smaller nor larger than another,
has no label and never fails identity; rows equal in doc_id and text are each
counted and don't make each other fail.  A document has a label if any row of
its doc_id has it.  Extra columns are ignored; without documents there are no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import WORD, bound

FILTERS = "ABCDE"
#: Parts whose rows a worker makes at a time.
PARTS = 64
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_mask(text: Column, least_words: int = 200, least_distinct: int = 50, most_capitals: int = 2) -> Column:
    """Bit i is set where filter i, of those on the text alone, fails; shares
    are in percent."""

    def flag(i: int, fails: Column) -> Column:
        return F.when(fails, 1 << i).otherwise(0)

    def words_fail(words: Column) -> Column:
        n = F.size(words).cast("long")
        return flag(0, n < least_words) + flag(1, 100 * F.size(F.array_distinct(words)).cast("long") < least_distinct * n)

    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    words = bound(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), words_fail)
    return (words + flag(2, 100 * capitals > most_capitals * F.length(text).cast("long")) + flag(3, text.rlike("[#$%&*|]"))).cast("int")


def histograms(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: documents of each mask that occurs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    facts = own.select("doc_id", "part", F.xxhash64("text").alias("one"), F.xxhash64(F.lit(1), "text").alias("two"), text_mask(F.col("text")).alias("mask"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    no = F.lit(False)
    rows = facts.join(marks, "doc_id", "left").select("one", "two", "doc_id", "part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    # rows of one doc_id lie together after the join
    by_id = rows.groupBy("one", "two", "doc_id", "part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    low = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    by_text = by_id.groupBy("one", "two", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), low.alias("low"))
    first = F.min("low.doc_id").over(Window.partitionBy("one", "two"))
    again = F.col("n") - F.col("no_id") - F.when(F.col("low.doc_id") == F.col("first"), F.col("low.n")).otherwise(0)
    bit = 1 << (len(FILTERS) - 1)
    split = by_text.withColumn("first", first).select("part", "good", "toxic", F.explode(F.array(F.struct((F.col("mask") + bit).alias("mask"), again.alias("n")), F.struct(F.col("mask"), (F.col("n") - again).alias("n")))).alias("x")).where("x.n > 0")
    n = F.col("x.n")
    return split.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


@cache
def matrices(filters: str = FILTERS) -> tuple[list[str], np.ndarray, dict[str, np.ndarray]]:
    """The orders, which filter each step of each order applies, and a matrix
    of masks by steps for each outcome."""
    n = len(filters)
    masks = np.arange(1 << n)
    fails = (masks[:, None] >> np.arange(n)) & 1
    orders = list(permutations(range(n)))
    out = {k: np.zeros((1 << n, len(orders) * n), dtype=np.int64) for k in ("kept", "removed", "redundant", "unique_fails")}
    for at, order in enumerate(orders):
        gone = np.zeros(1 << n, dtype=np.int64)
        for step, f in enumerate(order):
            column = at * n + step
            out["removed"][:, column] = fails[:, f] & ~gone
            out["redundant"][:, column] = fails[:, f] & gone
            gone = gone | fails[:, f]
            out["kept"][:, column] = 1 - gone
            out["unique_fails"][:, column] = masks == 1 << f
    return ["".join(filters[f] for f in order) for order in orders], np.array([f for order in orders for f in order]), out


def outcomes(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """`histograms` to a row for each part, order and step."""
    stacked = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("bins"))  # at most 2^n bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, applied, by = matrices(filters)
        steps, n = len(applied), len(filters)
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                own = batch.slice(at, PARTS)
                rows = np.zeros((3, own.num_rows, 1 << n), dtype=np.int64)
                for i, bins in enumerate(own.column(1).to_pylist()):
                    for x in bins:
                        rows[:, i, x["mask"]] = x["n"], x["good"], x["toxic"]
                removed, good, toxic = (rows.reshape(-1, 1 << n) @ by["removed"]).reshape(3, own.num_rows, steps)
                shares = removed @ (applied[:, None] == np.arange(n)).astype(np.int64)
                columns = [rows[0] @ by["kept"], removed, rows[0] @ by["redundant"], rows[0] @ by["unique_fails"], good, toxic, shares[:, applied]]
                parts = pa.array(np.repeat(np.array(own.column(0).to_pylist(), dtype=object), steps), pa.string())
                names = pa.array(np.tile(np.repeat(np.array(orders, dtype=object), n), own.num_rows), pa.string())
                places = pa.array(np.tile(np.arange(steps) % n + 1, own.num_rows), pa.int32())
                yield pa.RecordBatch.from_arrays([parts, names, places, *(pa.array(c.reshape(-1), pa.int64()) for c in columns)], ["part", "filter_order", "step", *COUNTS])

    return stacked.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, filter_order, step and the counts of that step."""
    return outcomes(histograms(docs, labels, part))
