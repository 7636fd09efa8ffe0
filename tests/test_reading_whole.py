"""Pages that come whole keep no ids on disk; pages in pieces are read again, by page."""

import random

import numpy as np
import pyarrow as pa
from lectern.operators import reading
from pyspark.sql import functions as F
from tests.test_drivers import plain_lines
from tests.test_reading_clumps import SCHEMA, found

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(spark, monkeypatch, frame, rows):
    """Lines of pages and the tables that were written for them, by label."""
    tables = {}

    def cut(df, label, own=reading.cut):
        tables[label] = own(df, label)
        return tables[label]

    monkeypatch.setattr(reading, "cut", cut)
    was = spark.conf.get(BATCH)
    try:
        spark.conf.set(BATCH, rows)
        return found(frame), tables
    finally:
        spark.conf.set(BATCH, was)
        monkeypatch.undo()


def columns(pages, rows):
    """Pages of a heading and two columns of four words a line; ids say nothing of the order."""
    boxes = [(j * 90, 0) for j in range(6)] + [(c * 400 + k * 70, 60 + r * 14) for c in range(2) for r in range(rows) for k in range(4)]
    return {p: [((p * 997 + j * 31) % 1009, x, y, x + 60, y + 10, f"w{j}") for j, (x, y) in enumerate(boxes)] for p in range(pages)}


def test_whole_pages_keep_no_ids(spark, monkeypatch):
    pages = columns(7, 9)
    frame = spark.createDataFrame([(p, *w) for p, ws in pages.items() for w in ws], SCHEMA.format("long")).coalesce(1)
    # batches end inside of pages
    lines, tables = written(spark, monkeypatch, frame, 50)
    assert lines == {p: plain_lines(ws) for p, ws in pages.items()}
    assert set(tables) == {"lines", "pieces", "blocks", "places"} and tables["pieces"].isEmpty()
    held = tables["lines"]
    assert held.schema["lines"].dataType.elementType.names == [*reading.ENDS, "n_words", "text"]
    assert held.count() == 7 * 3 and tables["places"].where("whole").count() == 7 * 3


def test_pages_in_pieces_are_read_again(spark, monkeypatch):
    """Words of one left edge, from two batches, go by id; other pages stand, and no ids are kept."""
    rng = random.Random(3)
    pages = columns(4, 5)
    # every box twice, far from its copy; ids of the copies are lower or higher
    copies = [(rng.choice([-1, 1]) * (2000 + i), *box, f"c{i}") for i, (_, *box, _) in enumerate(pages[1])]
    rows = [(p, *w) for p, ws in pages.items() for w in ws] + [(1, *w) for w in copies]
    pages[1] += copies
    lines, tables = written(spark, monkeypatch, spark.createDataFrame(rows, SCHEMA.format("long")).coalesce(1), 20)
    assert lines == {p: plain_lines(ws) for p, ws in pages.items()}
    assert {r.page for r in tables["lines"].select("page").distinct().collect()} == {1} and "clumps" not in tables


def test_pages_that_no_batch_holds(spark, monkeypatch):
    n, i = 120_000, F.col("id")
    # lines of two words
    words = spark.range(n).select(F.lit(1).cast("long").alias("page"), (n - i).alias("id"), (i % 2 * 70).alias("x0"), (F.floor(i / 2) * 14).alias("y0"), F.concat(F.lit("w"), i).alias("text"))
    words = words.withColumns({"x1": F.col("x0") + 60, "y1": F.col("y0") + 10})
    words = words.unionByName(words.where(i > n - 2).withColumn("page", F.lit(2).cast("long"))).coalesce(1)
    lines, tables = written(spark, monkeypatch, words, 10_000)
    assert lines == {1: [(0, f"w{k} w{k + 1}") for k in range(0, n, 2)], 2: [(0, "w0 w1")]}
    assert {r.page for r in tables["clumps"].select("page").distinct().collect()} == {1}
    # boxes without end or number: each word is one by itself
    inf, nan = float("inf"), float("nan")
    odd = [(5, 2, 0.0, 0.0, 9.0, 5.0, "a"), (5, 1, 0.0, 0.0, 9.0, 5.0, "b"), (6, 1, -inf, 0.0, inf, 5.0, "c"), (7, 1, nan, 0.0, 1.0, 5.0, "d"), (8, 1, 0.0, 0.0, 5.0, 5.0, "e")]
    assert found(spark.createDataFrame(odd, SCHEMA.format("double")).coalesce(1)) == {5: [(0, "b a")], 6: [(0, "c")], 7: [(0, "d")], 8: [(0, "e")]}


def test_batches_end_with_pages(monkeypatch):
    monkeypatch.setattr(reading, "WAITING", 6)

    def ends(pages, size):
        own = pa.RecordBatch.from_pydict({"page": pages, "at": list(range(len(pages)))})
        out = [b.to_pydict() for b in reading.between_pages(own.slice(i, size) for i in range(0, len(pages), size))]
        assert [x for b in out for x in b["at"]] == list(range(len(pages)))
        return [b["page"] for b in out]

    assert ends([1, 1, 1, 2, 2, 3, 3, 3], 2) == [[1, 1, 1], [2, 2], [3, 3, 3]]
    # a page of more words does not wait
    assert ends([1, *[2] * 9], 4) == [[1], [2] * 7, [2, 2]]
    assert ends([], 1) == [] and ends([4], 1) == [[4]]


def test_local_cuts_leave_what_rounds_would():
    """A ragged page is one clump a block, not one for each run of neighbours."""
    rng = random.Random(11)
    words = [(i, x := rng.choice([0, 120, 300]) + rng.randrange(40), y := rng.choice([0, 15, 60, 75]) + rng.randrange(5), x + rng.choice([20, 40, 200]), y + 10, f"w{i}") for i in range(60)]
    batch = pa.RecordBatch.from_pydict({"page": [0] * 60, **{c: [w[k] for w in words] for k, c in enumerate(["id", *reading.ENDS, "text"])}})
    clumps = reading.clumped(batch, 50, 20, False).to_pylist()
    wanted = plain_lines(words)
    assert [(b, x["text"]) for b, c in enumerate(clumps) for x in c["lines"]] == wanted
    assert [x["n_words"] for c in clumps for x in c["lines"]] == [len(t.split()) for _, t in wanted] and np.sum([len(c["lines"]) for c in clumps]) == len(wanted)
