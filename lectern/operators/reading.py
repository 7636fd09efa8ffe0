"""Words with boxes to blocks, lines and a reading order.

Words are rows (page, id, x0, y0, x1, y1, text), y downwards.  A page is divided
at its white gaps, over and over: a block is cut into rows wherever a horizontal
strip of `row_gap` is free of words, or else into columns wherever a vertical
strip of `column_gap` is, until no block can be cut.  Each cut is gaps and
islands over the words of a block: a word begins a new part if it begins `gap`
or more beyond the furthest end before it.  The path of cuts is the
reading order: what a heading spans comes first, then each column from top to
bottom.  In a block, words make lines where their heights overlap.

All pages are cut at once.  What no cut can part is one before: the words of a
page that come together in an Arrow batch are cut there, and what is left whole
is a clump, with its lines.  What a batch does not hold together is only left
for later.  A round of cuts is one shuffle by block of the clumps that the round
before has parted, without texts; it ends when no block was cut, so rounds
follow the depth of the deepest layout, not the number of pages.

Pages that came in several batches are read again, sorted by page.  A page all
of whose clumps are then blocks by themselves is whole: its lines stand, as
texts, and are only numbered by a join with their clumps' places, so that ids of
words are not on disk.  What is left, very long pages and boxes without end, is
read with the ids, and lines of several clumps of a block meet.

Defined results: words with a null page or box are left out, and so are words
without text; boxes with swapped ends are put right; words with one and the
same box go by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType
from pyspark.sql.window import Window

from lectern.sources.sinks import cut

ENDS = ("x0", "y0", "x1", "y1")
WORD = ["x0", "id", "text"]
#: Words of one page that wait for the next batch, at most.
WAITING = 100_000


def clean(words: DataFrame) -> DataFrame:
    own = words.where(F.col("page").isNotNull() & (F.trim("text") != ""))
    for c in ENDS:
        own = own.where(F.col(c).isNotNull())
    low, high = {a: F.least(f"{a}0", f"{a}1") for a in "xy"}, {a: F.greatest(f"{a}0", f"{a}1") for a in "xy"}
    return own.select("page", "id", low["x"].alias("x0"), low["y"].alias("y0"), high["x"].alias("x1"), high["y"].alias("y1"), "text")


def numbered(rows: DataFrame, axis: str, gap: float, by: list[str], name: str) -> DataFrame:
    """rows with the number of the island they lie in, from 0: in order of their
    starts, an island ends where `gap` is free behind all of it."""
    order = Window.partitionBy(*by).orderBy(f"{axis}0", f"{axis}1", "id")
    before = F.max(f"{axis}1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(f"{axis}0") - F.col("_before") >= gap, 1).otherwise(0)
    through = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_before", before).withColumn("_new", new).withColumn(name, F.sum("_new").over(through).cast("int")).drop("_before", "_new")


def runs(group: np.ndarray, box: dict[str, np.ndarray], by: tuple[str, str], x_gap: float, y_gap: float) -> np.ndarray:
    """The number of the run that each box lies in: of two neighbours by `by` in
    a group the second joins the first if less than both gaps is between them."""
    order = np.lexsort((box[by[1]], box[by[0]], group))
    a, b = order[:-1], order[1:]
    near = group[a] == group[b]
    for axis, gap in (("x", x_gap), ("y", y_gap)):
        low, high = box[f"{axis}0"], box[f"{axis}1"]
        near &= np.maximum(low[a], low[b]) - np.minimum(high[a], high[b]) < gap
    out = np.empty(len(order), np.int64)
    out[order] = np.concatenate(([0], np.cumsum(~near)))
    return out


def islands(group: np.ndarray, box: dict[str, np.ndarray], ids: np.ndarray, axis: str = "y", gap: float = 0) -> np.ndarray:
    """The number of the island that each box lies in, as `numbered`; groups go
    on from one another."""
    low, high = box[f"{axis}0"], box[f"{axis}1"]
    order = np.lexsort((ids, high, low, group))
    ends, rank = np.unique(high, return_inverse=True)
    # later groups count as further down, so that the furthest end is one of the own group or else new
    own = group[order]
    furthest = np.maximum.accumulate(own * len(ends) + rank[order])[:-1]
    same = own[1:] == own[:-1]
    joins = same & (low[order][1:] - ends[np.where(same, furthest - own[1:] * len(ends), 0)] < gap)
    out = np.empty(len(order), np.int64)
    out[order] = np.concatenate(([0], np.cumsum(~joins)))
    return out


def parted(block: np.ndarray, box: dict[str, np.ndarray], ids: np.ndarray, x_gap: float, y_gap: float) -> np.ndarray:
    """The number of the block that each box lies in, after all cuts of the
    blocks given: rows, or else columns."""
    while True:
        row, first = islands(block, box, ids, "y", y_gap), np.full(len(block), len(block))
        np.minimum.at(first, block, row)
        rows = np.zeros(len(block), bool)
        rows[block[row != first[block]]] = True
        part = np.where(rows[block], row, islands(block, box, ids, "x", x_gap))
        found, own = np.unique(block * len(block) + part, return_inverse=True)
        if len(found) == block.max() + 1:
            return own
        block = own


def hulls(label: np.ndarray, box: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Rows by label, where each label starts, the box around it."""
    order = np.argsort(label, kind="stable")
    starts = np.searchsorted(label[order], np.arange(label.max() + 1))
    return order, starts, {c: (np.minimum if c.endswith("0") else np.maximum).reduceat(b[order], starts) for c, b in box.items()}


def clumped(batch: pa.RecordBatch, column_gap: float, row_gap: float, apart: bool) -> pa.RecordBatch:
    """A row for each clump: page, id (of one of its words), box, lines."""
    page, ids = batch["page"].dictionary_encode().indices.to_numpy().astype(np.int64), pc.rank(batch["id"], null_placement="at_start", tiebreaker="dense").to_numpy()
    types = {c: batch[c].type for c in ENDS}
    box = {c: batch[c].to_numpy(zero_copy_only=False) for c in ENDS}
    if all(b.dtype.kind == "i" or (b.dtype.kind == "f" and np.isfinite(b).all()) for b in box.values()):
        box = {c: b.astype("int64") if b.dtype.kind == "i" else b for c, b in box.items()}
        # words side by side, then what is close both ways; neither can be parted by a cut
        piece = runs(page, box, ("y0", "x0"), column_gap, min(row_gap, 0))
        order, starts, around = hulls(piece, box)
        first = order[starts]
        near = runs(page[first], around, ("x0", "y0"), column_gap, row_gap)
        of_near, starts, hull = hulls(near, around)
        clump = parted(page[first[of_near[starts]]], hull, np.arange(len(starts)), column_gap, row_gap)[near]
        line, clump = islands(clump, around, ids[first])[piece], clump[piece]
    else:
        line = clump = np.arange(len(page))
        box = {c: batch[c] for c in ENDS}

    def part(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]:
        if line is clump:
            return of, of, box
        order, starts, around = hulls(of, box)
        return order, starts, {c: pa.array(b, types[c]) for c, b in around.items()}

    def offsets(starts: np.ndarray, end: int) -> pa.Array:
        return pa.array(np.append(starts, end), pa.int32())

    order, starts, around = part(line)
    # words of a line from left to right
    if line is not clump:
        keys = (ids, box["x0"], line)
        order = np.lexsort(keys)
        if len(order) > 1 and np.logical_and.reduce([k[order[1:]] == k[order[:-1]] for k in keys]).any():
            order = np.lexsort((pc.rank(batch["text"], tiebreaker="dense").to_numpy(), *keys))
    own, through = batch.take(pa.array(order)), offsets(starts, len(order))
    if apart:
        words = pa.StructArray.from_arrays([own[c] for c in WORD], WORD)
        lines = pa.StructArray.from_arrays([own["id"].take(pa.array(starts)), *(around[c] for c in ENDS), pa.ListArray.from_arrays(through, words)], ["id", *ENDS, "words"])
    else:
        texts = pc.binary_join(pa.ListArray.from_arrays(through, own["text"]), pa.scalar(" ", own["text"].type))
        lines = pa.StructArray.from_arrays([*(around[c] for c in ENDS), pa.array(np.diff(through.to_numpy()), pa.int32()), texts], [*ENDS, "n_words", "text"])
    of_line = clump[order[starts]]
    firsts = np.searchsorted(of_line, np.arange(of_line[-1] + 1))
    at = pa.array(starts[firsts])
    return pa.RecordBatch.from_arrays([own["page"].take(at), own["id"].take(at), *(part(clump)[2][c] for c in ENDS), pa.ListArray.from_arrays(offsets(firsts, len(lines)), lines)], ["page", "id", *ENDS, "lines"])


def between_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end where a page does, unless it is very long."""
    left = None
    for batch in batches:
        own = pa.concat_batches([left, batch]) if left else batch
        if not own.num_rows:
            continue
        others = np.flatnonzero(~pc.equal(own["page"], own["page"][-1]).to_numpy(zero_copy_only=False))
        end = int(others[-1]) + 1 if len(others) else 0
        if own.num_rows - end > WAITING:
            end = own.num_rows
        if end:
            yield own.slice(0, end)
        left = own.slice(end)
    if left:
        yield left


def merged(column_gap: float, row_gap: float, apart: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(between_pages(batches)):
            own = clumped(batch, column_gap, row_gap, apart)
            yield own.append_column("batch", pa.array(np.full(own.num_rows, n), pa.int64()))

    return run


def clumps(words: DataFrame, column_gap: float = 50, row_gap: float = 20, apart: bool = True) -> DataFrame:
    """clump, batch, page, id, box, lines: array of (id, box, words), words being
    arrays of (x0, id, text), or if they are not to be kept apart of (box,
    n_words, text)."""
    own = clean(words)
    line = F.struct("id", *ENDS, F.array(F.struct(*WORD)).alias("words")) if apart else F.struct(*ENDS, F.lit(1).alias("n_words"), "text")
    schema = own.select("page", "id", *ENDS, F.array(line).alias("lines"), F.lit(0).cast("long").alias("batch")).schema
    batch = F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("batch")
    return own.mapInArrow(merged(column_gap, row_gap, apart), schema).withColumns({"clump": F.monotonically_increasing_id(), "batch": batch})


def blocks(rows: DataFrame, column_gap: float = 50, row_gap: float = 20) -> DataFrame:
    """rows with path, the way of cuts to their block: array of int."""
    rows, whole = rows.withColumn("path", F.array().cast("array<int>")), []
    key = ["page", "path"]
    while True:
        own = numbered(numbered(rows, "x", column_gap, key, "_column"), "y", row_gap, key, "_row")
        block = Window.partitionBy(*key)
        columns, lines = F.max("_column").over(block), F.max("_row").over(block)
        # rows first where they are free of words all across: a heading is no part of a column below it
        part = F.when(lines > 0, F.col("_row")).when(columns > 0, F.col("_column"))
        own = cut(own.withColumn("_part", part).drop("_column", "_row"), "blocks")
        # a block that was not cut stays as it is
        whole.append(own.where(F.col("_part").isNull()).drop("_part"))
        rows = own.where(F.col("_part").isNotNull())
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, whole)
        rows = rows.withColumn("path", F.concat("path", F.array("_part"))).drop("_part")


def lines(words: DataFrame, column_gap: float = 50, row_gap: float = 20) -> DataFrame:
    """page, line (from 0, in reading order), block (likewise), box, text."""
    if any(isinstance(words.schema[c].dataType, DecimalType) for c in ENDS):
        return pieced(words, column_gap, row_gap)

    def written(own: DataFrame) -> DataFrame:
        return cut(clumps(own, column_gap, row_gap, apart=False).withColumn("n_lines", F.size("lines")), "lines")

    held, bare = written(words), ["clump", "page", "id", *ENDS, "n_lines"]
    own, several = held.select(bare), F.min("batch") < F.max("batch")
    pieces = cut(held.groupBy("page").agg(several.alias("several")).where("several").select("page"), "pieces")
    if not pieces.isEmpty():
        again = written(words.join(pieces, "page", "left_semi").repartition("page").sortWithinPartitions("page"))
        again = again.withColumn("clump", -1 - F.col("clump"))
        own = own.join(pieces, "page", "left_anti").unionByName(again.select(bare))
        # pieces stay among the texts, but get no number
        held = held.unionByName(again)
    found = blocks(own, column_gap, row_gap).repartition("page")
    page = Window.partitionBy("page")
    order, alone = page.orderBy("path"), F.count(F.lit(1)).over(Window.partitionBy("page", "path")) == 1
    before = F.sum("n_lines").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_lines")
    own = found.withColumn("alone", alone).select("page", "clump", before.cast("int").alias("before"), (F.row_number().over(order) - 1).alias("block"), F.min("alone").over(page).alias("whole"))
    places = cut(own, "places")
    # places are built upon and texts stream by, so that these move once and are not sorted
    parts = [*ENDS, "n_words", "text"]
    numbers = places.where("whole").select("clump", "before", "block").hint("shuffle_hash")
    each = held.select("clump", "page", *(F.col("lines")[c].alias(c) for c in parts)).join(numbers, "clump")
    each = each.select("page", "before", "block", *parts[:-1], F.posexplode("text").alias("at", "text"))
    done = each.select("page", (F.col("before") + F.col("at")).alias("line"), "block", *(F.col(c)[F.col("at")].alias(c) for c in ENDS), F.col("n_words")[F.col("at")].cast("long").alias("n_words"), "text")
    rest = places.where(~F.col("whole")).select("page").distinct()
    return done if rest.isEmpty() else done.unionByName(pieced(words.join(rest, "page", "left_semi"), column_gap, row_gap))


def pieced(words: DataFrame, column_gap: float, row_gap: float) -> DataFrame:
    """`lines` of pages of any kind: words of several clumps of a block meet."""
    held = cut(clumps(words, column_gap, row_gap).drop("batch"), "clumps")
    found = blocks(held.select("clump", "page", "id", *ENDS), column_gap, row_gap)
    alone = F.count(F.lit(1)).over(Window.partitionBy("page", "path")) == 1
    places = found.withColumn("alone", alone).select("page", "clump", F.struct("path", "alone").alias("place"))
    # by page throughout, so that texts move once: a clump's place comes before it
    both = held.select("page", "clump", "lines").unionByName(places, allowMissingColumns=True).repartition("page")
    through = Window.partitionBy("page", "clump").orderBy(F.col("place").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = both.withColumn("place", F.first("place").over(through)).where(F.col("lines").isNotNull())
    # a clump that is a block stays one row, of others each line is one
    each = F.when(F.col("place.alone"), F.array("lines")).otherwise(F.transform("lines", lambda x: F.array(x)))
    own = own.select("page", "place.*", F.explode(each).alias("lines"))
    rows = numbered(own.select("*", *(F.col("lines")[0][c].alias(c) for c in ("id", "y0", "y1"))), "y", 0, ["page", "path"], "_line")
    met = rows.groupBy("page", "path", "_line").agg(F.first("alone").alias("alone"), F.flatten(F.collect_list("lines")).alias("lines"))
    return in_order(met.select("page", "path", "_line", F.when(F.col("alone") | (F.size("lines") == 1), F.col("lines")).otherwise(F.array(one_line(F.col("lines")))).alias("lines")))


def one_line(parts: Column) -> Column:
    ends = [(F.array_min if c.endswith("0") else F.array_max)(parts[c]).alias(c) for c in ENDS]
    return F.struct(parts[0]["id"].alias("id"), *ends, F.flatten(parts["words"]).alias("words"))


def in_order(found: DataFrame) -> DataFrame:
    """The lines of a page's rows (path, _line, lines), numbered; words of a line
    are joined by blanks, from left to right."""
    order = Window.partitionBy("page").orderBy("path", "_line")
    before = F.coalesce(F.sum(F.size("lines")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    first = F.lag("path").over(order)
    own = found.withColumn("_before", before).withColumn("_opens", F.when(first.isNull() | (first == F.col("path")), 0).otherwise(1))
    own = own.withColumn("block", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int"))
    own = own.select("page", "_before", "block", F.posexplode("lines").alias("_at", "_own"))
    text = F.array_join(F.transform(F.array_sort("_own.words"), lambda w: w["text"]), " ")
    return own.select("page", (F.col("_before") + F.col("_at")).alias("line"), "block", *(F.col("_own")[c].alias(c) for c in ENDS), F.size("_own.words").cast("long").alias("n_words"), text.alias("text"))
