"""Ruled tables: crossing lines, their components, rows and columns.

Horizontal lines are rows (page, id, y, x1, x2), vertical ones (page, id, x, y1,
y2).  Lines cross where each lies between the other's ends; lines that hang
together by crossings are one table, whose boundaries are the places of its
lines.  Places within `tolerance` of the one before are one boundary.

Defined results: ends may be swapped; lines with nulls cross nothing; ids are
unique among a page's lines of one kind, and a repeated line counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.graph import components
from lectern.operators.regions import FEW, cells
from lectern.sources.sinks import cut

#: Where lines of pages with few lines across meet.
NO_CELL = -(1 << 62)


def crossings(across: DataFrame, down: DataFrame, cell: int = 200, few: int = FEW) -> DataFrame:
    """page, h_id, v_id, x, y.  A line across meets the lines down of the cells
    that it runs through, not all of the page; up to `few` lines across a page
    meet all of its lines down."""
    low, high = F.least("x1", "x2"), F.greatest("x1", "x2")
    h = across.select("page", F.col("id").alias("h_id"), low.alias("low"), high.alias("high"), "y").where("low IS NOT NULL AND high IS NOT NULL AND y IS NOT NULL")
    h = h.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("page")))
    # lines down are in their cell and, for pages with few lines across, in one without a number
    own = F.when(F.col("_n") <= few, F.array(F.lit(NO_CELL))).otherwise(cells(F.col("low"), F.col("high"), cell))
    h = h.withColumn("cell", F.explode(own)).drop("_n")
    v = down.select("page", F.col("id").alias("v_id"), "x", F.least("y1", "y2").alias("top"), F.greatest("y1", "y2").alias("bottom"))
    v = v.where("x IS NOT NULL").withColumn("cell", F.explode(F.array(F.floor(F.col("x") / cell).cast("long"), F.lit(NO_CELL))))
    return h.join(v, ["page", "cell"]).where("x BETWEEN low AND high AND y BETWEEN top AND bottom").select("page", "h_id", "v_id", "x", "y").distinct()


def boundaries(places: DataFrame, tolerance: float) -> DataFrame:
    """table, n: how many boundaries the places (table, at) make."""
    before = F.lag("at").over(Window.partitionBy("table").orderBy("at"))
    opens = F.when(before.isNull() | (F.col("at") - before > tolerance), 1).otherwise(0)
    return places.distinct().withColumn("opens", opens).groupBy("table").agg(F.sum("opens").cast("int").alias("n"))


def tables(across: DataFrame, down: DataFrame, tolerance: float = 3, cell: int = 200) -> DataFrame:
    """page, table (of its lines the first across), n_rows, n_columns, n_lines,
    n_crossings and box of what has a row and a column at least."""
    # read twice: by the components and by the tables
    met = cut(crossings(across, down, cell), "crossings")

    def line(kind: int, name: str) -> Column:
        return F.struct("page", F.lit(kind).alias("kind"), F.col(name).alias("id"))

    found = components(met.select(line(0, "h_id").alias("a"), line(1, "v_id").alias("b")))
    lines = met.select(line(0, "h_id").alias("node"), line(1, "v_id").alias("other"), "x", "y")
    own = lines.join(found, "node").select("root", "node", "other", "x", "y")
    rows = boundaries(own.select(F.col("root").alias("table"), F.col("y").alias("at")), tolerance).withColumnRenamed("n", "row_bounds")
    columns = boundaries(own.select(F.col("root").alias("table"), F.col("x").alias("at")), tolerance).withColumnRenamed("n", "column_bounds")
    size = own.groupBy(F.col("root").alias("table")).agg((F.countDistinct("node") + F.countDistinct("other")).cast("int").alias("n_lines"), F.count(F.lit(1)).cast("int").alias("n_crossings"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    whole = size.join(rows, "table").join(columns, "table").where("row_bounds > 1 AND column_bounds > 1")
    return whole.select("table.page", F.col("table.id").alias("table"), (F.col("row_bounds") - 1).alias("n_rows"), (F.col("column_bounds") - 1).alias("n_columns"), "n_lines", "n_crossings", "x0", "y0", "x1", "y1")
