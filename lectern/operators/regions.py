"""Layout regions of pages (page, id, x, y, w, h) and images."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import geometry as G
from lectern.sources.sinks import cut


def filter_images(images: DataFrame, min_size: int | None = None, exclude: tuple[str, ...] = (), confidence: float | None = None, skip_duplicates: bool = False, visible: tuple[str, ...] = (), correlation: float = 0.0, contexts: tuple[str, ...] = ()) -> DataFrame:
    """Each rule holds only if it is given; images under 10 pixels never pass."""
    keep = (F.col("w") >= 10) & (F.col("h") >= 10)
    if min_size is not None:
        keep = keep & (F.col("w") * F.col("h") >= min_size * min_size)
    if exclude:
        keep = keep & ~F.col("type").isin(*exclude)
    if confidence is not None:
        keep = keep & (F.col("confidence") >= confidence)
    if skip_duplicates:
        keep = keep & ~F.col("is_duplicate")
    if visible:
        keep = keep & F.col("visibility").isin(*visible)
    if correlation:
        keep = keep & (F.col("corr") >= correlation)
    if contexts:
        keep = keep & F.col("context").isin(*contexts)
    return images.where(keep)


def fitting(regions: DataFrame, width: int, height: int) -> DataFrame:
    x, y, w, h = (F.col(c) for c in "xywh")
    size = (w >= 50) & (h >= 50) & (w <= 0.95 * width) & (h <= 0.95 * height)
    return regions.where(size & (x >= 5) & (y >= 5) & (x + w <= width - 5) & (y + h <= height - 5))


def box(side: str) -> dict[str, Column]:
    return {c: F.col(f"{side}.{c}") for c in "xywh"}


#: Regions of a page up to which they all meet without a grid.
FEW = 64
#: A cell that holds a whole page.
WHOLE = float(1 << 40)


def cells(start: Column, end: Column, size: Column | float) -> Column:
    """The numbers of the cells that an interval touches."""
    return F.sequence(F.floor(start / size).cast("long"), F.floor(F.greatest(start, end) / size).cast("long"))


def touching(regions: DataFrame, cell: int = 100, few: int = FEW) -> DataFrame:
    """Pairs (a, b) of a page with a.id < b.id whose boxes share more
    than an edge.  Regions meet in the cells of a grid that both touch, so the
    work follows the neighbours of a region; a pair counts in the one cell where
    its common part begins.

    A page of up to `few` regions is one cell.  On others a cell is `cell` wide
    and high at least, and as large as the page's mean region, so a region lies
    in four cells in the mean, however large regions are."""
    page, double = Window.partitionBy("page"), {c: F.col(c).cast("double") for c in "wh"}
    own = regions.where("w > 0 AND h > 0 AND page IS NOT NULL").select("page", "id", *"xywh")
    own = own.withColumns({"_n": F.count(F.lit(1)).over(page), "_w": F.avg(double["w"]).over(page), "_h": F.avg(double["h"]).over(page), "_area": F.avg(double["w"] * double["h"]).over(page)})
    # so that mean area <= cell area too, where wide regions are the high ones
    wider = F.greatest(F.lit(1.0), F.sqrt(F.col("_area") / (F.col("_w") * F.col("_h"))))
    size = {c: F.when(F.col("_n") <= few, WHOLE).otherwise(F.greatest(F.lit(float(cell)), F.ceil(F.col(c) * wider))) for c in ("_w", "_h")}
    own = own.select("page", "id", *"xywh", size["_w"].alias("across"), size["_h"].alias("down"))
    own = own.withColumn("cx", F.explode(cells(F.col("x"), F.col("x") + F.col("w"), F.col("across")))).withColumn("cy", F.explode(cells(F.col("y"), F.col("y") + F.col("h"), F.col("down"))))
    a, b = own.alias("a"), own.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("page", "cx", "cy")]
    begins = (F.floor(F.greatest("a.x", "b.x") / F.col("a.across")) == F.col("a.cx")) & (F.floor(F.greatest("a.y", "b.y") / F.col("a.down")) == F.col("a.cy"))
    common = (F.greatest("a.x", "b.x") < F.least(F.col("a.x") + F.col("a.w"), F.col("b.x") + F.col("b.w"))) & (F.greatest("a.y", "b.y") < F.least(F.col("a.y") + F.col("a.h"), F.col("b.y") + F.col("b.h")))
    return a.join(b, same[0] & same[1] & same[2] & (F.col("a.id") < F.col("b.id"))).where(begins & common)


def overlaps(regions: DataFrame, least: float, cell: int = 100, few: int = FEW) -> DataFrame:
    """Pairs of which more than `least` (0 or more) of the smaller is common."""
    share = G.overlap_share(box("a"), box("b"))
    return touching(regions, cell, few).where(share > least).select(F.col("a.page").alias("page"), F.col("a.id").alias("one"), F.col("b.id").alias("two"), F.round(share, 6).alias("share"))


def centre(side: str) -> tuple[Column, Column]:
    c = box(side)
    return c["x"] + F.floor(c["w"] / 2), c["y"] + F.floor(c["h"] / 2)


def relationships(regions: DataFrame, most: float, few: int = FEW) -> DataFrame:
    """Pairs of a page whose centres are less than `most` apart.  Centres lie in
    cells of that size, so a near one is in the same cell or one beside it; a
    page of up to `few` regions is one cell, with none beside it."""
    (ax, ay), (bx, by) = centre("a"), centre("b")
    cell = max(1, math.ceil(most))
    small = F.count(F.lit(1)).over(Window.partitionBy("page")) <= few
    own = regions.select("page", "id", *"xywh").withColumn("_small", small)
    middle = {"cx": F.floor((F.col("x") + F.floor(F.col("w") / 2)) / cell), "cy": F.floor((F.col("y") + F.floor(F.col("h") / 2)) / cell)}
    own = own.withColumns({c: F.when(F.col("_small"), F.lit(0).cast("long")).otherwise(at) for c, at in middle.items()})
    near = {c: F.when(F.col("_small"), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.col(c) - 1, F.col(c) + 1)) for c in middle}
    beside = own.withColumn("cx", F.explode(near["cx"])).withColumn("cy", F.explode(near["cy"]))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("page", "cx", "cy")]
    met = own.alias("a").join(beside.alias("b"), same[0] & same[1] & same[2] & (F.col("a.id") < F.col("b.id")))
    distance = F.sqrt(((ax - bx) * (ax - bx) + (ay - by) * (ay - by)).cast("double"))
    return met.where(distance < most).select(F.col("a.page").alias("page"), F.col("a.id").alias("one"), F.col("b.id").alias("two"), F.round(distance, 6).alias("distance"), G.relative_position(ax, ay, bx, by).alias("position"))


def layouts(regions: DataFrame, width: int, height: int, pages: DataFrame | None = None) -> DataFrame:
    """page, header, footer, layout.  Regions with a type can make a page one of
    mixed data; `pages` (page) without a region are empty."""
    cx, cy = F.col("x") + F.floor(F.col("w") / 2), F.col("y") + F.floor(F.col("h") / 2)
    kind = F.col("type") if "type" in regions.columns else F.lit("")
    own = regions.groupBy("page").agg(
        F.count_if(cy < 0.2 * height).alias("header"), F.count_if(cy > 0.8 * height).alias("footer"), F.count_if(cx < 0.4 * width).alias("l"), F.count_if(cx > 0.6 * width).alias("r"), F.count("*").alias("n"),
        (F.max(F.coalesce(kind == "table", F.lit(False))) & F.max(F.coalesce(kind == "chart", F.lit(False)))).alias("mixed"),
    )
    layout = F.when((F.col("l") > 0) & (F.col("r") > 0), "multi_column").when(F.col("n") == 1, "single_element").when(F.col("mixed"), "mixed_data").otherwise("single_column")
    found = own.select("page", "header", "footer", layout.alias("layout"))
    if pages is None:
        return found
    none = F.lit(0).cast("long")
    return pages.select("page").distinct().join(found, "page", "full").select("page", F.coalesce("header", none).alias("header"), F.coalesce("footer", none).alias("footer"), F.coalesce("layout", F.lit("empty")).alias("layout"))


def suppress(regions: DataFrame, most: float, cell: int = 100) -> DataFrame:
    """Greedy: by area, largest first, of equals the smaller id, a region stays
    unless it overlaps one that stayed; page, id.

    In rounds over all pages: a region that no open region goes before stays,
    those it overlaps go.  A round settles at least the first of each group of
    overlapping regions, most settle in the first few."""
    area = {k: F.col(f"{k}.w") * F.col(f"{k}.h") for k in "ab"}
    first = (area["a"] > area["b"]) | ((area["a"] == area["b"]) & (F.col("a.id") < F.col("b.id")))
    pairs = touching(regions, cell).where(G.overlap_share(box("a"), box("b")) > most)
    one, two = F.struct(F.col("a.id").alias("id")), F.struct(F.col("b.id").alias("id"))
    before = cut(pairs.select(F.col("a.page").alias("page"), F.when(first, one).otherwise(two)["id"].alias("id"), F.when(first, two).otherwise(one)["id"].alias("loser")), "suppress-pairs")
    unpaired = regions.select("page", "id").distinct()
    open_ = cut(before.select("page", "id").union(before.select("page", "loser")).distinct(), "suppress-open")
    stay = unpaired.join(open_, ["page", "id"], "left_anti")
    while not open_.isEmpty():
        # nothing open goes before these
        top = cut(open_.join(before.select("page", F.col("loser").alias("id")), ["page", "id"], "left_anti"), "suppress-stay")
        gone = before.join(top, ["page", "id"], "left_semi").select("page", F.col("loser").alias("id")).distinct()
        stay = stay.unionByName(top)
        open_ = cut(open_.join(top, ["page", "id"], "left_anti").join(gone, ["page", "id"], "left_anti"), "suppress-open")
        both = before.join(open_, ["page", "id"], "left_semi").join(open_.withColumnRenamed("id", "loser"), ["page", "loser"], "left_semi")
        before = cut(both.select("page", "id", "loser"), "suppress-pairs")
    return stay


def grid(cells: DataFrame, tolerance: int) -> DataFrame:
    """Cells to rows: a cell joins the row while its y is within the tolerance
    of the row's first cell."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "id")))
    start = F.struct(F.lit(-1).alias("row"), F.lit(-1_000_000).alias("y"), F.array().cast("array<struct<row:int,x:int,id:int>>").alias("out"))

    def add(a: Column, c: Column) -> Column:
        new = F.abs(c["y"] - a["y"]) > tolerance
        row = F.when(new, a["row"] + 1).otherwise(a["row"])
        return F.struct(row.alias("row"), F.when(new, c["y"]).otherwise(a["y"]).alias("y"), F.concat(a["out"], F.array(F.struct(row.alias("row"), c["x"].alias("x"), c["id"].alias("id")))).alias("out"))

    own = cells.groupBy("page").agg(ordered.alias("all"))
    return own.select("page", F.inline(F.aggregate("all", start, add, lambda a: a["out"])))
