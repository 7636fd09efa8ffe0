"""Images and layout regions: classification, filters, geometry, joins.

There are no pixels in the tables, so images and regions come from integer
arithmetic on part and lineitem, the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import geometry as G
from lectern.operators import regions
from lectern.plans.registry import query, table

PW, PH = 612.0, 792.0
IMAGES = """img AS (SELECT p_partkey AS id, p_partkey % 40 AS doc, p_partkey % 4 AS page, CAST(p_partkey * 37 % 612 AS INT) AS x, CAST(p_partkey * 53 % 792 AS INT) AS y, CAST(p_size * 13 % 700 + 5 AS INT) AS w, CAST(p_partkey * 29 % 600 + 5 AS INT) AS h,
CAST(p_partkey * 31 % 2000 AS INT) AS colours, p_partkey % 2 = 0 AS has_text, p_partkey % 3 = 0 AS company, p_partkey % 5 = 0 AS data, p_partkey % 7 = 0 AS qr, p_partkey % 11 = 0 AS activity, p_partkey % 13 = 0 AS site, 'h' || (p_partkey % 97) AS hash, CAST(p_partkey % 17 AS DOUBLE) / 16 AS corr FROM part)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        p.alias("id"), (p % 40).alias("doc"), (p % 4).alias("page"), (p * 37 % 612).cast("int").alias("x"), (p * 53 % 792).cast("int").alias("y"), (s * 13 % 700 + 5).cast("int").alias("w"), (p * 29 % 600 + 5).cast("int").alias("h"),
        (p * 31 % 2000).cast("int").alias("colours"), (p % 2 == 0).alias("has_text"), (p % 3 == 0).alias("company"), (p % 5 == 0).alias("data"), (p % 7 == 0).alias("qr"), (p % 11 == 0).alias("activity"), (p % 13 == 0).alias("site"),
        F.concat(F.lit("h"), (p % 97).cast("string")).alias("hash"), ((p % 17).cast("double") / 16).alias("corr"),
    )


RATIOS = "x / 612.0::DOUBLE AS rx, y / 792.0::DOUBLE AS ry, w / 612.0::DOUBLE AS rw, h / 792.0::DOUBLE AS rh"
VIS = f"""{IMAGES}, r AS (SELECT *, {RATIOS}, (id % 10) / 10.0::DOUBLE AS density FROM img),
v AS (SELECT *, round(least(greatest(0.5::DOUBLE + CASE WHEN CASE WHEN rw * rh > 0.3 THEN 1 ELSE rw * rh / 0.3 END > 0.5 THEN 0.2 ELSE 0 END + CASE WHEN rx > 0.4 AND rx < 0.6 AND ry > 0.3 AND ry < 0.7 THEN 0.15 ELSE 0 END
- CASE WHEN rw > 0.8 AND rh > 0.8 THEN 0.3 ELSE 0 END - CASE WHEN density > 0.5 THEN 0.2 ELSE 0 END + CASE WHEN CASE WHEN rw * rh < 0.05 THEN 1 ELSE (0.05 - rw * rh) / 0.05 END > 0.7 THEN 0.1 ELSE 0 END + CASE WHEN ry < 0.15 OR ry > 0.85 THEN 0.05 ELSE 0 END, 0), 1), 6)::DOUBLE AS score FROM r),
vis AS (SELECT *, CASE WHEN rw > 0.8 AND rh > 0.8 THEN 'background' WHEN score > 0.7 THEN 'visible' WHEN score > 0.4 THEN 'embedded' ELSE 'background' END AS visibility FROM v)"""


def visible(df: DataFrame) -> DataFrame:
    r = G.position_ratios(F.col("x"), F.col("y"), F.col("w"), F.col("h"), PW, PH)
    own = df.withColumn("score", F.round(G.visibility_score(r, (F.col("id") % 10) / 10.0), 6))
    return own.withColumn("visibility", G.visibility(F.col("score"), r))


@query(f"WITH {VIS} SELECT id, score, visibility FROM vis")
def image_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible(images(spark, sf_dir)).select("id", "score", "visibility")


def sql_flag(condition: str, value: float) -> str:
    return f"CASE WHEN {condition} THEN {value} ELSE 0 END"


KINDS_SQL = {
    "logo": " + ".join([sql_flag("w * h < 10000", 0.4), sql_flag("ry < 0.2 OR ry > 0.8", 0.3), sql_flag("rx < 0.2 OR rx > 0.8", 0.2), sql_flag("colours < 50", 0.3), sql_flag("company", 0.2)]),
    "chart": " + ".join([sql_flag("rw > 0.6 OR rh > 0.6", 0.3), sql_flag("has_text", 0.4), sql_flag("colours < 50", 0.3), sql_flag("data", 0.3)]),
    "diagram": " + ".join([sql_flag("colours < 50", 0.4), sql_flag("has_text", 0.3), sql_flag("w / greatest(h, 1)::DOUBLE BETWEEN 0.5 AND 2", 0.2)]),
    "photo": " + ".join([sql_flag("colours > 1000", 0.4), sql_flag("NOT has_text", 0.3), sql_flag("w * h > 100000", 0.3), sql_flag("activity", 0.3)]),
    "qr_code": " + ".join([sql_flag("w / greatest(h, 1)::DOUBLE BETWEEN 0.8 AND 1.2", 0.3), sql_flag("w * h < 10000 AND colours < 50", 0.2), sql_flag("qr", 0.4), sql_flag("has_text AND site", 0.2)]),
}
#: Written out, so that a wrong bound of the engine shows.
LEAST_SQL = {"logo": 0.6, "chart": 0.7, "diagram": 0.6, "photo": 0.5, "qr_code": 0.8}
KIND_ROWS = ", ".join(f"{{'s': round(({sql})::DOUBLE, 6), 'o': {-i}, 'k': '{k}', 'b': {LEAST_SQL[k]}}}" for i, (k, sql) in enumerate(KINDS_SQL.items()))
CLASSIFIED = f"{VIS}, best AS (SELECT *, list_max([{KIND_ROWS}]) AS m FROM vis), cls AS (SELECT *, CASE WHEN m.s >= m.b THEN m.k ELSE 'unknown' END AS type, CASE WHEN m.s >= m.b THEN least(m.s, 1.0) ELSE 0.3 END::DOUBLE AS confidence FROM best)"


def classified(df: DataFrame) -> DataFrame:
    c = F.col
    r = G.position_ratios(c("x"), c("y"), c("w"), c("h"), PW, PH)
    best = G.argmax(G.image_scores(c("w"), c("h"), r, c("colours"), c("has_text"), c("company"), c("data"), c("qr"), c("activity"), c("site")))
    own = df.withColumn("best", best)
    bound = F.lit(9.0)
    for name, least in G.KIND_BOUNDS:
        bound = F.when(F.col("best.name") == name, least).otherwise(bound)
    sure = F.col("best.score") >= bound
    return own.withColumn("type", F.when(sure, F.col("best.name")).otherwise("unknown")).withColumn("confidence", F.when(sure, F.least("best.score", F.lit(1.0))).otherwise(0.3)).drop("best")


@query(f"WITH {CLASSIFIED} SELECT id, type, confidence FROM cls")
def image_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(visible(images(spark, sf_dir))).select("id", "type", "confidence")


DUPLICATES = f"{CLASSIFIED}, dup AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc, page, id) > 1 AS is_duplicate FROM cls)"


def flagged(df: DataFrame) -> DataFrame:
    """The first image of each hash, by document, page and id, is no duplicate."""
    return df.withColumn("is_duplicate", F.row_number().over(Window.partitionBy("hash").orderBy("doc", "page", "id")) > 1)


def all_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(classified(visible(images(spark, sf_dir))))


@query(f"WITH {DUPLICATES} SELECT id, hash, is_duplicate FROM dup")
def image_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(images(spark, sf_dir)).select("id", "hash", "is_duplicate")


@query(f"WITH {DUPLICATES} SELECT id FROM dup WHERE w >= 10 AND h >= 10 AND w * h >= 50 * 50 AND type NOT IN ('qr_code') AND confidence >= 0.3 AND NOT is_duplicate AND visibility IN ('visible', 'embedded') AND corr >= 0.2")
def image_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.filter_images(all_images(spark, sf_dir), min_size=50, exclude=("qr_code",), confidence=0.3, skip_duplicates=True, visible=("visible", "embedded"), correlation=0.2).select("id")


@query(f"WITH {DUPLICATES} SELECT type, visibility, count(*) AS n, CAST(sum((NOT is_duplicate)::INT) AS BIGINT) AS n_unique, CAST(sum(is_duplicate::INT) AS BIGINT) AS n_duplicate, round(avg(corr), 6) AS mean_correlation FROM dup GROUP BY type, visibility")
def image_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    dup = F.col("is_duplicate").cast("int")
    return all_images(spark, sf_dir).groupBy("type", "visibility").agg(F.count("*").alias("n"), F.sum(1 - dup).alias("n_unique"), F.sum(dup).alias("n_duplicate"), F.round(F.avg("corr"), 6).alias("mean_correlation"))


REGION_KEY = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS id"
REGIONS = f"reg AS (SELECT l_orderkey AS page, {REGION_KEY}, CAST(l_partkey * 41 % 2500 AS INT) AS x, CAST(l_suppkey * 67 % 3200 AS INT) AS y, CAST(l_quantity * 37 AS INT) % 900 + 20 AS w, CAST(l_quantity * 23 AS INT) % 700 + 20 AS h FROM lineitem)"
RW, RH = 2550, 3301


def region_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("page"), F.row_number().over(order).alias("id"), (c("l_partkey") * 41 % 2500).cast("int").alias("x"), (c("l_suppkey") * 67 % 3200).cast("int").alias("y"),
        ((c("l_quantity") * 37).cast("int") % 900 + 20).alias("w"), ((c("l_quantity") * 23).cast("int") % 700 + 20).alias("h"),
    )


FIT = f"w >= 50 AND h >= 50 AND w <= 0.95 * {RW} AND h <= 0.95 * {RH} AND x >= 5 AND y >= 5 AND x + w <= {RW} - 5 AND y + h <= {RH} - 5"


@query(f"WITH {REGIONS} SELECT page, id FROM reg WHERE {FIT}")
def region_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.fitting(region_rows(spark, sf_dir), RW, RH).select("page", "id")


INTER = "greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0)"


@query(f"WITH {REGIONS} SELECT a.page, a.id AS one, b.id AS two, round({INTER} / least(a.w * a.h, b.w * b.h)::DOUBLE, 6) AS share FROM reg a JOIN reg b ON a.page = b.page AND a.id < b.id WHERE {INTER} / least(a.w * a.h, b.w * b.h)::DOUBLE > 0.3")
def region_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.overlaps(region_rows(spark, sf_dir), 0.3)


POS = """CASE WHEN abs(ay - cy) < 20 THEN CASE WHEN ax < cx THEN 'left_of' ELSE 'right_of' END WHEN abs(ax - cx) < 20 THEN CASE WHEN ay < cy THEN 'above' ELSE 'below' END
WHEN ax < cx AND ay < cy THEN 'top_left_of' WHEN ax >= cx AND ay < cy THEN 'top_right_of' WHEN ax < cx THEN 'bottom_left_of' ELSE 'bottom_right_of' END"""


@query(f"""WITH {REGIONS}, p AS (SELECT a.page, a.id AS one, b.id AS two, a.x + a.w // 2 AS ax, a.y + a.h // 2 AS ay, b.x + b.w // 2 AS cx, b.y + b.h // 2 AS cy FROM reg a JOIN reg b ON a.page = b.page AND a.id < b.id)
SELECT page, one, two, round(sqrt(((ax - cx) * (ax - cx) + (ay - cy) * (ay - cy))::DOUBLE), 6) AS distance, {POS} AS position FROM p WHERE sqrt(((ax - cx) * (ax - cx) + (ay - cy) * (ay - cy))::DOUBLE) < 500""")
def region_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.relationships(region_rows(spark, sf_dir), 500)


@query(f"""WITH {REGIONS}, c AS (SELECT *, x + w // 2 AS cx, y + h // 2 AS cy FROM reg)
SELECT page, CAST(sum((cy < 0.2 * {RH})::INT) AS BIGINT) AS header, CAST(sum((cy > 0.8 * {RH})::INT) AS BIGINT) AS footer, CASE WHEN max((cx < 0.4 * {RW})::INT) = 1 AND max((cx > 0.6 * {RW})::INT) = 1 THEN 'multi_column' WHEN count(*) = 1 THEN 'single_element' ELSE 'single_column' END AS layout FROM c GROUP BY page""")
def region_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.layouts(region_rows(spark, sf_dir), RW, RH)


@query(f"WITH {REGIONS} SELECT page, list(id ORDER BY y, x, id) AS reading_order FROM reg GROUP BY page")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region_rows(spark, sf_dir).groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "id"))), lambda r: r["id"]).alias("reading_order"))


@query(f"WITH {REGIONS}, hl AS (SELECT page, id, x AS x1, x + w AS x2, y FROM reg WHERE id % 2 = 0), vl AS (SELECT page, id, x, y AS y1, y + h AS y2 FROM reg WHERE id % 2 = 1) SELECT hl.page, hl.id AS h_id, vl.id AS v_id, vl.x AS x, hl.y AS y FROM hl JOIN vl ON hl.page = vl.page AND vl.x BETWEEN x1 AND x2 AND hl.y BETWEEN y1 AND y2")
def line_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = region_rows(spark, sf_dir)
    rows = own.where("id % 2 = 0").select("page", F.col("id").alias("h_id"), F.col("x").alias("x1"), (F.col("x") + F.col("w")).alias("x2"), F.col("y").alias("hy"))
    columns = own.where("id % 2 = 1").select("page", F.col("id").alias("v_id"), F.col("x").alias("vx"), F.col("y").alias("y1"), (F.col("y") + F.col("h")).alias("y2"))
    both = rows.join(columns, "page").where("vx BETWEEN x1 AND x2 AND hy BETWEEN y1 AND y2")
    return both.select("page", "h_id", "v_id", F.col("vx").alias("x"), F.col("hy").alias("y"))


@query(f"WITH {REGIONS}, d AS (SELECT DISTINCT page, x FROM reg), g AS (SELECT page, x, lead(x) OVER (PARTITION BY page ORDER BY x) AS nx FROM d) SELECT page, x AS from_x, nx AS to_x, nx - x AS gap FROM g WHERE nx - x > 50")
def column_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = region_rows(spark, sf_dir).select("page", "x").distinct()
    ahead = F.lead("x").over(Window.partitionBy("page").orderBy("x"))
    return own.withColumn("to_x", ahead).where(F.col("to_x") - F.col("x") > 50).select("page", F.col("x").alias("from_x"), "to_x", (F.col("to_x") - F.col("x")).alias("gap"))


@query(f"WITH {REGIONS}, n AS (SELECT page, id, w, lag(w) OVER o AS before, lead(w) OVER o AS after, avg(w) OVER p AS m, stddev_pop(w) OVER p AS s FROM reg WINDOW o AS (PARTITION BY page ORDER BY id), p AS (PARTITION BY page)) SELECT page, id, w FROM n WHERE w > before AND w > after AND w > round(m + s, 6)")
def profile_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, page = Window.partitionBy("page").orderBy("id"), Window.partitionBy("page")
    own = region_rows(spark, sf_dir).withColumns({"before": F.lag("w").over(order), "after": F.lead("w").over(order), "m": F.avg("w").over(page), "s": F.stddev_pop("w").over(page)})
    return own.where("w > before AND w > after AND w > round(m + s, 6)").select("page", "id", "w")


@query(f"WITH {REGIONS}, g AS (SELECT page, x - lag(x) OVER (PARTITION BY page ORDER BY x, id) AS gap FROM reg) SELECT page, count(gap) AS n, round(avg(gap), 6) AS mean, round(stddev_pop(gap), 6) AS std, count(gap) >= 2 AND round(stddev_pop(gap), 6) < round(0.3 * avg(gap), 6) AS is_regular FROM g GROUP BY page HAVING count(gap) > 0")
def regular_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = region_rows(spark, sf_dir).withColumn("gap", F.col("x") - F.lag("x").over(Window.partitionBy("page").orderBy("x", "id")))
    own = gaps.groupBy("page").agg(F.count("gap").alias("n"), F.round(F.avg("gap"), 6).alias("mean"), F.round(F.stddev_pop("gap"), 6).alias("std"), F.round(F.avg("gap") * 0.3, 6).alias("bound"))
    return own.where("n > 0").select("page", "n", "mean", "std", ((F.col("n") >= 2) & (F.col("std") < F.col("bound"))).alias("is_regular"))


@query(f"""WITH {REGIONS}, m AS (SELECT page, unnest([{{'s': 0.5 * least(count(*) / 20.0, 1), 'o': 0, 'k': 'contour_method'}}, {{'s': 0.5 * least(sum(w > 400) / 20.0, 1), 'o': -1, 'k': 'line_method'}}, {{'s': 0.5 * least(sum(h > 300) / 10.0, 1), 'o': -2, 'k': 'grid_method'}}]) AS u FROM reg GROUP BY page)
SELECT page, arg_max(u.k, {{'s': round(u.s::DOUBLE, 6), 'o': u.o}}) AS method, max(round(u.s::DOUBLE, 6)) AS score FROM m GROUP BY page""")
def best_table_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of each method's confidence; the first of equals wins."""
    own = region_rows(spark, sf_dir).groupBy("page").agg(F.count("*").alias("a"), F.count_if(F.col("w") > 400).alias("b"), F.count_if(F.col("h") > 300).alias("c"))
    one = F.lit(1.0)
    best = G.argmax({"contour_method": F.least(F.col("a") / 20.0, one) * 0.5, "line_method": F.least(F.col("b") / 20.0, one) * 0.5, "grid_method": F.least(F.col("c") / 10.0, one) * 0.5})
    return own.select("page", best.alias("b")).select("page", F.col("b.name").alias("method"), F.col("b.score").alias("score"))


@query(f"WITH {REGIONS} SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY x, id) - 1 AS INT) AS bar_index, x, y, w AS width, h AS height, h AS value FROM reg")
def bar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = region_rows(spark, sf_dir).withColumn("bar_index", F.row_number().over(Window.partitionBy("page").orderBy("x", "id")) - 1)
    return own.select("page", "bar_index", "x", "y", F.col("w").alias("width"), F.col("h").alias("height"), F.col("h").alias("value"))


@query()
def region_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.suppress(region_rows(spark, sf_dir), 0.3)


@query()
def cell_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.grid(region_rows(spark, sf_dir), 20)
