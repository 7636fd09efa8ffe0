"""Regions meet in few cells, with the pairs of all regions of a page."""

import random

import pytest
from lectern.operators import regions, rulings
from pyspark.sql import functions as F

BOX = "page long, id long, x int, y int, w int, h int"


def boxes(seed, n, most):
    pick = random.Random(seed)
    own = [(p, i, pick.randrange(-300, 3000), pick.randrange(-300, 3000), pick.randint(1, most), pick.randint(1, most)) for p in range(3) for i in range(n)]
    return [*own, (0, n, -500, -500, 4000, 4000), (0, n + 1, 5, 5, 1, 3500), (0, n + 2, 5, 5, 3500, 1), (1, n, 7, 7, 0, 5), (None, 1, 0, 0, 9, 9), (None, 2, 0, 0, 9, 9)]


def shared(a, b):
    return max(min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]), 0) * max(min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]), 0)


@pytest.mark.parametrize("few", [0, 64, 1000])
def test_pairs_are_those_of_all_regions(spark, few):
    rows = [*boxes(1, 70, 40), *[(p + 10, *r) for p, *r in boxes(2, 70, 900) if p is not None]]
    frame = spark.createDataFrame(rows, BOX)
    pairs = [(a, b) for a in rows for b in rows if a[0] is not None and a[0] == b[0] and a[1] < b[1]]
    found = {(r.page, r.one, r.two) for r in regions.overlaps(frame, 0.3, few=few).collect()}
    assert found == {(a[0], a[1], b[1]) for a, b in pairs if a[4] * a[5] * b[4] * b[5] and shared(a, b) / min(a[4] * a[5], b[4] * b[5]) > 0.3}
    middle = lambda r: (r[2] + r[4] // 2, r[3] + r[5] // 2)
    close = {(r.page, r.one, r.two) for r in regions.relationships(frame, 150, few=few).collect()}
    assert close == {(a[0], a[1], b[1]) for a, b in pairs if (middle(a)[0] - middle(b)[0]) ** 2 + (middle(a)[1] - middle(b)[1]) ** 2 < 150**2}
    across, down = frame.where("id % 2 = 0").selectExpr("page", "id", "y", "x x1", "x + w x2"), frame.where("id % 2 = 1").selectExpr("page", "id", "x", "y y1", "y + h y2")
    met = {(r.page, r.h_id, r.v_id) for r in rulings.crossings(across, down, few=few).collect()}
    assert met == {(h[0], h[1], v[1]) for h in rows for v in rows if h[0] is not None and h[0] == v[0] and h[1] % 2 == 0 and v[1] % 2 == 1 and h[2] <= v[2] <= h[2] + h[4] and v[3] <= h[3] <= v[3] + v[5]}


@pytest.mark.parametrize(("few", "most"), [(0, 4.2), (64, 1)])
def test_cells_of_a_region(spark, few, most):
    """Regions of 900 x 700 lay in 80 cells each; they lie in four in the mean."""
    frame = spark.range(4000).select((F.col("id") % 100).alias("page"), F.col("id"), (F.col("id") * 7919 % 2500).cast("int").alias("x"), (F.col("id") * 104729 % 3200).cast("int").alias("y"), F.lit(900).alias("w"), F.lit(700).alias("h"))
    df = regions.overlaps(frame, 0.3, few=few)
    df.collect()
    plan, rows = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.nodeName() == "Generate":
            rows.append(node.metrics().apply("numOutputRows").value())
        inner = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if "QueryStage" in node.nodeName() else None
        if inner is not None:
            walk(inner)
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    assert 4000 <= max(rows) <= most * 4000
