"""Upserts, audits and numbering without a transactional table format.

Results are new DataFrames: write them beside the old table and swap paths,
never over a path that is being read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`."""
    last = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank")


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], order: list[str], update: list[str] | None = None) -> DataFrame:
    """Incoming rows replace stored ones with their key.  With `update` only
    those columns change, to null too, and the others keep what is stored."""
    new = latest(incoming, key, order)
    if update is None:
        return new.unionByName(stored.join(new.select(*key), key, "left_anti"))
    old, fresh = stored.withColumn("_is_old", F.lit(True)).alias("o"), new.withColumn("_is_new", F.lit(True)).alias("n")
    on = [F.col(f"o.{c}") == F.col(f"n.{c}") for c in key]

    def chosen(c: str) -> Column:
        was, comes = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in key:
            return F.coalesce(comes, was)
        return F.when(F.col("_is_new"), comes).otherwise(was) if c in update else F.when(F.col("_is_old"), was).otherwise(comes)

    columns = [chosen(c) for c in stored.columns]
    return old.join(fresh, on, "full").select(*[x.alias(c) for x, c in zip(columns, stored.columns, strict=True)])


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is missing."""
    return children.join(parents, children[child_key] == parents[parent_key], "left_anti")


def numbered(rows: DataFrame, order: str, name: str, parts: int = 64) -> DataFrame:
    """Gapless numbers from 1 in the order of a numeric column, without one
    task for all rows: quantiles give ranges, whose counts are added up; rows
    are numbered inside their range."""
    fractions = [i / parts for i in range(1, parts)]
    bounds = sorted(set(rows.agg(F.percentile_approx(order, fractions, 1000)).first()[0] or []))
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    parted = rows.withColumn("_part", part)
    counts = {r[0]: r[1] for r in parted.groupBy("_part").count().collect()}
    before, total = {}, 0
    for i in sorted(counts):
        before[i] = total
        total += counts[i]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_part")) if before else F.lit(0)
    own = Window.partitionBy("_part").orderBy(order)
    return parted.withColumn(name, (F.row_number().over(own) + offset).cast("long")).drop("_part")
