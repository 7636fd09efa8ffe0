"""Mixing sources to target weights by hash-threshold histograms.

Each source has a target number of words.  Whole passes over a source come
first; of the rest, documents are taken whose hash lies under the source's
threshold.  The threshold is found without sorting: sizes are summed by source
and hash bucket, the bucket in which the budget runs out is found from running
sums, and only that bucket is divided again, until it holds a single hash.
The documents of that last hash are taken if that brings the source nearer to
its budget.  The hash depends on doc_id alone, so reruns agree, and a larger
budget takes a superset.

Defined results: a null or empty text has no words and is taken 0 times; null
sources are a source, sorted last; documents with equal ids share a hash and
are taken together; a source without words has target 0.  Extra columns stay;
for `mix` and `take`, input columns named like a result of `mix` are left
out.  An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import cut, md5_key, word_count

HASH, SIZE, SOURCE, CUT = "_lx_hash", "_lx_size", "_lx_source", "_lx_cut"
TIMES, SOURCE_SIZE, TARGET = "_lx_times", "_lx_source_size", "_lx_target"
HASH_BITS, LEVEL_BITS = 60, 10
#: Sources up to which what is known of each goes to all executors.
BROADCAST_SOURCES = 20_000


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...], share: float, most: float) -> dict[str | None, float]:
    """Words for each source: `share` of all sizes by weight, none above
    `most` times its own size; what is cut off goes to the others by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    bound = {s: most * n for s, n in order}
    out: dict[str | None, float] = {}
    left, open_ = share * sum(n for _, n in order), [s for s, _ in order]
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > bound[s]]
        if not over:
            out.update((s, left * weight[s] / total) for s in open_)
            break
        out.update((s, bound[s]) for s in over)
        left -= sum(bound[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def bucket(level: int) -> Column:
    """The hash down to the bits of a level."""
    return F.shiftright(F.col(HASH), HASH_BITS - LEVEL_BITS * level)


def thresholds(docs: DataFrame, rests: DataFrame) -> DataFrame:
    """For each source (SOURCE, rest) the hash CUT under which documents are
    taken.  Each level sums the open bucket of each source by sub-bucket and
    keeps one running total per source, so no row is ever sorted."""
    spark = docs.sparkSession
    state = rests.select(SOURCE, F.col("rest").alias("left"), F.lit(0).cast("long").alias("prefix"))
    found = None
    rows = docs
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        same = [rows[SOURCE].eqNullSafe(state[SOURCE]), F.shiftright(rows[HASH], HASH_BITS - LEVEL_BITS * (level - 1)) == state["prefix"]]
        rows = rows.join(state, same[0] & same[1]).select(rows[SOURCE], HASH, SIZE, state["left"])
        sums = rows.groupBy(SOURCE, "left", bucket(level).alias("at")).agg(F.sum(SIZE).alias("n"), F.min(HASH).alias("low"), F.max(HASH).alias("high"))
        running = Window.partitionBy(SOURCE).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("through", F.sum("n").over(running))
        # the first bucket that goes beyond the budget
        over = sums.where(F.col("through") > F.col("left")).groupBy(SOURCE).agg(F.min(F.struct("at", "n", "through", "left", "low", "high")).alias("b")).select(SOURCE, "b.*")
        over = cut(over, f"mix-level-{level}")
        single = (F.col("low") == F.col("high")) if level * LEVEL_BITS < HASH_BITS else F.lit(True)
        before = F.col("through") - F.col("n")
        nearer = F.col("through") - F.col("left") < F.col("left") - before
        done = over.where(single).select(SOURCE, F.when(nearer, F.col("low") + 1).otherwise(F.col("low")).alias(CUT))
        found = done if found is None else found.unionByName(done)
        state = over.where(~single).select(SOURCE, (F.col("left") - before).alias("left"), F.col("at").alias("prefix"))
        if state.isEmpty():
            break
        rows = rows.select(SOURCE, HASH, SIZE)
    return cut(found, "mix-thresholds") if found is not None else spark.createDataFrame([], docs.select(SOURCE, F.col(HASH).alias(CUT)).schema)


def counted(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """`docs` with SIZE, TIMES (how often the mix takes a row), SOURCE_SIZE and TARGET."""
    sized = docs.withColumns({SIZE: word_count(F.col("text")), HASH: md5_key(F.col("doc_id").cast("string")), SOURCE: F.col("source")})
    narrow = cut(sized.select(SOURCE, HASH, SIZE), "mix-sizes")
    totals = cut(narrow.groupBy(SOURCE).agg(F.sum(SIZE).cast("long").alias("source_size")), "mix-totals")
    plan = source_plan(totals, weights, share, most)
    small = plan.count() <= BROADCAST_SOURCES
    hint = F.broadcast if small else (lambda df: df)
    rests = plan.where("rest > 0").select(SOURCE, "rest")
    limits = thresholds(narrow, rests)
    plan = plan.join(limits.withColumnRenamed(SOURCE, "_lx_of"), F.col(SOURCE).eqNullSafe(F.col("_lx_of")), "left")
    plan = plan.select(F.col(SOURCE).alias("_lx_of"), F.col("source_size").alias(SOURCE_SIZE), F.col("target").alias(TARGET), F.col("passes").alias(TIMES), CUT)
    out = sized.join(hint(plan), F.col(SOURCE).eqNullSafe(F.col("_lx_of")), "left")
    return out.withColumn(TIMES, F.col(TIMES) + F.when(F.col(HASH) < F.col(CUT), 1).otherwise(0))


def given_columns(docs: DataFrame) -> list[str]:
    """Columns that no result of `mix` is named like."""
    return [c for c in docs.columns if c.lower() not in {"size", "source_size", "target", "taken"}]


def mix(docs: DataFrame, **options) -> DataFrame:
    """`docs` with size, source_size, target and taken; options as in `counted`."""
    out = counted(docs, **options)
    return out.select(*given_columns(docs), F.col(SIZE).alias("size"), F.col(SOURCE_SIZE).alias("source_size"), F.col(TARGET).alias("target"), (F.col(SIZE) * F.col(TIMES)).cast("long").alias("taken"))


def source_plan(totals: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Target, whole passes and the rest of the budget of each source.  Sources
    are as few as there are origins of text; beyond BROADCAST_SOURCES the same
    reshare runs by joins, see `reshare`."""
    spark = totals.sparkSession
    if totals.count() <= BROADCAST_SOURCES:
        sizes = [(r[0], r[1]) for r in totals.collect()]
        aim = targets(sizes, weights, share, most)
        rows = [(s, n, float(aim[s])) for s, n in sizes]
        planned = spark.createDataFrame(rows, f"{SOURCE} string, source_size long, target double")
    else:
        planned = reshare(totals, weights, share, most)
    # a source taken `most` times over has no rest
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    planned = planned.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    return cut(planned, "mix-plan")


def reshare(totals: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """`targets` for any number of sources, as DataFrame rounds: the weights go
    by rank, and the level at which bounded sources stop is found by halving."""
    ranked = totals.rdd.map(lambda r: ((r[0] is None, r[0] or ""), r)).sortByKey().zipWithIndex().map(lambda x: (x[0][1][0], x[0][1][1], float(weights[x[1] % len(weights)])))
    own = cut(totals.sparkSession.createDataFrame(ranked, f"{SOURCE} string, source_size long, weight double"), "mix-weights")
    budget = share * (own.agg(F.sum("source_size")).first()[0] or 0)
    low, high = 0.0, max(1.0, budget)
    level = F.least(F.lit(most) * F.col("source_size"), F.col("weight") * F.lit(1.0))
    for _ in range(80):
        middle = (low + high) / 2
        level = F.least(F.lit(most) * F.col("source_size"), F.col("weight") * F.lit(middle))
        if (own.agg(F.sum(level)).first()[0] or 0.0) < budget:
            low = middle
        else:
            high = middle
    return own.select(SOURCE, "source_size", F.least(F.lit(most) * F.col("source_size"), F.col("weight") * F.lit(high)).alias("target"))


def repeat_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each row as often as it is taken, with the columns
    that it came with, whatever their names."""
    out = counted(docs, **options).where((F.col(SIZE) > 0) & (F.col(TIMES) > 0))
    return out.withColumn("_lx_copy", F.explode(F.sequence(F.lit(1), F.col(TIMES).cast("int")))).select(*docs.columns)


def take(docs: DataFrame, **options) -> DataFrame:
    """`repeat_rows` without columns named like a result of `mix`."""
    return repeat_rows(docs.select(*given_columns(docs)), **options)
