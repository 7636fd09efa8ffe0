"""Extraction by fallback: what one method did badly goes on to the next.

Methods plug in as functions from documents to (key, text, confidence): a
reader of stored extractions, or an extractor that runs in Python workers.  Each
step runs its method on the documents that are still waiting and on no others,
writes what came out, and keeps the documents whose text is good enough.  So an
expensive last method costs what the others left over.

A text's quality is the method's own confidence, if it gives one, or else
`functions.quality.validity`.  A document begins at the step that `start` names
(the first); its result is the first attempt of `least` or more, or else the
last attempt that gave a text.

Defined results: a document that a method doesn't return, or returns with a null
text, has failed there and goes on; an empty text is a result of quality 0; of
several texts for one document the larger counts; documents without a key are
left out; without any text, method and quality are null and 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import quality as Q
from lectern.sources.sinks import cut


@dataclass(frozen=True)
class Method:
    """run: documents to rows with key, text and, if it has one, confidence."""

    name: str
    run: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Outcome:
    """results: key, method_used, quality_score, fallback_applied, n_attempts,
    text.  attempts: key, step, method, success, quality_score,
    character_count."""

    results: DataFrame
    attempts: DataFrame


def probe(texts: DataFrame, key: str, sample: int = 500) -> DataFrame:
    """What a diagnosis says of one method's texts: characters, the start of the
    text and both scores; key, text."""
    text = F.coalesce("text", F.lit(""))
    short = F.when(F.length(text) > sample, F.concat(F.substring(text, 1, sample), F.lit("..."))).otherwise(text)
    return texts.select(key, F.length(text).alias("total_characters"), short.alias("text_sample"), Q.validity(F.col("text")).alias("validity"))


def attempt(waiting: DataFrame, method: Method, step: int, key: str) -> DataFrame:
    """One step on the documents that wait for it."""
    given = method.run(waiting)
    confidence = F.col("confidence").cast("double") if "confidence" in given.columns else F.lit(None).cast("double")
    best = given.select(key, F.struct("text", confidence.alias("confidence")).alias("x")).where(F.col("x.text").isNotNull()).groupBy(key).agg(F.max("x").alias("x"))
    own = waiting.select(key).distinct().join(best, key, "left")
    text = F.col("x.text")
    score = F.when(text.isNotNull(), F.coalesce("x.confidence", Q.validity(text).cast("double")))
    return own.select(key, F.lit(step).alias("step"), F.lit(method.name).alias("method"), text.isNotNull().alias("success"), score.alias("quality_score"), F.length(text).alias("character_count"), text.alias("text"))


def cascade(docs: DataFrame, methods: list[Method], key: str = "doc_id", least: float = 60, start: Column | None = None) -> Outcome:
    first = F.lit(0) if start is None else F.coalesce(start.cast("int"), F.lit(0))
    waiting = docs.where(F.col(key).isNotNull()).withColumn("_start", first)
    tables = []
    for step, method in enumerate(methods):
        due = waiting.where(F.col("_start") <= step).drop("_start")
        done = cut(attempt(due, method, step, key), f"cascade-{step}")
        tables.append(done)
        waiting = waiting.join(done.where(F.col("quality_score") >= least).select(key), key, "left_anti")
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    attempts = every.drop("text")
    # a row for each method at most
    chosen = attempts.groupBy(key).agg(F.max(F.when(F.col("success"), F.col("step"))).alias("step"), F.count(F.lit(1)).cast("int").alias("n_attempts"))
    texts = every.select(key, "step", F.col("method").alias("method_used"), "quality_score", "text")
    results = chosen.join(texts, [key, "step"], "left").select(key, "method_used", F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"), (F.col("n_attempts") > 1).alias("fallback_applied"), "n_attempts", "text")
    return Outcome(results, attempts)
