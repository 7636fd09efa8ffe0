"""Documents to training shards, in five stages.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
documents.  Counted as part of the package `lectern.llm`.

Defined results, of each stage by itself: rows without text or words, and
texts of fewer than 20 words, fail the quality rules.  Near duplicates leaves
all rows without words, and of rows with words that are equal in id and text
one; a null id comes after all others there.  Decontamination leaves rows
without words.  The mixture takes rows without words 0 times and rows of equal
ids alike; a null source is a source of its own.  Sharding places every row,
null ids before others.
Extra columns stay, but for the last stage's size, shard and slot, which
replace columns of these names.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import crf_quality, decontam, mixing, signature_tree, splitters
from lectern.llm.common import cut
from lectern.llm.queries import table

#: Conditional random fields and sampled splitters have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or have too little content go."""
    field = crf_quality.train_line_field(docs, table(spark, sf_dir, "labels"))
    return crf_quality.filter_documents(docs, field)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five words, a similarity of 0.8."""
    return signature_tree.drop_linked(docs, width=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontam.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.repeat_rows(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, shard and slot."""
    return splitters.shard_records(docs, shards=40, record_bytes=16)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
