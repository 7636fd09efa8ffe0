"""Corpus pipeline queries: pages, chunks, redaction, upserts."""

from __future__ import annotations

from datetime import timedelta

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import chunking, embedding, merge
from lectern.plans.registry import query, table
from lectern.sources import sinks
from lectern.streaming import documents

W = r"[\p{L}\p{N}_]"
SP = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SP}+', ''), '{SP}+$', '')"


def redact_sql(x: str) -> str:
    x = rf"regexp_replace({x}, '(?i)(account\s*number\s*[:#]?\s*)(\S+)', '\1ACCOUNT_NUMBER_REDACTED', 'g')"
    x = rf"regexp_replace({x}, '(?i)(service\s*address\s*[:#]?\s*)([^\n\r]+)', '\1SERVICE_ADDRESS_REDACTED', 'g')"
    return rf"regexp_replace({x}, '(?i)(dear\s+)([A-Z][A-Z\s]+)(,)', '\1NAME_REDACTED\3', 'g')"


def keep_sql(x: str) -> str:
    symbols = rf"regexp_replace({x}, '[\p{{L}}\p{{N}}\s\p{{Z}}\x0b\x1c-\x1f\x85]', '', 'g')"
    return f"len(regexp_extract_all({x}, '{W}+')) >= 30 AND length({symbols}) / greatest(1, length({x})) <= 0.5"


#: Pages to windows: needs CTE p(key, page, offs, t).
WINDOWS_SQL = rf"""
tok AS (SELECT key, page, offs, regexp_extract_all(t, '{W}+[^\p{{L}}\p{{N}}_]*') AS w, length(regexp_extract(t, '^[^\p{{L}}\p{{N}}_]*')) AS lead FROM p),
win AS (SELECT key, page, offs, lead, w, unnest(range(0, CAST(greatest(ceil((len(w) - 1000) / 880.0), 0) AS BIGINT) + 1)) AS i FROM tok WHERE len(w) > 0),
raw AS (SELECT key, page, i, offs + lead + coalesce(list_sum(list_transform(w[1:880 * i], lambda x: length(x))), 0) AS s, array_to_string(w[880 * i + 1:880 * i + 1000], '') AS raw FROM win)"""
DOC_PAGES = "p AS (SELECT doc_id AS key, 0 AS page, 0 AS offs, text AS t FROM documents)"
TURN_PAGES = "p AS (SELECT conv_id AS key, turn AS page, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offs, text AS t FROM conversations)"
LABELLED = "'Account number: ' || doc_id || ' Dear JILL DOE, ' || text || ' Service address: 12 Elm St' AS text"


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("page"), "text")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the labels that redaction looks for."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Account number: "), F.col("doc_id").cast("string"), F.lit(" Dear JILL DOE, "), F.col("text"), F.lit(" Service address: 12 Elm St")).alias("text"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, CAST(count(*) AS INT) AS page_count, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS checksum FROM conversations GROUP BY conv_id")
def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.normalize_pages(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char FROM conversations")
def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.page_offsets(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "start_char")


@query(f"WITH {DOC_PAGES}, {WINDOWS_SQL} SELECT key AS doc_id, CAST(i AS INT) AS window_no, CAST(s AS BIGINT) AS start_char, CAST(s + length(raw) AS BIGINT) AS end_char, {strip_sql('raw')} AS text FROM raw")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_windows(doc_pages(spark, sf_dir), "doc_id", "page").select("doc_id", "window_no", "start_char", "end_char", "text")


CHUNKS_SQL = rf"""{WINDOWS_SQL},
red AS (SELECT key, page, i, s, s + length(raw) AS e, {redact_sql(strip_sql('raw'))} AS text FROM raw),
chunk AS (SELECT key, page, s, e, text, row_number() OVER (PARTITION BY key ORDER BY page, i) - 1 AS n FROM red WHERE {keep_sql('text')})"""


CHUNK_RECORDS_SQL = rf"""SELECT key || ':c' || n AS chunk_id, key AS document_id, CAST(n AS INT) AS chunk_index, page AS page_num, CAST(s AS BIGINT) AS start_char, CAST(e AS BIGINT) AS end_char,
'page/' || page AS section_path, 'prose' AS content_type, CAST(len(regexp_extract_all(text, '{W}+')) AS INT) AS tokens, 1.0::DOUBLE AS quality_score, text FROM chunk"""


@query(f"WITH {TURN_PAGES}, {CHUNKS_SQL} {CHUNK_RECORDS_SQL}")
def chunk_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(table(spark, sf_dir, "conversations"), "conv_id", "turn")


#: Turns of a conversation come a second apart, conversations start a minute apart.
TURN_SECONDS = "(conv_id + 1) * 60 + turn"


class LetterCounts:
    """A provider whose vectors SQL can say: how often each of a to z occurs."""

    model, dim = "letter-counts", 26

    def load(self) -> embedding.Embed:
        return lambda texts: (np.array([float(t.count(chr(97 + i))) for i in range(26)]) for t in texts)


EMBEDDED_SQL = "embedded AS (SELECT key || ':c' || n AS chunk_id, key AS document_id, 'letter-counts' AS embedding_model, list_transform(range(26), lambda i: (length(text) - length(replace(text, chr(97 + i::INT), '')))::FLOAT) AS embedding_vector FROM chunk)"


@query(f"WITH {TURN_PAGES}, {CHUNKS_SQL}, {EMBEDDED_SQL} SELECT * FROM embedded")
def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of conversations through a provider, 64 to a call."""
    return embedding.embed(chunk_pipeline(spark, sf_dir), LetterCounts(), parent="document_id")


@query(f"WITH {TURN_PAGES}, {CHUNKS_SQL}, {EMBEDDED_SQL} SELECT 'run' AS run_id, 'conversations' AS source, max(embedding_model) AS model, coalesce(max(len(embedding_vector)), 0)::INT AS embedding_dim, count(*)::BIGINT AS chunks_embedded FROM embedded")
def embedding_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.manifest(embedded_chunks(spark, sf_dir), "run", "conversations").drop("created_at")


@query(f"WITH {TURN_PAGES}, {CHUNKS_SQL} {CHUNK_RECORDS_SQL} WHERE key IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING max({TURN_SECONDS}) + 200.5 < (SELECT max({TURN_SECONDS}) FROM conversations))")
def streamed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a stream of pages; those that are finished when all has
    come, as chunks."""
    folder = sinks.shared_folder(spark, "stream")
    pages = spark.readStream.schema(table(spark, sf_dir, "conversations").schema).parquet(f"{sf_dir}/[c]onversations.parquet")  # a pattern, since a stream takes no single file
    timed = pages.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text", F.timestamp_seconds(F.expr(TURN_SECONDS)).alias("ts"))
    documents.start(timed, folder, f"{folder}/checkpoint", idle=timedelta(seconds=100, milliseconds=250)).awaitTermination()
    return documents.current(spark, folder)


@query(rf"SELECT doc_id, {redact_sql('text')} AS text FROM (SELECT doc_id, {LABELLED} FROM documents)")
def redact_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("doc_id", X.redact(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {keep_sql('text')} AS kept FROM documents")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.passes_quality(F.col("text")).alias("kept"))


@query(rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '{W}+')) AS INT) AS tokens, CAST(len(regexp_extract_all(text, '[^\s\p{{Z}}\x0b\x1c-\x1f\x85]+')) AS INT) AS words FROM documents")
def word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.token_count(t).alias("tokens"), X.word_count(t).alias("words"))


@query("SELECT 'run' AS run_id, CAST(max(len(embedding)) AS INT) AS embedding_dim, count(*) AS chunks_embedded FROM embeddings")
def index_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding")).alias("embedding_dim"), F.count("*").alias("chunks_embedded")).select(F.lit("run").alias("run_id"), "embedding_dim", "chunks_embedded")


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(text) FROM documents) AS indexed")
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.count("text").alias("indexed"))
    return docs.crossJoin(table(spark, sf_dir, "embeddings").agg(F.count("*").alias("vectors"))).select("documents", "vectors", "indexed")


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the documents, by checksum: a third of the ids is stored
    only, a third comes in only, a third is in both.  The split is made up, and
    so are the nulls, which updates must carry over."""
    docs = table(spark, sf_dir, "documents").select(F.substring(F.sha2("text", 256), 1, 12).alias("document_id"), "doc_id", "lang", "source", "n_chars")
    old = docs.where("doc_id % 3 <> 1").withColumn("source", F.nullif("source", F.lit("src1")))
    return old, docs.where("doc_id % 3 <> 0").withColumn("lang", F.nullif("lang", F.lit("de")))


VERSIONS = """d AS (SELECT substr(sha256(text), 1, 12) AS document_id, doc_id, lang, source, n_chars FROM documents),
old AS (SELECT * FROM (SELECT document_id, doc_id, lang, nullif(source, 'src1') AS source, n_chars, row_number() OVER (PARTITION BY document_id ORDER BY doc_id DESC) AS r FROM d WHERE doc_id % 3 <> 1) WHERE r = 1),
new AS (SELECT * FROM (SELECT document_id, doc_id, nullif(lang, 'de') AS lang, source, n_chars, row_number() OVER (PARTITION BY document_id ORDER BY doc_id DESC) AS r FROM d WHERE doc_id % 3 <> 0) WHERE r = 1)"""


@query(f"WITH {VERSIONS} SELECT document_id, doc_id, lang, source, n_chars FROM new UNION ALL SELECT document_id, doc_id, lang, source, n_chars FROM old WHERE document_id NOT IN (SELECT document_id FROM new)")
def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = versions(spark, sf_dir)
    old = merge.latest(old, ["document_id"], ["doc_id"])
    return merge.upsert(old, new, ["document_id"], ["doc_id"])


@query(f"WITH {VERSIONS} SELECT coalesce(new.document_id, old.document_id) AS document_id, coalesce(old.doc_id, new.doc_id) AS doc_id, CASE WHEN new.document_id IS NULL THEN old.lang ELSE new.lang END AS lang, CASE WHEN old.document_id IS NULL THEN new.source ELSE old.source END AS source, CASE WHEN new.document_id IS NULL THEN old.n_chars ELSE new.n_chars END AS n_chars FROM new FULL JOIN old ON new.document_id = old.document_id")
def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = versions(spark, sf_dir)
    old = merge.latest(old, ["document_id"], ["doc_id"])
    return merge.upsert(old, new, ["document_id"], ["doc_id"], update=["lang", "n_chars"])


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def orphan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose id no label has."""
    return merge.orphans(table(spark, sf_dir, "embeddings").select("vec_id"), table(spark, sf_dir, "labels"), "vec_id", "doc_id")


@query("SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) AS BIGINT) AS point_id, CAST((row_number() OVER (ORDER BY vec_id) - 1) // 256 AS BIGINT) AS batch_no FROM embeddings")
def point_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.numbered(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", "point_id").withColumn("batch_no", F.floor((F.col("point_id") - 1) / 256))


@query()
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunking.create_chunks(docs, "semantic")


@query()
def structure_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.create_chunks(table(spark, sf_dir, "documents"), "structure")


@query()
def size_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.create_chunks(table(spark, sf_dir, "documents"), "size")
