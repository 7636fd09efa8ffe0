"""The `opN_` queries: each applies one operator, with production parameters,
to its whole table and selects the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import cross_polytope, crf_quality, decontam, filter_audit, keyed_upsert, langid, line_dedup, line_hash, mixing, pii, signature_tree, splitters, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = crf_quality.train_line_field(docs, table(spark, sf_dir, "labels"))
    return crf_quality.score_documents(docs, field).drop("text")


def op2_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    out = splitters.shard_records(docs, shards=40, record_bytes=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = pii.base_spans(F.col("spans"))
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(base) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", items, "contaminated")


def op5_line_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.near_repeated_lines(table(spark, sf_dir, "documents"), edits=4, short_copies=True)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_line_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_hash.repeated_spans(table(spark, sf_dir, "documents")).drop("text_key")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    model = langid.train_language_model(docs.where(~out))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op9_jaccard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_tree.link_components(table(spark, sf_dir, "documents"), width=4, num=85, den=100).drop("text_key")


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text", "source")


def op11_keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients, folder = table(spark, sf_dir, "clients"), keyed_upsert.new_folder(spark, "clients")
    files, now, _ = keyed_upsert.upsert_clients(clients, table(spark, sf_dir, "client_changes"), folder)
    text = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("source", "segment", "city")])
    sums = {"cents": F.coalesce(F.floor(100 * F.col("balance") + 0.5), F.lit(0)), "rows_crc": keyed_upsert.crc32(text)}
    found = keyed_upsert.file_digests(spark, folder, now, "client_id", sums)
    path = F.concat(F.lit(folder.replace("file://", "") + "/"), "_lx_name")
    return found.select(F.col("first_key").alias("first_id"), "n_rows", "cents", "rows_crc", F.col("keys_sha256").alias("ids_sha256"), F.lit(",".join(clients.columns)).alias("columns"), path.alias("path"), (~F.col("_lx_name").isin([f.name for f in files])).alias("rewritten"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20, tables=12, probes=10)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_line_field, op2_splitters, op3_pii, op4_decontamination, op5_line_edits, op6_warc, op7_line_hashes, op8_language, op9_jaccard_tree, op10_mixture, op11_keyed_upsert, op12_filter_audit, op13_cross_polytope)}


def oracle_sql() -> dict[str, str]:
    from lectern.llm.oracles import SQL

    return dict(SQL)
