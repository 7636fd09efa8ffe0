"""Reports of what extractors gave, and the tables and indices made of them.

Each report is a table with a row for each document (or element), so that a run
over many documents is one job; `write_queryable` stores the tables, the search
indices and the master index in the folders that readers look for.

Defined results: null texts have length 0; what a report's shape lacks is null;
numbers in ids follow the order of documents, from 0.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.merge import numbered
from lectern.sources import sinks

ELEMENTS = ("table", "chart", "image")
#: What counts when a result doesn't say.
NATIVE_CONFIDENCE, OCR_CONFIDENCE, OCR_DPI = 95, 0, 300


def stamp(at: datetime) -> str:
    """As it stands in file names."""
    return f"{at:%Y%m%d_%H%M%S}"


def file_name(document: Column, what: str, at: datetime, ending: str) -> Column:
    return F.concat(document.cast("string"), F.lit(f"_{stamp(at)}_{what}.{ending}"))


def native_reports(results: DataFrame) -> DataFrame:
    """results: document_id, full_text, structured_data (a map), total_pages,
    processing_time, confidence."""
    return results.select(
        F.lit("enhanced_pdf").alias("extraction_method"), "document_id", F.coalesce("processing_time", F.lit(0.0)).alias("processing_time"), F.length(F.coalesce("full_text", F.lit(""))).cast("long").alias("text_length"),
        F.coalesce(F.col("confidence").cast("double"), F.lit(float(NATIVE_CONFIDENCE))).alias("confidence_score"), F.coalesce("total_pages", F.lit(0)).alias("pages_processed"), F.when(F.col("structured_data").isNull(), 0).otherwise(F.size("structured_data")).alias("structured_elements_found"),
    )


def ocr_reports(results: DataFrame) -> DataFrame:
    """results: document_id, full_text, average_confidence, dpi, total_pages,
    processing_time, screenshots (an array)."""
    return results.select(
        F.lit("visual_ocr").alias("extraction_method"), "document_id", F.coalesce("processing_time", F.lit(0.0)).alias("processing_time"), F.length(F.coalesce("full_text", F.lit(""))).cast("long").alias("text_length"),
        F.coalesce(F.col("average_confidence").cast("double"), F.lit(float(OCR_CONFIDENCE))).alias("average_confidence"), F.coalesce("total_pages", F.lit(0)).alias("pages_processed"), F.coalesce("dpi", F.lit(OCR_DPI)).alias("dpi"), F.when(F.col("screenshots").isNull(), 0).otherwise(F.size("screenshots")).alias("screenshots_saved"),
    )


def text_reports(native: DataFrame, ocr: DataFrame) -> DataFrame:
    return native_reports(native).unionByName(ocr_reports(ocr), allowMissingColumns=True)


def element_manifest(elements: DataFrame, at: datetime) -> DataFrame:
    """document_id, type, index (from 0 for each type), filename, confidence,
    has_data; elements: document_id, id, type, confidence, has_data."""
    known = elements.where(F.col("type").isin(*ELEMENTS))
    index = F.row_number().over(Window.partitionBy("document_id", "type").orderBy("id")) - 1
    own = known.withColumn("index", index)
    name = F.concat(F.col("document_id").cast("string"), F.lit("_"), F.col("type"), F.lit("_"), F.col("index").cast("string"), F.lit(f"_{stamp(at)}.png"))
    return own.select("document_id", "type", "index", name.alias("filename"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), F.coalesce("has_data", F.lit(False)).alias("has_data"))


def element_summaries(elements: DataFrame) -> DataFrame:
    """document_id, total_elements, breakdown by type."""
    known = F.col("type").isin(*ELEMENTS)
    counts = F.struct(*[F.count_if(F.col("type") == t).alias(f"{t}s") for t in ELEMENTS])
    return elements.groupBy("document_id").agg(F.count_if(known).alias("total_elements"), counts.alias("breakdown"))


def classification_reports(images: DataFrame) -> DataFrame:
    """document_id, total_images, counts by type and by visibility; images:
    document_id, type, visibility."""
    kinds = [("classification_breakdown", "type"), ("visibility_breakdown", "visibility")]
    # counted before they meet: a map entry for each kind, of which there are few
    one = images.select("document_id", *[F.coalesce(c, F.lit("unknown")).alias(c) for _, c in kinds])
    out = one.groupBy("document_id").agg(F.count(F.lit(1)).alias("total_images"))
    for name, c in kinds:
        counted = one.groupBy("document_id", c).agg(F.count(F.lit(1)).alias("n")).groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(name))
        out = out.join(counted, "document_id")
    return out


def numbered_by(rows: DataFrame, order: Column, prefix: str) -> DataFrame:
    """rows with id: prefix and number in a numeric order, from 0."""
    own = numbered(rows.withColumn("_order", order.cast("long")), "_order", "_n").drop("_order")
    return own.withColumn("id", F.concat(F.lit(prefix), (F.col("_n") - 1).cast("string"))).drop("_n")


def image_index(images: DataFrame, order: Column) -> DataFrame:
    """images: document_id, type, description, context, confidence."""
    own = numbered_by(images, order, "img_")
    return own.select("id", "document_id", "type", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("context", F.lit("")).alias("context"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), F.lit(True).alias("searchable"))


def element_index(summaries: DataFrame, order: Column) -> DataFrame:
    own = numbered_by(summaries, order, "elem_")
    return own.select("id", "document_id", "total_elements", "breakdown", F.lit(True).alias("searchable"))


def text_index(reports: DataFrame, order: Column) -> DataFrame:
    own = numbered_by(reports, order, "text_")
    confidence = F.coalesce("confidence_score", "average_confidence", F.lit(0.0))
    return own.select("id", "document_id", F.col("extraction_method").alias("method"), F.lit("").alias("content_preview"), confidence.alias("confidence"), F.lit(True).alias("searchable"))


def unified_index(documents: DataFrame, reports: DataFrame, summaries: DataFrame, images: DataFrame, session: str, at: datetime) -> DataFrame:
    """One row: how much there is and what it is called."""
    one = documents.agg(F.count(F.lit(1)).alias("total_documents"))
    counts = [reports.agg(F.count(F.lit(1)).alias("total_text_extractions")), summaries.agg(F.coalesce(F.sum("total_elements"), F.lit(0)).alias("total_visual_elements")), images.agg(F.count(F.lit(1)).alias("total_images"))]
    for c in counts:  # a row each
        one = one.crossJoin(c)
    names = {"available_indices": [f"{x}_search_index" for x in ("text", "image", "elements")], "database_tables": [f"{x}_table.csv" for x in ("documents", "text_extractions", "visual_elements", "images")]}
    return one.select(F.lit(at.isoformat()).alias("created_at"), F.lit(session).alias("session_id"), *one.columns, *[F.array(*[F.lit(v) for v in values]).alias(n) for n, values in names.items()])


def write_queryable(root: str, documents: DataFrame, reports: DataFrame, summaries: DataFrame, images: DataFrame, session: str, at: datetime, order: Column) -> dict[str, str]:
    """The queryable formats of a run: CSV tables, search indices as JSON lines
    and the master index; a table without rows is not written.  Returns folders
    by name."""
    base, out = f"{root}/queryable", {}
    tables = {"documents_table": documents, "text_extractions_table": reports, "visual_elements_table": summaries, "images_table": images}
    for name, df in tables.items():
        if not df.isEmpty():
            out[name] = f"{base}/database_ready/{name}"
            sinks.csv(df, out[name])
    for name, df in {"text_search_index": text_index(reports, order), "image_search_index": image_index(images, order), "elements_search_index": element_index(summaries, order)}.items():
        out[name] = f"{base}/search_indices/{name}"
        sinks.jsonl(df, out[name])
    out["unified_index"] = f"{base}/unified_index"
    sinks.report(unified_index(documents, reports, summaries, images, session, at), out["unified_index"])
    for name, df in {"documents_api": documents, "extractions_api": reports}.items():
        out[name] = f"{base}/api_ready/{name}"
        sinks.jsonl(df, out[name])
    return out
