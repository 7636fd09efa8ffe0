"""Report builders and the queryable formats of a run; runs that are named at once."""

import json
import threading
from datetime import datetime
from pathlib import Path

import pytest
from lectern.operators import chunking, multimodal, regions, reports, retrieval
from lectern.sources import sinks, versions
from pyspark.sql import functions as F

AT = datetime(2024, 5, 1, 8, 0, 5)


def test_queryable_formats(spark, tmp_path):
    native = spark.createDataFrame([(1, "four", {"a": "1", "b": "2"}, 2, 0.5, None), (2, None, None, None, None, 80.0)], "document_id long, full_text string, structured_data map<string,string>, total_pages int, processing_time double, confidence double")
    ocr = spark.createDataFrame([(1, "text", None, None, 3, 1.5, ["s"]), (3, "é", 91.5, 200, 1, None, None)], "document_id long, full_text string, average_confidence double, dpi int, total_pages int, processing_time double, screenshots array<string>")
    texts = reports.text_reports(native, ocr)
    rows = {(r.extraction_method, r.document_id): r for r in texts.collect()}
    assert (rows["enhanced_pdf", 1].confidence_score, rows["enhanced_pdf", 1].structured_elements_found, rows["enhanced_pdf", 1].text_length) == (95.0, 2, 4)
    assert (rows["enhanced_pdf", 2].confidence_score, rows["enhanced_pdf", 2].pages_processed, rows["enhanced_pdf", 2].text_length, rows["enhanced_pdf", 2].dpi) == (80.0, 0, 0, None)
    assert (rows["visual_ocr", 1].average_confidence, rows["visual_ocr", 1].dpi, rows["visual_ocr", 1].screenshots_saved) == (0.0, 300, 1)
    assert (rows["visual_ocr", 3].average_confidence, rows["visual_ocr", 3].dpi, rows["visual_ocr", 3].processing_time) == (91.5, 200, 0.0)

    elements = spark.createDataFrame([(1, 5, "table", 0.5, True), (1, 7, "table", None, None), (1, 6, "chart", 1.0, False), (2, 1, "text", 1.0, True), (2, 2, None, 1.0, True)], "document_id long, id int, type string, confidence double, has_data boolean")
    manifest = sorted(tuple(r) for r in reports.element_manifest(elements, AT).collect())
    assert manifest == [(1, "chart", 0, "1_chart_0_20240501_080005.png", 1.0, False), (1, "table", 0, "1_table_0_20240501_080005.png", 0.5, True), (1, "table", 1, "1_table_1_20240501_080005.png", 0.0, False)]
    summaries = reports.element_summaries(elements)
    assert sorted((r.document_id, r.total_elements, tuple(r.breakdown)) for r in summaries.collect()) == [(1, 3, (2, 1, 0)), (2, 0, (0, 0, 0))]

    images = spark.createDataFrame([(1, "logo", "visible", None, "x", 0.9), (1, None, None, "d", None, None), (2, "logo", "visible", "e", "y", 0.1)], "document_id long, type string, visibility string, description string, context string, confidence double")
    found = {r.document_id: (r.total_images, r.classification_breakdown, r.visibility_breakdown) for r in reports.classification_reports(images).collect()}
    assert found == {1: (2, {"logo": 1, "unknown": 1}, {"unknown": 1, "visible": 1}), 2: (1, {"logo": 1}, {"visible": 1})}

    documents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "document_id long, title string")
    out = reports.write_queryable(str(tmp_path), documents, texts, summaries, images.limit(0), "s1", AT, F.col("document_id"))
    assert "images_table" not in out and Path(out["unified_index"]).is_dir()
    text = "\n".join(r.value for r in spark.read.text(out["unified_index"]).collect())
    index = json.loads(text)
    assert (index["total_documents"], index["total_text_extractions"], index["total_visual_elements"], index["total_images"], index["session_id"]) == (3, 4, 3, 0, "s1")
    ids = {r.id for r in spark.read.json(out["text_search_index"]).collect()}
    assert ids == {f"text_{i}" for i in range(4)}
    assert spark.read.option("header", True).csv(out["documents_table"]).count() == 3
    assert reports.file_name(F.lit(7), "full_text", AT, "txt") is not None


def test_runs_named_at_once_both_count(spark, tmp_path):
    root, numbers = str(tmp_path / "root"), []
    frames = [spark.createDataFrame([(i,)], "id int") for i in range(4)]
    threads = [threading.Thread(target=lambda i=i: numbers.append(sinks.staged({"t": frames[i]}, root, f"r{i}"))) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(numbers) == [1, 2, 3, 4]
    last = versions.latest(spark, root)[1]["run_id"]
    assert sinks.current(spark, root, "t").first().id == int(last[1:])
    with pytest.raises(LookupError):
        sinks.current(spark, root, "u")


def test_images_with_the_text_of_their_documents(spark):
    text = "First part.\n\nTip: save energy with full laundry loads today.\n\nUsage was above typical kwh."
    images = spark.createDataFrame([(1, 1, "photo", 10), (1, 2, "chart", 11), (1, 9, None, 12), (2, 0, "logo", 13)], "doc long, page int, type string, image_id int")
    texts = spark.createDataFrame([(1, text), (1, "A"), (3, "x"), (None, "y")], "doc long, text string")
    found = {r.image_id: r for r in multimodal.correlate_with_text(images, texts).collect()}
    assert set(found) == {10, 11, 12, 13}
    photo = found[10].text_correlation
    assert photo.nearby_text.startswith("Tip: save") and photo.primary_context == "energy_tips" and "direct_reference" not in photo.supporting_relationships
    assert photo.indicators == ["laundry_activity_reference", "energy_saving_context"] and photo.correlation_strength == pytest.approx(min(1, photo.context_scores["energy_tips"] + 0.12), abs=1e-6)
    assert found[11].text_correlation.primary_context in ("usage_data", "comparison") and found[13].text_correlation.primary_context == "general"
    assert found[13].text_correlation.context_confidence == 0.1 and found[10].contextual_description.startswith("Illustration supporting")


def test_embedding_chunks_and_others(spark):
    docs = spark.createDataFrame([(1, "One sentence. " * 80), (2, None)], "doc_id long, text string")
    images = spark.createDataFrame([(1, "b.png", "logo"), (1, "a.png", "photo"), (1, "a.png", "photo")], "doc_id long, filename string, type string")
    own = chunking.embedding_chunks(docs, "size", most=200, images=images).where("doc_id = 1").collect()
    assert len(own) > 3 and all(r.metadata == {"chunk_strategy": "size", "max_chunk_size": "200"} and [x.filename for x in r.image_references] == ["a.png", "b.png"] for r in own)
    with pytest.raises(ValueError, match="unknown"):
        chunking.embedding_chunks(docs, "other")
    # of equal keys among the nearest the farthest is left
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 0.1]), (3, [-1.0, 0.0])], "vec_id int, embedding array<double>")
    found = {r.vec_id: r.cosine for r in retrieval.vector_search(vectors, vectors.where("vec_id = 3").limit(1).withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0))), 3).collect()}
    assert found == {1: pytest.approx(0.707107, abs=1e-5), 2: pytest.approx(0.995037, abs=1e-5)}
    boxes = spark.createDataFrame([(1, 1, 0, 0, 10, 10, "table"), (1, 2, 0, 50, 10, 10, "chart"), (2, 1, 0, 0, 10, 10, "table")], "page int, id int, x int, y int, w int, h int, type string")
    pages = spark.createDataFrame([(1,), (2,), (3,)], "page int")
    assert {r.page: r.layout for r in regions.layouts(boxes, 100, 100, pages).collect()} == {1: "mixed_data", 2: "single_element", 3: "empty"}
