"""Recorded values, edge cases and properties of the engine's own operators."""

import json
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lectern import schemas
from lectern.functions import text as X
from lectern.operators import chunking, merge, multimodal, regions, retrieval, vectors
from lectern.sources import points, readers, sinks
from lectern.streaming import ingest
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE0 = "Home report for you.\nAccount number: 954137 Service address: 1627 Tulip Lane " + "word " * 100
PAGE1 = " ".join(f"word{i}" for i in range(183))


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_redaction_takes_the_rest_of_the_line(spark):
    assert one(spark, X.redact, "Account # : 12 x\nservice ADDRESS: 5 Elm\nDear JILL DOE, hi") == "Account # : 12 x\nservice ADDRESS: SERVICE_ADDRESS_REDACTED\nDear NAME_REDACTED, hi"
    assert one(spark, X.redact, "Account number: 12 x") == "Account number: ACCOUNT_NUMBER_REDACTED x"


def test_two_pages_make_one_chunk(spark):
    """The first page loses its text to redaction and fails the filter."""
    pages = spark.createDataFrame([(1, 0, PAGE0), (1, 1, PAGE1)], "doc long, page int, text string")
    found = chunking.chunks(pages, "doc", "page").collect()
    assert len(found) == 1
    c = found[0]
    assert (c.chunk_id, c.chunk_index, c.page_num, c.start_char, c.end_char, c.tokens, c.section_path) == ("1:c0", 0, 1, len(PAGE0), len(PAGE0) + len(PAGE1), 183, "page/1")


def plain_windows(text, size=1000, overlap=120):
    spans = [m.span() for m in re.finditer(r"\w+", text)]
    out, at = [], 0
    while spans:
        last = at + size >= len(spans)
        end = len(text) if last else spans[at + size][0]
        out.append((spans[at][0], text[spans[at][0] : end]))
        if last:
            break
        at += size - overlap
    return out


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="ab é_1 .,\n😀́", max_size=60), min_size=1, max_size=12))
def test_windows_are_the_plain_ones(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").withColumn("page", F.lit(0))
    found = {}
    for r in chunking.chunk_windows(rows, "doc", "page", 7, 3).collect():
        found.setdefault(r.doc, []).append((r.window_no, r.start_char, r.end_char, r.text))
    for i, t in enumerate(texts):
        assert sorted(found.get(i, [])) == [(n, s, s + len(raw), raw.strip()) for n, (s, raw) in enumerate(plain_windows(t, 7, 3))]


@pytest.mark.parametrize("n", [999, 1000, 1001, 1880, 1881])
def test_window_borders(spark, n):
    text = "- " + " ".join(f"w{i}" for i in range(n)) + "!\n"
    rows = spark.createDataFrame([(1, 0, text)], "doc long, page int, text string")
    found = chunking.chunk_windows(rows, "doc", "page").orderBy("window_no").collect()
    assert [(r.start_char, r.text) for r in found] == [(s, raw.strip()) for s, raw in plain_windows(text)]


def test_quality_borders(spark):
    keep = lambda t: one(spark, X.passes_quality, t)
    assert keep(" ".join(["w"] * 30)) and not keep(" ".join(["w"] * 29)) and not keep("")
    assert keep("ab" * 1 + " ab" * 29 + "!" * 89) and not keep("w " * 30 + "!" * 61)


def test_snippets(spark):
    assert one(spark, X.snippet, " " + "x" * 300 + "\n") == "x" * 300
    assert one(spark, X.snippet, "x" * 301) == "x" * 300 + "..." and one(spark, X.snippet, "") is None and one(spark, X.snippet, None) is None


def test_recorded_fields(spark):
    text = "Account number: 954137\nService address: 1627 Tulip Lane\nDear JILL DOE, you used 6% less. Call 800.895.4999 or visit xcelenergy.com/x"
    found = one(spark, X.structured_data, text)
    assert found.account_number == ["954137"] and found.service_address == ["1627 Tulip Lane"] and found.customer_name == ["JILL DOE"] and found.percentage == ["6"] and found.phone_number == ["800.895.4999"] and found.email is None


def test_constant_vectors_have_cosine_one(spark):
    rows = spark.createDataFrame([(1, [0.1] * 384), (2, [0.2] * 384), (3, [0.0] * 384)], "vec_id long, embedding array<float>")
    found = {r.vec_id: r.cosine for r in retrieval.similar(rows, 1, 5).collect()}
    assert found == {1: 1.0, 2: 1.0, 3: 0.0}
    assert retrieval.similar(rows, 99, 5).count() == 0


def test_search_edges(spark):
    docs = spark.createDataFrame([(1, "cat dog cat"), (2, "dog"), (3, None), (4, "bird")], "doc_id long, text string")
    hits = lambda q: [(r.doc_id, r["rank"]) for r in retrieval.fts(docs, q, 10, "doc_id").collect()]
    assert hits("cat dog") == [(1, 3)] and hits("cat zebra") == [(1, 2)] and hits("zebra") == [] and hits("the of") == []
    density = {r.doc_id: r["rank"] for r in retrieval.cover_density(docs, "cat dog", "doc_id").collect()}
    assert density == {1: 2.0}
    assert retrieval.answer(docs.limit(0).select("doc_id", F.lit(1.0).alias("score"), F.lit("x").alias("snippet"))).first().answer == "No relevant content found."


def plain_sentences(section, most):
    done, cur = [], ""
    for s in [x for x in re.split(r"[.!?]+\s+", section) if x]:
        joined = f"{cur}. {s}" if cur else s
        if len(joined) <= most:
            cur = joined
        else:
            done += [cur] if cur else []
            cur = s[:most]
    return done + ([cur] if cur else [])


def plain_semantic(text, most):
    done, cur = [], ""
    for s in [x.strip() for x in re.split(r"\n\n+|\n#{1,6}\s", text)]:
        if not s:
            continue
        joined = f"{cur}\n\n{s}" if cur else s
        if len(joined) <= most:
            cur = joined
            continue
        done += [cur] if cur else []
        cur = s
        if len(s) > most:
            pieces = plain_sentences(s, most)
            done, cur = done + pieces[:-1], pieces[-1] if pieces else ""
    return done + ([cur] if cur else [])


def test_semantic_chunks(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["word ", "other. ", "\n\n", "\n# head ", "x" * 40 + "! ", "é"]) for _ in range(rng.randrange(60))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = rows.select("doc_id", chunking.semantic_chunks(F.col("text"), 60).alias("c")).collect()
    for r in found:
        assert r.c == plain_semantic(texts[r.doc_id], 60)
    with pytest.raises(ValueError, match="unknown"):
        chunking.create_chunks(rows, "none")


def test_structure_chunks_of_whole_texts(spark):
    """Lines are stripped and packed; against a version that looks at all starts of a chunk."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.concat(F.lit("  "), F.replace("text", F.lit("\n"), F.lit(" \n\t ")), F.lit(" \n\n # x ")).alias("text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in docs.select("doc_id", chunking.structure_chunks(F.col("text"), 300).alias("c")).collect():
        lines = [x.strip() for x in (texts[r.doc_id] or "").split("\n") if x.strip()]
        wanted, at = [], 0
        while at < len(lines):
            stop = max(j for j in range(at + 1, len(lines) + 1) if j == at + 1 or sum(map(len, lines[at:j])) <= 300)
            wanted.append("\n".join(lines[at:stop]))
            at = stop
        assert r.c == wanted


def test_grid_rows(spark):
    rng = random.Random(9)
    cells = [(p, i, rng.randrange(300), rng.randrange(200)) for p in range(5) for i in range(40)]
    wanted = {}
    for page in range(5):
        row, top = -1, None
        for _, i, x, y in sorted((c for c in cells if c[0] == page), key=lambda c: (c[3], c[2], c[1])):
            if top is None or abs(y - top) > 20:
                row, top = row + 1, y
            wanted[page, i] = (row, x)
    found = {(r.page, r.id): (r.row, r.x) for r in regions.grid(spark.createDataFrame(cells, "page long, id int, x int, y int"), 20).collect()}
    assert found == wanted


def test_reports_images_and_databases(spark, tmp_path):
    """Reports carry the id of their folder; images come by page; a database is read by ranges."""
    for doc, name, body in (("d1", "a_ocr_report.json", {"document_id": "x", "text_length": 3}), ("d2", "b_ocr_report.json", {"text_length": 4}), ("d2", "c_other.json", {"text_length": 5})):
        (tmp_path / "documents" / doc / "metadata").mkdir(parents=True, exist_ok=True)
        (tmp_path / "documents" / doc / "metadata" / name).write_text(json.dumps(body, indent=1))
    schema = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("text_length", T.LongType())])
    found = sorted(map(tuple, readers.reports(spark, str(tmp_path), "*_ocr_report.json", schema).collect()))
    assert found == [("d1", 3), ("d2", 4)]
    (tmp_path / "images.json").write_text(json.dumps({"images": [{"image_id": "a", "filename": "a.png", "page_number": 1, "coordinates": {"x": 1, "y": 2}, "classification": {"type": "photo"}}, {"image_id": "b", "filename": "b.png", "page_number": 1, "coordinates": {"x": 3, "y": 4}, "classification": {"type": "logo"}}]}, indent=1))
    c = F.col
    images = readers.image_metadata(spark, str(tmp_path / "images.json")).select(F.lit(1).alias("doc"), c("page_number").alias("page"), "filename", c("classification.type").alias("type"), c("coordinates.x").alias("x"), c("coordinates.y").alias("y"))
    pages = spark.createDataFrame([(1, 1, "Monthly savings tip: go"), (1, 2, "none")], "doc int, page int, text string")
    out = {r.page: (r.text, r.n_images) for r in multimodal.pages_with_images(pages, images).collect()}
    assert out == {1: ("Monthly savings tip:\n\n[IMAGE: a.png - photo at (1, 2)]\n\n go\n\n[IMAGE: b.png - logo at (3, 4)]\n\n", 2), 2: ("none", 0)}
    sinks.images(spark.createDataFrame([(1, "visible", "logo"), (2, "embedded", "photo")], "id int, visibility string, type string"), str(tmp_path / "images"))
    assert (tmp_path / "images/visibility=visible/type=logo").is_dir() and spark.read.parquet(str(tmp_path / "images")).where("type = 'photo'").first().id == 2
    url = "jdbc:derby:memory:lectern;create=true"
    spark.range(100).withColumnRenamed("id", "n").write.format("jdbc").option("url", url).option("dbtable", "numbers").mode("overwrite").save()
    rows = readers.jdbc(spark, url, "numbers", "n", (0, 100), 4)
    assert rows.rdd.getNumPartitions() == 4 and sorted(r[0] for r in rows.where("n >= 95").collect()) == [95, 96, 97, 98, 99]


def test_size_chunks():
    text = " ".join(f"word{i}" for i in range(300))
    pieces = list(chunking.size_pieces(text, 100, 20))
    assert all(len(p) <= 100 for p in pieces) and pieces[-1].endswith("word299")
    assert len(list(chunking.size_pieces(text, 100, 20, legacy_tail=True))) > len(pieces)


def test_suppression_and_grid(spark):
    rows = spark.createDataFrame([(1, 1, 0, 0, 100, 100), (1, 2, 10, 10, 80, 80), (1, 3, 300, 0, 50, 50), (1, 4, 310, 18, 5, 5)], "page long, id int, x int, y int, w int, h int")
    assert sorted(r.id for r in regions.suppress(rows, 0.3).collect()) == [1, 3]
    assert {r.id: r.row for r in regions.grid(rows, 10).collect()} == {1: 0, 3: 0, 2: 0, 4: 1}


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, t string")
    new = spark.createDataFrame([("b", 3, "z"), ("c", 4, "w"), ("c", 5, "v")], "k string, n int, t string")
    assert sorted(map(tuple, merge.upsert(old, new, ["k"], ["n"]).collect())) == [("a", 1, "x"), ("b", 3, "z"), ("c", 5, "v")]
    assert sorted(map(tuple, merge.upsert(old, new, ["k"], ["n"], update=["t"]).collect())) == [("a", 1, "x"), ("b", 2, "z"), ("c", 5, "v")]
    update = merge.upsert(old.withColumn("t", F.lit(None).cast("string")), new.withColumn("n", F.nullif("n", F.lit(3))), ["k"], ["n"], update=["n"])
    assert sorted(map(tuple, update.collect())) == [("a", 1, None), ("b", None, None), ("c", 5, "v")]
    assert [r.i for r in merge.numbered(spark.range(1000).repartition(5), "id", "i").orderBy("id").collect()] == list(range(1, 1001))
    assert merge.numbered(spark.range(0), "id", "i").count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a/ocr_results").mkdir(parents=True)
    (tmp_path / "a/ocr_results/p0_ocr.json").write_text(json.dumps({"page_number": 0, "text": "one", "confidence": 90.5}))
    (tmp_path / "a/ocr_results/p1_ocr.json").write_text(json.dumps({"text": "two"}))
    (tmp_path / "a/ocr_results/p2_ocr.json").write_text("{broken")
    found = sorted((r.page_number, r.text, r.confidence) for r in readers.ocr_pages(spark, str(tmp_path)).collect())
    assert found == [(0, "one", 90.5), (1, "two", 0.0)]
    assert schemas.OCR_PAGE.names == ["page_number", "text", "confidence"]
    listing = {r.extension: (r.n, r.bytes) for r in readers.manifest(readers.files(spark, str(tmp_path))).collect()}
    assert listing[".json"][0] == 3
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "a:c0", "text": "t"}\n\n{"chunk_id": "a:c1"}\n')
    assert readers.jsonl(spark, str(tmp_path / "c.jsonl"), schemas.CHUNK).count() == 2
    (tmp_path / "b.md").write_text("second")
    (tmp_path / "a.md").write_text("first")
    assert readers.first_text(spark, str(tmp_path / "*.md")).first().text == "first"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], {"k": 1})], "id int, tags array<string>, m map<string,int>")
    sinks.csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).select("id").first().id == "1"
    sinks.staged({"t": df}, str(tmp_path / "root"), "20240101")
    sinks.staged({"t": df.withColumn("id", F.lit(2))}, str(tmp_path / "root"), "20240102")
    assert sinks.current(spark, str(tmp_path / "root"), "t").first().id == 2
    sinks.staged({"t": df.withColumn("id", F.lit(3))}, str(tmp_path / "root"), "20230101")
    assert sinks.current(spark, str(tmp_path / "root"), "t").first().id == 3
    sinks.report(df, str(tmp_path / "report"))
    sinks.markdown(df.withColumn("b", F.lit("body")), str(tmp_path / "md"), "id", "b")
    assert "body" in [r.value for r in spark.read.text(str(tmp_path / "md")).collect()]


def test_stream(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(50))
    for i in (1, 2):
        spark.createDataFrame([(7, 0, f"{words} v{i}"), (i, 0, words)], "doc_id long, page int, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
        ingest.ingest(spark, str(tmp_path / "pages"), str(tmp_path / "chunks"), str(tmp_path / "check")).awaitTermination(60)
    found = {r.document_id: r.text for r in ingest.current(spark, str(tmp_path / "chunks")).collect()}
    assert set(found) == {1, 2, 7} and found[7].endswith("v2")


def test_pages_of_a_document_in_several_batches(spark, tmp_path):
    pages = [" ".join(f"p{n}w{i}" for i in range(40)) for n in range(3)]
    batches = [[(1, 0, pages[0]), (2, 0, pages[0])], [(1, 1, pages[1])], [(1, 0, pages[2]), (2, 0, "gone")]]
    for rows in batches:
        spark.createDataFrame(rows, "doc_id long, page int, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
        ingest.ingest(spark, str(tmp_path / "pages"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    found = sorted((r.document_id, r.chunk_index, r.page_num, r.start_char, r.text) for r in ingest.current(spark, str(tmp_path / "out")).collect())
    assert found == [(1, 0, 0, 0, pages[2]), (1, 1, 1, len(pages[2]), pages[1])]


def test_images_that_are_barely_sure(spark):
    """A logo needs .6, and a site that the page names helps a code."""
    from lectern.plans import layout

    row = (1, 0, 0, 0, 0, 90, 300, 400, False, True, False, False, False, False, 0.0)
    names = "id long, doc long, page long, x int, y int, w int, h int, colours int, has_text boolean, company boolean, data boolean, qr boolean, activity boolean, site boolean, corr double"
    code = (2, 0, 0, 300, 400, 60, 60, 40, True, False, False, True, False, True, 0.0)
    found = {r.id: (r.type, r.confidence) for r in layout.classified(layout.visible(spark.createDataFrame([row, code], names))).collect()}
    assert found == {1: ("logo", 0.7), 2: ("qr_code", 1.0)}


def test_near_index_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    probes = rows.where("vec_id % 100 = 0")
    found = {}
    for r in vectors.NearIndex(rows).search(probes, 5).collect():
        found.setdefault(r.probe, set()).add(r.vec_id)
    hits = [len(found.get(p.vec_id, set()) & {r.vec_id for r in retrieval.similar(rows, p.vec_id, 5).collect()}) for p in probes.collect()]
    assert sum(hits) / (5 * len(hits)) >= 0.9


def test_average_hash(spark):
    grey = np.zeros((16, 16))
    grey[:, 8:] = 255
    assert vectors.average_hash(grey) == "f0f0f0f0f0f0f0f"
    rows = spark.createDataFrame([(1, 16, 16, bytearray(grey.astype(np.uint8).tobytes()))], "id long, width int, height int, pixels binary")
    assert vectors.image_hashes(rows).first().hash == "f0f0f0f0f0f0f0f"


def test_quality_of_whole_texts(spark, tmp_path):
    from lectern.plans import extraction

    clean = "A plain sentence of several words, which ends here. " * 4
    rows = [(i, clean) for i in range(8)] + [(i + 8, clean + X.ARTIFACTS[0]) for i in range(8)] + [(i + 16, "") for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    score = {r.doc_id: r.score for r in extraction.text_quality_full(spark, str(tmp_path)).collect()}
    assert [score[i] for i in range(24)] == [100] * 8 + [95] * 8 + [0] * 8


def test_service(spark):
    from lectern import service

    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert service.get_document(docs, 2).first().text == "two"
    with pytest.raises(service.NotFound):
        service.get_document(docs, 9)
    for unknown in (2, 3):
        with pytest.raises(service.NotFound):
            service.similar(docs, vectors, unknown)
    assert service.similar(docs, vectors, 1, 1).first().vec_id == 1
    assert service.Config.from_environment({"POSTGRES_DSN": "d"}).dsn == "d" and service.Config(alpha=2.0).problems()
    assert service.health(docs, vectors, service.Config("d")) == {"status": "ok", "problems": [], "documents": 2, "vectors": 2}
    assert [r.vec_id for r in service.orphans_removed(vectors, docs, "vec_id", "doc_id").collect()] == [1]


def test_retries():
    from lectern import service

    class Refused(Exception):
        status = 404

    def calls(errors):
        left = list(errors)

        def call():
            if left:
                raise left.pop(0)
            return "done"

        return call

    waits = []
    assert points.with_retries(calls([OSError()] * 4), sleep=waits.append) == "done" and waits == [0.5, 1.0, 2.0, 4.0]
    with pytest.raises(OSError):
        points.with_retries(calls([OSError()] * 5), sleep=waits.append)
    with pytest.raises(Refused):
        points.with_retries(calls([Refused()]), sleep=waits.append)


def test_record_rules(spark):
    from lectern.operators import validation

    good = {f.name: "x" for f in schemas.DOCUMENT if f.name in schemas.REQUIRED_DOCUMENT} | {"schema_version": "1.0.0", "language": "en"}
    rows = spark.createDataFrame([{**good, "n": 1}, {**good, "n": 2, "title": None, "language": "de"}, {**good, "n": 3, "schema_version": "2"}], schemas.StructType([f for f in schemas.DOCUMENT if f.name in good]).add("n", "integer"))
    found = {r.n: r.v for r in rows.select("n", validation.document_violations().alias("v")).collect()}
    assert found == {1: [], 2: ["required:title", "enum:language"], 3: ["const:schema_version"]}
    assert validation.unexpected_columns(rows, "document") == ["n"]
    vectors = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "embedding array<double>")
    assert validation.checked_vectors(vectors.where(F.size("embedding") == 2), 2).count() == 1
    with pytest.raises(Exception, match="the collection 2"):
        validation.checked_vectors(vectors, 2).collect()


def test_second_quality_score(spark):
    from lectern.functions import quality

    words = "plain words in a row " * 6
    assert [one(spark, quality.validity, t) for t in ("", "Short.", words, words + ".", words + ". Col1 NULL", words + "." + "aaaaa b " * 6)] == [0, 60, 70, 100, 80, 80]
