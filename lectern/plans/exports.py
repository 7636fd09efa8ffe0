"""Records checked against their schemas, flat tables and texts for exports,
region kinds and the second quality score."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern import schemas
from lectern.functions import geometry as G
from lectern.functions import quality as Q
from lectern.functions import relevance as R
from lectern.functions import text as X
from lectern.operators import reports as made
from lectern.operators import validation
from lectern.plans.analytics import MEDIA, NEAR_PAIRS, media, reports
from lectern.plans.corpus import strip_sql
from lectern.plans.layout import DUPLICATES, PH, PW, REGIONS, RH, VIS, all_images, images, region_rows
from lectern.plans.registry import query, table

RECORD = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '0.9.0' ELSE '1.0.0' END AS schema_version, lang AS language, CASE WHEN doc_id % 10 > 0 THEN source END AS title, CASE WHEN n_chars > 0 THEN text END AS text FROM documents"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records; some break a rule."""
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    made = {"schema_version": F.when(i % 7 == 0, "0.9.0").otherwise("1.0.0"), "language": F.col("lang"), "title": F.when(i % 10 > 0, F.col("source")), "text": F.when(F.col("n_chars") > 0, F.col("text"))}
    return docs.select("doc_id", *[made.get(f.name, F.lit("x")).alias(f.name) for f in schemas.DOCUMENT if f.name in schemas.REQUIRED_DOCUMENT])


@query(f"SELECT doc_id, list_filter([CASE WHEN title IS NULL THEN 'required:title' END, CASE WHEN language IS NULL THEN 'required:language' END, CASE WHEN text IS NULL THEN 'required:text' END, CASE WHEN schema_version <> '1.0.0' THEN 'const:schema_version' END, CASE WHEN language NOT IN ('en') THEN 'enum:language' END], lambda x: x IS NOT NULL) AS violations FROM ({RECORD})")
def document_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", validation.document_violations().alias("violations"))


@query("""SELECT conv_id, turn, list_filter([CASE WHEN text IS NULL THEN 'required:text' END, CASE WHEN role NOT IN ('prose', 'table', 'code', 'other') THEN 'enum:content_type' END, CASE WHEN turn - 1 < 0 THEN 'minimum:start_char' END], lambda x: x IS NOT NULL) AS violations FROM conversations""")
def chunk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = {"schema_version": F.lit("1.0.0"), "start_char": F.col("turn") - 1, "end_char": F.col("turn"), "text": F.col("text"), "content_type": F.col("role")}
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", *[own.get(c, F.lit("x")).alias(c) for c in (*schemas.REQUIRED_CHUNK, "content_type")])
    return rows.select("conv_id", "turn", validation.chunk_violations().alias("violations"))


SPACED = r"len(regexp_extract_all(text, '[^\s\p{Z}\x0b\x1c-\x1f\x85]+'))"


@query(rf"""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(1, length(text) + 1)) AS i FROM documents WHERE text <> ''),
g AS (SELECT doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS g FROM c),
r AS (SELECT doc_id, count(*) AS runs FROM (SELECT doc_id FROM g WHERE c <> chr(10) GROUP BY doc_id, c, g HAVING count(*) >= 5) GROUP BY doc_id)
SELECT doc_id, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(0, 100 - CASE WHEN length(text) < 100 THEN 40 ELSE 0 END - CASE WHEN NOT regexp_matches(text, '[.!?]') AND {SPACED} > 10 THEN 30 ELSE 0 END - CASE WHEN coalesce(runs, 0) > 5 THEN 20 ELSE 0 END
- 10 * (contains(text, 'Col1')::INT + contains(text, 'Col2')::INT + contains(text, 'Col3')::INT + contains(text, '��')::INT + contains(text, 'NULL')::INT)) END AS INT) AS score FROM documents LEFT JOIN r USING (doc_id)""")
def extraction_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", Q.validity(F.col("text")).alias("score"))


@query("""SELECT doc_id, CASE WHEN m = '' THEN 'No extraction method succeeded' WHEN s < 30 THEN m || ' scored highest (' || s || ') but quality is still poor. Consider visual OCR with preprocessing.' WHEN s < 60 THEN m || ' scored highest (' || s || ') with moderate quality. May need fallback methods.'
WHEN m = 'visual_ocr' THEN 'Visual OCR recommended (' || s || ') - programmatic methods likely have invisible text issues' WHEN m = 'pdfplumber' THEN 'PDFPlumber recommended (' || s || ') - good for complex layouts and tables' ELSE m || ' recommended (' || s || ') - standard extraction works well' END AS reason
FROM (SELECT doc_id, ['pymupdf', 'pdfplumber', 'visual_ocr', ''][doc_id % 4 + 1] AS m, doc_id * 17 % 101 AS s FROM documents)""")
def recommendation_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    method = F.element_at(F.array(*[F.lit(m) for m in ("pymupdf", "pdfplumber", "visual_ocr", "")]), (i % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", Q.recommendation_reason(method, i * 17 % 101).alias("reason"))


@query(f"""WITH {VIS} SELECT id, CASE WHEN len(said) = 0 THEN 'general characteristics' ELSE array_to_string(said, ', ') END AS reason FROM (SELECT id, list_filter([CASE WHEN CASE WHEN rw * rh > 0.3 THEN 1 ELSE rw * rh / 0.3 END > 0.5 THEN 'large size' WHEN CASE WHEN rw * rh < 0.05 THEN 1 ELSE (0.05 - rw * rh) / 0.05 END > 0.5 THEN 'small size' END,
CASE WHEN rx > 0.4 AND rx < 0.6 AND ry > 0.3 AND ry < 0.7 THEN 'centered position' END, CASE WHEN ry < 0.15 THEN 'header position' END, CASE WHEN ry > 0.85 THEN 'footer position' END, CASE WHEN colours > 1000 THEN 'photographic content' END, CASE WHEN has_text THEN 'contains text' END, CASE WHEN rw > 0.8 AND rh > 0.8 THEN 'page-sized dimensions' END], lambda x: x IS NOT NULL) AS said FROM vis)""")
def visibility_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    r = G.position_ratios(c("x"), c("y"), c("w"), c("h"), PW, PH)
    return images(spark, sf_dir).select("id", Q.visibility_reason(r, c("colours") > 1000, c("has_text")).alias("reason"))


KIND_SQL = {
    "table": "CASE WHEN a > 4 THEN 0.3 WHEN a > 2 THEN 0.2 ELSE 0 END + 0.5 * ((id % 5) / 4.0::DOUBLE)",
    "chart": "CASE WHEN a < 0.5 THEN 0.3 ELSE 0 END + 0.5 * ((id % 3) / 2.0::DOUBLE)",
    "image": "CASE WHEN a < 0.5 THEN 0.2 ELSE 0 END",
    "text": "CASE WHEN a > 2 AND a <= 4 THEN 0.3 ELSE 0 END + 0.5 * ((id % 2) / 2.0::DOUBLE)",
    "header": "CASE WHEN a > 4 THEN 0.2 ELSE 0 END + CASE WHEN y < 3301 * 0.2 THEN 0.3 ELSE 0 END",
    "footer": "CASE WHEN y > 3301 * 0.8 THEN 0.3 ELSE 0 END",
}
KINDS = ", ".join(f"{{'s': round(({s})::DOUBLE, 6), 'o': {-i}, 'k': '{k}'}}" for i, (k, s) in enumerate(KIND_SQL.items()))


@query(f"WITH {REGIONS} SELECT page, id, list_max([{KINDS}]).k AS kind, least(list_max([{KINDS}]).s, 1)::DOUBLE AS confidence, CASE WHEN y <= 3301 * 0.15 THEN 'header' WHEN y >= 3301 * 0.85 THEN 'footer' END AS band FROM (SELECT *, w / greatest(h, 1)::DOUBLE AS a FROM reg)")
def region_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest kind of each region, and whether it is in a page's band
    for headers or footers."""
    c = F.col
    best = Q.region_kind(c("w"), c("h"), c("y"), float(RH), {"table": c("id") % 5 / 4, "chart": c("id") % 3 / 2, "text": c("id") % 2 / 2})
    rows = region_rows(spark, sf_dir).withColumn("best", best)
    return rows.select("page", "id", F.col("best.name").alias("kind"), F.least(F.col("best.score"), F.lit(1.0)).alias("confidence"), Q.page_band(c("y"), float(RH)).alias("band"))


@query(f"WITH {REGIONS} SELECT page, id, CASE WHEN w * h / 20.0::DOUBLE > r * r * 0.1::DOUBLE THEN round(w * h / 20.0::DOUBLE / (pi() * r * r) * 100, 6) END AS percentage FROM (SELECT *, greatest(w, h) / 2.0::DOUBLE AS r FROM reg)")
def pie_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.greatest("w", "h") / 2.0
    return region_rows(spark, sf_dir).select("page", "id", F.round(Q.pie_share(F.col("w") * F.col("h") / 20.0, r), 6).alias("percentage"))


def image_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images as the nested records of image reports, with their place in the
    document."""
    c = F.col
    place = F.row_number().over(Window.partitionBy("doc").orderBy("page", "id")) - 1
    return all_images(spark, sf_dir).select(
        c("doc").alias("document_id"), place.alias("image_index"), F.concat(F.lit("img"), c("id").cast("string"), F.lit(".png")).alias("filename"),
        F.struct(c("w").alias("width"), c("h").alias("height")).alias("dimensions"), F.struct("x", "y", c("w").alias("width"), c("h").alias("height")).alias("coordinates"),
        F.struct("type", "confidence").alias("classification"), F.when(c("id") % 4 > 0, F.struct("visibility")).alias("visibility_analysis"),
        F.when(c("id") % 3 > 0, F.struct(c("corr").alias("correlation_strength"), c("hash").alias("primary_context"))).alias("text_correlation"), F.lit(None).cast("string").alias("contextual_description"),
    )


IMAGE_SQL = "SELECT doc AS document_id, row_number() OVER (PARTITION BY doc ORDER BY page, id) - 1 AS image_index, 'img' || id || '.png' AS filename, type, confidence, CASE WHEN id % 4 > 0 THEN visibility END AS visibility, CASE WHEN id % 3 > 0 THEN corr END AS corr, CASE WHEN id % 3 > 0 THEN hash END AS context, x, y, w, h FROM dup"


@query(f"WITH {DUPLICATES} SELECT document_id, image_index, filename, type, confidence AS type_confidence, visibility, corr AS correlation_strength, context, NULL::VARCHAR AS description, w AS width, h AS height FROM ({IMAGE_SQL})")
def images_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested image records as eleven plain columns; what is missing is null."""
    c = F.col
    return image_records(spark, sf_dir).select(
        "document_id", "image_index", "filename", "classification.type", c("classification.confidence").alias("type_confidence"), "visibility_analysis.visibility", "text_correlation.correlation_strength",
        c("text_correlation.primary_context").alias("context"), c("contextual_description").alias("description"), "dimensions.width", "dimensions.height",
    )


@query(f"WITH {DUPLICATES} SELECT filename, type, x, y, w AS width, h AS height, coalesce(corr, 0) AS correlation_strength, '' AS contextual_description, coalesce(visibility, 'unknown') AS visibility, 'proximity' AS pairing_type FROM ({IMAGE_SQL})")
def image_references_of_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a chunk keeps of an image that goes with it."""
    c = F.col
    return image_records(spark, sf_dir).select(
        "filename", "classification.type", "coordinates.*", F.coalesce("text_correlation.correlation_strength", F.lit(0.0)).alias("correlation_strength"), F.coalesce("contextual_description", F.lit("")).alias("contextual_description"),
        F.coalesce(c("visibility_analysis.visibility"), F.lit("unknown")).alias("visibility"), F.lit("proximity").alias("pairing_type"),
    )


KEYED = "list_filter(p, lambda x: " + " OR ".join(f"contains(lower(x), '{w}')" for w in ("energy", "tip", "save", "usage", "kwh", "laundry", "load")) + ")"


@query(rf"""SELECT doc_id, substr(CASE WHEN page < len(p) THEN p[page + 1] WHEN len({KEYED}) > 0 THEN array_to_string(({KEYED})[1:3], ' ') ELSE array_to_string(p[greatest(len(p) // 2, 1):greatest(len(p) // 2, 1) + 2], ' ') END, 1, 200) AS nearby_text
FROM (SELECT doc_id, doc_id % 5 AS page, string_split(replace(text || CASE WHEN doc_id % 3 = 0 THEN ' save' ELSE '' END, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS p FROM documents)""")
def nearby_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 characters of the text near a page's images."""
    i = F.col("doc_id")
    text = F.replace(F.concat("text", F.when(i % 3 == 0, " save").otherwise("")), F.lit("\n"), F.lit("\n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(R.nearby_text(text, (i % 5).cast("int")), 1, 200).alias("nearby_text"))


@query(f"WITH t AS (SELECT conv_id, turn, {strip_sql('text')} AS text FROM conversations) SELECT conv_id || ':c' || n AS chunk_id, conv_id AS parent_document_id, CAST(n AS INT) AS chunk_index, turn AS page_num, 'page/' || turn AS section_path, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM t WHERE text <> '')")
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each page that has text."""
    from lectern.operators import chunking

    return chunking.page_chunks(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("""WITH rep AS (SELECT o_custkey AS document_id, CASE WHEN o_orderstatus = 'F' THEN 'enhanced_pdf' ELSE 'visual_ocr' END AS m FROM orders)
SELECT document_id, list(DISTINCT m ORDER BY m) AS processing_methods, count(*) AS files_created, count(*) FILTER (m = 'enhanced_pdf') AS enhanced_pdf, count(*) FILTER (m = 'visual_ocr') AS visual_ocr FROM rep GROUP BY document_id""")
def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods that a document was read by, and the files of each."""
    m = F.when(F.col("o_orderstatus") == "F", "enhanced_pdf").otherwise("visual_ocr")
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), m.alias("m"))
    counted = [F.count_if(F.col("m") == k).alias(k) for k in ("enhanced_pdf", "visual_ocr")]
    return files.groupBy("document_id").agg(F.array_sort(F.collect_set("m")).alias("processing_methods"), F.count(F.lit(1)).alias("files_created"), *counted)


def sql_two(x: str) -> str:
    return f"round(CAST({x} AS DECIMAL(18,9)), 2)::DOUBLE"


@query(f"""WITH {MEDIA}, near AS ({NEAR_PAIRS}),
pq AS (SELECT chunk_id, round(avg(relevance), 6) * 0.7::DOUBLE + least(count(DISTINCT type) / 3.0::DOUBLE, 1) * 0.3::DOUBLE AS q FROM near JOIN im USING (image_id) GROUP BY chunk_id),
t AS (SELECT doc_id % 40 AS doc, least(sum(len(regexp_extract_all(text, '[^ \\n]+'))) / 1000.0::DOUBLE, 1) AS completeness, (max(contains(text, '#')::INT) + max(contains(text, '|')::INT) + max(regexp_matches(text, '\\d+\\s*%')::INT)) / 3.0::DOUBLE AS structure, avg((length(text) BETWEEN 200 AND 800)::INT) AS chunking FROM documents GROUP BY 1),
i AS (SELECT doc, avg((confidence > 0.5)::INT) AS sure, least(sum((visibility = 'visible')::INT) / greatest(0.6::DOUBLE * count(*), 1), 1) AS seen, avg((corr > 0.3)::INT) AS tied FROM dup GROUP BY doc),
k AS (SELECT doc, avg(coalesce(q, 0)) AS pairing, avg((q IS NOT NULL)::INT) AS coverage FROM ch LEFT JOIN pq USING (chunk_id) GROUP BY doc),
d AS (SELECT ch.doc AS doc, least(count(DISTINCT type) / 4.0::DOUBLE, 1) AS diversity FROM near JOIN ch USING (chunk_id) JOIN im USING (image_id) GROUP BY ch.doc),
s AS (SELECT doc, {sql_two('structure')} AS structure, {sql_two('chunking')} AS chunking, {sql_two('sure')} AS classification, {sql_two('tied')} AS correlation, {sql_two('coverage')} AS coverage, {sql_two('coalesce(diversity, 0)')} AS diversity,
{sql_two('(completeness + structure + chunking) / 3')} AS text_quality, {sql_two('(sure + seen + tied) / 3')} AS image_quality, {sql_two('(pairing + coverage + coalesce(diversity, 0)) / 3')} AS integration_quality FROM t JOIN i USING (doc) JOIN k USING (doc) LEFT JOIN d USING (doc)),
o AS (SELECT *, {sql_two('(text_quality + image_quality + integration_quality) / 3')} AS overall FROM s)
SELECT doc, text_quality, image_quality, integration_quality, overall, list_filter([CASE WHEN structure < 0.5 THEN 'Consider using enhanced layout analysis for better structure preservation' END, CASE WHEN chunking < 0.6 THEN 'Adjust chunking strategy or parameters for better embedding optimization' END,
CASE WHEN classification < 0.7 THEN 'Review image classification confidence thresholds' END, CASE WHEN correlation < 0.5 THEN 'Improve text-image correlation by providing more detailed text content' END, CASE WHEN coverage < 0.6 THEN 'Consider adjusting multimodal pairing strategy for better coverage' END,
CASE WHEN diversity < 0.5 THEN 'Enhance image classification to identify more diverse image types' END, CASE WHEN overall < 0.6 THEN 'Consider processing with higher quality settings or manual review' WHEN overall > 0.8 THEN 'High quality extraction achieved - suitable for production use' END], lambda x: x IS NOT NULL) AS recommendations FROM o""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document: how good its text, its images and their pairing are,
    each the mean of three scores, and what to do about it."""
    from lectern.operators import multimodal

    chunks, pictures = media(spark, sf_dir)
    pairs = multimodal.by_proximity(chunks, pictures)
    rate = multimodal.pairing_quality(pairs, pictures).select("chunk_id", (F.col("mean") * 0.7 + F.col("variety") * 0.3).alias("q"))
    one = F.lit(1.0)
    t = F.col("text")
    text = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 40).alias("doc")).agg(
        F.least(F.sum(F.regexp_count(t, F.lit("[^ \\n]+"))) / 1000.0, one).alias("completeness"),
        ((F.max(F.contains(t, F.lit("#")).cast("int")) + F.max(F.contains(t, F.lit("|")).cast("int")) + F.max(t.rlike(r"\d+\s*%").cast("int"))) / 3.0).alias("structure"),
        F.avg(F.length(t).between(200, 800).cast("int")).alias("chunking"),
    )
    image = all_images(spark, sf_dir).groupBy("doc").agg(F.avg((F.col("confidence") > 0.5).cast("int")).alias("sure"), F.least(F.count_if(F.col("visibility") == "visible") / F.greatest(F.count("*") * 0.6, one), one).alias("seen"), F.avg((F.col("corr") > 0.3).cast("int")).alias("tied"))
    paired = chunks.select("chunk_id", "doc").join(rate, "chunk_id", "left").groupBy("doc").agg(F.avg(F.coalesce("q", F.lit(0.0))).alias("pairing"), F.avg(F.col("q").isNotNull().cast("int")).alias("coverage"))
    kinds = pairs.join(chunks.select("chunk_id", "doc"), "chunk_id").join(pictures.select("image_id", "type"), "image_id").groupBy("doc").agg(F.least(F.countDistinct("type") / 4.0, one).alias("diversity"))
    rows = text.join(image, "doc").join(paired, "doc").join(kinds, "doc", "left").withColumn("diversity", F.coalesce("diversity", F.lit(0.0)))

    def mean(*names: str):  # noqa: ANN202
        return Q.two_places(sum((F.col(n) for n in names[1:]), F.col(names[0])) / 3)

    rows = rows.withColumns({"text_quality": mean("completeness", "structure", "chunking"), "image_quality": mean("sure", "seen", "tied"), "integration_quality": mean("pairing", "coverage", "diversity")})
    rows = rows.withColumn("overall", mean("text_quality", "image_quality", "integration_quality"))
    scores = {k: Q.two_places(F.col(c)) for k, c in (("structure", "structure"), ("chunking", "chunking"), ("classification", "sure"), ("correlation", "tied"), ("coverage", "coverage"), ("diversity", "diversity"))}
    return rows.select("doc", "text_quality", "image_quality", "integration_quality", "overall", Q.advice(scores, F.col("overall")).alias("recommendations"))


#: Regions as the elements of their pages.
ELEMENTS_SQL = f"{REGIONS}, el AS (SELECT page AS document_id, id, ['table', 'chart', 'image', 'text'][x % 4 + 1] AS type, (id % 5) / 4.0::DOUBLE AS confidence, x % 4 = 0 AS has_data FROM reg)"
AT = datetime(2024, 5, 1, 12, 30)


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("table", "chart", "image", "text")])
    return region_rows(spark, sf_dir).select(F.col("page").alias("document_id"), "id", F.element_at(kinds, F.col("x") % 4 + 1).alias("type"), (F.col("id") % 5 / 4).alias("confidence"), (F.col("x") % 4 == 0).alias("has_data"))


@query(f"""WITH {ELEMENTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY document_id, type ORDER BY id) - 1 AS i FROM el WHERE type <> 'text')
SELECT document_id, type, i::INT AS "index", document_id || '_' || type || '_' || i || '_20240501_123000.png' AS filename, confidence, has_data FROM n""")
def element_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made.element_manifest(elements(spark, sf_dir), AT)


SUMMARIES = "su AS (SELECT document_id, count(*) FILTER (type <> 'text') AS total_elements, count(*) FILTER (type = 'table') AS tables, count(*) FILTER (type = 'chart') AS charts, count(*) FILTER (type = 'image') AS images FROM el GROUP BY document_id)"


@query(f"WITH {ELEMENTS_SQL}, {SUMMARIES} SELECT 'elem_' || (row_number() OVER (ORDER BY document_id) - 1) AS id, document_id, total_elements, tables, charts, images, true AS searchable FROM su")
def element_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = made.element_index(made.element_summaries(elements(spark, sf_dir)), F.col("document_id"))
    return index.select("id", "document_id", "total_elements", "breakdown.*", "searchable")


@query(f"WITH {DUPLICATES} SELECT 'img_' || (row_number() OVER (ORDER BY id) - 1) AS id, doc AS document_id, type, '' AS description, CASE WHEN id % 3 > 0 THEN hash ELSE '' END AS context, confidence, true AS searchable FROM dup")
def image_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = all_images(spark, sf_dir).select(F.col("id").alias("key"), F.col("doc").alias("document_id"), "type", F.lit(None).cast("string").alias("description"), F.when(F.col("id") % 3 > 0, F.col("hash")).alias("context"), "confidence")
    return made.image_index(images, F.col("key"))


@query(f"""WITH {DUPLICATES}, kt AS (SELECT doc, type, count(*) AS n FROM dup GROUP BY doc, type), kv AS (SELECT doc, visibility, count(*) AS n FROM dup GROUP BY doc, visibility)
SELECT d.doc AS document_id, d.n AS total_images, (SELECT string_agg(type || '=' || n, ',' ORDER BY type) FROM kt WHERE kt.doc = d.doc) AS types, (SELECT string_agg(visibility || '=' || n, ',' ORDER BY visibility) FROM kv WHERE kv.doc = d.doc) AS visibilities FROM (SELECT doc, count(*) AS n FROM dup GROUP BY doc) d""")
def classification_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of each document by type and visibility."""
    found = made.classification_reports(all_images(spark, sf_dir).select(F.col("doc").alias("document_id"), "type", "visibility"))

    def said(name: str) -> Column:
        return F.array_join(F.transform(F.map_entries(name), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")

    return found.select("document_id", "total_images", said("classification_breakdown").alias("types"), said("visibility_breakdown").alias("visibilities"))
