"""Pairing of text and images, quality reports and query-ready exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import relevance as R
from lectern.operators import multimodal
from lectern.plans.layout import DUPLICATES, all_images
from lectern.plans.registry import query, table

CONTEXTS = list(R.CHUNK_CONTEXTS)
WORDS_OF = "CASE doc_id % 6 WHEN 0 THEN ' save energy tip' WHEN 1 THEN ' kwh usage above' WHEN 2 THEN ' call or visit' WHEN 3 THEN ' account number' WHEN 4 THEN ' compare neighbors' ELSE '' END"
KIND_OF = "CASE doc_id % 5 WHEN 0 THEN 'advice' WHEN 1 THEN 'usage_data' WHEN 2 THEN 'header' WHEN 3 THEN 'footer' ELSE 'body' END"


def score_sql(x: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({x}, '{w}')::INT" for w in words) + ")"


BEST_CONTEXT = ", ".join(f"{{'s': {score_sql('low', w)}, 'o': {-i}, 'k': '{k}'}}" for i, (k, w) in enumerate(R.CHUNK_CONTEXTS.items()))
BY_TYPE = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in R.TYPE_CONTEXT.items()) + " ELSE 'general' END"
CHUNKS = f"""ch0 AS (SELECT doc_id AS chunk_id, doc_id % 40 AS doc, doc_id % 4 AS page, lower(text || {WORDS_OF}) AS low, {KIND_OF} AS kind FROM documents),
ch AS (SELECT *, CASE WHEN list_max([{BEST_CONTEXT}]).s > 0 THEN list_max([{BEST_CONTEXT}]).k ELSE {BY_TYPE} END AS context, list_distinct(regexp_extract_all(low, '[^ \\n]+')) AS words FROM ch0)"""
IMAGE_CONTEXT = "CASE id % 7 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CONTEXTS)) + " ELSE 'general' END"
MEDIA = f"{CHUNKS}, {DUPLICATES}, im AS (SELECT id AS image_id, doc, page, corr, type, {IMAGE_CONTEXT} AS image_context, ['the', 'and', 'of', 'w' || (id % 5)] AS image_words FROM dup)"


def media(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    i = F.col("doc_id")
    m = i % 6
    tail = F.when(m == 0, " save energy tip").when(m == 1, " kwh usage above").when(m == 2, " call or visit").when(m == 3, " account number").when(m == 4, " compare neighbors").otherwise("")
    kind = F.when(i % 5 == 0, "advice").when(i % 5 == 1, "usage_data").when(i % 5 == 2, "header").when(i % 5 == 3, "footer").otherwise("body")
    chunks = table(spark, sf_dir, "documents").select(i.alias("chunk_id"), (i % 40).alias("doc"), (i % 4).alias("page"), F.lower(F.concat("text", tail)).alias("low"), kind.alias("kind"))
    chunks = chunks.withColumn("context", R.chunk_context(F.col("low"), F.col("kind"))).withColumn("words", F.array_distinct(F.regexp_extract_all("low", F.lit("[^ \\n]+"), F.lit(0))))
    context = F.lit("general")
    for k, c in enumerate(CONTEXTS):
        context = F.when(F.col("id") % 7 == k, c).otherwise(context)
    images = all_images(spark, sf_dir).select(F.col("id").alias("image_id"), "doc", "page", "corr", "type", context.alias("image_context"), F.array(F.lit("the"), F.lit("and"), F.lit("of"), F.concat(F.lit("w"), (F.col("id") % 5).cast("string"))).alias("image_words"))
    return chunks, images


@query(f"WITH {CHUNKS} SELECT chunk_id, context FROM ch")
def chunk_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(spark, sf_dir)[0].select("chunk_id", "context")


def ranked_sql(pairs: str, order: str, n: int) -> str:
    return f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY {order}, image_id) AS INT) AS place FROM ({pairs})) WHERE place <= {n}"


NEAR_PAIRS = ranked_sql("SELECT chunk_id, image_id, corr AS relevance FROM ch JOIN im USING (doc, page) WHERE corr > 0.3", "relevance DESC", 3)


@query(f"WITH {MEDIA} {NEAR_PAIRS}")
def multimodal_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multimodal.by_proximity(*media(spark, sf_dir))


PAIRS_OF = ", ".join(f"('{a}', '{b}', {s})" for a, b, s in [(a, a, 0) for a in [*CONTEXTS, "general"]] + [(a, b, 1) for a, b in R.RELATED])


@query(f"WITH {MEDIA}, rel(context, image_context, step) AS (VALUES {PAIRS_OF}) {ranked_sql('SELECT chunk_id, image_id, corr AS relevance, step FROM ch JOIN rel USING (context) JOIN im USING (doc, image_context)', 'step, relevance DESC', 3)}")
def multimodal_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multimodal.by_semantics(*media(spark, sf_dir))


RELATED_SQL = " OR ".join(f"(context = '{a}' AND image_context = '{b}')" for a, b in R.RELATED)
MATCH = f"""least(CASE WHEN context = image_context THEN 0.6 WHEN {RELATED_SQL} THEN 0.3 ELSE 0 END + CASE WHEN kind = 'advice' AND type = 'photo' THEN 0.2 ELSE 0 END + CASE WHEN kind = 'usage_data' AND type = 'chart' THEN 0.3 ELSE 0 END
+ CASE WHEN kind IN ('header', 'footer') AND type = 'logo' THEN 0.2 ELSE 0 END + least(0.05 * len(list_intersect(words, image_words)), 0.2), 1)"""
CONTEXT_PAIRS = ranked_sql(f"SELECT chunk_id, image_id, round({MATCH}::DOUBLE, 6) AS relevance FROM ch JOIN im USING (doc) WHERE round({MATCH}::DOUBLE, 6) > 0.4", "relevance DESC", 2)


@query(f"WITH {MEDIA} {CONTEXT_PAIRS}")
def multimodal_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multimodal.by_context(*media(spark, sf_dir))


@query(f"WITH {MEDIA}, c AS ({CONTEXT_PAIRS}) SELECT c.chunk_id, c.image_id, round(CASE WHEN ch.page = im.page THEN least(relevance + 0.2, 1) ELSE relevance END, 6) AS relevance, place FROM c JOIN ch USING (chunk_id) JOIN im USING (image_id)")
def multimodal_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multimodal.hybrid(*media(spark, sf_dir))


@query(f"WITH {MEDIA}, n AS ({NEAR_PAIRS}), g AS (SELECT chunk_id, count(*) AS n, round(avg(relevance), 6) AS mean, count(DISTINCT type) AS t FROM n JOIN im USING (image_id) GROUP BY chunk_id) SELECT chunk_id, n, mean, round(least(t / 3.0::DOUBLE, 1), 6) AS variety, round(mean * 0.7 + least(t / 3.0::DOUBLE, 1) * 0.3, 6) AS quality FROM g")
def pairing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, images = media(spark, sf_dir)
    return multimodal.pairing_quality(multimodal.by_proximity(chunks, images), images)


@query(f"WITH {DUPLICATES} SELECT type, CAST(sum((corr > 0.7)::INT) AS BIGINT) AS strong, CAST(sum((corr BETWEEN 0.4 AND 0.7)::INT) AS BIGINT) AS moderate, CAST(sum((corr < 0.4)::INT) AS BIGINT) AS weak, round(avg(corr), 6) AS mean FROM dup GROUP BY type")
def correlation_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("corr")
    return all_images(spark, sf_dir).groupBy("type").agg(F.count_if(c > 0.7).alias("strong"), F.count_if(c.between(0.4, 0.7)).alias("moderate"), F.count_if(c < 0.4).alias("weak"), F.round(F.avg(c), 6).alias("mean"))


SCORES = ", ".join(f"round(({score_sql('near', w)} / {len(w)}.0::DOUBLE + least({score_sql('near', w)} / greatest(n * 0.1::DOUBLE, 1), 1)) / 2, 6) AS {k}" for k, w in R.IMAGE_CONTEXTS.items())


@query(f"SELECT doc_id, {SCORES} FROM (SELECT doc_id, lower(text || {WORDS_OF}) AS near, len(regexp_extract_all(text || {WORDS_OF}, '[^ \\n]+')) AS n FROM documents)")
def image_text_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context scores of the text around an image."""
    m = F.col("doc_id") % 6
    tail = F.when(m == 0, " save energy tip").when(m == 1, " kwh usage above").when(m == 2, " call or visit").when(m == 3, " account number").when(m == 4, " compare neighbors").otherwise("")
    near = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", tail).alias("near"))
    near = near.withColumns({"n": F.regexp_count("near", F.lit("[^ \\n]+")), "low": F.lower("near")})
    return near.select("doc_id", *[F.round(R.context_score(F.col("low"), F.col("n"), w), 6).alias(k) for k, w in R.IMAGE_CONTEXTS.items()])


@query(f"WITH {MEDIA}, n AS ({NEAR_PAIRS}) SELECT (SELECT count(*) FROM ch) AS chunks, (SELECT count(*) FROM im) AS images, count(DISTINCT chunk_id) AS paired_chunks, count(*) AS pairs, round(avg(relevance), 6) AS mean_relevance FROM n")
def integration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, images = media(spark, sf_dir)
    own = multimodal.by_proximity(chunks, images).agg(F.countDistinct("chunk_id").alias("paired_chunks"), F.count("*").alias("pairs"), F.round(F.avg("relevance"), 6).alias("mean_relevance"))
    return chunks.agg(F.count("*").alias("chunks")).crossJoin(images.agg(F.count("*").alias("images"))).crossJoin(own)


REPORTS = """rep AS (SELECT 'enhanced_pdf' AS extraction_method, o_orderkey AS document_id, CAST(o_totalprice AS BIGINT) AS text_length, 95 AS confidence_score, NULL::INT AS average_confidence, CAST(o_orderkey % 30 AS INT) AS structured_elements_found, NULL::INT AS dpi FROM orders WHERE o_orderstatus = 'F'
UNION ALL BY NAME SELECT 'visual_ocr' AS extraction_method, o_orderkey AS document_id, CAST(o_totalprice AS BIGINT) AS text_length, CAST(o_orderkey % 101 AS INT) AS average_confidence, 300 AS dpi FROM orders WHERE o_orderstatus <> 'F')"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two report shapes in one table; what a shape lacks is null."""
    orders = table(spark, sf_dir, "orders")
    key, size = F.col("o_orderkey"), F.col("o_totalprice").cast("long")
    native = orders.where("o_orderstatus = 'F'").select(F.lit("enhanced_pdf").alias("extraction_method"), key.alias("document_id"), F.floor(size).alias("text_length"), F.lit(95).alias("confidence_score"), (key % 30).cast("int").alias("structured_elements_found"))
    ocr = orders.where("o_orderstatus <> 'F'").select(F.lit("visual_ocr").alias("extraction_method"), key.alias("document_id"), F.floor(size).alias("text_length"), (key % 101).cast("int").alias("average_confidence"), F.lit(300).alias("dpi"))
    return native.unionByName(ocr, allowMissingColumns=True)


REPORTS = REPORTS.replace("CAST(o_totalprice AS BIGINT)", "CAST(trunc(o_totalprice) AS BIGINT)")


@query(f"WITH {REPORTS} SELECT * FROM rep")
def report_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir)


@query(f"WITH {REPORTS} SELECT 'text_' || (row_number() OVER (ORDER BY document_id, extraction_method) - 1) AS id, document_id, extraction_method, coalesce(confidence_score, average_confidence, 0) AS confidence FROM rep")
def search_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.operators import merge

    own = merge.numbered(reports(spark, sf_dir), "document_id", "n")
    return own.select(F.concat(F.lit("text_"), (F.col("n") - 1).cast("string")).alias("id"), "document_id", "extraction_method", F.coalesce("confidence_score", "average_confidence", F.lit(0)).alias("confidence"))


@query(f"WITH {REPORTS}, {DUPLICATES} SELECT count(DISTINCT document_id) AS documents, count(*) AS text_extractions, CAST(sum(coalesce(structured_elements_found, 0)) AS BIGINT) AS elements, (SELECT count(*) FROM dup) AS images FROM rep")
def unified_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = reports(spark, sf_dir).agg(F.countDistinct("document_id").alias("documents"), F.count("*").alias("text_extractions"), F.sum(F.coalesce("structured_elements_found", F.lit(0))).alias("elements"))
    return own.crossJoin(all_images(spark, sf_dir).agg(F.count("*").alias("images")))


@query(f"WITH {DUPLICATES} SELECT 'img_' || lpad(CAST(row_number() OVER (PARTITION BY doc ORDER BY page, id) AS VARCHAR), 3, '0') AS image_tag_id, doc, [type, visibility, 'conf_' || lpad(CAST(CAST(floor(confidence * 10) AS INT) AS VARCHAR), 2, '0')] AS tags, CASE WHEN confidence > 0.7 THEN 'high' WHEN confidence > 0.4 THEN 'medium' ELSE 'low' END AS quality, round(corr, 3) AS correlation FROM dup")
def image_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("doc").orderBy("page", "id"))
    c = F.col("confidence")
    return all_images(spark, sf_dir).select(
        F.concat(F.lit("img_"), F.lpad(number.cast("string"), 3, "0")).alias("image_tag_id"), "doc",
        F.array("type", "visibility", F.concat(F.lit("conf_"), F.lpad(F.floor(c * 10).cast("string"), 2, "0"))).alias("tags"),
        F.when(c > 0.7, "high").when(c > 0.4, "medium").otherwise("low").alias("quality"), F.round("corr", 3).alias("correlation"),
    )


@query("SELECT source AS extension, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY source")
def extension_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("extension")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("bytes"))


LINES = "list_filter(list_transform(string_split(t, chr(10)), lambda l: list_filter(regexp_split_to_array(trim(l), '\\s{2,}|\\t'), lambda c: c <> '')), lambda r: len(r) > 1)"


@query(f"SELECT doc_id, {LINES} AS cells FROM (SELECT doc_id, replace(text, ', ', '  ') AS t FROM documents)")
def ocr_table_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to cells at runs of blanks or tabs; lines of one cell go."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(", "), F.lit("  ")).alias("t"))
    rows = F.transform(F.split("t", "\n"), lambda line: F.filter(F.split(F.trim(line), r"\s{2,}|\t"), lambda c: c != ""))
    return docs.select("doc_id", F.filter(rows, lambda r: F.size(r) > 1).alias("cells"))


@query(r"""SELECT doc_id, list_filter(l, lambda x: length(x) > 5)[1] AS title, list_filter(l, lambda x: regexp_full_match(x, '-?\d+\.?\d*')) AS x_axis, list_filter(l, lambda x: length(x) BETWEEN 3 AND 30) AS legend, regexp_extract_all(t, '\d+%|\d+\.\d+') AS labels
FROM (SELECT doc_id, t, list_transform(string_split(t, chr(10)), lambda x: trim(x)) AS l FROM (SELECT doc_id, text || chr(10) || doc_id || chr(10) || (doc_id % 90) || '% and ' || (doc_id % 7) || '.5' AS t FROM documents))""")
def chart_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    t = F.concat("text", F.lit("\n"), i.cast("string"), F.lit("\n"), (i % 90).cast("string"), F.lit("% and "), (i % 7).cast("string"), F.lit(".5"))
    docs = table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).withColumn("l", F.transform(F.split("t", "\n"), lambda x: F.trim(x)))
    return docs.select("doc_id", F.get(F.filter("l", lambda x: F.length(x) > 5), 0).alias("title"), F.filter("l", lambda x: x.rlike(r"^-?\d+\.?\d*$")).alias("x_axis"), F.filter("l", lambda x: F.length(x).between(3, 30)).alias("legend"), F.regexp_extract_all("t", F.lit(r"\d+%|\d+\.\d+"), F.lit(0)).alias("labels"))
