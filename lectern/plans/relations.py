"""Queries over image and text relations, page references and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import geometry as G
from lectern.functions import relations as R
from lectern.functions import relevance
from lectern.operators import multimodal, regions
from lectern.plans.analytics import WORDS_OF, score_sql
from lectern.plans.exports import KEYED, SPACED
from lectern.plans.extraction import has_sql
from lectern.plans.layout import DUPLICATES, REGIONS, RH, RW, all_images, region_rows
from lectern.plans.registry import query, table

KINDS = ("logo", "photo", "chart", "diagram", "unknown", "qr_code")
KIND_SQL = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
EXTRA = {0: " energy website", 1: " Laundry tip: full loads save energy", 2: " usage 5% above typical", 3: " scan the picture", 4: " qr code, visit", 5: " company data"}
EXTRA_SQL = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in EXTRA.items()) + " ELSE '' END"
PAGES_SQL = f"pg AS (SELECT doc_id, {KIND_SQL} AS kind, text || {EXTRA_SQL} AS text, lower(text || {EXTRA_SQL}) AS low, CASE doc_id % 5 WHEN 0 THEN 'energy_tips' WHEN 1 THEN 'contact_info' WHEN 2 THEN 'usage_data' WHEN 3 THEN 'account_info' ELSE 'general' END AS context FROM documents)"


def pick(values: dict[int, str], key, rest: str | None = None):  # noqa: ANN001, ANN201
    out = F.lit(rest)
    for i, v in values.items():
        out = F.when(key == i, v).otherwise(out)
    return out


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    text = F.concat("text", pick(EXTRA, i % 7, ""))
    context = pick({0: "energy_tips", 1: "contact_info", 2: "usage_data", 3: "account_info"}, i % 5, "general")
    return table(spark, sf_dir, "documents").select("doc_id", pick(dict(enumerate(KINDS)), i % 6).alias("kind"), text.alias("text"), F.lower(text).alias("low"), context.alias("context"))


def rules_sql(rules: tuple, first: str = "") -> str:
    rows = [first] if first else []
    for name, kinds, any_of, too in rules:
        holds = " AND ".join([has_sql("low", *any_of)] + ([has_sql("low", *too)] if too else []) + ([f"kind IN ({', '.join(repr(k) for k in kinds)})"] if kinds else []))
        rows.append(f"CASE WHEN {holds} THEN '{name}' END")
    return f"list_filter([{', '.join(rows)}], lambda x: x IS NOT NULL)"


BRANDING = f"CASE WHEN kind = 'logo' AND {has_sql('low', *R.COMPANY_WORDS)} THEN 'company_branding' END"


@query(f"WITH {PAGES_SQL} SELECT doc_id, {rules_sql(R.INDICATORS, BRANDING)} AS indicators, {rules_sql(R.RELATIONSHIPS)} AS relationships, round(least(0.5::DOUBLE + len({rules_sql(R.INDICATORS, BRANDING)}) * 0.2::DOUBLE * 0.3::DOUBLE, 1), 6) AS strength FROM pg")
def image_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.indicators(F.col("kind"), F.col("low"), F.col("low"))
    own = pages(spark, sf_dir).withColumn("indicators", found)
    return own.select("doc_id", "indicators", R.findings(R.RELATIONSHIPS, F.col("kind"), F.col("low")).alias("relationships"), F.round(R.correlation_strength(F.lit(0.5), F.col("indicators")), 6).alias("strength"))


FLAGS_SQL = ", ".join(f"{has_sql('low', *w)} AS {n}" for n, w, _ in R.PAGE_FLAGS)
CONTEXT_SQL = "CASE " + " ".join(f"WHEN {has_sql('low', *w)} THEN '{c}'" for _, w, c in reversed(R.PAGE_FLAGS) if c) + " END"


@query(f"WITH {PAGES_SQL} SELECT doc_id, {FLAGS_SQL}, {CONTEXT_SQL} AS context_type FROM pg")
def text_context_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", R.page_flags(F.col("low")).alias("f")).select("doc_id", "f.*")


DESCRIBED = "CASE " + " ".join(f"WHEN context = '{c}' AND kind IN ({', '.join(repr(k) for k in ks)}) THEN '{t}'" for c, ks, t in R.BY_CONTEXT) + " ELSE CASE kind " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in R.BY_KIND) + " ELSE 'Image element' END || ' related to ' || replace(context, '_', ' ') END"


@query(f"WITH {PAGES_SQL} SELECT doc_id, {DESCRIBED} AS description FROM pg")
def contextual_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", R.description(F.col("kind"), F.col("context")).alias("description"))


GAIN = "CASE " + " ".join(f"WHEN kind = '{k}' AND {has_sql('low', *w)} THEN {v}" for k, w, v in R.KIND_GAIN) + " ELSE 0 END"


@query(f"""WITH {PAGES_SQL} SELECT doc_id, round(least({GAIN} + CASE WHEN doc_id % 2 = 0 THEN 0.2 ELSE 0 END, 1)::DOUBLE, 6) AS correlation,
array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda l: {has_sql('lower(l)', *R.NEAR_WORDS)})[1:3], lambda l: trim(l, ' ')), ' ') AS nearby FROM pg""")
def page_image_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pages(spark, sf_dir)
    return own.select("doc_id", F.round(R.page_correlation(F.col("kind"), F.col("low"), F.col("doc_id") % 2 == 0), 6).alias("correlation"), R.near_lines(F.col("text")).alias("nearby"))


MARK = "chr(10) || chr(10) || '[IMAGE: f' || doc_id || ' - ' || kind || ' at (' || (doc_id % 600) || ', ' || (doc_id % 700) || ')]' || chr(10) || chr(10)"


@query(f"WITH {PAGES_SQL} SELECT doc_id, CASE WHEN contains(lower(t), 'tip') AND kind IN ('photo', 'illustration') THEN replace(t, 'Monthly savings tip:', 'Monthly savings tip:' || {MARK}) ELSE t || {MARK} END AS text FROM (SELECT *, 'Monthly savings tip: ' || text AS t FROM pg)")
def image_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    image = F.struct(F.concat(F.lit("f"), i.cast("string")).alias("filename"), F.col("kind").alias("type"), (i % 600).alias("x"), (i % 700).alias("y"))
    return pages(spark, sf_dir).select("doc_id", R.with_references(F.concat(F.lit("Monthly savings tip: "), F.col("text")), F.array(image)).alias("text"))


SHARE = "CASE kind " + " ".join(f"WHEN '{k}' THEN (" + " + ".join(f"contains(low, '{w}')::INT" for w in ws) + f") / {len(ws)}.0::DOUBLE" for k, ws in R.REGION_WORDS.items()) + " ELSE 0 END"


@query(f"WITH pg AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'chart' ELSE 'image' END AS kind, lower(text || {WORDS_OF}) AS low FROM documents) SELECT doc_id, round(({SHARE})::DOUBLE, 6) AS share FROM pg")
def region_text_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    tail = pick({0: " save energy tip", 1: " kwh usage above", 2: " call or visit", 3: " account number", 4: " compare neighbors"}, i % 6, "")
    own = table(spark, sf_dir, "documents").select("doc_id", pick({0: "table", 1: "chart"}, i % 3, "image").alias("kind"), F.lower(F.concat("text", tail)).alias("low"))
    return own.select("doc_id", F.round(R.region_correlation(F.col("kind"), F.col("low")), 6).alias("share"))


@query(f"""WITH {REGIONS} SELECT page, id, CASE WHEN y + h // 2 < {RH} / 2.0 THEN 'top_' ELSE 'bottom_' END || CASE WHEN x + w // 2 < {RW} / 2.0 THEN 'left' ELSE 'right' END AS quadrant,
CASE WHEN y + h // 2 < 0.2 * {RH} THEN 'header' WHEN y + h // 2 > 0.8 * {RH} THEN 'footer' ELSE 'body' END AS zone FROM reg""")
def region_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cx, cy = F.col("x") + F.floor(F.col("w") / 2), F.col("y") + F.floor(F.col("h") / 2)
    return region_rows(spark, sf_dir).select("page", "id", G.quadrant(cx, cy, RW, RH).alias("quadrant"), G.zone(cy, RH).alias("zone"))


@query("SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 20 OFFSET 40")
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").orderBy("doc_id").offset(40).limit(20)


@query("SELECT conv_id AS parent, count(*) AS turns, CAST(sum((role = 'user')::INT) AS BIGINT) AS asked, round(sum((length(text) > 0)::INT) / count(*), 6) AS success_rate FROM conversations GROUP BY conv_id")
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("parent"))
    return own.agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.round(F.count_if(F.length("text") > 0) / F.count("*"), 6).alias("success_rate"))


def in_text(sql: str, column: str) -> str:
    return sql.replace("low", column)


SCORED = ", ".join(f"{{'s': round(({score_sql('low', w)} / {len(w)}.0::DOUBLE + least({score_sql('low', w)} / greatest(n * 0.1::DOUBLE, 1), 1)) / 2, 6), 'o': {-i}, 'k': '{k}'}}" for i, (k, w) in enumerate(relevance.IMAGE_CONTEXTS.items()))
FOUND = rules_sql(R.INDICATORS, BRANDING.replace("contains(low", "contains(lowfull"))
#: Images with their documents' texts; every document's text goes to the images of one of 40 documents.
CORRELATED = f"""{DUPLICATES}, d AS (SELECT doc_id % 40 AS doc, max(replace(text, chr(10), chr(10) || chr(10))) AS text FROM documents GROUP BY doc_id % 40),
a AS (SELECT dup.id, dup.visibility, type AS kind, page, coalesce(text, '') AS full_text, string_split(coalesce(text, ''), chr(10) || chr(10)) AS p FROM dup LEFT JOIN d ON d.doc = dup.doc),
b AS (SELECT *, CASE WHEN page < len(p) THEN p[page + 1] WHEN len({KEYED}) > 0 THEN array_to_string(({KEYED})[1:3], ' ') ELSE array_to_string(p[greatest(len(p) // 2, 1):greatest(len(p) // 2, 1) + 2], ' ') END AS text FROM a),
c AS (SELECT *, lower(text) AS low, lower(full_text) AS lowfull, {SPACED} AS n FROM b),
e AS (SELECT *, list_filter([{SCORED}], lambda x: x.s > 0.1) AS scores, {FOUND} AS indicators FROM c),
f AS (SELECT *, list_max(scores) AS best, coalesce(list_max(scores).k, 'general') AS context FROM e)"""


def correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("doc"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return multimodal.correlate_with_text(all_images(spark, sf_dir), texts)


@query(f"""WITH {CORRELATED} SELECT id, text AS nearby_text, len(scores)::INT AS n_contexts, context AS primary_context, round(coalesce(best.s, 0.1), 2) AS context_confidence, indicators,
round(least(coalesce(best.s, 0.1) + len(indicators) * 0.2::DOUBLE * 0.3::DOUBLE, 1), 6) AS correlation_strength, {rules_sql(R.RELATIONSHIPS)} AS supporting_relationships, {DESCRIBED} AS contextual_description FROM f""")
def correlated_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image with what its page's text says of it."""
    c = F.col("text_correlation")
    names = ("nearby_text", "primary_context", "context_confidence", "indicators", "correlation_strength", "supporting_relationships")
    return correlated(spark, sf_dir).select("id", *[c[n].alias(n) for n in names], F.size(c["context_scores"]).alias("n_contexts"), "contextual_description")


@query(f"WITH {CORRELATED} SELECT 'img' || id || '.png' AS filename, kind AS type, {DESCRIBED} AS contextual_description, context AS primary_context, round(least(coalesce(best.s, 0.1) + len(indicators) * 0.2::DOUBLE * 0.3::DOUBLE, 1), 6) AS correlation_strength, visibility FROM f")
def image_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = correlated(spark, sf_dir).withColumn("filename", F.concat(F.lit("img"), F.col("id").cast("string"), F.lit(".png")))
    return multimodal.image_descriptions(images)


@query(f"""WITH {DUPLICATES} SELECT id, CASE WHEN confidence > 0.7 THEN 'This appears to be a ' || type WHEN confidence > 0.4 THEN 'This is likely a ' || type ELSE 'This may be a ' || type || ' or other visual element' END
|| '. ' || CASE WHEN w > 400 OR h > 400 THEN 'of large size' WHEN w < 100 OR h < 100 THEN 'of small size' ELSE 'of medium size' END || CASE WHEN w / h > 2 THEN '. with a wide aspect ratio' WHEN w / h < 0.5 THEN '. with a tall aspect ratio' ELSE '' END || '.' AS description FROM dup""")
def element_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return all_images(spark, sf_dir).select("id", R.element_description(c("type"), c("confidence"), c("w"), c("h")).alias("description"))


@query(f"""WITH {REGIONS}, c AS (SELECT *, x + w // 2 AS cx, y + h // 2 AS cy, ['table', 'chart', 'text'][(x % 3) + 1] AS type FROM reg WHERE w > 300),
o AS (SELECT page, sum((cy < 0.2 * {RH})::INT)::BIGINT AS header, sum((cy > 0.8 * {RH})::INT)::BIGINT AS footer, CASE WHEN bool_or(cx < 0.4 * {RW}) AND bool_or(cx > 0.6 * {RW}) THEN 'multi_column' WHEN count(*) = 1 THEN 'single_element' WHEN bool_or(type = 'table') AND bool_or(type = 'chart') THEN 'mixed_data' ELSE 'single_column' END AS layout FROM c GROUP BY page)
SELECT o_orderkey AS page, coalesce(header, 0) AS header, coalesce(footer, 0) AS footer, coalesce(layout, 'empty') AS layout FROM orders LEFT JOIN o ON o.page = o_orderkey""")
def typed_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts of pages whose regions have types, of pages without any too."""
    wide = region_rows(spark, sf_dir).where("w > 300").withColumn("type", F.element_at(F.array(F.lit("table"), F.lit("chart"), F.lit("text")), F.col("x") % 3 + 1))
    return regions.layouts(wide, RW, RH, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page")))


MARKS = "chr(10) || chr(10) || '[IMAGE: img' || id || ' - ' || type || ' at (' || x || ', ' || y || ')]' || chr(10) || chr(10)"
INSIDE = "contains(lower(t), 'tip') AND type IN ('photo', 'illustration')"


@query(f"""WITH {DUPLICATES}, pg AS (SELECT conv_id AS doc, turn AS page, CASE WHEN turn % 2 = 0 THEN 'Monthly savings tip: ' || text ELSE text END AS t FROM conversations),
j AS (SELECT pg.doc, pg.page, t, 'img' || id AS name, id IS NOT NULL AS found, {INSIDE} AS inside, {MARKS} AS mark FROM pg LEFT JOIN dup ON dup.doc = pg.doc AND dup.page = pg.page)
SELECT doc, page, replace(t, 'Monthly savings tip:', 'Monthly savings tip:' || coalesce(string_agg(mark, '' ORDER BY name DESC) FILTER (found AND inside), '')) || coalesce(string_agg(mark, '' ORDER BY name) FILTER (found AND NOT inside), '') AS text, count(*) FILTER (found)::INT AS n_images FROM j GROUP BY doc, page, t""")
def pages_with_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages, with markers for all images of each."""
    tip = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Monthly savings tip: "), F.col("text"))).otherwise(F.col("text"))
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), tip.alias("text"))
    images = all_images(spark, sf_dir).select("doc", "page", F.concat(F.lit("img"), F.col("id").cast("string")).alias("filename"), "type", "x", "y")
    return multimodal.pages_with_images(own, images)
