"""Field extraction and text-quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.plans.corpus import strip_sql
from lectern.plans.registry import query, table

#: Labels and figures to find, since the texts themselves have none.
MARKED = "text || chr(10) || 'Account number: ' || (100000 + doc_id) || chr(10) || 'Service address: ' || (doc_id % 900 + 100) || '  Tulip Lane' || chr(10) || 'Dear JILL DOE, you used ' || (doc_id * 7 % 2000) || ' kWh, ' || (doc_id % 90) || '% more than typical. Save $' || (doc_id % 50) || '.25, call 800.895.' || (1000 + doc_id % 9000) || ' or mail a.b@example.com by March 20' || (10 + doc_id % 90)"


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, s = F.col("doc_id"), "string"
    parts = [
        F.col("text"), F.lit("\nAccount number: "), (i + 100000).cast(s), F.lit("\nService address: "), (i % 900 + 100).cast(s), F.lit("  Tulip Lane\nDear JILL DOE, you used "), (i * 7 % 2000).cast(s),
        F.lit(" kWh, "), (i % 90).cast(s), F.lit("% more than typical. Save $"), (i % 50).cast(s), F.lit(".25, call 800.895."), (i % 9000 + 1000).cast(s), F.lit(" or mail a.b@example.com by March 20"), (i % 90 + 10).cast(s),
    ]
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(*parts).alias("text"))


def found_sql(pattern: str, group: int, x: str = "text") -> str:
    options = "'i'" if pattern.startswith("(?i)") else "''"
    bare = pattern.removeprefix("(?i)").replace("'", "''")
    # list_distinct keeps no order: the place of the first sight does
    found = f"list_transform(regexp_extract_all({x}, '{bare}', {group}, {options}), lambda v: {strip_sql('v')})"
    first = f"list_filter(list_transform(list_zip({found}, range(len({found}))), lambda z: CASE WHEN list_position({found}, z[1]) = z[2] + 1 THEN z[1] END), lambda v: v IS NOT NULL)"
    return f"CASE WHEN len({found}) > 0 THEN {first} END"


def structured_sql() -> str:
    own = {name: found_sql(p, g) for name, p, g in X.STRUCTURED_FIELDS}
    own["service_address"] = f"list_filter(list_transform({own['service_address']}, lambda a: regexp_replace(a, '\\s+', ' ', 'g')), lambda a: length(a) > 5)"
    own["energy_usage"] = f"list_filter(list_transform({own['energy_usage']}, lambda u: TRY_CAST(replace(u, ',', '') AS INT)), lambda u: u > 0 AND u < 100000)"
    own["customer_name"] = rf"CASE WHEN regexp_matches(text, 'Dear\s+([A-Z][A-Z\s]+),', 'i') THEN [{strip_sql(chr(114) + 'egexp_extract(text, ' + chr(39) + 'Dear' + chr(92) + 's+([A-Z][A-Z' + chr(92) + 's]+),' + chr(39) + ', 1, ' + chr(39) + 'i' + chr(39) + ')')}] END"
    return ", ".join(f"{sql} AS {name}" for name, sql in own.items())


@query(f"SELECT doc_id, {structured_sql()} FROM (SELECT doc_id, {MARKED} AS text FROM documents)")
def structured_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir).select("doc_id", X.structured_data(F.col("text")).alias("s")).select("doc_id", "s.*")


def energy_sql() -> str:
    return ", ".join(f"coalesce({found_sql(p, 1)}, []) AS {name}" for name, p in X.ENERGY_FIELDS)


@query(f"SELECT doc_id, {energy_sql()} FROM (SELECT doc_id, regexp_replace({MARKED}, '[^\\x00-\\x7F]', 'x', 'g') AS text FROM documents)")
def energy_report_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word borders mean all letters in Spark and ASCII in the SQL check, so
    other letters are replaced first."""
    docs = marked(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "x"))
    return docs.select("doc_id", X.energy_fields(F.col("text")).alias("s")).select("doc_id", "s.*")


INDICATORS = " + ".join(f"CAST(regexp_matches(text, '{p}', 'i') AS INT)" for p in X.ENERGY_INDICATORS)


@query(f"SELECT doc_id, {INDICATORS} AS indicators, {INDICATORS} >= 3 AS is_energy_report FROM (SELECT doc_id, {MARKED} AS text FROM documents)")
def energy_report_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir).select("doc_id", X.energy_indicators(F.col("text")).alias("indicators")).withColumn("is_energy_report", F.col("indicators") >= 3)


REQUIRED = ", ".join(f"CAST(len(regexp_extract_all(text, '{p}', 0, 'i')) AS INT) AS n_{n}" for n, p in X.ENERGY_REQUIRED)


@query(f"SELECT *, 20 * ((n_account_number > 0)::INT + (n_service_address > 0)::INT + (n_usage_analysis > 0)::INT + (n_energy_tips > 0)::INT + (n_comparison_data > 0)::INT) AS completeness FROM (SELECT doc_id, {REQUIRED} FROM (SELECT doc_id, {MARKED} AS text FROM documents))")
def energy_report_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.regexp_count("text", F.lit("(?i)" + X.bordered(p))).alias(f"n_{n}") for n, p in X.ENERGY_REQUIRED]
    score = F.lit(0)
    for n, _ in X.ENERGY_REQUIRED:
        score = score + F.when(F.col(f"n_{n}") > 0, 20).otherwise(0)
    return marked(spark, sf_dir).select("doc_id", *counts).withColumn("completeness", score)


CLEAN_INPUT = "'# Head   line' || chr(10) || replace(text, chr(10), chr(10) || chr(10) || chr(10)) || '|Col1|Col2| | | | | end.' || chr(10) || 'Next'"


@query(rf"""SELECT doc_id, {strip_sql('t7')} AS text FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({CLEAN_INPUT},
'\n\n\n+', chr(10) || chr(10), 'g'), '\|Col\d+', '|', 'g'), 'Col\d+\|', '|', 'g'), '\|\s*\|\s*\|\s*\|\s*\|', '', 'g'), '(?m)^(#+\s*.*?)\n+', '\1' || chr(10) || chr(10), 'g'), '([.!?])\s*\n([A-Z])', '\1' || chr(10) || chr(10) || '\2', 'g'), ' +', ' ', 'g') AS t7 FROM documents)""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("# Head   line\n"), F.replace("text", F.lit("\n"), F.lit("\n\n\n")), F.lit("|Col1|Col2| | | | | end.\nNext"))
    return table(spark, sf_dir, "documents").select("doc_id", X.clean(text).alias("text"))


#: Whole texts, with what the rarer rules look for before or after them.
VARIED = "CASE doc_id % 8 WHEN 0 THEN '# ' || text WHEN 1 THEN text || ' table' WHEN 2 THEN text || chr(10) || '* item' WHEN 3 THEN 'Tip: ' || text WHEN 4 THEN 'Account ' || text WHEN 5 THEN text || ' about 55 kWh and 120%' WHEN 6 THEN text || ' © all rights' ELSE text END"


def varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, t = F.col("doc_id") % 8, F.col("text")
    made = (
        F.when(m == 0, F.concat(F.lit("# "), t)).when(m == 1, F.concat(t, F.lit(" table"))).when(m == 2, F.concat(t, F.lit("\n* item"))).when(m == 3, F.concat(F.lit("Tip: "), t))
        .when(m == 4, F.concat(F.lit("Account "), t)).when(m == 5, F.concat(t, F.lit(" about 55 kWh and 120%"))).when(m == 6, F.concat(t, F.lit(" © all rights"))).otherwise(t)
    )
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("text"))


@query(rf"""SELECT doc_id, round(least(CASE WHEN regexp_matches(text, '(?m)^#{{1,6}}\s') THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(text, '\d+[%$]|\b\d{{3,}}\b') THEN 0.2 ELSE 0 END
+ CASE WHEN regexp_matches(text, '@|\.com|\d{{3}}[.-]?\d{{3}}[.-]?\d{{4}}') THEN 0.2 ELSE 0 END + least(length(text) / 200.0::DOUBLE, 1) * 0.3, 1), 6)::DOUBLE AS importance_score FROM (SELECT doc_id, {VARIED} AS text FROM documents)""")
def importance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return varied(spark, sf_dir).select("doc_id", F.round(X.importance(F.col("text")), 6).alias("importance_score"))


def has_sql(x: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


@query(rf"""SELECT doc_id, CASE WHEN regexp_matches(text, '^#{{1,6}}\s') THEN 'header' WHEN {has_sql('lower(text)', 'table', '|')} THEN 'table' WHEN regexp_matches(text, '(?m)^[\*\-\+]\s') THEN 'list'
WHEN {has_sql('lower(text)', 'tip:', 'advice:', 'recommendation:')} THEN 'advice' WHEN {has_sql('lower(text)', 'account', 'service address', 'number')} THEN 'account_info'
WHEN regexp_matches(lower(text), '\d+\s*%|\d+\s*kwh|\$\d+') THEN 'usage_data' WHEN contains(text, '©') OR contains(lower(text), 'reserved') THEN 'footer' ELSE 'body' END AS content_type FROM (SELECT doc_id, {VARIED} AS text FROM documents)""")
def content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return varied(spark, sf_dir).select("doc_id", X.content_type(F.col("text")).alias("content_type"))


ODD = "length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) / greatest(length(text), 1)"
ARTIFACTS_SQL = " + ".join(f"CASE WHEN contains(text, '{a}') THEN 5 ELSE 0 END" for a in X.ARTIFACTS)


@query(rf"""SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(100 - CASE WHEN {ODD} > 0.1 THEN 15 ELSE 0 END - CASE WHEN length({strip_sql('text')}) < 100 THEN 30 ELSE 0 END
- CASE WHEN NOT regexp_matches(text, '[.!?]') AND length(text) > 50 THEN 25 ELSE 0 END - CASE WHEN len(regexp_extract_all(text, '\s{{5,}}')) > 10 THEN 10 ELSE 0 END - ({ARTIFACTS_SQL}), 0) END AS INT) AS score
FROM (SELECT doc_id, {VARIED} AS text FROM documents)""")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the term for repeated characters, which needs a back reference."""
    return varied(spark, sf_dir).select("doc_id", X.quality_score(F.col("text"), leave_out=("repeats",)).alias("score"))


@query()
def text_quality_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms, over whole texts as they are."""
    return table(spark, sf_dir, "documents").select("doc_id", X.quality_score(F.col("text")).alias("score"))


WORDS = r"len(regexp_extract_all(text, '[^\s\p{Z}\x0b\x1c-\x1f\x85]+'))"
FACTORS = rf"list_filter([CASE WHEN avg > 0 THEN avg / 100.0::DOUBLE END, CASE WHEN length(text) > 0 THEN least(1.0::DOUBLE, {WORDS} * 5.0::DOUBLE / length(text)) END, CASE WHEN {WORDS} > 0 THEN least(1.0::DOUBLE, len(regexp_extract_all(text, '[.!?]+')) / ({WORDS} / 20.0::DOUBLE)) END], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, round(CASE WHEN len({FACTORS}) > 0 THEN list_sum({FACTORS}) / len({FACTORS}) ELSE 0 END, 6) AS confidence FROM (SELECT doc_id, text, CAST(doc_id % 101 AS DOUBLE) AS avg FROM documents)")
def extraction_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.round(X.extraction_confidence(F.col("text"), (F.col("doc_id") % 101).cast("double")), 6).alias("confidence"))


@query(r"""WITH m AS (SELECT doc_id, 'native' AS method, 0 AS ord, CAST(doc_id * 7 % 101 AS INT) AS quality, 0 AS tables, 0 AS conf FROM documents UNION ALL SELECT doc_id, 'plumber', 1, CAST(doc_id * 13 % 101 AS INT), CAST(doc_id % 3 AS INT), 0 FROM documents UNION ALL SELECT doc_id, 'visual_ocr', 2, CAST(doc_id * 17 % 101 AS INT), 0, CAST(doc_id * 5 % 100 AS INT) FROM documents),
s AS (SELECT *, quality + CASE WHEN method = 'plumber' AND tables > 0 THEN 10 ELSE 0 END + CASE WHEN method = 'visual_ocr' AND conf > 70 THEN 15 ELSE 0 END AS score FROM m)
SELECT doc_id, method, score, quality < 60 AND method <> 'visual_ocr' AS fallback FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS r FROM s) WHERE r = 1""")
def method_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of three extractions of each document: argmax of the adjusted
    quality, the first named of equals; poor ones ask for a fallback."""
    i = F.col("doc_id")
    rows = F.array(
        F.struct(F.lit("native").alias("method"), F.lit(0).alias("ord"), (i * 7 % 101).cast("int").alias("quality"), F.lit(0).alias("tables"), F.lit(0).alias("conf")),
        F.struct(F.lit("plumber").alias("method"), F.lit(1).alias("ord"), (i * 13 % 101).cast("int").alias("quality"), (i % 3).cast("int").alias("tables"), F.lit(0).alias("conf")),
        F.struct(F.lit("visual_ocr").alias("method"), F.lit(2).alias("ord"), (i * 17 % 101).cast("int").alias("quality"), F.lit(0).alias("tables"), (i * 5 % 100).cast("int").alias("conf")),
    )
    own = table(spark, sf_dir, "documents").select("doc_id", F.inline(rows))
    bonus = F.when((F.col("method") == "plumber") & (F.col("tables") > 0), 10).otherwise(0) + F.when((F.col("method") == "visual_ocr") & (F.col("conf") > 70), 15).otherwise(0)
    best = own.withColumn("score", F.col("quality") + bonus).groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("ord")).alias("o"), "method", "quality")).alias("b"))
    return best.select("doc_id", "b.method", "b.score", ((F.col("b.quality") < 60) & (F.col("b.method") != "visual_ocr")).alias("fallback"))


@query("""WITH w AS (SELECT l_orderkey % 500 AS doc, l_linenumber AS page, CAST(l_quantity * 2 AS INT) AS conf FROM lineitem WHERE CAST(l_quantity * 2 AS INT) > 0 AND l_shipdate IS NOT NULL),
p AS (SELECT doc, page, count(*) AS words, round(avg(conf), 6) AS mean, min(conf) AS low, max(conf) AS high, round(coalesce(stddev_pop(conf), 0), 6) AS std FROM w GROUP BY doc, page)
SELECT doc, page, words, mean, low, high, std, round(avg(mean) OVER (PARTITION BY doc), 5) AS document_mean FROM p""")
def ocr_page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word confidences by page; a document's is the mean of its pages' means."""
    from pyspark.sql.window import Window

    words = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("doc"), F.col("l_linenumber").alias("page"), (F.col("l_quantity") * 2).cast("int").alias("conf")).where("conf > 0")
    c = F.col("conf")
    pages = words.groupBy("doc", "page").agg(F.count("*").alias("words"), F.round(F.avg(c), 6).alias("mean"), F.min(c).alias("low"), F.max(c).alias("high"), F.round(F.coalesce(F.stddev_pop(c), F.lit(0.0)), 6).alias("std"))
    return pages.withColumn("document_mean", F.round(F.avg("mean").over(Window.partitionBy("doc")), 5))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(url, '[<>:"/\\|?*]', '_', 'g'), '_+', '_', 'g'), '_') AS name FROM pages""")
def sanitize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.sanitize_name(F.col("url")).alias("name"))


@query(r"SELECT page_id, CASE WHEN stem = '' THEN 'document' WHEN contains(stem, '_page') THEN regexp_extract(stem, '^(.*?)_page', 1) ELSE stem END AS source_id FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', ''), '_visual$', '') AS stem FROM pages)")
def infer_source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract("url", "([^/]*)$", 1), r"\.[^.]*$", ""), "_visual$", "")
    named = table(spark, sf_dir, "pages").select("page_id", stem.alias("stem"))
    return named.select("page_id", F.when(F.col("stem") == "", "document").when(F.contains("stem", F.lit("_page")), F.regexp_extract("stem", "^(.*?)_page", 1)).otherwise(F.col("stem")).alias("source_id"))
