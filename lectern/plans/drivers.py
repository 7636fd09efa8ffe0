"""Drivers around plugged-in extractors: fallback, reading order, ruled tables,
folder trees.  Extractors and word boxes are not in the tables, so texts are
taken as what several methods gave, and words are laid out by their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import cascade, reading, rulings, tree
from lectern.plans.exports import SPACED
from lectern.plans.layout import REGIONS, region_rows
from lectern.plans.registry import query, table

#: Four methods' texts of each document, in SQL of both engines.
METHODS = {
    "pymupdf": ("CASE WHEN source = 'src0' THEN translate(text, '.!?', '') || ' Col1 NULL' ELSE text END", "CAST(NULL AS DOUBLE)"),
    "pymupdf4llm": ("CASE WHEN lang = 'en' THEN text END", "CAST(NULL AS DOUBLE)"),
    "pdfplumber": ("CASE WHEN lang = 'de' THEN text ELSE 'NULL Col1 ' || translate(text, '.!?', '') END", "CAST(NULL AS DOUBLE)"),
    "visual_ocr": ("text", "CAST(doc_id * 5 % 100 AS DOUBLE)"),
}
TRIED = " UNION ALL ".join(f"SELECT doc_id, {i} AS step, '{name}' AS method, {text} AS text, {confidence} AS conf FROM documents" for i, (name, (text, confidence)) in enumerate(METHODS.items()))
CASCADE = rf"""WITH m AS ({TRIED}),
c AS (SELECT doc_id, step, unnest(string_split(text, '')) AS c, unnest(range(1, length(text) + 1)) AS i FROM m WHERE text <> ''),
g AS (SELECT doc_id, step, c, i - row_number() OVER (PARTITION BY doc_id, step, c ORDER BY i) AS g FROM c),
r AS (SELECT doc_id, step, count(*) AS runs FROM (SELECT doc_id, step FROM g WHERE c <> chr(10) GROUP BY doc_id, step, c, g HAVING count(*) >= 5) GROUP BY doc_id, step),
s AS (SELECT m.*, coalesce(conf, CASE WHEN text = '' THEN 0 ELSE greatest(0, 100 - CASE WHEN length(text) < 100 THEN 40 ELSE 0 END - CASE WHEN NOT regexp_matches(text, '[.!?]') AND {SPACED} > 10 THEN 30 ELSE 0 END - CASE WHEN coalesce(runs, 0) > 5 THEN 20 ELSE 0 END
- 10 * (contains(text, 'Col1')::INT + contains(text, 'Col2')::INT + contains(text, 'Col3')::INT + contains(text, '��')::INT + contains(text, 'NULL')::INT)) END)::DOUBLE AS score FROM m LEFT JOIN r ON r.doc_id = m.doc_id AND r.step = m.step),
e AS (SELECT doc_id, coalesce(min(CASE WHEN text IS NOT NULL AND score >= 60 THEN step END), 3) AS stop FROM s GROUP BY doc_id),
a AS (SELECT s.*, text IS NOT NULL AS success FROM s JOIN e ON e.doc_id = s.doc_id AND step <= stop)"""


def extractions(spark: SparkSession, sf_dir: str) -> cascade.Outcome:
    docs = table(spark, sf_dir, "documents")

    def method(name: str) -> cascade.Method:
        text, confidence = METHODS[name]
        return cascade.Method(name, lambda due: due.select("doc_id", F.expr(text).alias("text"), F.expr(confidence).alias("confidence")))

    return cascade.cascade(docs, [method(name) for name in METHODS])


@query(f"{CASCADE} SELECT doc_id, arg_max(method, step) FILTER (success) AS method_used, coalesce(arg_max(score, step) FILTER (success), 0)::DOUBLE AS quality_score, count(*) > 1 AS fallback_applied, count(*)::INT AS n_attempts, sha256(arg_max(text, step) FILTER (success)) AS text_sha256 FROM a GROUP BY doc_id")
def extraction_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a document's first good method gave, or else its last."""
    return extractions(spark, sf_dir).results.withColumn("text_sha256", F.sha2("text", 256)).drop("text")


@query(f"{CASCADE} SELECT step, method, count(*)::BIGINT AS seen, sum(success::INT)::BIGINT AS succeeded, sum((success AND score >= 60)::INT)::BIGINT AS settled FROM a GROUP BY step, method")
def extraction_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that each method saw: only what those before it left."""
    done = extractions(spark, sf_dir).attempts
    good = F.col("success") & (F.col("quality_score") >= 60)
    return done.groupBy("step", "method").agg(F.count(F.lit(1)).alias("seen"), F.count_if("success").alias("succeeded"), F.count_if(good).alias("settled"))


#: Words of a document on pages of 300: a heading of six, then two columns of 147, four to a line.
PLACED = r"""w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS text, unnest(range(0, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))) AS i FROM documents),
j AS (SELECT doc_id * 1000 + i // 300 AS page, i % 300 AS j, text FROM w),
p AS (SELECT page, j, text, CASE WHEN j < 6 THEN 0 ELSE 1 + (j - 6) // 147 END AS part, CASE WHEN j < 6 THEN 0 ELSE (j - 6) % 147 // 4 END AS row, CASE WHEN j < 6 THEN j * 90 ELSE (j - 6) // 147 * 400 + (j - 6) % 147 % 4 * 70 END AS x, CASE WHEN j < 6 THEN 0 ELSE 60 + (j - 6) % 147 // 4 * 14 END AS y FROM j)"""


@query(f"""WITH {PLACED}, l AS (SELECT page, part, row, min(x)::BIGINT AS x0, min(y)::BIGINT AS y0, max(x + 60)::BIGINT AS x1, max(y + 10)::BIGINT AS y1, count(*)::BIGINT AS n_words, string_agg(text, ' ' ORDER BY j) AS text FROM p GROUP BY page, part, row)
SELECT page, (row_number() OVER (PARTITION BY page ORDER BY part, row) - 1)::INT AS line, part::INT AS block, x0, y0, x1, y1, n_words, text FROM l""")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by their boxes alone to lines in reading order, columns one after
    the other."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("i", "text"))
    own = words.select((F.col("doc_id") * 1000 + F.floor(F.col("i") / 300)).alias("page"), (F.col("i") % 300).cast("long").alias("j"), "text")
    head, k = F.col("j") < 6, F.col("j") - 6
    part, in_part = F.floor(k / 147), k % 147
    x = F.when(head, F.col("j") * 90).otherwise(part * 400 + in_part % 4 * 70)
    y = F.when(head, F.lit(0)).otherwise(60 + F.floor(in_part / 4) * 14)
    # ids say nothing of the order
    return reading.lines(own.select("page", F.xxhash64("page", "j").alias("id"), x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 10).alias("y1"), "text"))


RULED = f"""WITH RECURSIVE {REGIONS}, h AS (SELECT page, id, y, x AS x1, x + w * 3 AS x2 FROM reg WHERE id % 2 = 0), v AS (SELECT page, id, x, y AS y1, y + h * 3 AS y2 FROM reg WHERE id % 2 = 1),
k AS (SELECT DISTINCT h.page, h.id AS h_id, v.id AS v_id, x, y FROM h JOIN v ON h.page = v.page AND x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2),
walk AS (SELECT page, h_id AS origin, h_id AS node FROM k UNION SELECT w.page, w.origin, b.h_id FROM walk w JOIN k a ON a.page = w.page AND a.h_id = w.node JOIN k b ON b.page = a.page AND b.v_id = a.v_id),
t AS (SELECT page, node AS h_id, min(origin) AS tab FROM walk GROUP BY page, node),
o AS (SELECT k.*, tab FROM k JOIN t ON t.page = k.page AND t.h_id = k.h_id),
ys AS (SELECT page, tab, sum(CASE WHEN b IS NULL OR y - b > 3 THEN 1 ELSE 0 END) AS n FROM (SELECT page, tab, y, lag(y) OVER (PARTITION BY page, tab ORDER BY y) AS b FROM (SELECT DISTINCT page, tab, y FROM o)) GROUP BY page, tab),
xs AS (SELECT page, tab, sum(CASE WHEN b IS NULL OR x - b > 3 THEN 1 ELSE 0 END) AS n FROM (SELECT page, tab, x, lag(x) OVER (PARTITION BY page, tab ORDER BY x) AS b FROM (SELECT DISTINCT page, tab, x FROM o)) GROUP BY page, tab)
SELECT o.page, o.tab AS "table", any_value(ys.n - 1)::INT AS n_rows, any_value(xs.n - 1)::INT AS n_columns, (count(DISTINCT h_id) + count(DISTINCT v_id))::INT AS n_lines, count(*)::INT AS n_crossings, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1
FROM o JOIN ys ON ys.page = o.page AND ys.tab = o.tab JOIN xs ON xs.page = o.page AND xs.tab = o.tab WHERE ys.n > 1 AND xs.n > 1 GROUP BY o.page, o.tab"""


@query(RULED)
def ruled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hang together by crossings, with their rows and columns."""
    own, c = region_rows(spark, sf_dir), F.col
    across = own.where("id % 2 = 0").select("page", "id", "y", c("x").alias("x1"), (c("x") + c("w") * 3).alias("x2"))
    down = own.where("id % 2 = 1").select("page", "id", "x", c("y").alias("y1"), (c("y") + c("h") * 3).alias("y2"))
    return rulings.tables(across, down)


@query("""WITH f AS (SELECT list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda p: p <> '') AS parts, strlen(html)::BIGINT AS size, page_id AS modified FROM pages),
n AS (SELECT parts, size, modified, unnest(range(1, least(len(parts), 3) + 1)) AS level FROM f WHERE len(parts) > 0 AND len(list_filter(parts, lambda p: starts_with(p, '.'))) = 0)
SELECT array_to_string(parts[1:level], '/') AS path, parts[level] AS name, level::INT AS level, CASE WHEN level = 3 OR NOT bool_and(len(parts) = level) THEN 'directory' ELSE 'file' END AS kind, level = 3 AS truncated, count(*)::BIGINT AS files, sum(coalesce(size, 0))::BIGINT AS bytes, max(modified) AS modified FROM n GROUP BY array_to_string(parts[1:level], '/'), parts[level], level""")
def directory_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files by their urls, to a depth of three."""
    pages = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.octet_length("html").alias("size"), F.col("page_id").alias("modified"))
    return tree.directory_tree(pages)
