"""Search queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import chunking, fulltext, retrieval
from lectern.operators.vector_index import VectorIndex
from lectern.plans.corpus import CHUNKS_SQL, DOC_PAGES, doc_pages, strip_sql
from lectern.plans.registry import query, table
from lectern.sources.sinks import keyed, lookup, shared_folder

ALL_TERMS = "thing hation onsh"
RARE_TERMS = "qwertyuiop thonly"
K = 10
STOPS = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)
TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
SNIP = f"CASE WHEN text <> '' THEN CASE WHEN length({strip_sql('text')}) > 300 THEN substr({strip_sql('text')}, 1, 300) || '...' ELSE {strip_sql('text')} END END"


#: Folders that this session has written, by what they hold.
STORED: dict[tuple, str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], object]) -> str:
    """A folder that is written when it is first asked for in a session."""
    of = (spark.sparkContext.applicationId, sf_dir, name)
    if of not in STORED:
        folder = shared_folder(spark, name)
        write(folder)
        STORED[of] = folder
    return STORED[of]


def text_index(spark: SparkSession, sf_dir: str, config: str = "simple") -> fulltext.TextIndex:
    """Of documents."""
    folder = stored(spark, sf_dir, f"{config}-index", lambda path: fulltext.TextIndex.create(table(spark, sf_dir, "documents"), path, "doc_id", config=config))
    return fulltext.TextIndex(spark, folder, "doc_id")


def stored_chunks(spark: SparkSession, sf_dir: str) -> str:
    """Chunks of documents by their ids."""
    return stored(spark, sf_dir, "chunks", lambda path: keyed(chunking.chunks(doc_pages(spark, sf_dir), "doc_id", "page").select("chunk_id", "text"), path, "chunk_id"))


def chunk_index(spark: SparkSession, sf_dir: str) -> fulltext.TextIndex:
    chunks = stored_chunks(spark, sf_dir)
    folder = stored(spark, sf_dir, "chunk-index", lambda path: fulltext.TextIndex.create(spark.read.parquet(chunks), path, config="simple"))
    return fulltext.TextIndex(spark, folder)


def fts_sql(terms: str, source: str, key: str, k: int = K) -> str:
    own = sorted(set(terms.split()))
    tfs = ", ".join(f"len(list_filter({TOK}, lambda x: x = '{t}'))" for t in own)
    return f"""tfs AS (SELECT {key}, [{tfs}] AS a FROM {source}),
hit AS (SELECT {key}, len(list_filter(a, lambda n: n > 0)) AS n_terms, CAST(list_sum(a) AS BIGINT) AS rank FROM tfs),
fts AS (SELECT {key}, rank FROM hit WHERE n_terms >= (SELECT CASE WHEN max(n_terms) = {len(own)} THEN {len(own)} ELSE 1 END FROM hit) AND n_terms > 0 ORDER BY rank DESC, {key} LIMIT {k})"""


DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def near_sql(probe: int, where: str = "true", k: int = K) -> str:
    a, b = "e.embedding", "q.embedding"
    cos = f"{DOT.format(a, b)} / ((sqrt({DOT.format(a, a)}) + 1e-9) * (sqrt({DOT.format(b, b)}) + 1e-9))"
    return f"near AS (SELECT e.vec_id, round({cos}, 6) AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {probe} LIMIT 1) q WHERE {where} ORDER BY cosine DESC, e.vec_id LIMIT {k})"


@query(f"WITH {DOC_PAGES}, {CHUNKS_SQL}, c AS (SELECT key || ':c' || n AS chunk_id, text FROM chunk), {fts_sql(ALL_TERMS, 'c', 'chunk_id')} SELECT fts.chunk_id, rank, {SNIP} AS snippet FROM fts JOIN c USING (chunk_id)")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: documents to chunks, redacted, filtered and numbered, both
    they and their postings stored; the ten best for a keyword query, with
    snippets."""
    best = retrieval.fts_index(chunk_index(spark, sf_dir), ALL_TERMS, K)
    return lookup(spark, stored_chunks(spark, sf_dir), best, "chunk_id").select("chunk_id", "rank", X.snippet(F.col("text")).alias("snippet"))


@query(f"WITH {DOC_PAGES}, {CHUNKS_SQL}, c AS (SELECT key || ':c' || n AS chunk_id, text FROM chunk), {fts_sql(ALL_TERMS, 'c', 'chunk_id')} SELECT fts.chunk_id, rank, {SNIP} AS snippet FROM fts JOIN c USING (chunk_id)")
def keyword_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`keyword_search` in one pass over the texts, with nothing stored."""
    chunks = chunking.chunks(doc_pages(spark, sf_dir), "doc_id", "page").select("chunk_id", "text")
    return retrieval.fts(chunks, ALL_TERMS, K, carry=("text",)).select("chunk_id", "rank", X.snippet(F.col("text")).alias("snippet"))


@query(f"WITH {fts_sql(ALL_TERMS, 'documents', 'doc_id')} SELECT * FROM fts")
def fts_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fts_index(text_index(spark, sf_dir), ALL_TERMS, K)


@query(f"WITH {fts_sql(ALL_TERMS, 'documents', 'doc_id')} SELECT * FROM fts")
def fts_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`fts_and` in one pass over the texts."""
    return retrieval.fts(table(spark, sf_dir, "documents"), ALL_TERMS, K, "doc_id")


@query(f"WITH {fts_sql(RARE_TERMS, 'documents', 'doc_id')} SELECT * FROM fts")
def fts_or_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fts_index(text_index(spark, sf_dir), RARE_TERMS, K)


@query(rf"SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS total FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK}) AS term FROM documents) WHERE term NOT IN ({STOPS}) GROUP BY ALL) GROUP BY term")
def term_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.postings(table(spark, sf_dir, "documents"), "doc_id").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


@query()
def cover_density_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.cover_density(table(spark, sf_dir, "documents"), ALL_TERMS, "doc_id")


@query(f"WITH {near_sql(7)} SELECT * FROM near")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.vector_search(vectors, vectors.where("vec_id = 7"), K)


@query(f"WITH {near_sql(7, 'e.vec_id % 5 = 0')} SELECT * FROM near")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.vector_search(vectors, vectors.where("vec_id = 7"), K, only=F.col("vec_id") % 5 == 0)


@query(f"WITH {near_sql(11)} SELECT * FROM near")
def similar_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.similar(table(spark, sf_dir, "embeddings"), 11, K)


def hybrid_sql(terms: str, probe: int, k: int, where: str = "true") -> str:
    link = "true" if where == "true" else f"e.vec_id IN (SELECT doc_id FROM documents WHERE {where})"
    return f"""d AS (SELECT * FROM documents WHERE {where}), {fts_sql(terms, 'd', 'doc_id', k)}, {near_sql(probe, link, k)},
one AS (SELECT doc_id, 'fts' AS source, coalesce(cosine, 0) * 0.6 + rank * (1 - 0.6) AS score FROM fts LEFT JOIN near ON doc_id = vec_id),
two AS (SELECT vec_id AS doc_id, 'vector' AS source, cosine * 0.6 AS score FROM (SELECT *, row_number() OVER (ORDER BY cosine DESC, vec_id) AS r FROM near WHERE vec_id NOT IN (SELECT doc_id FROM fts)) WHERE r <= {k} - (SELECT count(*) FROM fts)),
top AS (SELECT doc_id, source, round(score, 6) AS score FROM (SELECT * FROM one UNION ALL SELECT * FROM two) ORDER BY 3 DESC, doc_id LIMIT {k}),
hyb AS (SELECT top.doc_id, top.source, top.score, {SNIP} AS snippet FROM top LEFT JOIN documents USING (doc_id))"""


def run_hybrid(spark: SparkSession, sf_dir: str, terms: str, probe: int, k: int, only=None) -> DataFrame:  # noqa: ANN001
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    hits = retrieval.fts_index(text_index(spark, sf_dir), terms, k, None if only is None else docs.where(only))
    return retrieval.hybrid(docs, vectors, terms, vectors.where(F.col("vec_id") == probe), k, only, hits=hits)


@query(f"WITH {hybrid_sql(ALL_TERMS, 7, K)} SELECT * FROM hyb")
def hybrid_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`hybrid_search` with the texts scanned."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return retrieval.hybrid(docs, vectors, ALL_TERMS, vectors.where("vec_id = 7"), K)


@query(f"WITH {hybrid_sql(ALL_TERMS, 7, K)} SELECT * FROM hyb")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_hybrid(spark, sf_dir, ALL_TERMS, 7, K)


@query(f"WITH {hybrid_sql(ALL_TERMS, 7, K, 'doc_id % 4 = 1')} SELECT * FROM hyb")
def hybrid_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_hybrid(spark, sf_dir, ALL_TERMS, 7, K, F.col("doc_id") % 4 == 1)


@query(f"WITH {hybrid_sql('qwertyuiop', 3, 5)} SELECT * FROM hyb")
def vector_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_hybrid(spark, sf_dir, "qwertyuiop", 3, 5)


@query(f"WITH {hybrid_sql(ALL_TERMS, 7, 3)} SELECT string_agg(snippet, chr(10) || chr(10) ORDER BY score DESC, doc_id) AS answer, string_agg(doc_id::VARCHAR, ',' ORDER BY score DESC, doc_id) AS citations FROM hyb")
def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.answer(run_hybrid(spark, sf_dir, ALL_TERMS, 7, 3))


@query(f"SELECT doc_id, {SNIP} AS snippet FROM documents")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text")).alias("snippet"))


@query(rf"""WITH w AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM documents) WHERE term NOT IN ({STOPS}) GROUP BY ALL),
v AS (SELECT term, count(*) AS df FROM w GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 5000),
i AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM v),
r AS (SELECT doc_id, term, tf * idf AS w, idf FROM w JOIN i USING (term)),
q AS (SELECT term, 1 * idf AS qw FROM i WHERE term IN ('thing', 'hation', 'onsh')),
s AS (SELECT doc_id, sqrt(sum(r.w * r.w)) AS norm, sum(coalesce(r.w * qw, 0)) AS dot FROM r LEFT JOIN q USING (term) GROUP BY doc_id)
SELECT * FROM (SELECT doc_id, round(dot / (norm * (SELECT sqrt(sum(qw * qw)) FROM q)), 6) AS score FROM s WHERE dot > 0) WHERE score > 0.01 ORDER BY score DESC, doc_id DESC LIMIT 10""")
def tfidf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.tfidf_search(table(spark, sf_dir, "documents"), ALL_TERMS, K, index=text_index(spark, sf_dir))


@query()
def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hash_embeddings(table(spark, sf_dir, "documents"))


@query()
def english_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems and cover density over stored postings."""
    return text_index(spark, sf_dir, "english").search("things and hations", K)


CHANGED = "SELECT doc_id, CASE WHEN source = 'src1' THEN 'Changed since: ' || text || ' zyxwv' ELSE text END AS text FROM documents WHERE lang IS DISTINCT FROM 'en'"


@query(rf"SELECT stem, count(*)::BIGINT AS df, sum(tf)::BIGINT AS total FROM (SELECT doc_id, stem, count(*) AS tf FROM (SELECT doc_id, unnest({TOK}) AS stem FROM ({CHANGED})) GROUP BY ALL) GROUP BY stem")
def indexed_terms_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of an index of all documents, of which those of one source were
    then written again and those of one language deleted."""
    docs = table(spark, sf_dir, "documents")
    index = fulltext.TextIndex.create(docs, shared_folder(spark, "text-index"), "doc_id", config="simple")
    index.upsert(docs.where("source = 'src1'").withColumn("text", F.concat(F.lit("Changed since: "), "text", F.lit(" zyxwv"))))
    index.delete(docs.where("lang = 'en'"))
    index.tidy()
    return index.postings().groupBy("stem").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


def index_sql(rows: str) -> str:
    """Ten nearest, by a scan, of the smallest id of each label."""
    cos = f"{DOT.format('e.embedding', 'q.embedding')} / (sqrt({DOT.format('e.embedding', 'e.embedding')}) * sqrt({DOT.format('q.embedding', 'q.embedding')}))"
    return f"""WITH e AS ({rows}), q AS (SELECT min(vec_id) AS query, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label),
s AS (SELECT query, vec_id, round({cos}, 6) AS cosine FROM e, q), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS place FROM s)
SELECT query, place::INT AS place, vec_id, cosine FROM r WHERE place <= 10"""


def first_of_labels(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("label").agg(F.min("vec_id").alias("vec_id"), F.min_by("embedding", "vec_id").alias("embedding"))


@query(index_sql("SELECT vec_id, embedding FROM embeddings"))
def indexed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once in lists, searched by bounds: the same rows as a scan."""
    vectors = table(spark, sf_dir, "embeddings")
    index = VectorIndex.create(vectors, shared_folder(spark, "vector-index"), lists=16)
    return index.search_exact(first_of_labels(vectors), K, probes=4)


@query(index_sql("SELECT vec_id, CASE WHEN label = 2 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS embedding FROM embeddings WHERE label <> 1"))
def indexed_neighbours_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of label 2 are replaced and those of label 1 deleted, without a
    rebuild; a merge then leaves one segment."""
    vectors = table(spark, sf_dir, "embeddings")
    index = VectorIndex.create(vectors, shared_folder(spark, "vector-index"), lists=16)
    index.upsert(vectors.where("label = 2").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    index.delete(vectors.where("label = 1"))
    index.merge(last=2)
    return index.search_exact(first_of_labels(vectors), K, probes=4)
