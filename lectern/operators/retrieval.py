"""Full-text, vector, hybrid and extractive-answer search as single plans."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as X

if TYPE_CHECKING:
    from lectern.operators.fulltext import TextIndex

ALPHA = 0.6
#: Words of a text to a row, where hashes go to Python.
SLICE = 4096
#: Function words left out of queries and of the index.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def postings(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """term, key, tf, positions: the inverted index, one row a term and chunk."""
    words = chunks.select(key, F.posexplode(X.tokens(F.lower(F.col("text")))).alias("pos", "term")).where(~F.col("term").isin(*STOP_WORDS))
    return words.groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def query_terms(query: str) -> list[str]:
    return sorted({w for w in re.findall(r"\w+", query.lower()) if w not in STOP_WORDS})


def term_counts(chunks: DataFrame, terms: list[str], key: str = "chunk_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, n_terms, rank (sum of term frequencies) of all chunks.  Occurrences
    are counted where the text is; no list of its words is made."""

    def count(low: Column, term: str) -> Column:
        # begins with the term itself, which is fast to look for; then what may not stand around it
        alone = f"{re.escape(term)}(?!{X.WORD})(?<!{X.WORD}{re.escape(term)})"
        return F.when(F.contains(low, F.lit(term)), F.regexp_count(low, F.lit(alone))).otherwise(0)

    # bound once: the text is put into lower case once a row
    found = F.get(F.transform(F.array(F.lower("text")), lambda low: F.array(*[F.coalesce(count(low, t), F.lit(0)) for t in terms] or [F.lit(0)])), F.lit(0))
    counted = chunks.select(key, *carry, found.alias("tfs"))
    return counted.select(key, *carry, F.size(F.filter("tfs", lambda n: n > 0)).alias("n_terms"), F.aggregate("tfs", F.lit(0), lambda a, n: a + n).cast("long").alias("rank"))


def fts(chunks: DataFrame, query: str, k: int, key: str = "chunk_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Chunks with all terms; if there are none and the query has several
    words, chunks with any.  The k of highest rank, with the columns of `carry`.

    One pass: chunks with all terms sort first, so if there are any, the k best
    have them on top, and those without go."""
    terms = query_terms(query)
    hits = term_counts(chunks, terms, key, carry).withColumn("every", F.col("n_terms") == len(terms))
    # chunks without any term sort last; a filter here would count twice
    best = hits.orderBy(F.desc("every"), F.desc("rank"), key).limit(k).where("rank > 0")
    # k rows in one task
    found = best.withColumn("some", F.max("every").over(Window.partitionBy()))
    return found.where(F.col("every") | ~F.col("some")).select(key, "rank", *carry)


def fts_index(index: TextIndex, query: str, k: int, among: DataFrame | None = None) -> DataFrame:
    """`fts` over stored postings of plain words: key, rank.  The postings of
    the query's words are read and nothing else; `among` (key) narrows the rows
    before they are ranked."""
    terms = query_terms(query)
    own = index.of(terms)
    if among is not None:
        own = own.join(among.select(index.key), index.key, "left_semi")
    counted = own.groupBy(index.key).agg(F.countDistinct("stem").alias("n_terms"), F.sum("tf").alias("rank"))
    best = counted.withColumn("every", F.col("n_terms") == len(terms)).orderBy(F.desc("every"), F.desc("rank"), index.key).limit(k)
    # k rows in one task
    found = best.withColumn("some", F.max("every").over(Window.partitionBy()))
    return found.where(F.col("every") | ~F.col("some")).select(index.key, "rank")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-9) * (F.sqrt(dot(b, b)) + 1e-9))


def vector_search(vectors: DataFrame, probe: DataFrame, k: int, key: str = "vec_id", value: str = "embedding", only: Column | None = None) -> DataFrame:
    """The k vectors of highest cosine to the one row of `probe`; `only` is
    applied before the limit.  Of several among them with one key the last, and
    so the farthest, is left."""
    rows = vectors if only is None else vectors.where(only)
    scored = rows.crossJoin(F.broadcast(probe.select(F.col(value).alias("_probe")).limit(1)))
    best = scored.select(key, F.round(cosine(F.col(value), F.col("_probe")), 6).alias("cosine")).orderBy(F.desc("cosine"), key).limit(k)
    # k rows in one task
    last = F.min("cosine").over(Window.partitionBy(key))
    return best.withColumn("_last", last).where(F.col("cosine") == F.col("_last")).drop("_last").dropDuplicates([key])


def similar(vectors: DataFrame, vec_id: int, k: int) -> DataFrame:
    """Neighbours of a stored vector, itself included; none if it is unknown."""
    return vector_search(vectors, vectors.where(F.col("vec_id") == vec_id), k)


def hybrid(chunks: DataFrame, vectors: DataFrame, query: str, probe: DataFrame, k: int, only: Column | None = None, alpha: float = ALPHA, hits: DataFrame | None = None) -> DataFrame:
    """doc_id, source, score, snippet: full-text hits scored with their cosine
    if the vector search has them too, filled up by vector hits alone.  `hits`
    (doc_id, rank; k rows at most) stand in for the scan, `only` applied."""
    own = chunks if only is None else chunks.where(only)
    text_hits = fts(own, query, k, "doc_id") if hits is None else hits.select("doc_id", "rank")
    linked = vectors.join(own.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi") if only is not None else vectors
    near = vector_search(linked, probe, k).withColumnRenamed("vec_id", "doc_id")
    # both lists once, k rows each; what follows has 2 k rows at most
    both = text_hits.join(near, "doc_id", "full").withColumn("n_text", F.count("rank").over(Window.partitionBy()))
    place = F.row_number().over(Window.orderBy(F.col("rank").isNotNull(), F.desc("cosine"), "doc_id"))
    both = both.withColumn("place", place).where(F.col("rank").isNotNull() | (F.col("place") <= k - F.col("n_text")))
    score = F.coalesce("cosine", F.lit(0.0)) * alpha + F.coalesce("rank", F.lit(0)) * (1 - alpha)
    source = F.when(F.col("rank").isNotNull(), "fts").otherwise("vector")
    top = both.select("doc_id", source.alias("source"), F.round(score, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)
    # k rows; the text is fetched for those that are left
    return chunks.select("doc_id", "text").join(F.broadcast(top), "doc_id", "right").select("doc_id", "source", "score", X.snippet(F.col("text")).alias("snippet"))


def answer(hits: DataFrame) -> DataFrame:
    """One row: the snippets of the hits by score, joined by blank lines, and
    the ids they come from."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("doc_id").alias("d"), F.col("snippet").alias("t"))))
    row = hits.agg(ordered.alias("h"))
    text = F.array_join(F.transform(F.filter("h", lambda x: x["t"].isNotNull()), lambda x: x["t"]), "\n\n")
    shown = F.when(F.size("h") == 0, "No relevant content found.").when(text == "", "No snippet available.").otherwise(text)
    return row.select(shown.alias("answer"), F.array_join(F.transform("h", lambda x: x["d"].cast("string")), ",").alias("citations"))


def tfidf_search(docs: DataFrame, query: str, k: int, features: int = 5000, key: str = "doc_id", least: float = 0.01, index: TextIndex | None = None) -> DataFrame:
    """Cosine of TF-IDF rows with the query: words of two characters or more,
    the most frequent `features` of the corpus, idf ln((1+n)/(1+df))+1.
    Scores of `least` or less are not shown.  With an `index` of plain words its
    postings are read in place of the texts."""
    from collections import Counter

    if index is None:
        words = docs.select(key, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))).alias("term")).where(~F.col("term").isin(*STOP_WORDS))
        counts = words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    else:
        counts = index.postings().select(key, F.col("stem").alias("term"), "tf").where((F.length("term") >= 2) & ~F.col("term").isin(*STOP_WORDS))
    vocabulary = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")).orderBy(F.desc("total"), "term").limit(features)
    n = docs.agg(F.count("*").alias("n"))
    idf = vocabulary.crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    # `features` rows at most
    rows = counts.join(F.broadcast(idf), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"), "idf")
    asked = Counter(w for w in re.findall(r"\w{2,}", query.lower()) if w not in STOP_WORDS)
    times = F.lit(0)
    for t, c in asked.items():
        times = F.when(F.col("term") == t, c).otherwise(times)
    norms = rows.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum(F.col("w") * times * F.col("idf")).alias("dot"))
    own = idf.where(F.col("term").isin(*asked) if asked else F.lit(False)).select(F.sqrt(F.sum(F.pow(times * F.col("idf"), 2))).alias("q"))
    return norms.where("dot > 0").crossJoin(F.broadcast(own)).select(key, F.round(F.col("dot") / (F.col("norm") * F.col("q")), 6).alias("score")).where(F.col("score") > least).orderBy(F.desc("score"), F.desc(key)).limit(k)


def cover_density(chunks: DataFrame, query: str, key: str = "chunk_id", ideal: int = 4) -> DataFrame:
    """Rank by minimal spans that hold all terms: a span of up to `ideal`
    words counts 1, a longer one ideal / length."""
    terms = query_terms(query)
    hits = postings(chunks, key).where(F.col("term").isin(*terms) if terms else F.lit(False))
    places = hits.select(key, "term", F.explode("positions").alias("pos"))
    own = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = places.withColumns({f"p{i}": F.max(F.when(F.col("term") == t, F.col("pos"))).over(own) for i, t in enumerate(terms)})
    start = F.least(*[F.col(f"p{i}") for i in range(len(terms))]) if len(terms) > 1 else F.col("p0") if terms else F.lit(None)
    full = F.lit(True)
    for i in range(len(terms)):
        full = full & F.col(f"p{i}").isNotNull()
    spans = last.where(full).select(key, start.alias("start"), "pos").groupBy(key, "start").agg(F.min("pos").alias("stop"))
    return spans.groupBy(key).agg(F.round(F.sum(F.least(F.lit(1.0), F.lit(float(ideal)) / (F.col("stop") - F.col("start") + 1))), 6).alias("rank"))


def summed(key: str, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hashes of words to one row of signed counts for each key of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch[key].dictionary_encode(null_encoding="encode")
            h, n = batch["h"].flatten().to_numpy(), len(keys.dictionary)
            at = np.repeat(keys.indices.to_numpy().astype("int64"), batch["h"].value_lengths().to_numpy()) * dim + h % dim
            counts = np.bincount(at, weights=np.where(h >= 0, 1, -1), minlength=n * dim).astype("int64")
            yield pa.RecordBatch.from_arrays([keys.dictionary, pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(counts))], [key, "v"])

    return run


def hash_embeddings(docs: DataFrame, dim: int = 384, key: str = "doc_id") -> DataFrame:
    """A deterministic stand-in for an embedding model: hashed words with
    signs, length one.  Real models plug in behind the same columns.  Words are
    counted where they lie, in slices of at most `SLICE`; a row for each key of
    a batch is shuffled."""
    hashes = F.transform(X.tokens(F.lower(F.col("text"))), lambda w: F.xxhash64(w))

    def slices(h: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.floor((F.size(h) - 1) / SLICE).cast("int")), lambda i: F.slice(h, i * SLICE + 1, SLICE))
        return F.when(F.size(h) > 0, made).otherwise(F.array().cast("array<array<bigint>>"))

    # bound once, so that words are hashed once
    own = docs.select(key, F.explode(F.flatten(F.transform(F.array(hashes), slices))).alias("h"))
    schema = own.select(key, F.col("h").alias("v")).schema
    held = own.mapInArrow(summed(key, dim), schema).groupBy(key).agg(F.collect_list("v").alias("p"))
    # a key in several batches adds them up
    both = F.aggregate(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.col("p")[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    vectors = held.select(key, F.when(F.size("p") == 1, F.col("p")[0]).otherwise(both).alias("v"))

    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        # bound once, so that the norm is not found again for each value
        return F.transform(F.array(norm), lambda n: F.transform(v, lambda x: (x / n).cast("float")))[0]

    return vectors.where(F.exists("v", lambda x: x != 0)).select(key, scaled(F.col("v")).alias("embedding"))
