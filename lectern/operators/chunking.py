"""Documents to chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as X

RUN_LINES = r"[\p{L}\p{N}_]+[^\p{L}\p{N}_]*"


def normalize_pages(pages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Pages (key, order, text) to one document each: text joined by blank
    lines in page order, its checksum and page count."""
    page = F.struct(F.col(order).alias("n"), F.coalesce("text", F.lit("")).alias("t"))
    own = pages.groupBy(key).agg(F.array_sort(F.collect_list(page)).alias("p"))
    own = own.select(key, F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("text"), F.size("p").alias("page_count"))
    return own.withColumn("checksum", F.sha2("text", 256))


def page_offsets(pages: DataFrame, key: str, order: str) -> DataFrame:
    """start_char: characters on earlier pages, without separators."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("start_char", F.coalesce(F.sum(F.length(F.coalesce("text", F.lit("")))).over(before), F.lit(0)).cast("long"))


def windows(text: Column, size: int = 1000, overlap: int = 120) -> Column:
    """Array of (window_no, start, raw): sliding windows of words, each word
    with what follows it."""
    step = max(1, size - overlap)

    def cut(w: Column) -> Column:
        n = F.size(w)
        lead = F.length(F.regexp_extract(text, r"^[^\p{L}\p{N}_]*", 0))
        last = F.greatest(F.ceil((n - size) / step).cast("int"), F.lit(0))
        made = F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(
                i.alias("window_no"),
                (lead + F.aggregate(F.slice(w, 1, i * step), F.lit(0), lambda a, t: a + F.length(t))).alias("start"),
                F.array_join(F.slice(w, i * step + 1, size), "").alias("raw"),
            ),
        )
        return F.when(n > 0, made).otherwise(F.filter(made, lambda _: F.lit(False)))

    # bound once, so the words are not found again for each window
    return F.flatten(F.transform(F.array(F.regexp_extract_all(text, F.lit(RUN_LINES), F.lit(0))), cut))


def chunk_windows(pages: DataFrame, key: str, order: str, size: int = 1000, overlap: int = 120) -> DataFrame:
    """key, page, window_no, start_char, end_char, text of every window."""
    own = page_offsets(pages, key, order).select(key, F.col(order).alias("page"), "start_char", F.explode(windows(F.coalesce("text", F.lit("")), size, overlap)).alias("w"))
    start = F.col("start_char") + F.col("w.start")
    return own.select(key, "page", F.col("w.window_no").alias("window_no"), start.alias("start_char"), (start + F.length("w.raw")).alias("end_char"), X.strip(F.col("w.raw")).alias("text"))


def page_chunks(pages: DataFrame, key: str, order: str) -> DataFrame:
    """A chunk for each page with text, numbered in page order."""
    own = pages.select(F.col(key).alias("parent_document_id"), F.col(order).alias("page_num"), X.strip(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''")
    own = own.withColumn("chunk_index", F.row_number().over(Window.partitionBy("parent_document_id").orderBy("page_num")) - 1)
    return own.select(F.concat(F.col("parent_document_id").cast("string"), F.lit(":c"), F.col("chunk_index").cast("string")).alias("chunk_id"), "parent_document_id", "chunk_index", "page_num", F.concat(F.lit("page/"), F.col("page_num").cast("string")).alias("section_path"), "text")


def chunks(pages: DataFrame, key: str, order: str, size: int = 1000, overlap: int = 120) -> DataFrame:
    """Windows, redacted, then filtered, then numbered: only kept chunks count."""
    own = chunk_windows(pages, key, order, size, overlap)
    # a generator of one row: redaction is done once, not again for each use in the filter
    own = own.select(*[c for c in own.columns if c != "text"], F.explode(F.array(X.redact(F.col("text")))).alias("text"))
    kept = own.where(X.passes_quality(F.col("text")))
    number = F.row_number().over(Window.partitionBy(key).orderBy("page", "window_no")) - 1
    kept = kept.withColumn("chunk_index", number)
    return kept.select(
        F.concat(F.col(key).cast("string"), F.lit(":c"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        F.col(key).alias("document_id"),
        "chunk_index",
        F.col("page").alias("page_num"),
        "start_char",
        "end_char",
        F.concat(F.lit("page/"), F.col("page").cast("string")).alias("section_path"),
        F.lit("prose").alias("content_type"),
        X.token_count(F.col("text")).alias("tokens"),
        F.lit(1.0).alias("quality_score"),
        "text",
    )


SECTIONS, SENTENCES = re.compile(r"\n\n+|\n#{1,6}\s"), re.compile(r"[.!?]+\s+")


def sentence_pieces(section: str, most: int = 512) -> Iterator[str]:
    """Sentences packed to at most `most` characters, joined by '. '; a longer
    sentence is cut off there."""
    held, any_piece = "", False
    for sentence in filter(str.strip, SENTENCES.split(section)):
        joined = f"{held}. {sentence}" if held else sentence
        if len(joined) > most:
            if held:
                yield held
            joined = sentence[:most]
        held, any_piece = joined, True
    yield held if any_piece else section[:most]


def semantic_pieces(text: str, most: int = 512) -> Iterator[str]:
    """Sections between blank lines or before headings, packed greedily;
    sections that are too long go by sentences, the last piece staying open."""
    held = ""
    for section in filter(None, map(str.strip, SECTIONS.split(text))):
        joined = f"{held}\n\n{section}" if held else section
        if len(joined) <= most:
            held = joined
            continue
        if held:
            yield held
        *whole, held = [section] if len(section) <= most else sentence_pieces(section, most)
        yield from whole
    if held:
        yield held


def structure_pieces(text: str, most: int = 512) -> Iterator[str]:
    """Stripped lines packed greedily; blank lines go, line breaks do not
    count."""
    held: list[str] = []
    size = 0
    for line in filter(None, map(str.strip, text.split("\n"))):
        if held and size + len(line) > most:
            yield "\n".join(held)
            held, size = [], 0
        held.append(line)
        size += len(line)
    if held:
        yield "\n".join(held)


def folded(pieces: Callable[[str, int], Iterator[str]], text: Column, most: int) -> Column:
    """The pieces of a text as an array.  What a greedy fold does depends on all
    before it; in Python it is linear in the text, where an aggregate would copy
    its list for each piece."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([list(pieces(t or "", most)) for t in texts], index=texts.index, dtype=object)

    return run(text)


def semantic_chunks(text: Column, most: int = 512) -> Column:
    return folded(semantic_pieces, text, most)


def structure_chunks(text: Column, most: int = 512) -> Column:
    return folded(structure_pieces, text, most)


def size_pieces(text: str, most: int = 512, overlap: int = 50, legacy_tail: bool = False) -> Iterator[str]:
    """Cuts at the last blank before `most` characters, `overlap` back.  The
    legacy tail goes on with shorter and shorter ends of the text."""
    at = 0
    while at < len(text):
        end = min(at + most, len(text))
        if end < len(text):
            blank = text.rfind(" ", at, end)
            end = blank if blank > at else end
        piece = text[at:end].strip()
        if piece:
            yield piece
        if end >= len(text) and not legacy_tail:
            return
        at = max(end - overlap, at + 1)


def size_chunks(docs: DataFrame, key: str = "doc_id", most: int = 512, overlap: int = 50, legacy_tail: bool = False) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, p) for k, t in zip(batch[key], batch["text"], strict=True) for i, p in enumerate(size_pieces(t or "", most, overlap, legacy_tail))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "text"])

    return docs.select(key, "text").mapInPandas(run, f"{key} long, chunk_index int, text string")


STRATEGIES = {"semantic": semantic_chunks, "hybrid": semantic_chunks, "structure": structure_chunks}


def create_chunks(docs: DataFrame, strategy: str = "semantic", key: str = "doc_id", most: int = 512) -> DataFrame:
    """key, chunk_index, text, character_count, word_count, importance_score,
    content_type.  hybrid never finds a chunk to split further: it is semantic."""
    if strategy == "size":
        own = size_chunks(docs, key, most)
    elif strategy in STRATEGIES:
        own = docs.select(key, F.posexplode(STRATEGIES[strategy](F.coalesce("text", F.lit("")), most)).alias("chunk_index", "text"))
    else:
        raise ValueError(f"unknown chunking strategy: {strategy}")
    t = F.col("text")
    return own.select(key, "chunk_index", "text", F.length(t).alias("character_count"), X.word_count(t).alias("word_count"), X.importance(t).alias("importance_score"), X.content_type(t).alias("content_type"))


def embedding_chunks(docs: DataFrame, strategy: str = "semantic", key: str = "doc_id", most: int = 512, images: DataFrame | None = None) -> DataFrame:
    """`create_chunks` of at most `most` characters, with their strategy and
    size as metadata, and the references (filename, type) of the document's
    `images` (key, filename, type), by filename."""
    own = create_chunks(docs, strategy, key, most).withColumn("metadata", F.create_map(F.lit("chunk_strategy"), F.lit(strategy), F.lit("max_chunk_size"), F.lit(str(most))))
    if images is None:
        return own.withColumn("image_references", F.array().cast("array<struct<filename:string,type:string>>"))
    held = images.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(F.col("filename").cast("string").alias("filename"), F.col("type").cast("string").alias("type")))).alias("image_references"))
    return own.join(held, key, "left").withColumn("image_references", F.coalesce("image_references", F.array().cast("array<struct<filename:string,type:string>>")))
