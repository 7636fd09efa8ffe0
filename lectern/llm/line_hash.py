"""Substring dedup by hashing of lines and passages.

The words of a text (lower case) are cut into units: a unit ends after a word
whose MD5 is not above those of the `REACH` words before and after it, so that
where units end depends on the words alone and never on line breaks, marks or
what stands farther off.  Two kinds of blocks are hashed:

* passages: from the start of each unit, of the text and of each line that is
  too short for a block of its own, on as many units as make `least_words`
  words or more, or what the text has left if that is as much;
* lines of `line_words` words or more.

Digests are grouped over all documents; the occurrence with the smallest
(doc_id, start) stays and all others go.  Blocks that go and overlap or touch
are one span.  Offsets are code points of the original text, end exclusive.

Of a passage that two texts share, what lies before its first unit and after
its last stays, so a passage is found if it has `least_words` words besides
those; passages of over 50 words mostly have.  Blocks that are shorter repeat by
chance and as plain headers and footers; they are left alone.

Defined results: null and empty texts have no words; a null doc_id ranks
before all others; rows that share both the smallest doc_id and the start all
keep the block, so repeated rows fare alike; rows equal in id and text are
listed once.  Extra columns stay in `remove_repeats`.  An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import cut, small_batches

#: Narrow on purpose: there is a row for every five words or so.  The digest has 96 bits, and text_key tells texts of one id apart.
UNITS = "doc_id long, text_key int, start int, chars int, first_word int, n_words int, high long, low int"
#: Blocks with `FREQUENT` rows in a sample of `SAMPLE_ROWS` go apart from the others.
SAMPLE_ROWS, FREQUENT = 2_000_000, 50
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LEAST_WORDS, LINE_WORDS, REACH = 25, 20, 3


class Ranks(dict):
    """The leading 32 bits of words' MD5s, kept when a word is first seen."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        found = self[word] = int.from_bytes(hashlib.md5(word).digest()[:4], "big")
        return found


def unit_ends(words: list[bytes], ranks: Ranks) -> list[int]:
    """Places behind the last words of units."""
    n = len(words)
    wide = np.full(n + 2 * REACH, 1 << 32, dtype=np.int64)
    own = wide[REACH : REACH + n]
    own[:] = [ranks[w] for w in words]
    low = np.ones(n, dtype=bool)
    for k in range(1, REACH + 1):
        low &= (own <= wide[REACH - k : REACH - k + n]) & (own <= wide[REACH + k : REACH + k + n])
    return (np.nonzero(low)[0] + 1).tolist()


def lowered(text: str) -> str:
    """Lower case, code point by code point where the whole would get longer."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def blocks_of(text: str, ranks: Ranks, least_words: int, line_words: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """start, characters, first word, number of words and digest of each block."""
    low = lowered(text)
    words = low.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return
    lines = [0, *accumulate(len(x.encode("utf-8", "surrogatepass").split()) for x in low.split("\n"))]
    cuts = unit_ends(words, ranks)
    spread = list(zip(lines, lines[1:], strict=False))
    found = {(a, b) for a, b in spread if b - a >= max(1, line_words)}
    for a in {0, *cuts, *[a for a, b in spread if b - a < max(1, line_words)]}:
        if n - a >= least_words:
            at = bisect_left(cuts, a + least_words)
            found.add((a, cuts[at] if at < len(cuts) else n))
    if found:
        spans = [m.span() for m in WORDS.finditer(text)]
        joined, at = b" ".join(words), [0, *accumulate(len(w) + 1 for w in words)]
        for a, b in sorted(found):
            yield spans[a][0], spans[b - 1][1] - spans[a][0], a, b - a, *struct.unpack("<qi", hashlib.md5(joined[at[a] : at[b] - 1]).digest()[:12])


def hashed_blocks(docs: DataFrame, least_words: int, line_words: int) -> DataFrame:
    """UNITS of each row."""
    types = [pa.int64(), *[pa.int32()] * 5, pa.int64(), pa.int32()]
    names = [x.split()[0] for x in UNITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, held = Ranks(), []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names)

        for batch in batches:
            for doc_id, key, text in zip(*batch.columns, strict=True):
                if text := text.as_py():
                    lead = (doc_id.as_py(), key.as_py())
                    held += [(*lead, *block) for block in blocks_of(text, ranks, least_words, line_words)]
                if len(held) >= 20_000:
                    yield out()
                    held = []
        if held:
            yield out()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("text_key"), "text").mapInArrow(run, UNITS)


def frequent_firsts(units: DataFrame) -> DataFrame:
    """The first occurrence of the most frequent blocks, told by a sample: at
    most `SAMPLE_ROWS` / `FREQUENT` rows or so, whatever the input.  The sample
    only says which way a block's rows take, not what becomes of them."""
    n = units.count()
    drawn = units.select("high", "low") if n <= SAMPLE_ROWS else units.select("high", "low").sample(SAMPLE_ROWS / n, seed=1)
    often = cut(drawn.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT).drop("n"), "frequent-blocks")
    firsts = units.join(F.broadcast(often), ["high", "low"]).groupBy("high", "low").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    return cut(firsts.select("high", "low", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start")), "frequent-firsts")


def repeated_blocks(docs: DataFrame, least_words: int = LEAST_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """The blocks that go: UNITS without the digest, and the occurrence that
    stays as first_doc_id and first_start.  Rows of frequent blocks stay where
    they are and only meet a minimum that was combined before its shuffle; all
    others are shuffled once, by digest."""
    units = cut(hashed_blocks(docs, least_words, line_words), "blocks", "zstd")
    firsts = F.broadcast(frequent_firsts(units))
    # null ids come first; plain columns, so that nothing is added to what is shuffled
    earlier = Window.partitionBy("high", "low").orderBy(F.asc_nulls_first("doc_id"), "start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = units.join(firsts, ["high", "low"], "left_anti").select("*", F.first("doc_id").over(earlier).alias("first_doc_id"), F.first("start").over(earlier).alias("first_start"))
    found = units.join(firsts, ["high", "low"]).unionByName(rest)
    return found.where(~F.col("doc_id").eqNullSafe(F.col("first_doc_id")) | (F.col("start") != F.col("first_start"))).drop("high", "low")


def repeated_spans(docs: DataFrame, least_words: int = LEAST_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """The spans that go: doc_id, text_key, start, stop, n_words and what stays
    for the first block in it as first_doc_id and first_start."""
    of_text = Window.partitionBy("doc_id", "text_key").orderBy("first_word", "n_words")
    before = of_text.rowsBetween(Window.unboundedPreceding, -1)
    rows = repeated_blocks(docs, least_words, line_words).withColumn("last_word", F.col("first_word") + F.col("n_words"))
    rows = rows.withColumn("opens", (F.col("first_word") > F.coalesce(F.max("last_word").over(before), F.lit(-1))).cast("int"))
    rows = rows.withColumn("span", F.sum("opens").over(of_text.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = rows.groupBy("doc_id", "text_key", "span").agg(
        F.min("start").alias("start"),
        F.max(F.col("start") + F.col("chars")).alias("stop"),
        (F.max("last_word") - F.min("first_word")).cast("long").alias("n_words"),
        F.min(F.struct("first_word", "n_words", "first_doc_id", "first_start")).alias("lead"),
    )
    return merged.select("doc_id", "text_key", *[F.col(c).cast("long").alias(c) for c in ("start", "stop")], "n_words", "lead.first_doc_id", F.col("lead.first_start").cast("long").alias("first_start"))


def remove_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """`docs` without the spans that go, and with removed, an array of their
    (start, stop) in the original text."""
    span = F.struct("start", "stop")
    gone = repeated_spans(docs, least_words, line_words).groupBy(F.col("doc_id").alias("_lx_id"), F.col("text_key").alias("_lx_key")).agg(F.array_sort(F.collect_list(span)).alias("_lx_gone"))
    own = [c for c in docs.columns if c.lower() != "removed"]
    rows = docs.select(*own).withColumn("_lx_own", F.hash("text"))
    rows = rows.join(gone, rows["doc_id"].cast("long").eqNullSafe(gone["_lx_id"]) & (rows["_lx_own"] == gone["_lx_key"]), "left")
    spans = F.coalesce("_lx_gone", F.array().cast("array<struct<start:bigint,stop:bigint>>"))
    # what is left lies before the first span, between two of them and after the last
    opens = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["stop"]))
    closes = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length("text").cast("long")))
    kept = F.array_join(F.zip_with(opens, closes, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))), "")
    return rows.select(*[F.when(F.size(spans) > 0, kept).otherwise(F.col("text")).alias("text") if c == "text" else rows[c] for c in own], spans.alias("removed"))
