"""Benchmark decontamination: a hash set of the test items' n-grams, a scan of
the training words, an exact check of each hit.  DataFrame functions only.

A window is `width` consecutive words of an item (an item of fewer words is
one window).  Every window holds at least one of its item's anchors: short
n-grams picked so that they are unlikely to occur by chance.  A document's
words are looked up in the set of the anchors' first words, then the few that
are left in the set of the anchors' hashes; what passes is joined to the
anchors, and the words around are compared one by one with the item's.  A
stretch of equal words of at least the window's length is a hit: all its words
lie in occurrences of windows.

The sets go to the executors with the plan.  While there are at most
`BROADCAST_ANCHORS` anchors (this is checked) they are exact; beyond that one
table of marks holds the hashes of all of them, of a size set by
`MARKS_PER_ANCHOR` and never above `MOST_MARKS` bytes.  It lets a few places
through that are none, the more the fuller it is, and loses no place; the join
with the anchors, by a shuffle if Spark finds them too many to broadcast,
settles the rest.  The plan is the same: one scan, few places, one join.

Defined results: null and empty texts have no words and are not contaminated;
items without words are ignored; rows that are equal in id and text get equal
results; items that share an item_id count as one.  Extra columns stay in
`remove_documents`.  An empty benchmark hits nothing; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import cut

#: What is no word in lower-cased text: all of ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ANCHORS = 20_000
MARKS_PER_ANCHOR, MOST_MARKS = 32, 1 << 23
#: Contaminated documents up to which their list goes to all executors: 16 bytes each.
BROADCAST_DOCUMENTS = 200_000
GRAM = 3


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else.  Spark's lower() does that where no other
    letter has a lower case, which is cheap to see and the common case."""
    return F.when(text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    # what lies between words, split off: faster than to extract the words
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), "")


def anchors_of(benchmark: DataFrame, width: int) -> DataFrame:
    """item_id, words, need (words in a window), at (0-based place of the
    anchor), gram (its words).

    Of the places that a window offers, the one whose words are longest is its
    anchor, the first of equals: neighbouring windows mostly agree on it."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    n = F.size("words")
    need = F.least(n, F.lit(width))
    gram = F.least(need, F.lit(GRAM))
    starts = F.transform(F.sequence(F.lit(0), n - need), lambda s: F.sequence(s, s + need - gram))

    def best(places: Column) -> Column:
        rated = F.transform(places, lambda p: F.struct(F.aggregate(F.slice(F.col("words"), p + 1, gram), F.lit(0), lambda a, w: a - F.length(w)).alias("cost"), p.alias("at")))
        return F.array_min(rated)["at"]

    picked = items.select("item_id", "words", need.alias("need"), F.explode(F.array_distinct(F.transform(starts, best))).alias("at"), gram.alias("size"))
    return picked.select("item_id", "words", "need", "at", F.slice("words", F.col("at") + 1, F.col("size")).alias("gram"))


def hashed(words: list[Column]) -> Column:
    """Of the words of a gram; missing ones (null) add nothing."""
    return F.xxhash64(*words)


def scan(docs: DataFrame, benchmark: DataFrame, width: int) -> tuple[DataFrame, DataFrame, bool]:
    """Documents as (doc_id, key, n_words, places), places being an array of
    (at, near): where an anchor may begin and the words around it.  With it
    the anchors, and whether they are few enough to be sent to all tasks."""
    gram = [F.try_element_at("gram", F.lit(k + 1)) for k in range(GRAM)]
    anchors = cut(anchors_of(benchmark, width).withColumn("hash", hashed(gram)), "anchors")
    small = anchors.limit(BROADCAST_ANCHORS + 1).count() <= BROADCAST_ANCHORS
    reach = width - 1
    probe = exact_probe(anchors) if small else marked_probe(anchors)

    def look(w: Column) -> Column:
        # w is bound by transform(), so the text is taken apart once a row
        n = F.size(w)
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        places = F.filter(places, lambda i: probe(w, i))
        near = F.transform(places, lambda i: F.struct(i.alias("at"), F.slice(w, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)) + 1 + reach).alias("near")))
        return F.struct(n.cast("long").alias("n_words"), near.alias("places"))

    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.explode(F.transform(F.array(words_of(F.col("text"))), look)).alias("x")).select("doc_id", "key", "x.n_words", "x.places")
    # one scan serves both the counts and the hits
    return cut(rows, "scanned"), anchors, small


def exact_probe(anchors: DataFrame) -> Callable[[Column, Column], Column]:
    """Whether an anchor may begin at a place: its first word is one of theirs
    and the hash of its words too."""
    known = anchors.select(F.element_at("gram", 1).alias("first"), "hash", F.size("gram").alias("size")).distinct().collect()
    firsts = sorted({r.first for r in known}) or [""]
    by_size = {k: sorted({r.hash for r in known if r.size == k}) for k in range(1, GRAM + 1)}

    def probe(w: Column, i: Column) -> Column:
        # single elements: slice() copies the whole array
        own = [hashed(probed(w, i, k)).isin(by_size[k]) for k in by_size if by_size[k]]
        return F.element_at(w, i + 1).isin(firsts) & _any(own or [F.lit(False)])

    return probe


def marked_probe(anchors: DataFrame) -> Callable[[Column, Column], Column]:
    """The same for any number of anchors: two bytes of a table are marked for
    each hash, one by its lower half and one by its upper half."""
    n = anchors.agg(F.count(F.lit(1))).first()[0]
    marks = min(MOST_MARKS, 1 << max(15, (MARKS_PER_ANCHOR * n - 1).bit_length()))
    own = anchors.select("hash").distinct().select(F.explode(F.array(*mark_places(F.col("hash"), marks))).alias("m"))
    # Spark's bitmaps count from 1 and hold 32,768 bits each, lowest bit first
    bitmaps = own.groupBy(F.bitmap_bucket_number(F.col("m") + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("m") + 1)).alias("bits"))
    table = bytearray(marks)
    spread = [bytes(x >> k & 1 for k in range(8)) for x in range(256)]
    for row in bitmaps.toLocalIterator():
        at = (row.b - 1) * 32_768
        table[at : at + 32_768] = b"".join([spread[x] for x in row.bits])
    sizes = sorted(r[0] for r in anchors.select(F.size("gram")).distinct().collect())

    def probe(w: Column, i: Column) -> Column:
        return _any([_marked(hashed(probed(w, i, k)), F.lit(table), marks) for k in sizes])

    return probe


def mark_places(value: Column, marks: int) -> list[Column]:
    return [F.pmod(value, F.lit(marks).cast("long")), F.pmod(F.shiftright(value, 32), F.lit(marks).cast("long"))]


def _marked(value: Column, table: Column, marks: int) -> Column:
    one, two = [F.substring(table, (m + 1).cast("int"), F.lit(1)) == F.lit(bytearray(b"\x01")) for m in mark_places(value, marks)]
    return one & two


def probed(w: Column, i: Column, size: int) -> list[Column]:
    return [F.try_element_at(w, i + k + 1) for k in range(size)]


def hits(scanned: DataFrame, anchors: DataFrame, small: bool, width: int) -> DataFrame:
    """doc_id, key, item_id, first, last (places of the first and last hit
    word, from 0): one row for each stretch."""
    reach = width - 1
    spread = scanned.select("doc_id", "key", F.explode("places").alias("p")).select("doc_id", "key", F.col("p.at").alias("place"), F.col("p.near").alias("near"))
    # near[mid] is the word at place
    spread = spread.withColumn("mid", F.least("place", F.lit(reach)))
    grams = spread.withColumn("probe", F.explode(F.array_distinct(F.array(*[hashed(probed(F.col("near"), F.col("mid"), k)) for k in range(1, GRAM + 1)]))))
    side = F.broadcast(anchors) if small else anchors
    pairs = grams.join(side, F.col("probe") == F.col("hash"))
    same = lambda step: F.element_at(F.col("near"), F.col("mid") + step + 1) == F.element_at(F.col("words"), F.col("at") + step + 1)
    # equal words to the left of the place and from it on
    left_most, right_most = F.least("mid", "at"), F.least(F.size("near") - F.col("mid"), F.size("words") - F.col("at"), F.lit(width))
    left = _run(left_most, lambda k: same(-k), 1)
    right = _run(right_most, lambda k: same(k), 0)
    pairs = pairs.withColumns({"left": left, "right": right}).where(F.col("left") + F.col("right") >= F.col("need"))
    return pairs.select("doc_id", "key", "item_id", (F.col("place") - F.col("left")).alias("first"), (F.col("place") + F.col("right") - 1).alias("last"))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _run(most: Column, same, start: int) -> Column:  # noqa: ANN001
    """How many steps from `start` on are the same without a break, at most
    `most` of them."""
    steps = F.when(most > 0, F.sequence(F.lit(start), most - 1 + start)).otherwise(F.array().cast("array<int>"))
    breaks = F.filter(steps, lambda k: ~same(k))
    return F.when(F.size(breaks) > 0, F.element_at(breaks, 1) - start).otherwise(most)


def count_hits(scanned: DataFrame, anchors: DataFrame, small: bool, width: int) -> DataFrame:
    """doc_id, key, n_hit, items: one row for each document that is hit."""
    found = hits(scanned, anchors, small, width).distinct()
    # stretches that overlap or touch make one: what lies beyond all earlier ends is new
    before = Window.partitionBy("doc_id", "key").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("last").over(before), F.lit(-1))
    new = F.greatest(F.col("last") - F.greatest(F.col("first") - 1, reached), F.lit(0))
    return found.withColumn("new", new).groupBy("doc_id", "key").agg(F.sum("new").cast("long").alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: tuple[int, int] = (1, 20)) -> DataFrame:
    """doc_id, key, n_words, n_hit, n_items, items, contaminated for each row."""
    scanned, anchors, small = scan(docs, benchmark, width)
    found = count_hits(scanned, anchors, small, width).withColumnsRenamed({"doc_id": "_lx_id", "key": "_lx_key"})
    own = scanned.select("doc_id", "key", "n_words")
    out = own.join(found, own["doc_id"].eqNullSafe(found["_lx_id"]) & (own["key"] == found["_lx_key"]), "left")
    return out.select("doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")).withColumns({
        "n_items": F.size("items").cast("long"),
        "contaminated": (F.col("n_hit") > 0) & (F.col("n_hit") * share[1] >= F.col("n_words") * share[0]),
    })


def remove_documents(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: tuple[int, int] = (1, 20)) -> DataFrame:
    """The rows of `docs` that are not contaminated."""
    found = contamination(docs, benchmark, width, share).where("contaminated").select(F.col("doc_id").alias("_lx_id"), F.col("key").alias("_lx_of")).distinct()
    bad = cut(found, "contaminated")
    few = bad.limit(BROADCAST_DOCUMENTS + 1).count() <= BROADCAST_DOCUMENTS
    side = F.broadcast(bad) if few else bad
    own = docs.withColumn("_lx_key", F.xxhash64("text"))
    return own.join(side, own["doc_id"].eqNullSafe(bad["_lx_id"]) & (own["_lx_key"] == bad["_lx_of"]), "left_anti").select(*docs.columns)
