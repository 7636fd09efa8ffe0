"""Line dedup by blocks, for an edit bound that grows with a line's length.
DataFrame functions only.

Two lines are near copies when their edit distance is at most `edit_bound` of
the shorter one: one edit for each `per_edit` characters, at least one and at
most `edits`.  A line with k edits has one of k + 1 separate blocks whole: the
j-th (from 0) such that j edits lie before it and at most k - j after it.  So
the block is found within j places of where it stands from the left, or within
k - j of where it stands from the right.  Each line gives its own blocks, and
what stands at these places of it as a partner of lines as long or slightly
shorter; for k = 4 that is 5 and 13 hashed keys, whatever the length.  Blocks
are as wide for all lines of a class of lengths.

Lines that share a key are a pair only if their numbers of letters allow for
it: an edit changes two counts by one at most.  A line is compared with the
earliest of each key it shares first.  Only where
an earlier one than what that found could be left are the others of the key
compared.  The edit distance is then verified on the texts.  Of all lines
within the bound, itself included, the one with the smallest (doc_id, line_no)
is a line's earliest; a line that is not its own earliest goes.

Lines are compared as they are, but for blanks at the end.  Lines under
`min_chars` are left alone, or with `short_copies` compared for equality only;
empty lines are always left alone.

Defined results: null and empty texts have no lines; a null doc_id ranks
before all others; rows that share the smallest (doc_id, line_no) all stay, so
repeated rows fare alike.  Extra columns are ignored.  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import bound, cut

NULL_ID = -(2**63)
#: Lines up to which a list of hashes goes to all executors: 40 bytes each at most.
BROADCAST_LINES = 300_000


def place(doc_id: str = "doc_id", line_no: str = "line_no") -> Column:
    return F.struct(F.coalesce(F.col(doc_id), F.lit(NULL_ID)).alias("id"), F.col(line_no).alias("no"))


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, line_no, line, h1, h2."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    rows = rows.select("doc_id", "line_no", F.rtrim(F.col("raw")).alias("line")).where(F.length("line") >= min_chars)
    return rows.select("doc_id", "line_no", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def edit_bound(n: Column, edits: int, per_edit: int) -> Column:
    return F.least(F.lit(edits), F.greatest(F.lit(1), F.floor(n / per_edit).cast("int")))


def length_class(n: Column, edits: int, per_edit: int) -> Column:
    """k (the bound), low (n rounded down to a quarter of its power of two)
    and w (the width of k + 1 blocks of low)."""
    step = F.greatest(F.lit(1), F.pow(F.lit(2), F.length(F.bin(n)) - 3).cast("int"))
    k, low = edit_bound(n, edits, per_edit), n - n % step
    return F.struct(k.alias("k"), low.alias("low"), F.floor(low / (k + 1)).cast("int").alias("w"))


def key_rows(texts: DataFrame, edits: int, per_edit: int) -> DataFrame:
    """key, h1, moved (false: a block of the line itself): hashes of the blocks
    of a class, the first half of them by their place from the left, the others
    from the right; moved ones of all places where they can stand in a partner.
    Rows are spread by generators, which compile, unlike functions of arrays."""
    n, m = F.length("line"), F.col("m")
    # the classes of the line and of partners that are shorter
    shorter = texts.select("h1", "line", n.alias("n"), F.explode(F.sequence(F.greatest(F.lit(1), n - edit_bound(n, edits, per_edit)), n)).alias("m"))
    own, last = length_class(m, edits, per_edit), length_class(m - 1, edits, per_edit)
    classes = shorter.withColumns({"c": own, "before": last}).where((m == F.greatest(F.lit(1), F.col("n") - edit_bound(F.col("n"), edits, per_edit))) | (F.col("c") != F.col("before")))
    k, w, j, x = F.col("c.k"), F.col("c.w"), F.col("j"), F.col("x")
    blocks = classes.select("h1", "line", "n", "c", (F.col("c") == length_class(F.col("n"), edits, per_edit)).alias("is_own"), F.explode(F.sequence(F.lit(0), k)).alias("j"))
    left = j * 2 <= k
    far = F.when(left, j).otherwise(k - j)
    # a partner's block at the line's own place has a moved row besides the line's own row, whose x is null
    places = F.when(F.col("is_own"), F.concat(F.array(F.lit(None).cast("int")), F.sequence(-far, far))).otherwise(F.sequence(-far, far))
    at = F.when(left, j * w).otherwise(F.col("n") - (k - j + 1) * w) + F.coalesce(x, F.lit(0))
    return blocks.select("*", F.explode(places).alias("x")).select(F.xxhash64(k, F.col("c.low"), j, F.substring("line", at + 1, w)).alias("key"), "h1", x.isNotNull().alias("moved"))


#: Characters whose numbers in a line are compared; any would do.
COUNTED = "etaoinshrdlucmfgpbvk "


def letter_counts(line: Column) -> Column:
    """Three longs of seven bytes, each the number of a character, at most 255."""
    counts = [F.least(F.length(line) - F.length(F.replace(line, F.lit(c), F.lit(""))), F.lit(255)).cast("long") for c in COUNTED]
    packed = {name: sum((F.shiftleft(c, 8 * i) for i, c in enumerate(counts[at : at + 7])), F.lit(0).cast("long")) for name, at in (("x", 0), ("y", 7), ("z", 14))}
    return F.struct(*[c.alias(name) for name, c in packed.items()])


def counts_differ(a: str, b: str) -> Column:
    """By how much the counts of two lines differ; at most twice their edits."""
    parts = [F.abs(F.shiftright(F.col(f"{a}.{c}"), 8 * i).bitwiseAND(255) - F.shiftright(F.col(f"{b}.{c}"), 8 * i).bitwiseAND(255)) for c in "xyz" for i in range(7)]
    return sum(parts[1:], parts[0])


def within(a: Column, b: Column, most: Column) -> Column:
    """Whether the edit distance is at most `most`.  Of long lines, equal
    pieces at both ends go first: Spark's function takes time with the square
    of what it is given."""
    piece = 256

    def equal_ends(x: Column, y: Column, pieces: Column, at: Callable[[Column], Column]) -> Column:
        places = F.when(pieces > 0, F.sequence(F.lit(0), pieces - 1)).otherwise(F.array().cast("array<int>"))
        return F.coalesce(F.get(F.filter(places, lambda i: F.substring(x, at(i), piece) != F.substring(y, at(i), piece)), F.lit(0)), pieces)

    n = F.least(F.length(a), F.length(b))
    whole = lambda x: F.floor(x / piece).cast("int")
    head = equal_ends(a, b, whole(n), lambda i: i * piece + 1)
    tail = lambda h: equal_ends(a, b, whole(n) - h, lambda i: -(i + 1) * piece)
    rest = lambda x, h, t: F.substring(x, h * piece + 1, F.length(x) - (h + t) * piece)
    trimmed = bound(head, lambda h: bound(tail(h), lambda t: F.call_function("levenshtein", rest(a, h, t), rest(b, h, t), most)))
    return F.when(n > 8 * piece, trimmed).otherwise(F.call_function("levenshtein", a, b, most)) >= 0


def verified(pairs: DataFrame, texts: DataFrame, edits: int, per_edit: int) -> DataFrame:
    """first, and the smallest `to` within the bound, of pairs (first, to)."""
    one = texts.select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "line")
    two = texts.select(F.col("h1").alias("t1"), F.col("h2").alias("t2"), F.col("line").alias("other"))
    rows = pairs.select("first", "to", F.col("first.h1").alias("f1"), F.col("first.h2").alias("f2"), F.col("to.h1").alias("t1"), F.col("to.h2").alias("t2"))
    rows = rows.join(one, ["f1", "f2"]).join(two, ["t1", "t2"])
    near = within(F.col("line"), F.col("other"), edit_bound(F.least(F.length("line"), F.length("other")), edits, per_edit))
    return rows.where(near).groupBy("first").agg(F.min("to").alias("to"))


def earliest_lines(docs: DataFrame, min_chars: int = 20, edits: int = 1, per_edit: int = 40, short_copies: bool = False) -> tuple[DataFrame, DataFrame]:
    """All lines (doc_id, line_no, h1, h2), and by (h1, h2) the earliest line
    within the bound, for lines that are not unique."""
    every = lines_of(docs, 1 if short_copies else min_chars)
    lines = cut(every.select("doc_id", "line_no", "h1", "h2"), "lines")
    distinct = lines.groupBy("h1", "h2").agg(F.min(place()).alias("p"), F.count(F.lit(1)).alias("n"))
    distinct = cut(distinct.select("h1", "h2", F.struct(F.col("p.id").alias("id"), F.col("p.no").alias("no"), "h1", "h2").alias("first"), "n"), "distinct-lines")
    # what different lines share
    long = every.where(F.length("line") >= min_chars)
    again = distinct.where("n > 1").select("h1", "h2", F.col("first.id").alias("id"), F.col("first.no").alias("no"))
    few = again.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    once = long.join(F.broadcast(again) if few else again, ["h1", "h2"], "left").where("id IS NULL OR (id = coalesce(doc_id, %d) AND no = line_no)" % NULL_ID).select("h1", "h2", "line")
    of_key = Window.partitionBy("key")
    rows = key_rows(once, edits, per_edit).select("*", F.min("h1").over(of_key).alias("low"), F.max("h1").over(of_key).alias("high"), F.min("moved").over(of_key).alias("all_moved"))
    rows = cut(rows.where("low <> high AND NOT all_moved").select("key", "h1", "moved").distinct(), "shared-keys")
    near = cut(rows.select("h1").distinct(), "near-lines")
    small = near.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    texts = once.join(F.broadcast(near) if small else near, "h1", "left_semi").dropDuplicates(["h1", "h2"])
    texts = cut(texts.join(distinct.select("h1", "h2", "first"), ["h1", "h2"]).withColumn("bag", letter_counts(F.col("line"))), "near-texts")
    # the earliest of each key
    rows = rows.join(texts.select("h1", "first", F.length("line").alias("n"), "bag", "line"), "h1")
    own, partner = F.min(F.when(~F.col("moved"), F.col("first"))).over(of_key), F.min(F.when(F.col("moved"), F.col("first"))).over(of_key)
    rows = cut(rows.select("key", "moved", "first", "n", "bag", "line", F.when(F.col("moved"), own).otherwise(partner).alias("to")), "keys")
    good = cut(verified(rows.where("to < first").select("first", "to").distinct(), texts, edits, per_edit), "first-links")
    # the others of a key that has one before what was found; what is no link does not leave the join
    open_rows = rows.join(good.withColumnRenamed("to", "found"), "first", "left").withColumn("found", F.coalesce("found", "first")).where("to < found")
    others = rows.select("key", F.col("moved").alias("as"), F.col("first").alias("other"), F.col("n").alias("m"), F.col("bag").alias("other_bag"), F.col("line").alias("other_line"))
    most = edit_bound(F.least("n", "m"), edits, per_edit)
    fit = (F.col("as") != F.col("moved")) & (F.col("other") > F.col("to")) & (F.col("other") < F.col("found"))
    fit = fit & (F.abs(F.col("n") - F.col("m")) <= most) & (counts_differ("bag", "other_bag") <= 2 * most) & within(F.col("line"), F.col("other_line"), most)
    more = open_rows.withColumnRenamed("key", "own_key").join(others, (F.col("own_key") == F.col("key")) & fit).groupBy("first").agg(F.min("other").alias("to"))
    good = good.unionByName(more).groupBy("first").agg(F.min("to").alias("to"))
    good = good.select(F.col("first.h1").alias("h1"), F.col("first.h2").alias("h2"), "to")
    found = distinct.join(good, ["h1", "h2"], "left").where("n > 1 OR to IS NOT NULL")
    return lines, found.select("h1", "h2", F.least("first", "to").alias("keep"))


def near_repeated_lines(docs: DataFrame, min_chars: int = 20, edits: int = 1, per_edit: int = 40, short_copies: bool = False) -> DataFrame:
    """The lines that go: doc_id, line_no, and the line that stays for it as
    keep_doc_id and keep_line_no."""
    lines, found = earliest_lines(docs, min_chars, edits, per_edit, short_copies)
    out = lines.select("doc_id", "line_no", "h1", "h2").join(found, ["h1", "h2"])
    out = out.where(place() > F.struct(F.col("keep.id").alias("id"), F.col("keep.no").alias("no")))
    return out.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.nullif(F.col("keep.id"), F.lit(NULL_ID)).alias("keep_doc_id"), F.col("keep.no").cast("long").alias("keep_line_no"))
