"""N-gram Jaccard join by signature trees, exact.

Texts become sets of hashed word shingles; rows with equal sets are one node
from the start.  Two nodes link when their Jaccard similarity is at least
num/den; the result is the components of the links.

1. Prefixes.  In the order of the shingles' hashes, two similar sets share at
   least l shingles among their first n - ceil(t n) + l.  Shingles that only
   one set has in its prefix cannot be shared, so sets with fewer than l shared
   ones link with nothing.  Most texts end here.
2. Stars.  The most central set of each group that shares a rare prefix
   shingle is compared with the others.  This joins large groups of copies by
   a number of comparisons that is linear in the group.
3. Trees.  Groups that still hold several components are searched for links
   between them.  A signature tree has the sets at its leaves; its nodes hold
   the OR of their bitmaps and the range of their sizes.  Two trees are walked
   together; a pair of nodes is left out if all below is one component, if the
   sizes cannot match, or if the bits that both have are too few for the
   overlap that the sizes ask for.  Groups of more than `block` sets are
   searched as pairs of blocks, so no task holds more than two blocks.
4. Every pair that is left is compared by its whole sets.

Defined results: a text without words has an empty set and links with nothing,
not even with another; a text of fewer words than a shingle has the whole
sequence as its only shingle; null doc_ids count as larger than any other and
are never a component's id unless it has no other.  Extra columns are ignored
by `link_components` and kept by `drop_linked`; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import cut, small_batches
from lectern.llm.components import components

BITS = 2048
LEAF = 32
#: Rows up to which a list of ids goes to all executors: 24 bytes each.
BROADCAST_IDS = 200_000
#: Words whose hashes a worker keeps: about 180 bytes each.
CACHE = 100_000
BREAKS = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hashes of words, made when a word is first seen."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class Shingler:
    """Hashed shingle sets of texts; words are hashed once."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.cache = WordHashes()

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes."""
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(self.cache) > CACHE:
            self.cache.clear()
        seq = np.fromiter(map(self.cache.__getitem__, words), dtype=np.uint64, count=len(words))
        width = min(self.width, len(words))
        n = len(words) - width + 1
        out = np.full(n, width, dtype=np.uint64)
        for j in range(width):
            out = (out ^ seq[j : j + n]) * BREAKS
            out ^= out >> np.uint64(32)
        return np.unique(out)


def least_overlap(n: int, num: int, den: int) -> int:
    """ceil(t n)."""
    return -(-n * num // den)


def lead(n: int) -> int:
    """Shared prefix shingles asked for, by set size; never falls with n."""
    return max(1, n // 20)


def signature(found: np.ndarray) -> bytes:
    bits = np.zeros(BITS, dtype=np.uint8)
    bits[(found % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def set_key(found: np.ndarray) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(found.tobytes())
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def prefixes(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, text_key, n, k1, k2, prefix of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            n, k1, k2, parts = [], [], [], []
            for text in batch.column(2):
                found = shingler.shingles(text.as_py())
                a, b = set_key(found)
                n.append(len(found))
                k1.append(a)
                k2.append(b)
                parts.append(found[: len(found) - least_overlap(len(found), num, den) + lead(len(found))].view(np.int64) if len(found) else found.view(np.int64))
            offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "text_key", "n", "k1", "k2", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, n int, k1 long, k2 long, prefix array<long>")


def whole_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """kid, n, hashes, sig of the sets in `wanted` (kid, low_row, k1, k2).

    A set is read from its first row, which its id and its text name together:
    ids that repeat or are null bring no other texts along.
    """
    small = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    wanted = wanted.select("kid", "k1", "k2", F.col("low_row.id").alias("low_id"), F.col("low_row.key").alias("low_key"))
    side = F.broadcast(wanted) if small else wanted
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    rows = keyed.join(side, F.col("doc_id").eqNullSafe(F.col("low_id")) & (F.col("text_key") == F.col("low_key"))).select("kid", "k1", "k2", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            out = []
            for kid, k1, k2, text in zip(*batch.columns, strict=True):
                found = shingler.shingles(text.as_py())
                if set_key(found) == (k1.as_py(), k2.as_py()):  # another text may have the same key
                    out.append((kid.as_py(), len(found), found.tobytes(), signature(found)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["kid", "n", "hashes", "sig"])

    return rows.mapInArrow(run, "kid long, n int, hashes binary, sig binary").dropDuplicates(["kid"])


def linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    one = sets.select(F.col("kid").alias("a"), F.col("hashes").alias("x"))
    two = sets.select(F.col("kid").alias("b"), F.col("hashes").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum()) if len(y) else 0
                mask.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(mask, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


class Tree:
    """A signature tree over rows sorted by size and component."""

    def __init__(self, n: np.ndarray, comp: np.ndarray, sig: np.ndarray) -> None:
        self.order = np.lexsort((comp, n))
        self.n, self.comp, self.sig = n[self.order], comp[self.order], sig[self.order]
        self.extra = self.n - np.bitwise_count(self.sig).sum(axis=1).astype(np.int64)
        starts = np.arange(0, len(n), LEAF)
        stops = np.minimum(starts + LEAF, len(n))
        #: levels[0] are leaves: start, stop, least and most n, least and most component, most extra, OR of bitmaps
        self.levels = [(starts, stops, np.minimum.reduceat(self.n, starts), np.maximum.reduceat(self.n, starts), np.minimum.reduceat(self.comp, starts), np.maximum.reduceat(self.comp, starts), np.maximum.reduceat(self.extra, starts), np.bitwise_or.reduceat(self.sig, starts, axis=0))]
        while len(self.levels[-1][0]) > 1:
            low = self.levels[-1]
            at = np.arange(0, len(low[0]), 4)
            self.levels.append((at, np.minimum(at + 4, len(low[0])), np.minimum.reduceat(low[2], at), np.maximum.reduceat(low[3], at), np.minimum.reduceat(low[4], at), np.maximum.reduceat(low[5], at), np.maximum.reduceat(low[6], at), np.bitwise_or.reduceat(low[7], at, axis=0)))

    def node(self, level: int, i: int) -> tuple:
        return tuple(x[i] for x in self.levels[level])


#: A pair that may link: its group, its sets, their components, and its greatest overlap by its sizes.
PAIR = np.dtype([("group", np.int64), ("a", np.int64), ("b", np.int64), ("one", np.int64), ("two", np.int64), ("share", np.float64)])


def walk(one: Tree, two: Tree, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (in the trees' input) of pairs that may link and are of
    different components, with their greatest overlap by their sizes, some at
    a time.  one and two may be the same tree."""
    same = one is two
    stack = [(len(one.levels) - 1, 0, len(two.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        a, b = one.node(la, i), two.node(lb, j)
        if a[4] == a[5] == b[4] == b[5]:
            continue
        if den * a[3] < num * b[2] or den * b[3] < num * a[2]:
            continue
        need = -(-num * (int(a[2]) + int(b[2])) // (num + den))
        if min(int(a[3]), int(b[3]), int(np.bitwise_count(a[7] & b[7]).sum()) + min(int(a[6]), int(b[6]))) < need:
            continue
        if not la and not lb:
            yield leaves(one, two, int(a[0]), int(a[1]), int(b[0]), int(b[1]), same, num, den)
        elif la >= lb:
            if same and la == lb and i == j:
                own = range(int(a[0]), int(a[1]))
                stack.extend((la - 1, x, la - 1, y) for x in own for y in own if x <= y)
            else:
                stack.extend((la - 1, x, lb, j) for x in range(int(a[0]), int(a[1])))
        else:
            stack.extend((la, i, lb - 1, y) for y in range(int(b[0]), int(b[1])))


def leaves(one: Tree, two: Tree, a0: int, a1: int, b0: int, b1: int, same: bool, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = one.n[a0:a1, None], two.n[None, b0:b1]
    x, y = one.sig[a0:a1, None, :], two.sig[None, b0:b1, :]
    most = np.minimum(n - np.bitwise_count(x & ~y).sum(axis=2).astype(np.int64), m - np.bitwise_count(y & ~x).sum(axis=2).astype(np.int64))
    fit = (most * (num + den) >= num * (n + m)) & (one.comp[a0:a1, None] != two.comp[None, b0:b1])
    if same and a0 == b0:
        fit &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)[None, :]
    i, j = np.nonzero(fit)
    return one.order[a0 + i], two.order[b0 + j], (most / (n + m))[i, j]


def as_pairs(group: np.ndarray, kid: np.ndarray, comp: np.ndarray, i: np.ndarray, j: np.ndarray, share: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), dtype=PAIR)
    out["group"], out["a"], out["b"], out["one"], out["two"], out["share"] = group[i], kid[i], kid[j], comp[i], comp[j], share
    return out


def search_group(rows: dict[str, np.ndarray], first: int, second: int, num: int, den: int) -> Iterator[np.ndarray]:
    """Pairs of one group, or of a pair of its blocks, some at a time."""
    n, comp, sig, part = rows["n"], rows["comp"], rows["sig"], rows["part"]
    if first == second:
        a = b = np.arange(len(n))
        one = two = Tree(n, comp, sig)
    else:
        a, b = np.nonzero(part == first)[0], np.nonzero(part == second)[0]
        if not len(a) or not len(b):
            return
        one, two = Tree(n[a], comp[a], sig[a]), Tree(n[b], comp[b], sig[b])
    for i, j, share in walk(one, two, num, den):
        yield as_pairs(rows["group"], rows["kid"], comp, a[i], b[j], share)


def forest(found: np.ndarray) -> np.ndarray:
    """Of each group, the likeliest pairs that join its components without a
    circle."""
    root: dict[tuple[int, int], tuple[int, int]] = {}

    def find(x: tuple[int, int]) -> tuple[int, int]:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    found = found[np.lexsort((found["b"], found["a"], -found["share"]))]
    keep = np.zeros(len(found), dtype=bool)
    for at, (group, one, two) in enumerate(zip(found["group"].tolist(), found["one"].tolist(), found["two"].tolist(), strict=True)):
        x, y = find((group, one)), find((group, two))
        if x != y:
            root[x] = y
            keep[at] = True
    return found[keep]


def in_pieces(found: Iterator[np.ndarray], every: bool, piece: int = 50_000) -> Iterator[np.ndarray]:
    """All pairs that are found, or a forest of them, without holding more
    than about `piece` of them besides the forest.  A forest of a forest and
    what came later is a forest of both."""
    held: list[np.ndarray] = []
    n, most = 0, piece
    for rows in found:
        if not len(rows):
            continue
        held.append(rows)
        n += len(rows)
        if n >= most:
            rows = np.concatenate(held)
            if every:
                yield rows
                held, n = [], 0
            else:
                held = [forest(rows)]
                n, most = len(held[0]), piece + len(held[0])
    if held:
        yield np.concatenate(held) if every else forest(np.concatenate(held))


def small_groups(rows: dict[str, np.ndarray], num: int, den: int) -> Iterator[np.ndarray]:
    """Pairs that may link in groups of up to LEAF rows, all groups at once:
    each row against the next, the second next and so on of its group."""
    group, n, comp, sig, kid = rows["group"], rows["n"], rows["comp"], rows["sig"], rows["kid"]
    for step in range(1, LEAF):
        i = np.nonzero(group[step:] == group[:-step])[0] if len(group) > step else np.zeros(0, dtype=np.int64)
        if not len(i):
            break
        j = i + step
        fit = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num)
        i, j = i[fit], j[fit]
        for at in range(0, len(i), 10_000):
            p, q = i[at : at + 10_000], j[at : at + 10_000]
            x, y = sig[p], sig[q]
            most = np.minimum(n[p] - np.bitwise_count(x & ~y).sum(axis=1).astype(np.int64), n[q] - np.bitwise_count(y & ~x).sum(axis=1).astype(np.int64))
            good = most * (num + den) >= num * (n[p] + n[q])
            p, q = p[good], q[good]
            yield as_pairs(group, kid, comp, p, q, most[good] / (n[p] + n[q]))


def search_groups(table: pa.Table, key: list[str], num: int, den: int) -> Iterator[np.ndarray]:
    """Pairs of all groups in `table`, which holds whole groups in order."""
    keys = [table[c].to_numpy() for c in key]
    new = np.ones(table.num_rows, dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    group = np.cumsum(new) - 1
    starts = np.append(np.nonzero(new)[0], table.num_rows)
    sizes = np.diff(starts)
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64)
    rows = {"group": group, "sig": sig} | {c: table[c].to_numpy().astype(np.int64) for c in ("kid", "comp", "n", "part")}
    for g in np.nonzero((sizes > LEAF) | (keys[1][starts[:-1]] != keys[2][starts[:-1]]))[0]:
        own = slice(int(starts[g]), int(starts[g + 1]))
        yield from search_group({c: x[own] for c, x in rows.items()}, int(keys[1][starts[g]]), int(keys[2][starts[g]]), num, den)
    few = (sizes[group] <= LEAF) & (keys[1] == keys[2])
    yield from small_groups({c: x[few] for c, x in rows.items()}, num, den)


def tree_pairs(rows: DataFrame, num: int, den: int, block: int, every: bool) -> DataFrame:
    """rows: token, df, kid, comp, n, sig.  Pairs that may link, of different
    components, from groups by token; large groups as pairs of blocks.  Not
    `every`: of each group only what would join its components, the likeliest
    first."""
    parts = F.ceil(F.col("df") / F.lit(float(block))).cast("int")
    own = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("kid"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    spread = own.select("token", "kid", "comp", "n", "sig", "part", other)
    key = ["token", "first", "second"]
    keyed = spread.select("token", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"), "kid", "comp", "n", "sig", "part")
    dealt = keyed.repartition(*key).sortWithinPartitions(*key)

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """table: whole groups."""
        for pairs in in_pieces(search_groups(table, key, num, den), every):
            ends = np.unique(np.stack([np.minimum(pairs["a"], pairs["b"]), np.maximum(pairs["a"], pairs["b"])], axis=1), axis=0)
            ends = ends[ends[:, 0] != ends[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            # the last group may go on in the next batch
            last = [batch.column(c)[-1].as_py() for c in key]
            if all(batch.column(c)[0].as_py() == v for c, v in zip(key, last, strict=True)) and sum(b.num_rows for b in held) > batch.num_rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            open_ = np.logical_and.reduce([table[c].to_numpy() == v for c, v in zip(key, last, strict=True)])
            at = int(np.argmax(open_))
            if at >= 8_000 or (at and table.num_rows - at > LEAF):
                yield from found(table.slice(0, at))
                held = table.slice(at).combine_chunks().to_batches()
        if held:
            yield from found(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(run, "a long, b long")


def rooted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (kid, ...) with comp."""
    found = components(edges)
    return nodes.join(found, nodes["kid"] == found["node"], "left").select(*[nodes[c] for c in nodes.columns], F.coalesce("root", "kid").alias("comp"))


def link_components(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100, block: int = 4096) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id of each row of `docs`."""
    return component_rows(docs, width, num, den, block).drop("stays")


def component_rows(docs: DataFrame, width: int, num: int, den: int, block: int = 4096) -> DataFrame:
    """`link_components`, with stays, the `rank` of a component's first row
    (null for rows without words)."""
    small_batches(docs.sparkSession)
    rows = cut(prefixes(docs, width, num, den), "prefixes")
    own = rows.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("low_doc"), F.min(rank()).alias("low_row"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    nodes = cut(own.withColumn("kid", F.monotonically_increasing_id()), "nodes")

    # 1. shingles that two sets have in their prefixes
    tokens = nodes.select("kid", F.explode("prefix").alias("token"))
    twice = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = cut(tokens.join(twice, "token"), "shared")
    n = F.col("n")
    least = _ceil_share(n, num, den)
    asked = F.greatest(F.lit(1), F.floor(least / F.lit(20)).cast("int"))
    counted = shared.groupBy("kid").agg(F.count(F.lit(1)).alias("n_shared")).join(nodes.select("kid", "low_row", "k1", "k2", "n"), "kid").where(F.col("n_shared") >= asked)
    length = n - least + F.greatest(F.lit(1), F.floor(n / F.lit(20)).cast("int"))
    left = cut(counted.select("kid", "low_row", "k1", "k2", "n", (F.col("n_shared") / length).alias("central")), "left")
    if left.isEmpty():
        return result(rows, nodes.select("k1", "k2", F.col("low_doc").alias("component"), F.col("low_row").alias("stays")))
    sets = cut(whole_sets(docs, left.select("kid", "low_row", "k1", "k2"), width), "sets")
    # a pair shares l of these shingles, so each set may leave out its l - 1 most frequent ones and the pair's rarest stays
    often = Window.partitionBy("kid").orderBy(F.desc("df"), F.desc("token"))
    rare = shared.join(left.select("kid", "n", "central"), "kid").withColumn("place", F.row_number().over(often)).where(F.col("place") >= asked)
    groups = cut(rare.select("token", "kid", "n", "central"), "groups")

    # 2. stars: the most central set of a group against the others, for each set's three rarest groups
    middle = F.struct("central", "n", "kid")
    pivots = groups.groupBy("token").agg(F.max(middle).alias("best"), F.count(F.lit(1)).alias("df")).where("df > 1").select("token", "df", F.col("best.kid").alias("pivot"), F.col("best.n").alias("pivot_n"))
    near = groups.join(pivots, "token").where("kid <> pivot").where((n * den >= F.col("pivot_n") * num) & (F.col("pivot_n") * den >= n * num))
    few = near.groupBy("kid", "pivot").agg(F.count(F.lit(1)).alias("often")).groupBy("kid").agg(F.max(F.struct("often", "pivot")).alias("best"), F.min_by("pivot", F.struct("often", "pivot")).alias("other"))
    pairs = few.select(F.explode(F.array_distinct(F.array("best.pivot", "other"))).alias("b"), F.col("kid").alias("a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = cut(linked(pairs, sets, num, den), "star-edges")
    comps = cut(rooted(left.select("kid"), edges), "star-components")

    # 3. trees over the groups that hold several components: twice only what would join them, then all that is left
    for step in range(3):
        held = groups.join(comps, "kid")
        mixed = cut(held.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("kid").alias("a"), F.max("kid").alias("b"), F.count(F.lit(1)).alias("df")).where("low <> high"), "mixed")
        search = held.join(mixed.where("df > 2").select("token", "df"), "token").select("token", "df", "kid", "comp").join(sets.select("kid", "n", "sig"), "kid")
        more = tree_pairs(search, num, den, block, every=step == 2)
        if not step:  # a group of two is a pair as it stands
            more = more.unionByName(mixed.where("df = 2").select("a", "b"))
        # 4. by the whole sets
        new = cut(linked(cut(more.distinct(), "tree-pairs"), sets, num, den), "new-edges")
        if not new.isEmpty():
            edges = edges.unionByName(new)
            comps = cut(rooted(left.select("kid"), edges), "components")
    roots = nodes.select("kid", "k1", "k2", "low_doc", "low_row").join(comps, "kid", "left").select("k1", "k2", "low_doc", "low_row", F.coalesce("comp", "kid").alias("comp"))
    lows = roots.groupBy("comp").agg(F.min("low_doc").alias("component"), F.min("low_row").alias("stays"))
    return result(rows, roots.join(lows, "comp").select("k1", "k2", "component", "stays"))


def rank() -> Column:
    """Rows in the order in which they stay: by id, null last, then by text."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))


def _ceil_share(n: Column, num: int, den: int) -> Column:
    """ceil(n num / den) in whole numbers."""
    raised = n * F.lit(num) + F.lit(den - 1)
    return ((raised - raised % F.lit(den)) / F.lit(den)).cast("int")


def result(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Sets back to rows; a row without words is its own component."""
    found = rows.where("n > 0").join(keys, ["k1", "k2"], "left").select("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"), "stays")
    return found.unionByName(rows.where("n = 0").select("doc_id", "text_key", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast(found.schema["stays"].dataType).alias("stays")))


def drop_linked(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """`docs` with one row of each component: that with the smallest doc_id
    (null last), then the smallest text key; of rows equal in both one.  Rows
    without words all stay."""
    found = cut(component_rows(docs, width, num, den), "components").withColumn("is_first", rank().eqNullSafe(F.col("stays")))
    key = [F.col("doc_id").alias("_lx_id"), F.col("text_key").alias("_lx_key")]
    gone = found.where((F.col("n_shingles") > 0) & ~F.col("is_first")).select(*key).distinct()
    rows = docs.withColumn("_lx_text", F.xxhash64("text"))

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        small = right.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        side = F.broadcast(right) if small else right
        return left.join(side, left["doc_id"].cast("long").eqNullSafe(right["_lx_id"]) & left["_lx_text"].eqNullSafe(right["_lx_key"]), how)

    kept = joined(rows, gone, "left_anti")
    again = found.where("is_first").groupBy(*key).agg(F.count(F.lit(1)).alias("often")).where("often > 1").select("_lx_id", "_lx_key")
    if not again.isEmpty():
        kept = joined(kept, again, "left_anti").unionByName(joined(kept, again, "left_semi").dropDuplicates(["doc_id", "_lx_text"]))
    return kept.select(*docs.columns)
