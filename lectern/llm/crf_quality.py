"""Quality rules: a linear-chain conditional random field labels lines.

Each line of a document gets categorical features; Viterbi decoding finds the
best sequence of labels (0 boilerplate, 1 content), and the share of words on
content lines decides whether the document stays.  A few plain counts go with
it, and documents that fail them go whatever the field says.

The field is trained here, by gradient ascent on the regularised conditional
log-likelihood, on a bounded sample of documents whose quality is labelled:
lines of good documents count as content, lines of bad ones as boilerplate,
and after a first fit the lines of bad documents that look like content are
labelled anew.

Defined results: a null or empty text has no lines, no words and fails the
base rules.  Without labelled rows of both kinds, all lines are content.
Repeated rows and ids are judged row by row; extra columns pass through, and
an input column named like a result is replaced.  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import small_batches

SYMBOLS = "#*$%&|<>"
BREAKS = " \t\n\x0b\x0c\r"
#: Number of values of each categorical feature of a line.
FEATURES = {"words": 5, "symbols": 4, "upper": 3, "distinct": 4, "runs": 3, "bars": 3, "end": 3, "digits": 3, "shout": 3, "length": 4, "seen": 2, "place": 4}
WIDTH = sum(FEATURES.values())
STARTS = np.cumsum([0, *FEATURES.values()])[:-1].astype(np.int64)

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("n_lines", T.LongType()),
    T.StructField("n_content_lines", T.LongType()),
    T.StructField("content_share", T.DoubleType()),
    T.StructField("kept", T.BooleanType()),
])


@dataclass(frozen=True)
class LineField:
    """Weights of the field: emission[feature value, label], step[label, next
    label], start[label]."""

    emission: np.ndarray
    step: np.ndarray
    start: np.ndarray

    @staticmethod
    def neutral() -> LineField:
        emission = np.zeros((WIDTH, 2))
        return LineField(emission, np.zeros((2, 2)), np.array([0.0, 1.0]))


def grade(value: float, *bounds: float) -> int:
    return sum(value >= b for b in bounds)


def line_features(lines: list[str]) -> np.ndarray:
    """One row for each line: the index of the value of each feature."""
    seen: set[str] = set()
    rows = np.empty((len(lines), len(FEATURES)), dtype=np.int64)
    last = len(lines) - 1
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        size = max(1, len(line))
        distinct = len(set(words)) / n if n else 1.0
        runs = sum(map(str.__eq__, words, words[1:])) / n if n > 1 else 0.0
        symbols = sum(map(line.count, SYMBOLS)) / size
        upper = 2 if line.isupper() else 1 if n and sum(map(str.isupper, words)) > 0.3 * n else 0
        tail = line.rstrip(BREAKS)[-1:]
        rows[i] = (
            grade(n, 1, 4, 12, 40),
            grade(symbols, 1e-9, 0.03, 0.1),
            upper,
            grade(distinct, 0.2, 0.4, 0.7),
            grade(runs, 0.05, 0.3),
            grade(line.count("|") / max(1, n), 0.02, 0.2),
            2 if tail in (".", "?", "!", "…") else 1 if tail.isalnum() else 0,
            grade(sum(map(line.count, "0123456789")) / size, 1e-9, 0.1),
            grade(line.count("!") / max(1, n), 0.05, 0.4),
            grade((size - n) / max(1, n), 2.5, 4.5, 9),
            line in seen,
            3 if not last else 0 if not i else 2 if i == last else 1,
        )
        seen.add(line)
    return rows + STARTS


def emissions(field: LineField, rows: np.ndarray) -> np.ndarray:
    return field.emission[rows].sum(axis=1)


def viterbi(field: LineField, scores: np.ndarray) -> np.ndarray:
    """Best labels for one document's lines; on a tie, content."""
    if not len(scores):
        return np.zeros(0, dtype=np.int8)
    (t00, t01), (t10, t11) = field.step.tolist()
    a, b = field.start[0] + scores[0, 0], field.start[1] + scores[0, 1]
    back = []
    for x, y in scores[1:].tolist():
        from0, from1 = b + t10 >= a + t00, b + t11 >= a + t01
        a, b = (b + t10 if from0 else a + t00) + x, (b + t11 if from1 else a + t01) + y
        back.append((from0, from1))
    labels = np.empty(len(scores), dtype=np.int8)
    labels[-1] = now = int(b >= a)
    for i in range(len(back) - 1, -1, -1):
        labels[i] = now = int(back[i][now])
    return labels


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows that occur at least twice, exactly."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    put = ids.setdefault
    seq = np.array([put(w, len(ids)) for w in words], dtype=np.uint64)
    if len(ids) == len(words):
        return 0
    # 64-bit sums first: if all windows differ there, they differ
    mixed = (seq + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    sums = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        sums = sums * np.uint64(0x100000001B3) + mixed[j : j + n]
    sums.sort()
    if not (sums[1:] == sums[:-1]).any():
        return 0
    # exact ranks of windows of 2, 4, 8 words
    ranks, span = seq.astype(np.int64), 1
    while span < width:
        base = int(ranks.max()) + 1
        _, ranks = np.unique(ranks[: len(ranks) - span] * base + ranks[span:], return_inverse=True)
        span *= 2
    twice = np.bincount(ranks)[ranks] >= 2
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    cover[:n] += twice
    cover[width : width + n] -= twice
    return int((np.cumsum(cover) > 0).sum())


def judge(text: str | None, field: LineField, least_share: float) -> tuple:
    if not text:
        return 0, 0, 0, 0, 0, True, 0, 0, 0.0, False
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    lines = text.split("\n")
    filled = [x for x in lines if x.strip(BREAKS)]
    repeat = repeated_words(words)
    failed = n < 20 or 100 * repeat > 30 * n
    labels = viterbi(field, emissions(field, line_features(filled)))
    sizes = np.fromiter((len(x.encode("utf-8", "surrogatepass").split()) for x in filled), dtype=np.int64, count=len(filled))
    share = float(sizes[labels == 1].sum() / n) if n else 0.0
    return (n, len(text) - sum(map(text.count, BREAKS)), sum(map(text.count, SYMBOLS)), len(filled) - len(set(filled)), repeat, failed, len(filled), int(labels.sum()), share, not failed and share >= least_share)


def fit(documents: list[tuple[np.ndarray, int]], rounds: int = 60, l2: float = 1e-3) -> LineField:
    """documents: feature rows and quality of each.  Full-batch ascent with
    momentum on the mean log-likelihood of the lines; documents of like length
    are stepped through together."""
    documents = [d for d in documents if len(d[0])]
    if len({q for _, q in documents}) < 2:
        return LineField.neutral()
    gold = [np.full(len(rows), q, dtype=np.int64) for rows, q in documents]
    field = ascend(documents, gold, rounds, l2, LineField.neutral())
    for i, (rows, q) in enumerate(documents):
        if not q:
            best = viterbi(field, emissions(field, rows)).astype(np.int64)
            gold[i] = best if not best.all() else gold[i]
    return ascend(documents, gold, rounds, l2, field)


def ascend(documents: list, gold: list, rounds: int, l2: float, field: LineField) -> LineField:
    order = sorted(range(len(documents)), key=lambda i: len(documents[i][0]))
    batches = []
    for at in range(0, len(order), 256):
        own = order[at : at + 256]
        long = len(documents[own[-1]][0])
        rows = np.zeros((len(own), long, len(FEATURES)), dtype=np.int64)
        labels = np.zeros((len(own), long), dtype=np.int64)
        mask = np.zeros((len(own), long), dtype=bool)
        for k, i in enumerate(own):
            n = len(gold[i])
            rows[k, :n], labels[k, :n], mask[k, :n] = documents[i][0], gold[i], True
        batches.append((rows, labels, mask))
    total = sum(int(m.sum()) for _, _, m in batches)
    w = [field.emission.copy(), field.step.copy(), field.start.copy()]
    speed = [np.zeros_like(x) for x in w]
    for _ in range(rounds):
        slope = [-l2 * x for x in w]
        for rows, labels, mask in batches:
            for g, x in zip(slope, gradient(w, rows, labels, mask), strict=True):
                g += x / total
        for x, v, g in zip(w, speed, slope, strict=True):
            v *= 0.8
            v += g
            x += 1.5 * v
    return LineField(*w)


def gradient(w: list[np.ndarray], rows: np.ndarray, labels: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
    """Observed less expected counts, by the forward-backward recursions."""
    emission, step, start = w
    n, long = labels.shape
    score = emission[rows].sum(axis=2)
    alpha = np.empty((n, long, 2))
    alpha[:, 0] = start + score[:, 0]
    for t in range(1, long):
        now = np.logaddexp(alpha[:, t - 1, :1] + step[0], alpha[:, t - 1, 1:] + step[1]) + score[:, t]
        alpha[:, t] = np.where(mask[:, t, None], now, alpha[:, t - 1])
    logz = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    beta = np.zeros((n, long, 2))
    pair = np.zeros((2, 2))
    for t in range(long - 2, -1, -1):
        ahead = score[:, t + 1] + beta[:, t + 1]
        on = mask[:, t + 1]
        beta[:, t] = np.where(on[:, None], np.logaddexp(step[:, 0] + ahead[:, :1], step[:, 1] + ahead[:, 1:]), 0.0)
        joint = np.exp(alpha[:, t, :, None] + step + ahead[:, None, :] - logz[:, None, None])
        pair += joint[on].sum(axis=0)
    share = np.exp(alpha + beta - logz[:, None, None]) * mask[:, :, None]
    seen = np.eye(2)[labels] * mask[:, :, None]
    rest = (seen - share)[mask]
    out = np.zeros_like(emission)
    np.add.at(out, rows[mask].ravel(), np.repeat(rest, len(FEATURES), axis=0))
    both = mask[:, 1:]
    seen_pair = np.zeros((2, 2))
    np.add.at(seen_pair, (labels[:, :-1][both], labels[:, 1:][both]), 1.0)
    return [out, seen_pair - pair, (seen[:, 0] - share[:, 0]).sum(axis=0)]


def train_line_field(docs: DataFrame, labels: DataFrame, per_class: int = 600, max_lines: int = 60_000) -> LineField:
    """Fit on at most `per_class` labelled documents of each quality, those
    first by a hash of the id, and on at most `max_lines` of their lines."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = None
    for q in (0, 1):
        own = known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = own if picked is None else picked.unionByName(own)
    ids = {r.doc_id: r.quality for r in picked.collect()}
    if not ids:
        return LineField.neutral()
    sample = docs.where(F.col("doc_id").isin(list(ids))).select("doc_id", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_features([x for x in (t or "").split("\n") if x.strip(BREAKS)]) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([x.astype(np.int16).tobytes() for x in found], pa.binary())], ["doc_id", "rows"])

    found = sample.mapInArrow(rows, "doc_id long, rows binary").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    kept, lines = [], 0
    for r in found:
        own = np.frombuffer(bytes(r.rows), dtype=np.int16).reshape(-1, len(FEATURES)).astype(np.int64)
        if lines + len(own) <= max_lines:
            kept.append((own, ids[r.doc_id]))
            lines += len(own)
    return fit(kept)


def score_documents(docs: DataFrame, field: LineField, least_share: float = 0.5) -> DataFrame:
    """`docs` with the columns of RESULT after its own."""
    names = {f.name.lower() for f in RESULT}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in names])
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, *RESULT.fields])
    types = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                found = [judge(t, field, least_share) for t in part.column(at).to_pylist()]
                made = [pa.array([x[k] for x in found], kind) for k, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *(f.name for f in RESULT)])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def parts(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def filter_documents(docs: DataFrame, field: LineField, least_share: float = 0.5) -> DataFrame:
    """The rows of `docs` that stay, with all their own columns and no other."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                yield part.filter(pa.array([judge(t, field, least_share)[-1] for t in part.column(at).to_pylist()], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
