"""Language ID: word-first backoff.

A known word adds its smoothed log frequency in each language.  An unknown
word is scored by its longest known character n-grams: the word (with marks
at both ends) is covered from left to right, at each place by the longest
n-gram that the model has, down to single letters; a letter that no language
has adds nothing.

The classifier is fitted on a bounded sample of labelled rows: for each
language about `per_language` documents, chosen by a hash of the id, of at most
an eighth of `max_chars` characters each and `max_chars` together.  Its tables hold the `max_words` most frequent words and, for each length, the
`max_grams` most frequent n-grams, so the model that goes to the executors
has a bound set by its parameters.

Defined results: text that is null or has no letter is `und` with score 0,
and so is all text if nothing was learned.  Ties go to the language that
sorts first.  Every row is judged by its text alone; extra columns are
ignored and an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import small_batches

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
CACHE = 200_000


def parts(word: str) -> list[str]:
    """What a match of LETTERS has of letters: Python counts some signs that
    are numbers, as ½ and ², among them."""
    return [word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split()


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    words: dict[str, np.ndarray]
    grams: tuple[dict[str, np.ndarray], ...]  # by length, from 1
    nothing = np.zeros(0)  # the score of a match without letters

    def word_score(self, word: str) -> np.ndarray:
        """Natural log of the word's probability in each language."""
        found = self.words.get(word)
        if found is not None:
            return found
        total = np.zeros(len(self.languages))
        marked, at = f"^{word}$", 0
        while at < len(marked):
            for n in range(min(len(self.grams), len(marked) - at), 0, -1):
                found = self.grams[n - 1].get(marked[at : at + n])
                if found is not None:
                    total += found
                    at += n
                    break
            else:
                at += 1
        return total

    def predict(self, text: str | None, cache: dict[str, np.ndarray]) -> tuple[str, float]:
        words = Counter(LETTERS.findall(text.lower())) if text else None
        if not words or not self.languages:
            return UNKNOWN, 0.0
        total, letters = np.zeros(len(self.languages)), False
        for word, n in words.items():
            found = cache.get(word)
            if found is None:
                if len(cache) >= CACHE:
                    cache.clear()
                own = parts(word)
                found = cache[word] = sum((self.word_score(w) for w in own), np.zeros(len(self.languages))) if own else self.nothing
            if found is not self.nothing:
                letters = True
                total += n * found
        if not letters:
            return UNKNOWN, 0.0
        best = int(total.argmax())
        return self.languages[best], float(1.0 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def logs(counts: dict[str, Counter], languages: tuple[str, ...], most: int) -> dict[str, np.ndarray]:
    """Add-half smoothed log frequencies of the most frequent keys."""
    every: Counter = Counter()
    for c in counts.values():
        every.update(c)
    keys = [k for k, _ in sorted(every.items(), key=lambda x: (-x[1], x[0]))[:most]]
    totals = [sum(counts[g].values()) + 0.5 * (len(keys) + 1) for g in languages]
    return {k: np.array([math.log((counts[g][k] + 0.5) / n) for g, n in zip(languages, totals, strict=True)]) for k in keys}


def fit(rows: list[tuple[str, str]], max_words: int, max_grams: int, longest: int) -> LanguageModel:
    """rows: (language, text)."""
    languages = tuple(sorted({g for g, _ in rows}))
    words = {g: Counter() for g in languages}
    for g, text in rows:
        words[g].update(w for x in LETTERS.findall(text.lower()) for w in parts(x))
    grams = []
    for n in range(1, longest + 1):
        counts = {g: Counter() for g in languages}
        for g in languages:
            for word, k in words[g].items():
                marked = f"^{word}$"
                for i in range(len(marked) - n + 1):
                    counts[g][marked[i : i + n]] += k
        grams.append(logs(counts, languages, max_grams))
    return LanguageModel(languages, logs(words, languages, max_words), tuple(grams))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train_language_model(docs: DataFrame, per_language: int = 400, max_chars: int = 8_000_000, max_words: int = 30_000, max_grams: int = 20_000, longest: int = 4) -> LanguageModel:
    """Learn from `docs` (text, lang); rows without either are left out.  The
    sample has about `per_language` documents of each language and at most
    `max_chars` characters in whole texts."""
    own = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r[0]: r[1] for r in own.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel((), {}, ())
    toss = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
    share = None
    for lang, n in counts.items():
        bound = F.lit(min(1 << 30, (per_language << 30) // n + 1))
        share = F.when(F.col("lang") == lang, bound) if share is None else share.when(F.col("lang") == lang, bound)
    size = F.length("text")
    sample = own.where(toss < share).select("lang", "text", toss.alias("toss"), size.alias("chars")).where(size <= max_chars // 8)
    rows, chars, by = [], 0, Counter()
    for r in sample.orderBy("toss", "text").limit(2 * per_language * len(counts)).toLocalIterator():
        if by[r.lang] + r.chars <= max_chars // len(counts):
            rows.append((r.lang, r.text))
            by[r.lang] += r.chars
    return fit(rows, max_words, max_grams, longest)


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of `docs` with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(*keep, F.col("text").alias("_lx_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, np.ndarray] = {}
        own = shared.value
        for batch in batches:
            found = [own.predict(t.as_py(), cache) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = given.drop("_lx_text").schema.add("lang_pred", "string").add("score", "double")
    small_batches(docs.sparkSession)
    return given.mapInArrow(run, schema)
