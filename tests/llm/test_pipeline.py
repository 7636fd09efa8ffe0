"""The pipeline against its stages done the plain way."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lectern.llm.common import cut

from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), "test-stage")
        out.append(docs)
    return [d.collect() for d in out]


def test_columns(spark, kept):
    for rows in kept[:-1]:
        assert rows[0].__fields__ == kept[0][0].__fields__


def test_quality(kept):
    left = {r.doc_id for r in kept[1]}
    failed = {r.doc_id for r in kept[0] if brute.base_rules(r.text)[-1]}
    assert failed and not failed & left
    assert len(left) > 0.7 * (len(kept[0]) - len(failed))


def test_near_duplicates(kept):
    found = brute.jaccard_components([(r.doc_id, r.text) for r in kept[1]], 5, 80)
    assert sorted(r.doc_id for r in kept[2]) == sorted(d for d, _, c in found if d == c)


def test_decontamination(spark, kept):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute.contamination([(r.doc_id, r.text) for r in kept[2]], items) if r[-1]}
    assert sorted(r.doc_id for r in kept[3]) == sorted(r.doc_id for r in kept[2] if r.doc_id not in bad)


def test_mixture(kept):
    size = {r.doc_id: len(brute.words(r.text)) for r in kept[3]}
    times = {}
    for r in kept[4]:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert set(times) <= set(size) and max(times.values()) <= 2
    total, taken = sum(size.values()), sum(size[d] * n for d, n in times.items())
    assert abs(taken - 1.5 * total) < 0.1 * total


def test_sharding(kept):
    assert sorted((r.doc_id, r.text) for r in kept[5]) == sorted((r.doc_id, r.text) for r in kept[4])
    by = {}
    for r in kept[5]:
        by.setdefault(r.shard, []).append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    sizes = [r.size for r in kept[5]]
    assert max(abs(sum(r.size for r in own) - sum(sizes) / 40) for own in by.values()) <= 2 * max(sizes)


def test_run(spark, kept):
    assert sorted((r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r.shard, r.slot) for r in kept[5])


CLEAN = "\n".join("when the %s went to the market of %s they found that there was some bread and a little fish on the old table near the door" % (a, b) for a, b in zip("abcdefgh", "stuvwxyz", strict=True))
#: Nulls in any column, empty and wordless texts, a very long text, rows that are repeated, ids that are null or repeated.
ODD = [
    (None, None, None),
    (None, "", "web"),
    (1, None, "web"),
    (2, " \n\t", None),
    (3, "one two", "web"),
    (3, "one two", "web"),
    (None, CLEAN, None),
    (None, CLEAN, None),
    (4, CLEAN + " at last", "web"),
    (4, " ".join(f"{a}{b}" for a in "bcdfghjk" for b in "aeiou") + ".\n" + CLEAN.replace("market", "harbour"), "news"),
    (5, "\n".join(f"line {i} of a very long text says that the number {i * i} is the square of {i}" for i in range(8_000)), "web"),
]
#: Names that stages or operators give to results of their own, in another case too.
CLASHING = {"size": "a", "shard": 7, "Slot": "b", "kept": "c", "n_words": "d", "text_key": "e", "component_id": "f", "taken": "g", "contaminated": "h", "target": "i", "passes": "j", "rest": "k", "source_size": "l"}


def odd(spark, rows, extra):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = spark.createDataFrame(rows, "doc_id long, text string, source string").select(*[F.col(f.name).cast(f.dataType) if f.name in ("doc_id", "text", "source") else F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema])
    return cut(own.withColumns({c: F.lit(v) for c, v in CLASHING.items()}) if extra else own, "odd")


@pytest.mark.parametrize("extra", [False, True])
def test_odd_rows(spark, extra):
    docs = odd(spark, ODD, extra)
    of = lambda df: Counter((r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect())
    given, left = of(docs), {}
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, SF), "odd-stage")
        left[name] = of(out)
        if name != "sharding":
            assert out.columns == docs.columns
        assert all(r in given for r in left[name])
    short = {r for r in given if len(brute.words(r[1] or "")) < 20}
    assert not short & set(left["quality rules"])
    # one row of the rows of CLEAN and its near copy; rows without words link with nothing, rows equal in id and text are one
    once = Counter(given.keys())
    near = [r for r in given if (r[1] or "").startswith(CLEAN)]
    kept = left["near duplicates"]
    assert sum(kept[r] for r in near) == 1
    assert {r for r in once if r not in near and r[1] and r[1].strip()} == {r for r in kept if r not in near and r[1] and r[1].strip()}
    assert left["decontamination"] == given
    assert all(n <= 2 * given[r] for r, n in left["mixture"].items())
    assert left["sharding"] == given


def test_no_rows(spark):
    docs = odd(spark, [], False)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
