"""Stems, and searches over stored postings against a plain version."""

import random

import pytest
from lectern import service
from lectern.functions.stemming import stem
from lectern.operators import fulltext, retrieval
from lectern.sources import segments
from pyspark.sql import functions as F

STEMS = {
    "running": "run", "hopping": "hop", "hoping": "hope", "consistency": "consist", "consolation": "consol", "knightly": "knight", "generously": "generous", "happy": "happi", "skies": "sky", "ties": "tie",
    "cries": "cri", "relational": "relat", "national": "nation", "university": "univers", "communication": "communic", "gas": "gas", "gaps": "gap", "this": "this", "kiwis": "kiwi", "luxuriated": "luxuri", "agreed": "agre",
    "feed": "feed", "say": "say", "by": "by", "inning": "inning", "exceedingly": "exceed", "falling": "fall", "controlled": "control", "energy": "energi", "usage": "usag", "adoption": "adopt", "kwh2": "kwh2", "été": "été",
}


@pytest.mark.parametrize("word", sorted(STEMS))
def test_stem(word):
    assert stem(word) == STEMS[word]


def plain_search(docs, query, k):
    wanted = sorted(fulltext.stems_of(query))
    every, some = [], []
    for key, text in docs:
        found = fulltext.stems_of(text or "")
        places = sorted((p, w) for w in wanted for p in found.get(w, []))
        if places:
            some.append((-round(0.1 * len(places), 6), key))
        rank, hit = 0.0, False
        for i, (start, w) in enumerate(places):
            ends = [j for j in range(i, len(places)) if {x for _, x in places[i : j + 1]} == set(wanted)]
            # shortest: without its first word something is missing
            if ends and w not in {x for _, x in places[i + 1 : ends[0] + 1]}:
                hit, rank = True, rank + 0.1 / (1 + places[ends[0]][0] - start - (ends[0] - i))
        if hit:
            every.append((-round(rank, 6), key))
    return [(key, -r) for r, key in sorted(every or some)[:k]]


def test_stored_search(spark, tmp_path):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("cats running the dog of house energies saved".split()) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "the of"), (103, "zebra"), (104, "dog " * 40)]
    rows = spark.createDataFrame(docs, "chunk_id long, text string")
    fulltext.write_index(rows, f"{tmp_path}/index")
    index = fulltext.read_index(spark, f"{tmp_path}/index")
    for query in ("cat runs", "energy saving houses", "zebra dog", "the of"):
        found = [(r.chunk_id, r["rank"]) for r in service.search_index(index, query, 10).collect()]
        wanted = plain_search(docs, query, 10)
        assert [k for k, _ in found] == [k for k, _ in wanted] and [r for _, r in found] == pytest.approx([r for _, r in wanted], abs=2e-6), query
    plan = index.where("bucket = 3 and stem = 'dog'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(stem,dog)" in plan


def test_index_follows_changes(spark, tmp_path):
    """After each change searches find what a new index would, ranks included."""
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice("cats running the dog of house energies saved".split()) for _ in range(rng.randint(0, 25)))
    now = {i: text() for i in range(40)}
    frame = lambda rows: spark.createDataFrame([(*r, "x") for r in rows], "chunk_id long, text string, stem string")
    index = fulltext.TextIndex.create(frame(now.items()), f"{tmp_path}/index")

    def agree():
        for query in ("cat runs", "energy saving houses", "zebra dog", "the of"):
            found = [(r.chunk_id, r["rank"]) for r in service.search_index(index, query, 60).collect()]
            wanted = plain_search(list(now.items()), query, 60)
            assert [k for k, _ in found] == [k for k, _ in wanted] and [r for _, r in found] == pytest.approx([r for _, r in wanted], abs=2e-6), query

    def upsert(rows):
        index.upsert(frame(rows.items()))
        now.update(rows)

    def delete(keys):
        index.delete(frame([(k, None) for k in keys]))
        for k in keys:
            now.pop(k, None)

    upsert({i: text() for i in range(30, 50)})
    delete([1, 2, 35, 999])
    agree()
    upsert({1: "zebra dog", 3: None, 4: ""} | {i: text() for i in range(20)})
    index.merge(last=2)
    agree()
    assert len(segments.names(spark, index.path)[1]) == 3
    index.tidy()
    assert len(segments.names(spark, index.path)[1]) < 3
    index.merge()
    segments.vacuum(spark, index.path)
    agree()
    again = fulltext.TextIndex(spark, index.path)
    assert {r.stem for r in again.postings().select("stem").distinct().collect()} == set().union(*(fulltext.stems_of(t or "") for t in now.values()))
    plan = again.postings().where("bucket = 3 and stem = 'dog'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(stem,dog)" in plan


def test_empty_index(spark):
    none = fulltext.postings(spark.createDataFrame([], "chunk_id long, text string"))
    assert fulltext.search(none, "dog", 5).count() == 0


def test_scores_near_zero_are_not_shown(spark):
    docs = spark.createDataFrame([(1, "cat " + "dog " * 2000), (2, "cat"), (3, None)], "doc_id long, text string")
    find = lambda least: [r.doc_id for r in retrieval.tfidf_search(docs, "cat", 5, least=least).collect()]
    assert find(0.01) == [2] and find(0.0) == [2, 1]


def test_hybrid_over_an_index(spark):
    docs = spark.createDataFrame([(1, "cats run"), (2, "a cat and a house"), (3, "none"), (4, "cat")], "doc_id long, text string")
    vectors = spark.createDataFrame([(2, [1.0, 0.0]), (3, [0.8, 0.6])], "vec_id long, embedding array<float>")
    index = fulltext.postings(docs, "doc_id")
    found = lambda only: [(r.doc_id, r.source, r.score) for r in service.hybrid(docs, vectors, "the cats", vectors.where("vec_id = 2"), 4, only, index=index).orderBy("doc_id").collect()]
    assert found(None) == [(1, "fts", 0.04), (2, "fts", 0.64), (3, "vector", 0.48), (4, "fts", 0.04)]
    assert found(F.col("doc_id") > 1) == [(2, "fts", 0.64), (3, "vector", 0.48), (4, "fts", 0.04)]
