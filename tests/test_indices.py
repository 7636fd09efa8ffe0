"""Stored indices that follow changes, against scans and rebuilt ones."""

import os
import shutil

import numpy as np
import pytest
from lectern.operators import vector_index
from lectern.operators.vector_index import VectorIndex
from lectern.sources import segments, versions
from pyspark.sql import functions as F

VECTORS = "/root/testdata/sf0.1/embeddings.parquet"


def scan(rows, queries, k):
    """rows, queries: {key: vector}."""
    out = {}
    for q, v in queries.items():
        near = sorted((-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 6), i) for i, w in rows.items() if np.any(w))
        out[q] = [(i, -c) for c, i in near[:k]]
    return out


def found_by(df):
    out = {}
    for r in df.orderBy("query", "place").collect():
        out.setdefault(r.query, []).append((r.vec_id, r.cosine))
    return out


def close(a, b):
    assert set(a) == set(b)
    for q in b:
        assert [c for _, c in a[q]] == pytest.approx([c for _, c in b[q]], abs=2e-6)
        assert {i for i, c in a[q] if c > a[q][-1][1] + 2e-6} <= {i for i, _ in b[q]}
    return True


@pytest.fixture(scope="module")
def clustered(spark):
    """Vectors in 40 groups: what an index of lists is for."""
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(40, 16))
    rows = [(i, [float(np.float32(x)) for x in middles[i % 40] + 0.35 * rng.normal(size=16)]) for i in range(4000)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), {i: np.array(v) for i, v in rows}


def test_lists_are_read_for_their_queries_only(spark, tmp_path, clustered):
    vectors, rows = clustered
    index = VectorIndex.create(vectors, f"{tmp_path}/v", lists=40, sample=1000)
    queries = vectors.where("vec_id < 40")
    exact = index.search_exact(queries, 10, probes=2)
    assert close(found_by(exact), scan(rows, {i: rows[i] for i in range(40)}, 10))
    assert vector_index.recall(index.search(queries, 10, probes=4), exact) >= 0.9
    # a query of two lists goes as well when the files of all other lists are gone
    one = lambda: found_by(index.search(vectors.where("vec_id = 7"), 10, probes=2))
    before = one()
    asked = {r.list for r in index._lists(index._queries(vectors.where("vec_id = 7"), "embedding"), 2).collect()}
    (folder,) = os.listdir(f"{tmp_path}/v/rows")
    others = [x for x in os.listdir(f"{tmp_path}/v/rows/{folder}") if x.startswith("list=") and int(x[5:]) not in asked]
    for x in others:
        shutil.rmtree(f"{tmp_path}/v/rows/{folder}/{x}")
    assert len(others) > 30 and one() == before


def test_table_of_random_vectors(spark, tmp_path):
    """Without groups more lists must be read; bounds keep the exact search right."""
    vectors = spark.read.parquet(VECTORS)
    index = VectorIndex.create(vectors, f"{tmp_path}/v", lists=20)
    queries = vectors.where("vec_id % 100 = 0")
    rows = {r.vec_id: np.array(r.embedding, dtype=float) for r in vectors.collect()}
    exact = index.search_exact(queries, 10, probes=3)
    assert close(found_by(exact), scan(rows, {i: v for i, v in rows.items() if i % 100 == 0}, 10))
    assert vector_index.recall(index.search(queries, 10, probes=14), exact) >= 0.9


def test_index_follows_changes(spark, tmp_path, clustered):
    vectors, rows = clustered
    index = VectorIndex.create(vectors.where("vec_id < 3000"), f"{tmp_path}/v", lists=10)
    moved = vectors.where("vec_id BETWEEN 2500 AND 3499").withColumn("embedding", F.transform("embedding", lambda x: -x)).withColumn("extra", F.lit(1))
    index.upsert(moved)
    index.delete(vectors.where("vec_id < 300 OR vec_id = 2600"))
    odd = spark.createDataFrame([(9000, None), (None, [1.0] * 16), (9001, [0.0] * 16), (9002, [1.0] * 16), (9002, [1.0] * 16)], "vec_id long, embedding array<float>")
    index.upsert(odd)
    now = {i: (-v if i >= 2500 else v) for i, v in rows.items() if 300 <= i < 3500 and i != 2600} | {9002: np.ones(16)}
    queries = vectors.where("vec_id IN (0, 350, 2600, 3400)")
    wanted = scan(now, {i: rows[i] for i in (0, 350, 2600, 3400)}, 5)
    assert close(found_by(index.search_exact(queries, 5)), wanted)
    assert index.rows().count() == len(now)
    index.merge(last=3)
    assert len(segments.names(spark, index.path)[1]) == 2 and close(found_by(index.search_exact(queries, 5)), wanted)
    index.merge()
    assert [s["gone"] for s in segments.names(spark, index.path)[1]] == [0]
    assert segments.vacuum(spark, index.path) > 0
    again = VectorIndex(spark, index.path)
    assert close(found_by(again.search_exact(queries, 5)), wanted) and again.rows().count() == len(now)
    again.delete(vectors.unionByName(odd))
    again.merge()
    assert again.rows().count() == 0 and again.search(queries, 5).count() == 0 and again.search_exact(queries, 5).count() == 0


def test_versions(spark, tmp_path):
    root = f"{tmp_path}/x"
    assert versions.latest(spark, root) == (0, {})
    assert versions.publish(spark, root, {"a": 1}, 0) == 1
    with pytest.raises(versions.Conflict):
        versions.publish(spark, root, {"a": 2}, 0)
    assert versions.latest(spark, root) == (1, {"a": 1})
    with open(f"{root}/_versions/000000000002.json", "w") as f:
        f.write('{"a": ')  # still being written
    os.remove(f"{root}/_versions/.000000000001.json.crc")
    assert versions.latest(spark, root) == (1, {"a": 1})
