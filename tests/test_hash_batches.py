"""Hashed embeddings: one row a text is shuffled, keys in several batches add up."""

import numpy as np
from lectern.operators import embedding, retrieval


def test_words_are_counted_where_they_lie(spark):
    long = " ".join(f"w{i % 700}" for i in range(2 * retrieval.SLICE + 5))
    texts = [("a", "the house and its energy"), ("b", long), ("c", ""), ("d", None), ("e", "?!"), (None, "no key"), ("f", "one"), ("f", "two two"), ("f", "three"), (None, "again")]
    df = spark.createDataFrame(texts, "doc_id string, text string").repartition(5)
    vectors = retrieval.hash_embeddings(df, 48)
    found = {r.doc_id: list(r.embedding) for r in vectors.collect()}
    wanted = {"a": "the house and its energy", "b": long, "f": "one two two three", None: "no key again"}
    given = embedding.HashProvider(dim=48).load()(list(wanted.values()))
    assert set(found) == set(wanted) and all(np.allclose(found[k], v, atol=1e-6) for k, v in zip(wanted, given, strict=True))
    plan = retrieval.hash_embeddings(df, 48)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert retrieval.hash_embeddings(df.limit(0), 48).count() == 0
