"""Pages as keyed state: finished documents, restarts, changes, bounded batches."""

import random
from datetime import datetime, timedelta

import pytest
from lectern.operators import chunking
from lectern.streaming import documents

START = datetime(2024, 1, 1)


def words(rng, n=60):
    return " ".join(f"Sentence {rng.randrange(1000)} about the house and its energy use." for _ in range(n // 8))


@pytest.fixture
def stream(spark, tmp_path):
    """Runs rows (doc_id, page, text, minute) through the stream; each call starts it again."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def run(rows):
        frame = spark.createDataFrame([(d, p, t, m if m is None else START + timedelta(minutes=m)) for d, p, t, m in rows], documents.PAGES)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
        query = documents.ingest(spark, str(tmp_path / "pages"), str(tmp_path / "out"), str(tmp_path / "check"), retain=timedelta(hours=100))
        assert query.awaitTermination(120)
        state = [s for p in query.recentProgress for s in p["stateOperators"]]
        return sum(s["numRowsUpdated"] for s in state)

    yield run
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def found(spark, tmp_path):
    return sorted(tuple(r[c] for c in ("document_id", "chunk_index", "page_num", "start_char", "text")) for r in documents.current(spark, str(tmp_path / "out")).collect())


def wanted(spark, pages):
    """pages: {(doc_id, page): text}."""
    rows = spark.createDataFrame([(d, p, t) for (d, p), t in pages.items()], "doc_id long, page int, text string")
    return sorted(tuple(r[c] for c in ("document_id", "chunk_index", "page_num", "start_char", "text")) for r in chunking.chunks(rows, "doc_id", "page").collect())


def test_documents_go_out_when_they_are_finished(spark, tmp_path, stream):
    rng = random.Random(2)
    pages = {(d, p): words(rng) for d in range(6) for p in range(1, 4)}
    order = list(pages)
    rng.shuffle(order)
    half = {k for k in order if k[1] != 2}
    # all but one page of each, in any order; one page twice, its later text counts
    stream([(d, p, pages[d, p], rng.randrange(5)) for d, p in order if (d, p) in half] + [(0, 1, "old text", 0), (0, 1, pages[0, 1], 6), (None, 1, "x", 1), (3, None, "x", 1)])
    assert not found(spark, tmp_path)
    # the rest comes after a restart; then a page long after them lets the watermark pass
    stream([(d, 2, pages[d, 2], 8) for d in range(6)])
    assert not found(spark, tmp_path)
    stream([(50, 1, words(rng), 100)])
    assert found(spark, tmp_path) == wanted(spark, pages)
    # a change: the whole document again; what is behind the watermark is dropped
    pages[2, 2] = words(rng)
    late = stream([(2, 2, pages[2, 2], 105), (4, 1, "too late", 3), (51, 1, None, 200)])
    assert [r for r in found(spark, tmp_path) if r[0] < 50] == wanted(spark, pages)
    assert late


def test_a_batch_costs_what_it_brings(spark, tmp_path, stream):
    """State rows that a batch writes follow its own pages, not what came before."""
    rng = random.Random(3)
    big = stream([(d, p, words(rng), d) for d in range(60) for p in range(4)])
    small = stream([(1000, 1, words(rng), 61)])
    again = stream([(1001, 1, words(rng), 62)])
    assert big > 200 and small < 20 and again <= small + 4
