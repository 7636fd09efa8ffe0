"""Fallback, reading order, ruled tables, components and suppression against plain versions."""

import random

import pytest
from lectern.operators import cascade, graph, reading, regions, rulings, tree
from pyspark.sql import functions as F

GOOD = "This is a sentence that reads well. " * 5
BAD = "col " * 40 + "Col1 NULL"


def test_later_methods_see_what_is_left(spark):
    docs = spark.createDataFrame([(i, i % 4, "x") for i in range(20)] + [(None, 0, "x")], "doc_id long, kind int, text string")
    seen = {}

    def method(name, text, confidence=None):
        def run(due):
            seen[name] = sorted(r.doc_id for r in due.select("doc_id").collect())
            return due.select("doc_id", F.expr(text).alias("text"), *([F.expr(confidence).alias("confidence")] if confidence else []))

        return cascade.Method(name, run)

    methods = [method("a", f"CASE WHEN kind = 0 THEN '{GOOD}' ELSE '{BAD}' END"), method("b", f"CASE WHEN kind = 1 THEN '{GOOD}' END"), method("c", "concat('text ', kind)", "CASE WHEN kind = 2 THEN 90 ELSE 10 END")]
    out = cascade.cascade(docs, methods)
    assert seen == {"a": list(range(20)), "b": [i for i in range(20) if i % 4], "c": [i for i in range(20) if i % 4 > 1]}
    found = {r.doc_id: (r.method_used, r.quality_score, r.fallback_applied, r.n_attempts, r.text) for r in out.results.collect()}
    wanted = {0: ("a", 100.0, False, 1, GOOD), 1: ("b", 100.0, True, 2, GOOD), 2: ("c", 90.0, True, 3, "text 2"), 3: ("c", 10.0, True, 3, "text 3")}
    assert found == {i: wanted[i % 4] for i in range(20)}
    assert out.attempts.count() == 20 + 15 + 10 and out.attempts.where("method = 'b' AND NOT success").count() == 10
    # documents begin where a diagnosis says
    later = {r.doc_id: r.n_attempts for r in cascade.cascade(docs, methods, start=F.when(F.col("kind") == 3, 2)).results.collect()}
    assert later == {i: (1, 2, 3, 1)[i % 4] for i in range(20)} and seen["b"] == [i for i in range(20) if i % 4 in (1, 2)]
    # nothing but failures; no documents
    none = cascade.cascade(docs, [cascade.Method("n", lambda due: due.select("doc_id", F.lit(None).cast("string").alias("text")))])
    assert {(r.method_used, r.quality_score, r.text) for r in none.results.collect()} == {(None, 0.0, None)}
    assert cascade.cascade(docs.limit(0), methods).results.count() == 0
    sample = cascade.probe(docs.select("doc_id", F.lit("ab" * 300).alias("text")), "doc_id").first()
    assert sample.total_characters == 600 and sample.text_sample == "ab" * 250 + "..."


def plain_lines(words, column_gap=50, row_gap=20):
    """words: (id, x0, y0, x1, y1, text) of a page: texts of lines in reading order, with their blocks."""

    def parts(own, a, b, gap):
        own = sorted(own, key=lambda w: (w[a], w[b], w[0]))
        out, end = [[]], None
        for w in own:
            if end is not None and w[a] - end >= gap:
                out.append([])
            out[-1].append(w)
            end = w[b] if end is None else max(end, w[b])
        return out

    def cut(own):
        for a, b, gap in ((2, 4, row_gap), (1, 3, column_gap)):
            found = parts(own, a, b, gap)
            if len(found) > 1:
                return [x for f in found for x in cut(f)]
        return [own]

    out = []
    for block, own in enumerate(cut(words) if words else []):
        out += [(block, " ".join(w[5] for w in sorted(line, key=lambda w: (w[1], w[0])))) for line in parts(own, 2, 4, 0)]
    return out


def test_reading_order(spark):
    rng = random.Random(4)
    pages = {}
    for page in range(12):
        # boxes in a rough grid of columns and rows, some of them wide
        words = []
        for i in range(rng.randrange(0, 40)):
            x, y = rng.choice([0, 120, 300, 420]) + rng.randrange(30), rng.choice([0, 15, 60, 75, 140]) + rng.randrange(5)
            words.append((i, x, y, x + rng.choice([20, 40, 300]), y + 10, f"w{i}"))
        pages[page] = words
    rows = [(p, *w) for p, ws in pages.items() for w in ws] + [(3, 90, None, 1, 2, 3, "x"), (None, 91, 1, 1, 2, 3, "x"), (4, 92, 1, 1, 2, 3, " ")]
    frame = spark.createDataFrame(rows, "page long, id long, x0 int, y0 int, x1 int, y1 int, text string")
    found = {}
    for r in reading.lines(frame).orderBy("page", "line").collect():
        found.setdefault(r.page, []).append((r.block, r.text))
    assert found == {p: plain_lines(ws) for p, ws in pages.items() if ws}
    assert reading.lines(frame.limit(0)).count() == 0


def test_reading_order_by_hand(spark):
    """A heading over two columns, of which the second has a paragraph break; ends swapped in one box."""
    words = [("Title", 0, 0, 200, 10), ("of", 210, 0, 250, 10), ("left1", 0, 50, 80, 60), ("left2", 80, 63, 0, 73), ("right1", 150, 50, 220, 60), ("right2", 150, 100, 220, 110), ("more", 230, 101, 260, 111)]
    frame = spark.createDataFrame([(1, i, *w[1:], w[0]) for i, w in enumerate(reversed(words))], "page int, id int, x0 int, y0 int, x1 int, y1 int, text string")
    found = [(r.block, r.text) for r in reading.lines(frame).orderBy("line").collect()]
    assert found == [(0, "Title of"), (1, "left1"), (1, "left2"), (2, "right1"), (3, "right2 more")]


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(200, 201), (205, 201), (300, 300), (None, 5), (7, None)] + [(1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            root[max(find(a), find(b))] = min(find(a), find(b))
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in root}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ruled_tables(spark):
    # a table of 2 x 3 with a doubled line, one across only, one of another page with swapped ends
    across = [(1, i, y, 0, 90) for i, y in enumerate((10, 30, 50, 52))] + [(1, 9, 500, 0, 90), (2, 0, 5, 50, 0), (2, 1, 25, 0, 50), (1, 20, None, 0, 90)]
    down = [(1, i, x, 10, 52) for i, x in enumerate((0, 30, 60, 90))] + [(1, 9, 300, 0, 900), (2, 0, 0, 0, 30), (2, 1, 40, 30, 0), (2, 1, 40, 30, 0)]
    h = spark.createDataFrame(across, "page int, id int, y int, x1 int, x2 int")
    v = spark.createDataFrame(down, "page int, id int, x int, y1 int, y2 int")
    for cell in (7, 200):
        found = sorted(tuple(r) for r in rulings.tables(h, v, cell=cell).collect())
        assert found == [(1, 0, 2, 3, 8, 16, 0, 10, 90, 52), (2, 0, 1, 1, 4, 4, 0, 5, 40, 25)]


@pytest.mark.parametrize("cell", [30, 1000])
def test_suppression(spark, cell):
    rng = random.Random(6)
    rows = [(p, i, rng.randrange(200), rng.randrange(200), rng.choice([0, 10, 60, 60, 120]), rng.choice([10, 60, 60])) for p in range(4) for i in range(40)]

    def share(a, b):
        w = max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
        h = max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
        small = min(a[4] * a[5], b[4] * b[5])
        return w * h / small if small else 0

    kept = []
    for r in sorted(rows, key=lambda r: (r[0], -r[4] * r[5], r[1])):
        if not any(k[0] == r[0] and share(k, r) > 0.3 for k in kept):
            kept.append(r)
    frame = spark.createDataFrame(rows, "page long, id long, x long, y long, w long, h long")
    assert sorted(map(tuple, regions.suppress(frame, 0.3, cell).select("page", "id").collect())) == sorted(r[:2] for r in kept)
    near = {(r.page, r.one, r.two) for r in regions.overlaps(frame, 0.0, cell).collect()}
    assert near == {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and share(a, b) > 0}
    close = {(r.page, r.one, r.two) for r in regions.relationships(frame, cell).collect()}
    middle = lambda r: (r[2] + r[4] // 2, r[3] + r[5] // 2)
    assert close == {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and (middle(a)[0] - middle(b)[0]) ** 2 + (middle(a)[1] - middle(b)[1]) ** 2 < cell**2}


def test_directory_tree(spark):
    files = [("a/b/c/d.txt", 5, 3), ("a/b/e.txt", 7, 1), ("/a/f.txt", None, 2), ("a/.hidden/x", 100, 9), ("g", 1, 1), ("g", 2, 4), ("", 1, 1), (None, 1, 1), ("a/b/c", 1, 1)]
    found = {r.path: (r.name, r.level, r.kind, r.truncated, r["files"], r.bytes, r.modified) for r in tree.directory_tree(spark.createDataFrame(files, "path string, size long, modified long")).collect()}
    assert found == {
        "a": ("a", 1, "directory", False, 4, 13, 3),
        "a/b": ("b", 2, "directory", False, 3, 13, 3),
        "a/b/c": ("c", 3, "directory", True, 2, 6, 3),
        "a/b/e.txt": ("e.txt", 3, "directory", True, 1, 7, 1),
        "a/f.txt": ("f.txt", 2, "file", False, 1, 0, 2),
        "g": ("g", 1, "file", False, 2, 3, 4),
    }
