"""Reading order by clumps: what rounds of cuts move, pages in pieces, boxes of any kind."""

import random
from decimal import Decimal

import pytest
from lectern.operators import reading
from tests.test_drivers import plain_lines

SCHEMA = "page long, id long, x0 {0}, y0 {0}, x1 {0}, y1 {0}, text string"


def found(frame):
    out = {}
    for r in reading.lines(frame).orderBy("page", "line").collect():
        out.setdefault(r.page, []).append((r.block, r.text))
    return out


def test_rounds_move_clumps_without_texts(spark, monkeypatch):
    moved = []

    def cut(df, label, own=reading.cut):
        out = own(df, label)
        moved.append((label, "text" in out.columns, out.count()))
        return out

    monkeypatch.setattr(reading, "cut", cut)
    # pages of a heading and two columns, 40 rows of three words each
    words = [(p, (p * 997 + i * 31) % 1009, x, y, x + 60, y + 10, f"w{i}") for p in range(5) for i, (x, y) in enumerate([(0, 0), (100, 0)] + [(c * 400 + k * 70, 60 + r * 14) for c in range(2) for r in range(40) for k in range(3)])]
    frame = spark.createDataFrame(words, SCHEMA.format("long")).coalesce(1)
    lines = found(frame)
    assert {len(x) for x in lines.values()} == {81} and lines[0][:2] == [(0, "w0 w1"), (1, "w2 w3 w4")]
    rounds = [x for x in moved if x[0] == "blocks"]
    assert rounds and not any(texts for _, texts, _ in rounds) and sum(n for *_, n in rounds) <= 5 * 3 * 3


@pytest.mark.parametrize(("kind", "of"), [("long", int), ("double", float), ("decimal(9,2)", Decimal)])
def test_pages_over_many_batches(spark, kind, of):
    """Words in any order over partitions, flat boxes too, equal plain cuts."""
    rng = random.Random(8)
    pages = {p: [(i, x := rng.choice([0, 120, 300]) + rng.randrange(40), y := rng.choice([0, 15, 60, 75]) + rng.randrange(5), x + rng.choice([20, 40, 200]), y + rng.choice([0, 10, 10]), f"w{i}") for i in range(rng.randrange(1, 50))] for p in range(10)}
    rows = [(p, i, *map(of, box), t) for p, ws in pages.items() for i, *box, t in ws]
    rng.shuffle(rows)
    # flat boxes of one height each make a line, by id
    pages[99] = [(i, 0, 5, 9, 5, f"f{i}") for i in (4, 1, 3, 0, 2)]
    rows += [(99, i, *map(of, box), t) for i, *box, t in pages[99]]
    wanted = {p: plain_lines(ws) for p, ws in pages.items()}
    wanted[99] = [(0, f"f{i}") for i in range(5)]
    for parts in (1, 4):
        assert found(spark.createDataFrame(rows, SCHEMA.format(kind)).repartition(parts)) == wanted
