"""Tables by their drawn lines: planted grids with torn and wobbly lines, spans and boxes."""

import random

import pytest

from quireframe.operators import grids
from quireframe.schema import DRAWINGS, LINES

BLACK, WHITE = [0.0, 0.0, 0.0], [1.0, 1.0, 1.0]


def drawn(spark, rects, page=0):
    return spark.createDataFrame([(1, page, k, tuple(map(float, r)), f, c) for k, (r, f, c) in enumerate(rects)], DRAWINGS)


def across(x0, x1, y, t=0.5):
    return (x0, y - t, x1, y + t), BLACK, None


def down(x, y0, y1, t=0.5):
    return (x - t, y0, x + t, y1), BLACK, None


def found(spark, rects, lines=None, **options):
    tables, cells = grids.find_tables(drawn(spark, rects), lines, **options)
    t = {r.table_no: (tuple(r.rect), r.n_rows, r.n_cols) for r in tables.collect()}
    return t, {(r.table_no, r.row_idx, r.col_idx): (None if r.bbox is None else tuple(r.bbox), r.text) for r in cells.collect()}


def test_planted_grids(spark):
    rnd = random.Random(9)
    for _ in range(4):
        xs, ys = ([50.0 + k * rnd.choice([40, 60]) for k in range(rnd.randint(2, 5))] for _ in range(2))
        xs, ys = sorted(set(xs)), sorted(set(ys))
        rects, wobble = [], lambda: rnd.choice([-0.6, 0.0, 0.6])
        for y in ys:  # torn into pieces that nearly touch, in any order
            cuts = sorted([xs[0], xs[-1], *(rnd.uniform(xs[0], xs[-1]) for _ in range(3))])
            rects += [across(a, b - 1.5 if b < xs[-1] else b, y + wobble()) for a, b in zip(cuts, cuts[1:], strict=False)]
        rects += [down(x + wobble(), ys[0], ys[-1]) for x in xs]
        rnd.shuffle(rects)
        rects += [((200.0, 500.0, 300.0, 500.4), BLACK, None), ((400.0, 400.0, 402.0, 402.0), BLACK, None), ((50.0, 50.0, 600.0, 51.0), WHITE, None)]  # a rule, a dot, nothing seen
        t, cells = found(spark, rects)
        n = (len(xs) - 1) * (len(ys) - 1)
        if n < 2:
            assert not t
            continue
        assert set(t) == {0} and t[0][1:] == (len(ys) - 1, len(xs) - 1) and len(cells) == n
        for (_, r, c), (box, _) in cells.items():
            assert all(abs(a - b) <= 1.0 for a, b in zip(box, (xs[c], ys[r], xs[c + 1], ys[r + 1]), strict=True))


def test_spans_boxes_and_texts(spark):
    rects = [across(0, 90, y) for y in (0, 20, 40)] + [down(0, 0, 40), down(90, 0, 40), down(30, 20, 40), down(60, 0, 40)]
    rects += [((200.0, 100.0, 250.0, 120.0), None, BLACK), ((250.0, 100.0, 300.0, 120.0), None, BLACK), ((200.0, 120.0, 250.0, 140.0), None, BLACK), ((250.0, 120.0, 300.0, 140.0), None, BLACK)]
    rects += [((200.0, 300.0, 250.0, 320.0), BLACK, None), ((250.0, 300.0, 300.0, 320.0), BLACK, None)]  # filled, without borders
    span = lambda t: [(t, 9.0, "f", 0)]
    lines = spark.createDataFrame([(1, 0, 0, (2.0, 12.0, 20.0, 18.0), span("below")), (1, 0, 1, (2.0, 2.0, 20.0, 8.0), span("above")), (1, 0, 2, (65.0, 25.0, 80.0, 33.0), span("right")), (1, 0, 3, (500.0, 25.0, 580.0, 33.0), span("none"))], LINES)
    t, cells = found(spark, rects, lines)
    assert t == {0: ((0.0, 0.0, 90.0, 40.0), 2, 3), 1: ((200.0, 100.0, 300.0, 140.0), 2, 2), 2: ((200.0, 300.0, 300.0, 320.0), 1, 2)}
    assert cells[0, 0, 0] == ((0.0, 0.0, 60.0, 20.0), "above\nbelow") and cells[0, 0, 1] == (None, None) and cells[0, 1, 2] == ((60.0, 20.0, 90.0, 40.0), "right") and cells[0, 1, 1][1] == ""
    assert cells[1, 1, 1][0] == (250.0, 120.0, 300.0, 140.0)
    strict, _ = found(spark, rects, strategy="lines_strict")
    assert set(strict) == {0, 1}
    with pytest.raises(ValueError):
        grids.find_tables(drawn(spark, rects), strategy="text")
    assert found(spark, rects[:0] or [((0.0, 0.0, 1.0, 1.0), BLACK, None)]) == ({}, {})
