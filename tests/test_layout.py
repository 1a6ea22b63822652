"""Relational layout on small character lists."""

from __future__ import annotations

import numpy as np
import pytest

from paperlake.operators import layout

CHARS = "path string, page long, seq long, c string, x0 double, y0 double, x1 double, y1 double, size double, rotated boolean"


def chars(spark, words):
    """Rows of (text, x, y[, rotated]): characters 6 wide and 12 high."""
    rows, seq = [], 0
    for text, x, y, *turned in words:
        for k, c in enumerate(text):
            box = (x, y + 6 * k, x + 12, y + 6 * k + 6) if turned else (x + 6 * k, y, x + 6 * k + 6, y + 12)
            rows.append(("f", 0, seq, c, *map(float, box), 12.0, bool(turned)))
            seq += 1
    return spark.createDataFrame(rows, CHARS)


def texts(df):
    return [r.text for r in df.orderBy("path", "page", "block_no").collect()]


def test_spans_lines_and_blocks(spark):
    table = chars(spark, [("one", 72, 700), ("span", 90, 700), ("gap", 119, 700), ("next", 72, 688), ("far", 72, 630)])
    assert [r.text for r in layout.build_spans(table).orderBy("span").collect()] == ["onespan", "gap", "next", "far"]
    assert texts(layout.cluster_chars(table)) == ["onespan gap\nnext\n", "far\n"]


def test_two_columns(spark):
    words = [(w, x, 700 - 14 * k) for k in range(4) for w, x in (("left", 72), ("right", 400))]
    got = layout.cluster_chars(chars(spark, words))
    assert texts(got) == ["left\n" * 4, "right\n" * 4] and [r.col for r in got.orderBy("block_no").collect()] == [0, 1]


def test_rotated(spark):
    table = chars(spark, [("body", 72, 700), ("side", 20, 300, True)])
    assert texts(layout.body_blocks(table)) == ["body\n"] and texts(layout.body_blocks(table, True)) == ["body\n", "side\n"]
    turned = layout.cluster_rotated(table).first()
    assert (turned.x0, turned.y0, turned.x1, turned.y1) == (20, 300, 32, 324)


def blocks(spark, boxes):
    rows = [("f", 0, k, 0, *map(float, b), f"b{k}", []) for k, b in enumerate(boxes)]
    return spark.createDataFrame(rows, "path string, page long, block_no long, col int, x0 double, y0 double, x1 double, y1 double, text string, lines array<struct<text:string>>")


def rects(spark, rect=(0, 0, 612, 792)):
    return spark.createDataFrame([("f", 0, list(map(float, rect)))], "path string, page long, rect array<double>")


def test_reading_order(spark):
    boxes = [(320, 400, 540, 500), (72, 100, 290, 380), (72, 700, 540, 740), (320, 100, 540, 380), (72, 400, 290, 500)]
    assert layout.reading_order(boxes, [0, 0, 612, 792]) == [2, 4, 0, 1, 3]
    assert layout.reading_order([], [0, 0, 612, 792]) == [] and layout.reading_order(boxes[:1], [0, 0, 612, 792]) == [0]
    got = layout.order_blocks(blocks(spark, boxes), rects(spark)).orderBy("block_no").collect()
    assert [r.text for r in got] == ["b2", "b4", "b0", "b1", "b3"]
    deep = [(10.0 * k, 10.0 * k, 10.0 * k + 5, 10.0 * k + 5) for k in range(300)]
    assert layout.reading_order(deep, [0, 0, 3000, 3000]) == list(range(299, -1, -1))


def test_every_block_once():
    rng = np.random.default_rng(1)
    for n in (2, 10, 60):
        at = rng.uniform(0, 700, (n, 2))
        boxes = np.hstack([at, at + rng.uniform(1, 300, (n, 2))]).tolist()
        assert sorted(layout.reading_order(boxes, [0, 0, 800, 800])) == list(range(n))


@pytest.mark.parametrize(("boxes", "dropped"), [([(10, 10, 50, 50), (700, 10, 720, 50), (10, 60, 50, 90)], 1), ([(10, 900, 50, 940), (10, 950, 50, 990), (10, 60, 50, 90)], 0), ([(1e6, 0, 1e6, 1)], 0), ([(10, 10, 20, 20), (1e6, 0, 1e6, 1)], 1)])
def test_outside(spark, boxes, dropped):
    assert layout.drop_outside(blocks(spark, boxes), rects(spark)).where("dropped").count() == dropped


def test_scanned_and_rects(spark):
    pages = spark.createDataFrame([("f", 0, None)], "path string, page long, rect array<double>")
    small = blocks(spark, [(10, 20, 30, 40)])
    assert layout.page_rects(pages, small).first().rect == [10, 20, 30, 40]
    assert layout.page_rects(pages, small.limit(0)).first().rect == [0, 0, 612, 792]
    image = spark.createDataFrame([("f", 0, 0.0, 0.0, 600.0, 780.0)], "path string, page long, x0 double, y0 double, x1 double, y1 double")
    assert layout.scanned_pages(pages, small, image, rects(spark)).first().is_scanned
    assert not layout.scanned_pages(pages, small, image.limit(0), rects(spark)).first().is_scanned
