"""The one-pass layout of files against the operators with windows, on pages of scattered words."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from paperlake.operators import layout
from paperlake.plans.registry import QUERIES
from paperlake.sources.reader import Corpus
from paperlake.sources.writer import FONT, assemble, stream

SF = "/root/testdata/sf0.001"


def scattered(rng: random.Random) -> bytes:
    """Words in columns, at any place, turned, and outside the page; pages without words or media box."""
    objects, kids = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: FONT}, []
    for k in range(8):
        words = []
        for n in range(rng.choice([0, 1, 3, 30, 80])):
            x, y = rng.choice([(72 + 6 * (n % 40), 700 - 14 * (n // 4)), (72 + 300 * (n % 2), 700 - 14 * (n // 2)), (rng.uniform(0, 600), rng.uniform(0, 780)), (rng.choice([-90, 700, 3000]), 5 * n)])
            turn = rng.choice([b"1 0 0 1", b"1 0 0 1", b"1 0 0 1", b"0 1 -1 0"])
            words.append(b"%s %.2f %.2f Tm (%s) Tj" % (turn, x, y, rng.choice([b"a", b"word", b" lead", b"words in a line"])))
        objects[5 + 2 * k] = b"<< /Type /Page /Parent 2 0 R %s /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (rng.choice([b"", b"/MediaBox [0 0 612 792]"]), 6 + 2 * k)
        objects[6 + 2 * k] = stream(b"BT /F1 10 Tf " + b"\n".join(words) + b" ET")
        kids.append(b"%d 0 R" % (5 + 2 * k))
    objects[2] = b"<< /Type /Pages /Count 8 /Kids [%s] >>" % b" ".join(kids)
    return assemble(objects)


def rows(df):
    return sorted(repr(r) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("rotated", [False, True])
def test_one_pass_is_the_windows_result(spark, rotated, tmp_path):
    rng = random.Random(7)
    files = spark.createDataFrame([*((f"f{k}", scattered(rng)) for k in range(12)), ("bad", b"no file"), ("none", None)], "path string, content binary")
    fresh = Corpus.of(files, include_rotated=rotated)
    kept = fresh.persist(f"file://{tmp_path}/parsed")
    blocks = layout.body_blocks(kept.chars, rotated).cache()
    rects = layout.page_rects(kept._pages.select("path", "page", "p.rect"), blocks).cache()
    ordered = layout.order_blocks(blocks, rects).cache()
    texts = kept._pages.select("path", "page").join(layout.page_text(ordered), ["path", "page"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    assert blocks.count() > ordered.count() > 500
    for c in (fresh, kept):
        assert rows(c.all_blocks) == rows(blocks) and rows(c.rects) == rows(rects)
        assert rows(c.blocks) == rows(ordered) and rows(c.page_text) == rows(texts)


def test_page_text_needs_one_pass_and_no_stored_rows(spark):
    plan = QUERIES["pdf_page_text"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "posexplode" not in plan and "Join" not in plan and "parsed-" not in plan
