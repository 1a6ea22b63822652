"""From positioned characters to spans, lines, blocks and text.

Tables are keyed by (path, page). Every step is a window over one page, so one shuffle by
(path, page) serves all of them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE = 12.0
SPAN_GAP, LINE_APART, BLOCK_GAP = 0.3 * SIZE, 0.5 * SIZE, 1.5 * SIZE
LEAST_GAP = 0.015
PAGE = (0.0, 0.0, 612.0, 792.0)
KEY = ["path", "page"]
_BOX = ("x0", "y0", "x1", "y1")


def _union() -> list[Column]:
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]


def _joined(order: list[str], value: str, separator: str = "") -> Column:
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return F.array_join(F.transform(rows, lambda r: r["_v"]), separator)


def _islands(df: DataFrame, keys: list[str], order: str, same: Column, name: str) -> DataFrame:
    """Numbers runs of rows: a run ends where `same`, which may use prev_*, doesn't hold."""
    w = Window.partitionBy(*keys).orderBy(order)
    lagged = df.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in _BOX])
    broken = F.when(same, 0).otherwise(1)
    return lagged.withColumn("_b", broken).withColumn(name, (F.sum("_b").over(w) - 1).cast("long")).drop("_b", *[f"prev_{c}" for c in _BOX])


def build_spans(chars: DataFrame) -> DataFrame:
    """(path, page, span, text, box): neighbouring characters of one line, in content order."""
    near = (F.abs(F.col("y0") - F.col("prev_y0")) < LINE_APART) & (F.col("x0") - F.col("prev_x1") < SPAN_GAP) & (F.col("x0") - F.col("prev_x1") > -LINE_APART)
    return _islands(chars, KEY, "seq", near, "span").groupBy(*KEY, "span").agg(_joined(["seq"], "c").alias("text"), *_union())


def detect_columns(spans: DataFrame) -> DataFrame:
    """Adds col, 0 or 1: pages are cut in two at their widest empty gap, if it is wide enough and both sides have spans."""
    whole = Window.partitionBy(*KEY)
    before = whole.orderBy("x0", "span").rowsBetween(Window.unboundedPreceding, -1)
    reach = spans.withColumn("_reach", F.max("x1").over(before))
    gap = F.col("x0") - F.col("_reach")
    place = F.when(gap > 0, F.struct(gap.alias("gap"), (-(F.col("_reach") + gap / 2)).alias("at")))
    wide = F.max("x1").over(whole) - F.min("x0").over(whole)
    cut = reach.withColumn("_best", F.max(place).over(whole)).withColumn("_wide", wide).withColumn("_n", F.count("*").over(whole))
    at = F.when((F.col("_n") >= 6) & (F.col("_wide") >= 100) & (F.col("_best.gap") >= 0.04 * F.col("_wide")), -F.col("_best.at"))
    sided = cut.withColumn("_left", F.coalesce(F.col("x0") < at, F.lit(True)))
    left, right = (F.sum(F.when(F.col("_left") == s, 1).otherwise(0)).over(whole) for s in (True, False))
    split = sided.withColumn("_two", (left >= 2) & (right >= 2))
    return split.withColumn("col", F.when(F.col("_two") & ~F.col("_left"), 1).otherwise(0)).drop("_reach", "_best", "_wide", "_n", "_left", "_two")


def build_lines(spans: DataFrame) -> DataFrame:
    """(path, page, col, line, text, box, spans): spans at one height, left to right, with spaces where gaps are."""
    keys = [*KEY, "col"]
    near = (F.abs(F.col("y0") - F.col("prev_y0")) < LINE_APART) & (F.col("x0") - F.col("prev_x1") < 5 * SIZE) & (F.col("x0") - F.col("prev_x1") > -10 * SIZE)
    lined = _islands(spans, keys, "span", near, "line")
    gap = F.col("x0") - F.lag("x1").over(Window.partitionBy(*keys, "line").orderBy("x0", "span"))
    spaced = F.when(~F.startswith("text", F.lit(" ")) & (gap > 0.25 * SIZE) & (gap < 0.6 * SIZE), F.concat(F.lit(" "), "text")).otherwise(F.col("text"))
    one = F.struct("x0", "span", spaced.alias("text"), "y0", "x1", "y1")
    rows = lined.select(*keys, "line", *_BOX, one.alias("one")).groupBy(*keys, "line").agg(F.array_sort(F.collect_list("one")).alias("spans"), *_union())
    return rows.withColumn("text", F.array_join(F.transform("spans", lambda s: s["text"]), ""))


def build_blocks(lines: DataFrame) -> DataFrame:
    """(path, page, block_no, col, box, text, lines): lines that follow each other closely; the left column's come first."""
    keys = [*KEY, "col"]
    near = F.greatest("y0", "prev_y0") - F.least("y1", "prev_y1") <= BLOCK_GAP
    numbered = _islands(lines, keys, "line", near & F.col("prev_y0").isNotNull(), "block")
    one = F.struct("line", F.col("text"), F.array(*_BOX).alias("bbox"), "spans")
    out = numbered.select(*keys, "block", *_BOX, one.alias("one")).groupBy(*keys, "block").agg(F.array_sort(F.collect_list("one")).alias("lines"), *_union())
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("col", "block")) - 1
    text = F.array_join(F.transform("lines", lambda r: F.concat(r["text"], F.lit("\n"))), "")
    return out.select(*KEY, number.cast("long").alias("block_no"), "col", *_BOX, text.alias("text"), "lines")


def cluster_chars(chars: DataFrame) -> DataFrame:
    """Blocks of upright characters; rotated ones are left out."""
    upright = chars.where(~F.col("rotated")) if "rotated" in chars.columns else chars
    return build_blocks(build_lines(detect_columns(build_spans(upright))))


def cluster_rotated(chars: DataFrame) -> DataFrame:
    """Blocks of rotated characters: the axes change places, and back."""
    turned = chars.where("rotated").select(*KEY, "seq", "c", *[F.col(a).alias(b) for a, b in (("y0", "x0"), ("x0", "y0"), ("y1", "x1"), ("x1", "y1"))])
    out = build_blocks(build_lines(detect_columns(build_spans(turned))))
    back = F.transform("lines", lambda r: r.withField("bbox", F.array(r["bbox"][1], r["bbox"][0], r["bbox"][3], r["bbox"][2])))
    return out.select(*KEY, "block_no", "col", *[F.col(a).alias(b) for a, b in (("y0", "x0"), ("x0", "y0"), ("y1", "x1"), ("x1", "y1"))], "text", back.alias("lines"))


def body_blocks(chars: DataFrame, include_rotated: bool = False) -> DataFrame:
    """Upright blocks and, if asked for, rotated ones after them."""
    body = cluster_chars(chars)
    if not include_rotated:
        return body
    both = body.withColumn("_part", F.lit(0)).unionByName(cluster_rotated(chars).withColumn("_part", F.lit(1)))
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("_part", "block_no")) - 1
    return both.withColumn("block_no", number.cast("long")).drop("_part")


def page_rects(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(path, page, rect): the media box, else the union of the blocks, else a letter page."""
    union = blocks.groupBy(*KEY).agg(F.array(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).alias("_union"))
    return pages.select(*KEY, "rect").join(union, KEY, "left").select(*KEY, F.coalesce("rect", "_union", F.array(*map(F.lit, PAGE))).alias("rect"))


def drop_outside(blocks: DataFrame, rects: DataFrame) -> DataFrame:
    """Adds dropped: blocks far outside the page, or beyond a tenth of it unless most blocks are."""
    r = lambda k: F.col("rect")[k]
    wide, high = F.greatest(F.abs(r(2) - r(0)), F.lit(1.0)), F.greatest(F.abs(r(3) - r(1)), F.lit(1.0))

    def within(slack: float) -> Column:
        return (F.least("x0", "x1") >= r(0) - slack * wide) & (F.greatest("x0", "x1") <= r(2) + slack * wide) & (F.least("y0", "y1") >= r(1) - slack * high) & (F.greatest("y0", "y1") <= r(3) + slack * high)

    whole = Window.partitionBy(*KEY)
    tested = blocks.join(rects, KEY).withColumn("_slack", within(2.0)).withColumn("_margin", within(0.1)).withColumn("_n", F.count("*").over(whole))
    only = F.sum(F.when(F.col("_slack") & ~F.col("_margin"), 1).otherwise(0)).over(whole)
    keep = (F.col("_n") <= 1) | F.col("_slack") & (F.col("_margin") | (2 * F.col("_only") > F.col("_n")))
    return tested.withColumn("_only", only).withColumn("dropped", ~keep).drop("_slack", "_margin", "_n", "_only")


def _widest(boxes: list, axis: int, rect: list) -> tuple[float, float] | None:
    """(gap, middle) of the widest empty stretch; boxes wider than 70 % of the page don't count."""
    limit = 0.7 * max(abs(rect[axis + 2] - rect[axis]), 1.0)
    sides = sorted((b[axis], b[axis + 2]) for b in boxes if abs(b[axis + 2] - b[axis]) <= limit)
    best, reach = None, None
    for lo, hi in sides:
        if reach is not None and lo > reach and (best is None or lo - reach > best[0]):
            best = lo - reach, reach + (lo - reach) / 2
        reach = hi if reach is None else max(reach, hi)
    return best


def reading_order(boxes: list, rect: list) -> list[int]:
    """Places of the boxes in reading order: recursive cuts, the upper half and the left half first."""
    out: list[int] = []
    waiting = [(list(range(len(boxes))), list(rect))]
    while waiting:
        own, r = waiting.pop()
        if len(own) > 1:
            cut = None
            for axis in (1, 0):
                gap = _widest([boxes[k] for k in own], axis, r)
                if gap and gap[0] >= LEAST_GAP * (r[axis + 2] - r[axis]):
                    at = gap[1]
                    low = [k for k in own if (boxes[k][axis] + boxes[k][axis + 2]) / 2 < at]
                    high = [k for k in own if (boxes[k][axis] + boxes[k][axis + 2]) / 2 >= at]
                    if low and high:
                        under, over = list(r), list(r)
                        under[axis + 2] = over[axis] = at
                        cut = [(low, under), (high, over)] if axis else [(high, over), (low, under)]
                        break
                    own = high + low if axis else low + high
            if cut:
                waiting += cut
                continue
            own = sorted(own, key=lambda k: (-boxes[k][3], boxes[k][0]))
        out += own
    return out


_ORDER = "path string, page long, block_no long, reading_no long"


def _order_page(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("block_no")
    order = reading_order(rows[list(_BOX)].values.tolist(), list(rows["rect"].iloc[0]))
    return pd.DataFrame({"path": rows["path"].iloc[0], "page": rows["page"].iloc[0], "block_no": rows["block_no"].to_numpy()[order], "reading_no": range(len(order))})


def order_blocks(blocks: DataFrame, rects: DataFrame) -> DataFrame:
    """Blocks that drop_outside() keeps, with block_no in reading order. Pages of one block need no Python."""
    kept = drop_outside(blocks, rects).where("not dropped").drop("dropped")
    counted = kept.withColumn("_n", F.count("*").over(Window.partitionBy(*KEY)))
    order = counted.where("_n > 1").select(*KEY, "block_no", *_BOX, "rect").groupBy(*KEY).applyInPandas(_order_page, _ORDER)
    many = counted.where("_n > 1").join(order, [*KEY, "block_no"]).drop("block_no").withColumnRenamed("reading_no", "block_no")
    one = counted.where("_n = 1").withColumn("block_no", F.lit(0).cast("long"))
    return many.unionByName(one).drop("_n", "rect")


def page_text(blocks: DataFrame) -> DataFrame:
    """(path, page, text): a line break after each line and another after each block."""
    return blocks.groupBy(*KEY).agg(F.concat(_joined(["block_no"], "text", "\n"), F.lit("\n")).alias("text"))


def scanned_pages(pages: DataFrame, blocks: DataFrame, images: DataFrame, rects: DataFrame) -> DataFrame:
    """(path, page, is_scanned): fewer than 50 characters, and an image over 70 % of the page or more."""
    letters = blocks.groupBy(*KEY).agg(F.sum(F.aggregate("lines", F.lit(0), lambda a, r: a + F.length(r["text"]))).alias("_letters"))
    return scanned_of(pages.select(*KEY).join(rects, KEY), letters, images)


def scanned_of(placed: DataFrame, letters: DataFrame, images: DataFrame) -> DataFrame:
    """scanned_pages() of pages with their rects, whose characters are counted."""
    covered = images.groupBy(*KEY).agg(F.max(F.abs(F.col("x1") - F.col("x0")) * F.abs(F.col("y1") - F.col("y0"))).alias("_area"))
    r = lambda k: F.col("rect")[k]
    area = F.greatest(F.abs((r(2) - r(0)) * (r(3) - r(1))), F.lit(1.0))
    out = placed.select(*KEY, "rect").join(letters, KEY, "left").join(covered, KEY, "left")
    return out.select(*KEY, ((F.coalesce("_letters", F.lit(0)) < 50) & (F.coalesce("_area", F.lit(0.0)) / area >= 0.7)).alias("is_scanned"))
