"""Layout in one pass over whole pages: what `layout` states with windows, for characters that come page by page.

Characters never become rows: arrays of a batch of pages go through spans, columns, lines and blocks, and
only what a query asks for is returned.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from paperlake.operators.layout import BLOCK_GAP, LINE_APART, PAGE, SIZE, SPAN_GAP, reading_order

BOX = ("x0", "y0", "x1", "y1")
SPAN = pa.struct([("x0", pa.float64()), ("span", pa.int64()), ("text", pa.string()), ("y0", pa.float64()), ("x1", pa.float64()), ("y1", pa.float64())])
LINE = pa.struct([("line", pa.int64()), ("text", pa.string()), ("bbox", pa.list_(pa.float64())), ("spans", pa.list_(SPAN))])


def changes(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any key; true for the first."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def number(new: np.ndarray) -> np.ndarray:
    """Numbers from 0 within groups that begin where `new` holds."""
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0)) if len(new) else at


def unions(box: list[np.ndarray], at: np.ndarray) -> list[np.ndarray]:
    return [f.reduceat(v, at) if len(at) else v[:0] for f, v in zip((np.fmin, np.fmin, np.maximum, np.maximum), box)]


def _ends(at: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.append(at, n), pa.int32())


def _near(box: list[np.ndarray], after: float, before: float) -> np.ndarray:
    """Whether rows but the first stand at the height of the one before, and close to its end."""
    gap = box[0][1:] - box[2][:-1]
    return (np.abs(box[1][1:] - box[1][:-1]) < LINE_APART) & (gap < after) & (gap > -before)


def _closed(texts: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(texts, "", "\n")


def letters(codes: np.ndarray) -> pa.StringArray:
    """A string for each code point; surrogates are no characters."""
    codes = np.where((codes >= 0xD800) & (codes < 0xE000), np.uint32(0xFFFD), codes).astype(np.uint32)
    ends = np.append(0, np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))).astype(np.int32)
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(ends), pa.py_buffer(codes.tobytes().decode("utf-32-le").encode()))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Rows:
    """Spans, lines or blocks in order: page, number within it (lines: within its column), box, text."""

    def __init__(self, page, no, box, text=None, col=None):
        self.page, self.no, self.box, self.text, self.col = page, no, box, text, col

    def take(self, order: np.ndarray) -> Rows:
        return Rows(self.page[order], self.no[order], [v[order] for v in self.box], None if self.text is None else self.text.take(pa.array(order)), None if self.col is None else self.col[order])


class Pages:
    """Characters of several pages: page (never falling), box, and text as one string for each; in content order.

    seq: their places, where some share one (documents lie upon each other); these are of one span, as with a window's peers.
    """

    @np.errstate(all="ignore")
    def __init__(self, page: np.ndarray, box: list[np.ndarray], text: pa.Array, texts: bool = True, seq: np.ndarray | None = None):
        self.texts = texts
        new = changes(page)
        new[1:] |= ~_near(box, SPAN_GAP, LINE_APART)
        no = None
        if seq is not None:
            count, first = np.cumsum(new), changes(page, seq)
            last = np.append(np.flatnonzero(first)[1:], len(page)) - 1
            begun = (count - 1)[np.flatnonzero(changes(page))][page] if len(page) else count
            no = count[last][np.cumsum(first) - 1] - 1 - begun
            new = changes(page, no)
        at = np.flatnonzero(new)
        own = page[at]
        self.spans = Rows(own, number(changes(own)) if no is None else no[at], unions(box, at), pc.binary_join(pa.ListArray.from_arrays(_ends(at, len(page)), text), "") if texts else None)
        self.spans.col = self._columns()

    def _columns(self) -> np.ndarray:
        """See layout.detect_columns."""
        s = self.spans
        if not len(s.page):
            return s.page
        order = np.lexsort((s.no, s.box[0], s.page))
        page, x0, x1 = s.page[order], s.box[0][order], s.box[2][order]
        new = changes(page)
        at, own = np.flatnonzero(new), np.cumsum(new) - 1
        values, rank = np.unique(x1, return_inverse=True)
        # The rank of what is reached so far; a page's ranks are above those of the pages before.
        reached = np.maximum.accumulate(own * len(values) + rank) % len(values)
        reach = values[np.append(0, reached[:-1])]
        gap = x0 - reach
        gap[new] = 0
        best = np.maximum.reduceat(np.where(gap > 0, gap, -np.inf), at)
        middle = np.minimum.reduceat(np.where((gap > 0) & (gap == best[own]), reach + gap / 2, np.inf), at)
        wide = np.maximum.reduceat(x1, at) - np.minimum.reduceat(x0, at)
        cut = np.where((np.diff(np.append(at, len(page))) >= 6) & (wide >= 100) & (best >= 0.04 * wide), middle, np.inf)
        # Spans lie page by page in either order, so `own` holds for both.
        left = (s.box[0] < cut[own]) | np.isinf(cut[own])
        two = (np.bincount(own, left) >= 2) & (np.bincount(own, ~left) >= 2)
        return (two[own] & ~left).astype(np.int64)

    @cached_property
    def _lined(self) -> tuple[Rows, np.ndarray, Rows]:
        """Lines, where each begins, and their spans from left to right, with spaces where gaps are."""
        with np.errstate(all="ignore"):
            s = self.spans.take(np.argsort(self.spans.page * 2 + self.spans.col, kind="stable"))
            new = changes(s.page, s.col)
            new[1:] |= ~_near(s.box, 5 * SIZE, 10 * SIZE)
            at, line = np.flatnonzero(new), np.cumsum(new)
            s = s.take(np.lexsort((s.no, s.box[0], line)))
            page, col = s.page[at], s.col[at]
            if self.texts:
                gap = s.box[0] - np.append(0, s.box[2][:-1])
                spaced = ~new & (gap > 0.25 * SIZE) & (gap < 0.6 * SIZE)
                spaced &= ~pc.starts_with(s.text, " ").to_numpy(zero_copy_only=False)
                s.text = pc.binary_join_element_wise(pa.array(np.where(spaced, " ", "").tolist(), pa.string()), s.text, "")
            text = pc.binary_join(pa.ListArray.from_arrays(_ends(at, len(new)), s.text), "") if self.texts else None
            return Rows(page, number(changes(page, col)), unions(s.box, at), text, col), at, s

    @property
    def lines(self) -> Rows:
        return self._lined[0]

    @property
    def spans_a_line(self) -> np.ndarray:
        return np.diff(np.append(self._lined[1], len(self._lined[2].page)))

    @cached_property
    def _blocked(self) -> tuple[Rows, np.ndarray]:
        """Blocks, and where the lines of each begin."""
        s = self.lines
        new = changes(s.page, s.col)
        with np.errstate(all="ignore"):
            new[1:] |= ~(np.maximum(s.box[1][1:], s.box[1][:-1]) - np.fmin(s.box[3][1:], s.box[3][:-1]) <= BLOCK_GAP)
        at = np.flatnonzero(new)
        page = s.page[at]
        text = _closed(pc.binary_join(pa.ListArray.from_arrays(_ends(at, len(new)), s.text), "\n")) if self.texts else None
        return Rows(page, number(changes(page)), unions(s.box, at), text, s.col[at]), at

    @property
    def blocks(self) -> Rows:
        return self._blocked[0]

    @property
    def lines_a_block(self) -> np.ndarray:
        return np.diff(np.append(self._blocked[1], len(self.lines.page)))

    def nested(self, turned: bool = False) -> pa.Array:
        """The lines of each block with their spans; turned: the boxes' axes change places."""
        lines, at, s = self._lined
        spans = pa.StructArray.from_arrays([pa.array(s.box[0]), pa.array(s.no), s.text, *map(pa.array, s.box[1:])], fields=list(SPAN))
        flat = np.column_stack([lines.box[k] for k in ((1, 0, 3, 2) if turned else (0, 1, 2, 3))]).ravel()
        boxes = pa.ListArray.from_arrays(pa.array(np.arange(len(lines.page) + 1) * 4, pa.int32()), pa.array(flat))
        own = pa.StructArray.from_arrays([pa.array(lines.no), lines.text, boxes, pa.ListArray.from_arrays(_ends(at, len(s.page)), spans)], fields=list(LINE))
        return pa.ListArray.from_arrays(_ends(self._blocked[1], len(lines.page)), own)


def page_union(blocks: Rows, count: int) -> np.ndarray:
    """The union of each page's blocks, NaN for pages without any."""
    out = np.full((count, 4), np.nan)
    at = np.flatnonzero(changes(blocks.page))
    out[blocks.page[at]] = np.column_stack(unions(blocks.box, at))
    return out


def rects_of(given: list, blocks: Rows) -> np.ndarray:
    """A row for each page: the media box, else the union of the blocks, else a letter page."""
    union = page_union(blocks, len(given))
    bare = np.ones(len(given), bool)
    bare[blocks.page] = False
    union[bare] = PAGE
    for k, r in enumerate(given):
        if r is not None:
            union[k] = r
    return union


def outside(blocks: Rows, rects: np.ndarray) -> np.ndarray:
    """Which blocks go; see layout.drop_outside."""
    (a, b, c, d), (x0, y0, x1, y1) = rects[blocks.page].T, blocks.box
    wide, high = np.maximum(np.abs(c - a), 1.0), np.maximum(np.abs(d - b), 1.0)

    def within(slack: float) -> np.ndarray:
        return (np.fmin(x0, x1) >= a - slack * wide) & (np.maximum(x0, x1) <= c + slack * wide) & (np.fmin(y0, y1) >= b - slack * high) & (np.maximum(y0, y1) <= d + slack * high)

    loose, margin = within(2.0), within(0.1)
    n, only = (np.bincount(blocks.page, w, len(rects))[blocks.page] for w in (None, loose & ~margin))
    return ~((n <= 1) | loose & (margin | (2 * only > n)))


def read_order(blocks: Rows, rects: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the blocks that stay, page by page in reading order, and their numbers in it."""
    kept = np.flatnonzero(~outside(blocks, rects))
    page = blocks.page[kept]
    new = changes(page)
    at = np.append(np.flatnonzero(new), len(kept))
    boxes, out = np.column_stack(blocks.box)[kept], kept.copy()
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo > 1:
            out[lo:hi] = kept[lo:hi][reading_order(boxes[lo:hi].tolist(), rects[page[lo]].tolist())]
    return out, number(new)


def page_texts(blocks: Rows, count: int) -> pa.Array:
    """Texts of all pages from blocks in order: a line break after each block; empty without any."""
    borders = np.searchsorted(blocks.page, np.arange(count + 1))
    text = _closed(pc.binary_join(pa.ListArray.from_arrays(pa.array(borders, pa.int32()), blocks.text), "\n"))
    return pc.if_else(pa.array(np.diff(borders) > 0), text, "")
