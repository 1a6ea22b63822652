"""Scalar functions as columns: font flags, page selections, colours, geometry, text similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare_font(name: Column) -> Column:
    """A font's name without the mark of a subset."""
    return F.regexp_replace(name, r"^[^+]*\+", "")


def font_flags(name: Column, descriptor: Column | None = None) -> Column:
    """Italic 2, serif 4, monospaced 8, bold 16, from a name or a descriptor's bits."""
    n, bits = F.lower(bare_font(name)), F.lit(0) if descriptor is None else F.coalesce(descriptor, F.lit(0))

    def has(*parts: str) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | F.contains(n, F.lit(p))
        return out

    def flag(test: Column, mask: int, value: int) -> Column:
        return F.when(test | (bits.bitwiseAND(mask) != 0), value).otherwise(0)

    serif = has("times", "serif", "georgia", "garamond", "roman") & ~has("sans")
    return flag(has("italic", "oblique"), 64, 2) + flag(serif, 2, 4) + flag(has("courier", "mono", "consol", "typewriter"), 1, 8) + flag(has("bold", "black", "heavy"), 262144, 16)


def selected_pages(selection: str, count: int) -> list[int]:
    """Page numbers of a selection such as 0,3,5-8, 5- or -3: clipped, distinct and sorted."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in selection.split(","))):
        if "-" in part:
            lo, _, hi = part.partition("-")
            out.update(range(max(0, int(lo) if lo else 0), min(count - 1, int(hi) if hi else count - 1) + 1))
        elif 0 <= int(part) < count:
            out.add(int(part))
    return sorted(out)


def rgb(r: Column, g: Column, b: Column) -> Column:
    """0xRRGGBB from shares of one."""
    part = lambda c: F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("long")
    return F.shiftleft(part(r), 16).bitwiseOR(F.shiftleft(part(g), 8)).bitwiseOR(part(b))


def transformed_box(matrix: list[Column], box: list[Column]) -> list[Column]:
    """The upright box of a rectangle under an affine matrix (a b c d e f)."""
    a, b, c, d, e, f = matrix
    xs = [a * x + c * y + e for x in (box[0], box[2]) for y in (box[1], box[3])]
    ys = [b * x + d * y + f for x in (box[0], box[2]) for y in (box[1], box[3])]
    return [F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)]


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def set_scores(a: Column, b: Column) -> Column:
    """Precision, recall and Jaccard index of two arrays without repetitions; empty ones score 0."""

    def scores(n: Column) -> Column:
        share = lambda total: F.when(total > 0, n["both"] / total).otherwise(0.0)
        return F.struct(share(n["a"]).alias("precision"), share(n["b"]).alias("recall"), share(n["a"] + n["b"] - n["both"]).alias("jaccard"))

    sizes = lambda s: F.struct(F.size(s["a"]).alias("a"), F.size(s["b"]).alias("b"), F.size(F.array_intersect(s["a"], s["b"])).alias("both"))
    return _let(_let(F.struct(a.alias("a"), b.alias("b")), sizes), scores)


def word_scores(found: Column, wanted: Column) -> dict[str, Column]:
    """Precision, recall and Jaccard index of two texts' word sets; empty sets score 0."""
    scores = set_scores(words(found), words(wanted))
    return {k: scores[k] for k in ("precision", "recall", "jaccard")}


def trigrams(text: Column) -> Column:
    """From the text's characters, since a substring would be looked for from the beginning each time."""
    each = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.concat(c[i], c[i + 1], c[i + 2]))
    return F.when(F.length(text) >= 3, F.array_distinct(_let(F.split(text, ""), each))).otherwise(F.array().cast("array<string>"))


def trigram_jaccard(a: Column, b: Column) -> Column:
    return set_scores(trigrams(a), trigrams(b))["jaccard"]


def replacements(text: Column) -> Column:
    """Characters that could not be decoded."""
    return F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
