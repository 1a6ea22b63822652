"""Benchmark decontamination by spaced seeds (operator 7).

An overlap is a run of `SPAN` = 12 words of a document that differs from a run of a benchmark item
in at most `MISSES` = 2 words at the same places. The places of a run fall into four residues modulo
4; two misses spoil two residues at most, so two others agree whole. Six fixed masks, one for each
pair of residues, read six words of a run and ignore the other six. Masks whose residues lie equally
far apart are one mask shifted, so three hashes a word find every overlap. Each hit is verified on
all twelve words, and runs that overlap or touch merge into maximal intervals.

The benchmark is far smaller than the corpus. Its seeds go to every task in slices of bounded size,
and the corpus is read once for each slice; nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.llm.kernels import FOLDED, U, Words, buffers, filter_rows, lean, mix, sole, words
from paperlake.session import prepare

SPAN, MISSES = 12, 2
_STEP = 4
_APART = (1, 2, 3)
#: Bytes of benchmark text in one slice: about 40 bytes of seeds reach each task for one of them.
SLICE_BYTES = 4 << 20
_TABLE_BITS = 22


def seeds(prints: np.ndarray) -> dict[int, np.ndarray]:
    """For each mask the hash at every word where it can begin; words of other rows may be under it."""
    n = len(prints) - 2 * _STEP
    if n <= 0:
        return {d: np.zeros(0, U) for d in _APART}
    third = prints[:n] * U(0x9E3779B97F4A7C15) + prints[_STEP : n + _STEP] * U(0xC2B2AE3D27D4EB4F) + prints[2 * _STEP : n + 2 * _STEP] * U(0x165667B19E3779F9)
    third = mix(third)
    return {d: mix(third[:-d] + third[d:] * U(0xD6E8FEB86659FD93)) if n > d else np.zeros(0, U) for d in _APART}


class Benchmark:
    """Words and seeds of some benchmark items."""

    def __init__(self, ids: np.ndarray, texts: pa.Array):
        data, offsets = buffers(texts)
        w = Words(data, offsets, FOLDED)
        self.ids, self.print, self.row = ids, w.print, w.row
        self.seed = {}
        for d, h in seeds(w.print).items():
            at = np.flatnonzero(w.row[: len(h)] == w.row[2 * _STEP + d : 2 * _STEP + d + len(h)]) if len(h) else np.zeros(0, np.int64)
            order = np.argsort(h[at], kind="stable")
            key = h[at][order]
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[(key >> U(64 - _TABLE_BITS)).astype(np.int64)] = True
            self.seed[d] = key, at[order], table

    def runs(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, item's place in ids) of each run of the document words that is an overlap, sorted and distinct."""
        starts, items = [], []
        n, m = len(w.print), len(self.print)
        for d, h in seeds(w.print).items():
            key, place, table = self.seed[d]
            at = np.flatnonzero(table[(h >> U(64 - _TABLE_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(key, h[at], "left"), np.searchsorted(key, h[at], "right")
            many = hi - lo
            at, lo, many = at[many > 0], lo[many > 0], many[many > 0]
            for cut in _slices(many, 1 << 20):
                a, size = at[cut], many[cut]
                i = np.repeat(a, size)
                q = place[np.repeat(lo[cut], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
                for shift in range(_STEP - d):
                    s, t = i - shift, q - shift
                    fits = (s >= 0) & (t >= 0) & (s + SPAN <= n) & (t + SPAN <= m)
                    s, t = s[fits], t[fits]
                    fits = (w.row[s] == w.row[s + SPAN - 1]) & (self.row[t] == self.row[t + SPAN - 1])
                    s, t = s[fits], t[fits]
                    equal = np.zeros(len(s), np.int64)
                    for k in range(SPAN):
                        equal += w.print[s + k] == self.print[t + k]
                    good = equal >= SPAN - MISSES
                    starts.append(s[good])
                    items.append(self.row[t[good]])
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(items), np.concatenate(starts)], axis=1), axis=0)
        return pairs[:, 1], pairs[:, 0]


def _slices(many: np.ndarray, limit: int):
    total, at = np.cumsum(many), 0
    while at < len(many):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
        yield slice(at, to)
        at = to


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_token", pa.int64()), ("end_token", pa.int64()), ("n_windows", pa.int64())])
_DDL = "doc_id long, item_id long, start_token long, end_token long, n_windows long"
_made: dict[int, Benchmark] = {}


def _worker(sent) -> Benchmark:
    if sent.id not in sole(_made):
        _made.clear()
        ids, texts = sent.value
        _made[sent.id] = Benchmark(np.array(ids, np.int64), pa.array(texts, pa.string()))
    return _made[sent.id]


class _Sent:
    """One slice and its number, which a worker knows it by."""

    def __init__(self, spark: SparkSession, ids: list, texts: list):
        self.value_of = spark.sparkContext.broadcast((ids, texts))
        self.id = f"{spark.sparkContext.applicationId}-{self.value_of._jbroadcast.id()}"

    def __getstate__(self):
        return {"value_of": self.value_of, "id": self.id}

    @property
    def value(self):
        return self.value_of.value


def _scan_rows(sent):
    @lean
    def run(batches):
        test = _worker(sent)
        for rows in batches:
            ids = rows.column(0)
            for i, j, w, _ in words(rows.column(1), FOLDED, 4 << 20):
                start, item = test.runs(w)
                if not len(start):
                    continue
                row = w.row[start]
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] > start[:-1] + SPAN)])
                last = np.r_[new[1:], len(start)] - 1
                base = w.first[row[new]]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i + row[new])), pa.array(test.ids[item[new]]), pa.array(start[new] - base), pa.array(start[last] + SPAN - base), pa.array(last - new + 1)], schema=_OUT)

    return run


def _clean_rows(sent, at: int):
    @lean
    def run(batches):
        test = _worker(sent)
        for rows in batches:
            clean = np.ones(rows.num_rows, bool)
            for i, _, w, _ in words(rows.column(at), FOLDED, 4 << 20):
                clean[i + w.row[test.runs(w)[0]]] = False
            yield rows.filter(pa.array(clean))

    return run


def _sent(spark: SparkSession, benchmark: DataFrame) -> list[_Sent]:
    """The benchmark in slices of SLICE_BYTES at most, an item never cut; only one is on the driver at a time."""
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    out, ids, texts, size = [], [], [], 0
    for r in rows.toLocalIterator():
        if ids and size + len(r.text) > SLICE_BYTES:
            out.append(_Sent(spark, ids, texts))
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text)
    return [*out, _Sent(spark, ids, texts)]


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_token, end_token, n_windows): maximal intervals of a document that overlap an item.

    Words are ASCII letters and digits in lower case and all other letters as they stand. A document
    or an item of fewer than SPAN words has no overlap; nor have null or empty texts, and items
    without an id are left out. A null doc_id stays null, rows that stand twice come out twice, items
    that share an id are reported apart where their rows differ, empty tables give no rows. Only
    doc_id, item_id and text are read.
    """
    spark = prepare(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for sent in _sent(spark, benchmark):
        part = narrow.mapInArrow(_scan_rows(sent), _DDL)
        out = part if out is None else out.unionByName(part)
    return out


def without_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that have no overlap; nothing is shuffled."""
    for sent in _sent(prepare(docs.sparkSession), benchmark):
        docs = filter_rows(docs, _clean_rows(sent, docs.columns.index("text")))
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_KEYS = "unnest([" + ", ".join(f"'{a}{b}' || " + " || ' ' || ".join(f"t[p + {k + 1}]" for k in range(SPAN) if k % 4 in (a, b)) for a in range(4) for b in range(a + 1, 4)) + "])"
_EQUAL = " + ".join(f"CAST(d.t[d.p + {k + 1}] = b.t[b.p + {k + 1}] AS INTEGER)" for k in range(SPAN))
SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS t FROM documents),
bw AS (SELECT item_id, {_WORDS} AS t FROM benchmark),
dp AS (SELECT doc_id, t, unnest(range(len(t) - {SPAN - 1})) AS p FROM dw WHERE len(t) >= {SPAN}),
bp AS (SELECT item_id, t, unnest(range(len(t) - {SPAN - 1})) AS p FROM bw WHERE len(t) >= {SPAN}),
bk AS (SELECT item_id, t, p, {_KEYS} AS k FROM bp),
few AS (SELECT DISTINCT k FROM bk),
dk AS (SELECT * FROM (SELECT doc_id, t[p + 1:p + {SPAN}] AS t, 0 AS p, p AS pos, {_KEYS} AS k FROM dp) WHERE k IN (SELECT k FROM few)),
hit AS (SELECT DISTINCT d.doc_id, b.item_id, d.pos FROM dk d JOIN bk b ON d.k = b.k WHERE {_EQUAL} >= {SPAN - MISSES}),
brk AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id, item_id ORDER BY pos) + {SPAN} THEN 0 ELSE 1 END AS x FROM hit),
run AS (SELECT *, sum(x) OVER (PARTITION BY doc_id, item_id ORDER BY pos) AS r FROM brk)
SELECT doc_id, item_id, CAST(min(pos) AS BIGINT) AS start_token, CAST(max(pos) + {SPAN} AS BIGINT) AS end_token, CAST(count(*) AS BIGINT) AS n_windows
FROM run GROUP BY doc_id, item_id, r
"""
