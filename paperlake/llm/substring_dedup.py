"""Repeated token windows (operator 1).

Every window of `width` white-space tokens gets a Rabin-Karp fingerprint of 93 bits: one polynomial
modulo 2**61 - 1 and the low half of another, with bases drawn for the query. Tasks collapse equal
fingerprints of their own rows, the rest travel in packed blocks by fingerprint range, are counted
there, and the places of those that occur twice or more come back by document, where windows that
touch merge into maximal intervals.

Shuffled per window: 12 bytes of fingerprint and about 2 of place; a window that many rows repeat
travels once per task, so no fingerprint range becomes hot. The number of ranges follows the size of
the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.llm.kernels import CHUNK, U, batch, fresh_key, groups_of, words
from paperlake.llm.packing import pack_ints, split_by, unpack_ints
from paperlake.session import prepare

WIDTH = 50
_MOVED = pa.schema([("part", pa.int64()), ("prints", pa.binary()), ("more", pa.binary()), ("docs", pa.binary()), ("places", pa.binary()), ("seen", pa.binary())])
_FOUND = pa.schema([("part", pa.int64()), ("docs", pa.binary()), ("places", pa.binary())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("start_token", pa.int64()), ("end_token", pa.int64()), ("n_windows", pa.int64())])
_DDL = {"_MOVED": "part long, prints binary, more binary, docs binary, places binary, seen binary", "_FOUND": "part long, docs binary, places binary", "_SPANS": "doc_id long, start_token long, end_token long, n_windows long"}


def _shard(docs: np.ndarray, parts: int) -> np.ndarray:
    return ((docs.astype(U) * U(0x9E3779B97F4A7C15)) >> U(40)).astype(np.int64) % parts


def _home(docs: np.ndarray, places: np.ndarray, parts: int) -> list[tuple[int, bytes, bytes]]:
    """Blocks by the document's shard."""
    order, keys, cut = split_by(_shard(docs, parts))
    return [(int(k), pack_ints(docs[o]), pack_ints(places[o])) for k, o in ((k, order[a:b]) for k, a, b in zip(keys, cut[:-1], cut[1:]))]


def _sorted(h: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by both parts of a fingerprint, and where a new one begins in it."""
    order = np.argsort(h, kind="stable")
    x, y = h[order], more[order]
    same = x[1:] == x[:-1]
    if (same & (y[1:] != y[:-1])).any():
        order = np.lexsort((more, h))
        x, y = h[order], more[order]
        same = x[1:] == x[:-1]
    return order, np.r_[True, ~(same & (y[1:] == y[:-1]))] if len(h) else np.zeros(0, bool)


def _hash_rows(width: int, parts: int, key: int):
    def run(batches):
        for rows in batches:
            ids = rows.column(0).to_numpy(zero_copy_only=False)
            for i, j, w, _ in words(rows.column(1), limit=2 * CHUNK, key=key):
                at, h = w.windows(width)
                if not len(at):
                    continue
                more = w.windows(width, 1)[1].astype(np.uint32)
                docs = ids[i:j][w.row[at]].astype(np.int64)
                places = at - w.first[w.row[at]]
                order, new = _sorted(h, more)
                size = np.diff(np.r_[np.flatnonzero(new), len(h)])
                twice = np.zeros(len(h), bool)
                twice[order[new]] = size > 1
                lead = np.zeros(len(h), bool)
                lead[order[new]] = True
                out = [(-1 - k, b"", b"", d, p, b"") for k, d, p in _home(docs[~lead], places[~lead], parts)] if not lead.all() else []
                docs, places, h, more, twice = docs[lead], places[lead], h[lead], more[lead], twice[lead]
                o, keys, cut = split_by(((h >> U(32)) * U(parts) >> U(32)).astype(np.int64))
                for k, a, b in zip(keys, cut[:-1], cut[1:]):
                    x = o[a:b]
                    blocks = h[x].tobytes(), more[x].tobytes(), pack_ints(docs[x]), pack_ints(places[x])
                    out.append((int(k), *blocks, np.packbits(twice[x]).tobytes()))
                yield batch(_MOVED, **dict(zip(_MOVED.names, zip(*out))))

    return run


def _count(parts: int):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part < 0:
            return pa.table([pa.array([-1 - part] * len(table), pa.int64()), table.column("docs"), table.column("places")], schema=_FOUND)
        read = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]
        prints = read("prints", U)
        h, more = np.concatenate(prints), np.concatenate(read("more", np.uint32))
        seen = np.concatenate([np.unpackbits(x)[: len(y)] for x, y in zip(read("seen", np.uint8), prints)]).astype(bool)
        order, new = _sorted(h, more)
        start = np.flatnonzero(new)
        size = np.diff(np.r_[start, len(h)])
        hit = (size > 1) | np.logical_or.reduceat(seen[order], start)
        take = np.sort(order[np.repeat(hit, size)])
        del h, more, order, new
        # Places only of blocks in which something was found.
        docs, places, at = [], [], 0
        for x, d, p in zip(prints, table.column("docs"), table.column("places")):
            lo, hi = np.searchsorted(take, (at, at + len(x)))
            if hi > lo:
                docs.append(unpack_ints(d.as_py())[take[lo:hi] - at])
                places.append(unpack_ints(p.as_py())[take[lo:hi] - at])
            at += len(x)
        found = _home(np.concatenate(docs), np.concatenate(places), parts) if docs else []
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*found), _FOUND)] if found else [pa.array([], f.type) for f in _FOUND], schema=_FOUND)

    return run


def _merge(width: int):
    def run(table: pa.Table) -> pa.Table:
        docs = np.concatenate([unpack_ints(x.as_py()) for x in table.column("docs")])
        places = np.concatenate([unpack_ints(x.as_py()) for x in table.column("places")])
        order = np.lexsort((places, docs))
        docs, places = docs[order], places[order]
        only = np.r_[True, (docs[1:] != docs[:-1]) | (places[1:] != places[:-1])]
        docs, places = docs[only], places[only]
        first = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (places[1:] > places[:-1] + width)])
        last = np.r_[first[1:], len(docs)] - 1
        return pa.table([docs[first], places[first], places[last] + width, last - first + 1], schema=_SPANS)

    return run


def repeated_spans(docs: DataFrame, width: int = WIDTH, parts: int | None = None) -> DataFrame:
    """Maximal token intervals [start_token, end_token) covered by windows that occur twice or more.

    Every copy is listed, the first one too; occurrences inside one document count. Tokens are runs
    without ASCII white space, compared byte for byte. Rows with a null doc_id or text, and texts of
    fewer than `width` tokens, give no interval. A row that stands twice repeats itself, so all of
    it is covered; intervals of rows that share a doc_id are merged. An empty table gives no rows.
    Only doc_id and text are read; other columns don't matter, whatever their names.
    """
    prepare(docs.sparkSession)
    parts = parts or groups_of(docs, 8 << 20)
    narrow = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    moved = narrow.mapInArrow(_hash_rows(width, parts, fresh_key()), _DDL["_MOVED"])
    found = moved.groupBy("part").applyInArrow(_count(parts), _DDL["_FOUND"])
    return found.groupBy("part").applyInArrow(_merge(width), _DDL["_SPANS"])


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0B\x0C\r]+') AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT doc_id, unnest(range(len(t) - 49)) AS pos,
             unnest(list_transform(range(len(t) - 49), lambda i: md5(array_to_string(t[i + 1:i + 50], ' ')))) AS h
      FROM w WHERE len(t) >= 50),
r AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY h) AS c FROM p) WHERE c > 1),
b AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 0 ELSE 1 END AS brk FROM r),
g AS (SELECT doc_id, pos, sum(brk) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM b)
SELECT doc_id, CAST(min(pos) AS BIGINT) AS start_token, CAST(max(pos) + 50 AS BIGINT) AS end_token, CAST(count(*) AS BIGINT) AS n_windows
FROM g GROUP BY doc_id, run
"""
