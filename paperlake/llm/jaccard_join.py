"""N-gram Jaccard join by PartEnum signatures (operator 10).

Documents of one text are one class, found by SHA-256; only each class's first document goes on. It
is its set of hashed word n-grams. Sizes are cut into bands so that sets at `least` or more lie in
one band or in neighbours; for each band a bound k on the symmetric difference follows. The feature
domain is cut into n1 parts of 3 pieces, where 2 * n1 > k: in at least one part two such sets differ
in at most one piece, so their projections on the other two agree. All (part, two pieces)
projections are the signatures.

A projection of few features is shared by strangers without number, and an empty one by all. Those
say nothing and aren't sent: enough() tells how many features a band's projections need. What they
would have found is found by the others: the cut of the domain is a hash, drawn for each query, and
a band is cut anew, independently, until it has parts_of() parts in all. missed() bounds the chance that a pair at the threshold shares no signature
that is sent; it is below 1e-9 in every band, whatever the texts.

All pairs of a bucket are candidates; large buckets are paired in blocks, by other tasks. Distinct
candidates that sketches don't rule out (a lower bound of the difference; the larger a set, the more
counters) are compared on their whole sets, in tasks that get each set once, and give what is asked for: each document's number of links, and edges enough to connect its group.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.llm.kernels import FOLDED, U, Words, batch, buffers, chunks, fresh_key, groups_of, lean, mix, sole
from paperlake.llm.packing import pack_ints, split_by, unpack_ints
from paperlake.session import prepare, shared_dir

N, LEAST = 2, 0.7
PIECES = 3
#: (from this size on, features that a projection needs to be a signature, parts over all independent cuts of the domain).
NEEDS = ((1, 1, 96), (3, 2, 96), (8, 3, 96), (18, 4, 256), (38, 5, 560), (1200, 6, 1700))
#: Documents of a bucket, or of a group, that are paired in one go.
BLOCK = 1024
#: Counters of the sketch that rules out most of the pairs that aren't similar: so many at least, and one for 4 to 8 features.
COUNTERS = 128
#: Ids up to this many are sent to every task (8 bytes each); beyond it they are joined by a shuffle.
SENT_IDS = 2_000_000
_FEATURE_BITS = 44


def bands(least: float, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """(first size of each band, parts n1 of one cut of each band)."""
    low, parts = [1], []
    while low[-1] <= upto:
        high = int(low[-1] / least + 1e-9)
        k = int(2 * high * (1 - least) / (1 + least) + 1e-9)
        parts.append(k // 2 + 1)
        low.append(high + 1)
    high = int(low[-1] / least + 1e-9)
    parts.append(int(2 * high * (1 - least) / (1 + least) + 1e-9) // 2 + 1)
    return np.array(low), np.array(parts)


def enough(low: np.ndarray) -> np.ndarray:
    """Features that a projection needs to be a signature, for bands that begin at these sizes."""
    return np.array([x[1] for x in NEEDS])[np.searchsorted([x[0] for x in NEEDS], low, "right") - 1]


def parts_of(low: np.ndarray) -> np.ndarray:
    """Parts that bands that begin at these sizes have at least, over all cuts."""
    return np.array([x[2] for x in NEEDS])[np.searchsorted([x[0] for x in NEEDS], low, "right") - 1]


def missed(low: int, least: float = LEAST, tries: int = 2000, seed: int = 1) -> float:
    """The chance that sets at the threshold share no signature of the band that begins at `low`, from `tries` cuts of it.

    The most of all sizes that meet in the band and don't have room for equal sets only; beyond small
    bands the smallest and the greatest stand for the rest.
    """
    rng, (starts, parts) = np.random.default_rng(seed), bands(least, low)
    at = int(np.searchsorted(starts, low, "right")) - 1
    n1, need, high = int(parts[at]), int(enough(starts[at : at + 1])[0]), int(starts[at] / least + 1e-9)
    cuts = -(-int(parts_of(starts[at : at + 1])[0]) // n1)
    worst = 0.0
    for t in range(low, high + 1) if high < 20 else (low, high):
        for s in {math.ceil(t * least - 1e-9), t}:
            both, fail = math.ceil((s + t) * least / (1 + least) - 1e-9), 0
            for _ in range(tries):
                common, other = (np.bincount(rng.integers(0, n1 * PIECES, x), minlength=n1 * PIECES).reshape(-1, PIECES) for x in (both, s + t - 2 * both))
                fine = (other.sum(axis=1, keepdims=True) == other) & (common.sum(axis=1, keepdims=True) - common >= need)
                fail += not fine.any()
            worst = max(worst, (fail / tries) ** cuts)
    return worst


def feature_sets(data: np.ndarray, offsets: np.ndarray, n: int, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each row's distinct n-grams, sorted; a text of fewer words has one feature, of no word none."""
    w = Words(data, offsets, FOLDED, key)
    rows, prints = [], []
    size = np.diff(w.first)
    for m in range(1, n + 1):
        at, h = w.windows(m)
        if m < n:  # texts of exactly m words
            own = size[w.row[at]] == m
            at, h = at[own], h[own]
        rows.append(w.row[at])
        prints.append(h)
    row, h = np.concatenate(rows).astype(U), np.concatenate(prints)
    both = np.unique(row << U(_FEATURE_BITS) | h >> U(64 - _FEATURE_BITS))
    return (both >> U(_FEATURE_BITS)).astype(np.int64), mix(both & U((1 << _FEATURE_BITS) - 1))


def signatures(row: np.ndarray, feature: np.ndarray, rows: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of the projections of all rows, for a set's own band and the next; `row` is sorted."""
    size = np.bincount(row, minlength=rows)
    low, parts = bands(least, int(size.max(initial=1)))
    own = np.searchsorted(low, np.maximum(size, 1), "right") - 1
    out_row, out_sig = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    first = np.searchsorted(row, np.arange(rows))
    needs, cuts = enough(low), -(-parts_of(low) // parts)
    for home in np.unique(own[size > 0]).tolist():
        of = np.flatnonzero((own == home) & (size > 0))
        many = size[of]
        f = feature[np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many - first[of], many)]
        weight = (f >> U(12)).astype(float)
        for band in (home, home + 1):
            n1, need = int(parts[band]), int(needs[band])
            cells = n1 * PIECES
            base = np.repeat(np.arange(len(of)) * cells, many)
            for cut in range(int(cuts[band])):
                spread = mix(f + U(((band << 16) + cut + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
                cell = base + ((spread >> U(32)) * U(cells) >> U(32)).astype(np.int64)
                # Sums of equal sets are equal, rounded or not: their features come in one order.
                total = np.bincount(cell, weight, len(of) * cells).astype(U).reshape(-1, PIECES)
                count = np.bincount(cell, minlength=len(of) * cells).reshape(-1, PIECES)
                sum_total, sum_count = total[:, 0] + total[:, 1] + total[:, 2], count[:, 0] + count[:, 1] + count[:, 2]
                tag = mix((U(band) << U(44)) ^ (U(cut) << U(36)) ^ (np.arange(n1, dtype=U) << U(4))[:, None] ^ np.arange(1, PIECES + 1, dtype=U))
                for left_out in range(PIECES):
                    some = np.flatnonzero(sum_count - count[:, left_out] >= need)
                    out_row.append(of[some // n1])
                    out_sig.append(mix((sum_total[some] - total[some, left_out]) ^ tag[some % n1, left_out]))
    return np.concatenate(out_row), np.concatenate(out_sig)


_MOVED = pa.schema([("part", pa.int64()), ("sigs", pa.binary()), ("docs", pa.binary()), ("sizes", pa.binary()), ("own", pa.binary())])
_EDGES = pa.schema([("part", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_SETS = pa.schema([("doc", pa.int64()), ("feats", pa.binary())])
_SKETCH = pa.schema([("doc", pa.int64()), ("size", pa.int64()), ("sketch", pa.binary())])
_LIKELY = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("tree", pa.bool_())])
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _sign_rows(n: int, least: float, parts: int, key: int):
    @lean
    def run(batches):
        sole({})
        for rows in batches:
            ids = rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = buffers(rows.column(1))
            for i, j in chunks(offsets, 4 << 20):
                row, feature = feature_sets(data, offsets[i : j + 1], n, key)
                if not len(row):
                    continue
                size = np.bincount(row, minlength=j - i)
                own, sig = signatures(row, feature, j - i, least)
                sig >>= U(16)
                order = np.argsort(sig)
                own, sig = own[order], sig[order]
                part = ((sig >> U(16)) * U(parts) >> U(32)).astype(np.int64)
                out, kind = [], "<u2" if j - i <= 1 << 16 else "<u4"
                for x in np.split(np.arange(len(sig)), np.flatnonzero(np.diff(part)) + 1):
                    used, local = np.unique(own[x], return_inverse=True)
                    places = kind[-1].encode() + pa.compress(local.astype(kind), "zstd", asbytes=True) + len(x).to_bytes(8, "little")
                    out.append((int(part[x[0]]), pack_ints(sig[x].astype(np.int64)), pack_ints(ids[i + used]), pack_ints(size[used]), places))
                if out:
                    yield batch(_MOVED, **dict(zip(_MOVED.names, zip(*out))))

    return run


def _places_of(own: bytes) -> np.ndarray:
    kind, n = "<u" + own[:1].decode(), int.from_bytes(own[-8:], "little")
    return np.frombuffer(pa.decompress(own[1:-8], n * int(kind[-1]), "zstd"), kind).astype(np.int64)


def _edge_table(rows: list) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _EDGES)] if rows else [pa.array([], f.type) for f in _EDGES], schema=_EDGES)


def _at_home(a: np.ndarray, b: np.ndarray, parts: int) -> list[tuple[int, bytes, bytes]]:
    """Pairs in blocks by the first document's shard."""
    home, keys, cut = split_by((mix(a.astype(U)) >> U(40)).astype(np.int64) % parts)
    return [(int(k), pack_ints(a[home[x:y]]), pack_ints(b[home[x:y]])) for k, x, y in zip(keys, cut[:-1], cut[1:])]


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    new &= a != b
    return a[new], b[new]


def _fits(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of these sizes can reach `least`."""
    return np.minimum(x, y) >= least * np.maximum(x, y) - 1e-9


def _pairs(parts: int, least: float):
    """All pairs of each bucket, with part = the first one's shard; of a large bucket its blocks, with part < 0."""

    def run(table: pa.Table) -> pa.Table:
        sig = np.concatenate([unpack_ints(x.as_py()) for x in table.column("sigs")])
        places = [_places_of(x.as_py()) for x in table.column("own")]
        read = lambda name: np.concatenate([unpack_ints(x.as_py())[p] for x, p in zip(table.column(name), places)])
        doc, size = read("docs"), read("sizes")
        order = np.argsort(sig, kind="stable")
        start = np.flatnonzero(np.r_[True, np.diff(sig[order]) != 0])
        many = np.diff(np.r_[start, len(sig)])
        out, found = [], []
        for k in np.flatnonzero(many > BLOCK):
            members = np.unique(doc[order[start[k] : start[k] + many[k]]])
            blocks = [members[x : x + BLOCK] for x in range(0, len(members), BLOCK)]
            salt = int(sig[order[start[k]]])
            packed = [pack_ints(x) for x in blocks]
            out += [(-1 - int(mix(np.array([salt * 31 + i * 1009 + j], U))[0] >> U(20)) % (4 * parts), packed[i], packed[j]) for i in range(len(blocks)) for j in range(i, len(blocks))]
        take = np.flatnonzero((many > 1) & (many <= BLOCK))
        start, many = start[take], many[take]
        each = many * (many - 1) // 2
        at = 0
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(np.cumsum(each[at:]), 4 << 20, "right")) + at)
            m = many[at:to]
            left = np.arange(m.sum()) + np.repeat(start[at:to] - (np.cumsum(m) - m), m)
            more = np.repeat(start[at:to] + m, m) - left - 1
            x = order[np.repeat(left, more)]
            y = order[np.arange(more.sum()) - np.repeat(np.cumsum(more) - more - left - 1, more)]
            fine = _fits(size[x], size[y], least)
            found.append(_distinct(doc[x[fine]], doc[y[fine]]))
            if sum(len(a) for a, _ in found) > 8 << 20:
                found = [_distinct(*map(np.concatenate, zip(*found)))]
            at = to
        if found:
            out += _at_home(*_distinct(*map(np.concatenate, zip(*found))), parts)
        return _edge_table(out)

    return run


def _cross(parts: int):
    """Pairs of two blocks of a large bucket."""

    @lean
    def run(batches):
        for rows in batches:
            for a, b in zip(rows.column(1), rows.column(2)):
                x, y = unpack_ints(a.as_py()), unpack_ints(b.as_py())
                out = _at_home(*_distinct(np.repeat(x, len(y)), np.tile(y, len(x))), parts)
                yield from _edge_table(out).to_batches()

    return run


def _unite(table: pa.Table) -> pa.Table:
    a = np.concatenate([unpack_ints(x.as_py()) for x in table.column("a")])
    b = np.concatenate([unpack_ints(x.as_py()) for x in table.column("b")])
    return pa.table(_distinct(a, b), schema=_PAIR)


def _set_rows(n: int, key: int):
    @lean
    def run(batches):
        sole({})
        for rows in batches:
            data, offsets = buffers(rows.column(1))
            for i, j in chunks(offsets, 4 << 20):
                row, feature = feature_sets(data, offsets[i : j + 1], n, key)
                at = np.searchsorted(row, np.arange(j - i + 1)).tolist()
                feature = (feature >> U(64 - _FEATURE_BITS)).astype(np.int64)
                yield batch(_SETS, doc=rows.column(0).slice(i, j - i), feats=[pack_ints(np.sort(feature[x:y])) for x, y in zip(at[:-1], at[1:])])

    return run


def sketches(row: np.ndarray, feature: np.ndarray, rows: int) -> list[bytes]:
    """How many features fall into each share of the domain; shares are a power of two, in proportion to the set; empty where a count is beyond a byte."""
    size = np.bincount(row, minlength=rows)
    many = np.maximum(COUNTERS, 1 << np.log2(np.maximum(size // 4, 1)).astype(np.int64))
    base = np.r_[0, np.cumsum(many)]
    count = np.bincount(base[row] + ((feature >> U(17)).astype(np.int64) & (many - 1)[row]), minlength=int(base[-1]))
    full = np.add.reduceat(count > 255, base[:-1]) if rows else np.zeros(0)
    flat = count.astype(np.uint8).tobytes()
    return [b"" if f else flat[x:y] for x, y, f in zip(base[:-1].tolist(), base[1:].tolist(), full.tolist())]


def _sketch_rows(n: int, key: int):
    @lean
    def run(batches):
        sole({})
        for rows in batches:
            data, offsets = buffers(rows.column(1))
            for i, j in chunks(offsets, 4 << 20):
                row, feature = feature_sets(data, offsets[i : j + 1], n, key)
                yield batch(_SKETCH, doc=rows.column(0).slice(i, j - i), size=np.bincount(row, minlength=j - i), sketch=sketches(row, feature, j - i))

    return run


def may_be_similar(sketch: list[bytes], size: np.ndarray, x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which pairs (x, y) of sketched sets their sketches don't rule out; an empty sketch rules nothing out.

    Sets differ in at least as many features as their counters do in sum; the finer sketch is folded.
    """
    many = np.array([len(s) for s in sketch], np.int64)
    out = (many[x] == 0) | (many[y] == 0)
    first = np.r_[0, np.cumsum(many)]
    flat = np.frombuffer(b"".join(sketch), np.uint8)
    x, y = np.where(many[x] <= many[y], x, y), np.where(many[x] <= many[y], y, x)
    fit = ~out & _fits(size[x], size[y], least)
    for c in np.unique(many[x[fit]]).tolist():
        for fold in (1, 2):  # sets that fit have as many counters, or twice as many
            these = np.flatnonzero(fit & (many[x] == c) & (many[y] == fold * c))
            for k in np.split(these, range(step := max(1, (4 << 20) // c), len(these), step)):
                p = flat[first[x[k]][:, None] + np.arange(c)].astype(np.int16)
                q = flat[first[y[k]][:, None] + np.arange(fold * c)].astype(np.int16).reshape(len(k), fold, c).sum(axis=1, dtype=np.int16)
                out[k] = np.abs(p - q).sum(axis=1, dtype=np.int64) <= (size[x[k]] + size[y[k]]) * (1 - least) / (1 + least) + 1e-9
    return out


def forest(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Which edges between numbers below n join two trees, taken in order."""
    root, tree = list(range(n)), np.zeros(len(x), bool)

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for at, (i, j) in enumerate(zip(x.tolist(), y.tolist())):
        p, q = find(i), find(j)
        if p != q:
            root[max(p, q)] = min(p, q)
            tree[at] = True
    return tree


def _likely(least: float):
    """(a, b, tree): a cell's pairs that sketches don't rule out; those with `tree` connect all that these connect."""

    def run(pairs: pa.Table, known: pa.Table) -> pa.Table:
        if not len(pairs) or not len(known):
            return pa.table([pa.array([], f.type) for f in _LIKELY], schema=_LIKELY)
        known = known.sort_by("doc")
        docs, size = known.column("doc").to_numpy(), known.column("size").to_numpy()
        x, y = (np.searchsorted(docs, pairs.column(c).to_numpy()) for c in ("a", "b"))
        # Documents with several texts have no one sketch; their pairs pass.
        sketch = [b"" if n > 1 else s for n, s in zip(known.column("n").to_pylist(), known.column("sketch").to_pylist())]
        fine = may_be_similar(sketch, size, x, y, least)
        x, y = x[fine], y[fine]
        return pa.table([pa.array(docs[x]), pa.array(docs[y]), pa.array(forest(x, y, len(docs)))], schema=_LIKELY)

    return run


def similar(docs: np.ndarray, offsets: np.ndarray, feats: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which pairs (a, b) of documents reach `least`; feats[offsets[i]:offsets[i + 1]] is a set of document docs[i], in order; documents too."""
    out = np.zeros(len(a), bool)
    if not len(a):
        return out
    size = np.diff(offsets)
    a_from, a_to = np.searchsorted(docs, a, "left"), np.searchsorted(docs, a, "right")
    b_from, b_to = np.searchsorted(docs, b, "left"), np.searchsorted(docs, b, "right")
    order = np.argsort(a, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
        for k in range(a_from[run[0]], a_to[run[0]]):  # usually one: the texts of the document
            own = feats[offsets[k] : offsets[k + 1]]
            if not len(own):
                continue
            for part in np.split(run, np.flatnonzero(np.diff(np.cumsum(size[b_from[run]]) >> 20)) + 1):
                texts = b_to[part] - b_from[part]
                of = np.repeat(part, texts)
                t = np.arange(len(of)) - np.repeat(np.cumsum(texts) - texts - b_from[part], texts)
                n = size[t]
                other = np.concatenate([feats[x:y] for x, y in zip(offsets[t].tolist(), offsets[t + 1].tolist())])
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                hits = np.r_[0, np.cumsum(own[at] == other)]
                common = np.diff(hits[np.r_[0, np.cumsum(n)]])
                near = (common > 0) & (common >= least * (len(own) + n - common) - 1e-9)
                out[of[near]] = True
    return out


def _verify(least: float):
    """(a, b, -1) for edges that connect all that is similar, (a, null, n) for a's n links."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        if not len(pairs) or not len(sets):
            return pa.table([pa.array([], f.type) for f in _FOUND], schema=_FOUND)
        a, b = (pairs.column(c).to_numpy().astype(np.int64) for c in ("a", "b"))
        sets = sets.sort_by("doc")
        feats = [unpack_ints(x.as_py()) for x in sets.column("feats")]
        offsets = np.r_[0, np.cumsum([len(x) for x in feats])]
        near = similar(sets.column("doc").to_numpy(), offsets, np.concatenate(feats), a, b, least)
        a, b = a[near], b[near]
        docs, links = np.unique(np.r_[a, b], return_counts=True)
        x, y = np.searchsorted(docs, a), np.searchsorted(docs, b)
        tree = forest(x, y, len(docs))
        x, y = x[tree], y[tree]
        first = pa.array(np.r_[docs[x], docs])
        return pa.table([first, pa.array(np.r_[docs[y], np.zeros(len(docs), np.int64)]), pa.array(np.r_[np.full(len(x), -1), links])], schema=_FOUND)

    return run


class _Work:
    """Steps written into the shared folder, so that lineage ends there."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/jaccard-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.path}/{self.n}")
        return self.spark.read.parquet(f"{self.path}/{self.n}")


def components(edges: DataFrame, keep) -> DataFrame:
    """(doc, root): the least document of each connected component, by alternating large and small stars.

    Each round is one grouping of the edges by either end; the number of rounds grows with the
    logarithm of a component's size. A document all others point to isn't collected into one row.
    """
    # An edge (u, v) has u > v.
    now = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = keep(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        new = keep(small)
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        now, before, changed = new, state, state != before
        if not changed:
            return now.select(F.col("u").alias("doc"), F.col("v").alias("root"))


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))


def _sent(df: DataFrame, rows: int, many: int = SENT_IDS) -> DataFrame:
    """`df` of `rows` rows for a join: sent to all tasks if it is known to be small."""
    return F.broadcast(df) if rows <= many else df


def text_classes(docs: DataFrame, keep) -> DataFrame:
    """(doc, text_hash, first): rows whose text stands more than once, with the least document of that text."""
    hashed = _narrow(docs).select("doc", F.unhex(F.sha2("text", 256)).alias("text_hash"))
    least = keep(hashed.groupBy("text_hash").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return keep(hashed.join(_sent(least, least.count(), SENT_IDS // 4), "text_hash").distinct())


def candidate_pairs(texts: DataFrame, keep, size: int, n: int = N, least: float = LEAST, key: int = 0) -> DataFrame:
    """(a, b), a < b: distinct pairs of documents with a common signature, from (doc, text); `size` is the number of ranges."""
    moved = texts.mapInArrow(_sign_rows(n, least, size, key), "part long, sigs binary, docs binary, sizes binary, own binary")
    found = keep(moved.groupBy("part").applyInArrow(_pairs(size, least), "part long, a binary, b binary"))
    large = found.where("part < 0").repartition("part").mapInArrow(_cross(size), "part long, a binary, b binary")
    return found.where("part >= 0").unionByName(large).groupBy("part").applyInArrow(_unite, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, keep, ranges: int, n: int = N, least: float = LEAST, key: int = 0) -> DataFrame:
    """(a, b, n): with n = -1 edges that connect all similar pairs, with n > 0 a's number of similar documents in one task.

    Pairs that sketches rule out go first, in cells: documents are split by a hash, and pairs meet by
    the two parts of theirs, so that a sketch is sent once for each part its document has pairs with,
    and no row of a pair carries one. The rest meet by connected component, so that each set is sent
    once; components over BLOCK documents are cut into blocks, and pairs meet by two blocks.
    """
    split = max(4, math.isqrt(ranges) * 2)
    side = lambda c: F.expr(f"pmod(xxhash64({c}), {split})")
    celled = pairs.select("a", "b", (F.least(side("a"), side("b")) * split + F.greatest(side("a"), side("b"))).cast("int").alias("cell"))
    asked = keep(celled.select(F.col("cell").alias("at"), F.explode(F.array("a", "b")).alias("doc")).distinct())
    ids = keep(asked.select("doc").distinct())
    some = texts.join(_sent(ids, ids.count()), "doc", "left_semi")
    sketch = some.mapInArrow(_sketch_rows(n, key), "doc long, size long, sketch binary").groupBy("doc").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    known = asked.join(keep(sketch).hint("merge"), "doc").select("at", "doc", "n", "size", "sketch")
    left = keep(celled.groupBy("cell").cogroup(known.groupBy("at")).applyInArrow(_likely(least), "a long, b long, tree boolean"))
    root = components(left.where("tree"), keep)
    left = left.drop("tree")
    label = keep(root.select("doc", F.col("root").alias("label")).unionByName(root.select(F.col("root").alias("doc"), F.col("root").alias("label")).distinct()))
    rows = label.count()
    large = label.groupBy("label").agg(F.count("*").alias("n")).where(f"n > {BLOCK}").select("label", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    home = keep(label.join(large, "label", "left").select("doc", F.xxhash64("label", F.expr("pmod(xxhash64(doc), coalesce(blocks, 1))")).alias("home")))
    at = lambda c: _sent(home.select(F.col("doc").alias(c), F.col("home").alias(f"home_{c}")), rows, SENT_IDS // 2)
    goal = F.expr(f"pmod(xxhash64(least(home_a, home_b), greatest(home_a, home_b)), {8 * ranges})")
    routed = keep(left.join(at("a"), "a").join(at("b"), "b").select("a", "b", goal.alias("range")))
    wanted = keep(routed.select(F.col("range").alias("goal"), F.explode(F.array("a", "b")).alias("doc")).distinct())
    many = wanted.count()
    some = texts.join(_sent(wanted.select("doc").distinct(), many), "doc", "left_semi")
    sets = some.mapInArrow(_set_rows(n, key), "doc long, feats binary").join(_sent(wanted, many, SENT_IDS // 2), "doc")
    return routed.groupBy("range").cogroup(sets.groupBy("goal")).applyInArrow(_verify(least), "a long, b long, n long")


def groups(docs: DataFrame, n: int = N, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """((doc, root), (doc, n_links)): roots of the documents that aren't their group's first, links of all that have some."""
    spark = prepare(docs.sparkSession)
    keep, key, ranges = _Work(spark).keep, fresh_key(), groups_of(docs, 8 << 20)
    classes = text_classes(docs, keep)
    copies = classes.where("doc != first")
    rows = copies.count()
    texts = _narrow(docs)
    if rows:
        gone = copies.select(F.col("doc").alias("gone"), "text_hash")
        same = (F.col("doc") == F.col("gone")) & (F.unhex(F.sha2("text", 256)) == F.col("text_hash"))
        texts = texts.join(_sent(gone, rows, SENT_IDS // 4), same, "left_anti")
    pairs = keep(candidate_pairs(texts, keep, ranges, n, least, key))
    found = keep(verified(pairs, texts, keep, ranges, n, least, key))
    links = found.where("n > 0").groupBy(F.col("a").alias("doc")).agg(F.sum("n").cast("int").alias("n_links"))
    # Copies of texts without words are in no group, as such texts aren't.
    worded = F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    blank = keep(_narrow(docs).where(~worded).select("doc", F.unhex(F.sha2("text", 256)).alias("text_hash")).distinct())
    copies = copies.join(_sent(blank, blank.count(), SENT_IDS // 4), ["doc", "text_hash"], "left_anti")
    edges = found.where("n < 0").select("a", "b").unionByName(copies.select(F.col("doc").alias("a"), F.col("first").alias("b")))
    return components(edges, keep), links.unionByName(copies.join(links, copies["first"] == links["doc"]).select(copies["doc"], "n_links"))


def near_groups(docs: DataFrame, n: int = N, least: float = LEAST) -> DataFrame:
    """(doc_id, kept_doc_id, n_links): each document of a group but its first, with the first.

    Documents are linked if their word n-gram sets have a Jaccard index of `least` or more; a group
    is a connected component, its first is the one with the least doc_id. n_links counts the other
    texts that the document's text is linked to: copies of one text count once, and a text that only
    has exact copies has none. Words are ASCII letters and digits in lower case and all other letters
    as they stand. A text of fewer than n words is compared by all its words. Null, empty and
    wordless texts and null ids are in no group. Rows that share a doc_id are one document with
    several texts; its links are those of any of them, counted by document. An empty table gives no
    rows. Only doc_id and text are read.
    """
    root, links = groups(docs, n, least)
    links = links.groupBy("doc").agg(F.max("n_links").alias("n_links"))
    return root.join(links, "doc", "left").select(F.col("doc").alias("doc_id"), F.col("root").alias("kept_doc_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, n: int = N, least: float = LEAST) -> DataFrame:
    """The rows of `docs`, with all their columns, without the documents that near_groups() lists as not kept."""
    gone = groups(docs, n, least)[0].select(F.col("doc").alias("__gone"))
    return docs.join(_sent(gone, gone.count()), docs["doc_id"].cast("long") == gone["__gone"], "left_anti")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
