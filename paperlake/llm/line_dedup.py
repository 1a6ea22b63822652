"""Reversible incremental line dedup (operator 5).

A store holds, for all live documents, a ledger (one row per line), an exact table (one row per
distinct line: how many references, which one is kept) and, per shard of the line keys, a cuckoo
filter. Inserting probes the filters first: only lines that may be known are joined with the exact
table. Deleting takes references away; a line without any leaves table and filter, and one whose
kept copy went gets the next from the ledger. So inserting and then deleting a document leaves the
store as it was.

Lines are compared without spaces, tabs and carriage returns at either end, by a 128-bit key. The
first line by (doc_id, line number) is kept. Blank lines are never dropped.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.llm.kernels import U, mix
from paperlake.session import partitions, prepare, shared_dir

_SLOTS = 4


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; keys are 64-bit and added once each."""

    def __init__(self, capacity: int = 0, cells: np.ndarray | None = None):
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / (_SLOTS * 0.75)))))
        self.cells = np.zeros((buckets, _SLOTS), np.uint16) if cells is None else cells

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys.astype(U))
        mark = np.maximum((h >> U(48)).astype(np.uint16), 1)
        one = (h & U(len(self.cells) - 1)).astype(np.int64)
        return mark, one, self._other(one, mark)

    def _other(self, bucket, mark):
        return bucket ^ (mix(np.atleast_1d(mark).astype(U)) & U(len(self.cells) - 1)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._place(keys)
        return ((self.cells[one] == mark[:, None]) | (self.cells[two] == mark[:, None])).any(axis=1)

    def add(self, keys: np.ndarray) -> bool:
        """False: it is full, and its content no longer complete."""
        mark, one, two = self._place(keys)
        left = np.arange(len(keys))
        for bucket in (one, two):  # whole batches first: as many into each bucket as are free
            order = left[np.argsort(bucket[left], kind="stable")]
            b = bucket[order]
            start = np.r_[True, b[1:] != b[:-1]] if len(b) else np.zeros(0, bool)
            rank = np.arange(len(b)) - np.maximum.accumulate(np.where(start, np.arange(len(b)), 0))
            free = np.argsort(self.cells[b] != 0, axis=1, kind="stable")
            fits = rank < (self.cells[b] == 0).sum(axis=1)
            self.cells[b[fits], free[fits, rank[fits]]] = mark[order[fits]]
            left = order[~fits]
        for x in left:
            bucket, m = int(one[x]), mark[x]
            for kick in range(500):
                row = self.cells[bucket]
                empty = np.flatnonzero(row == 0)
                if len(empty):
                    row[empty[0]] = m
                    break
                slot = (kick + int(m)) % _SLOTS
                row[slot], m = m, row[slot].copy()
                bucket = int(self._other(np.array([bucket]), m)[0])
            else:
                return False
        return True

    def remove(self, keys: np.ndarray) -> None:
        mark, one, two = self._place(keys)
        for m, a, b in zip(mark, one, two):
            for bucket in (a, b):
                at = np.flatnonzero(self.cells[bucket] == m)
                if len(at):
                    self.cells[bucket, at[0]] = 0
                    break

    def __len__(self) -> int:
        return int((self.cells != 0).sum())

    def dump(self) -> bytes:
        return struct.pack("<q", len(self.cells)) + self.cells.tobytes()

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        (n,) = struct.unpack_from("<q", blob)
        return cls(cells=np.frombuffer(blob, np.uint16, offset=8).reshape(n, _SLOTS).copy())


_FILTER = pa.schema([("shard", pa.int32()), ("cells", pa.binary()), ("full", pa.bool_())])
_FILTER_DDL = "shard int, cells binary, full boolean"
_PROBE = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("maybe", pa.bool_())])


def _keys(table: pa.Table) -> np.ndarray:
    k1, k2 = (table.column(c).to_numpy().astype(np.int64).view(U) for c in ("k1", "k2"))
    return k1 ^ mix(k2)


def _build(table: pa.Table) -> pa.Table:
    keys = _keys(table)
    spare = 2 * len(keys)
    f = CuckooFilter(spare)
    while not f.add(keys):
        spare *= 2
        f = CuckooFilter(spare)
    return pa.table([pa.array([table.column("shard")[0].as_py()], pa.int32()), [f.dump()], [False]], schema=_FILTER)


def _probe(rows: pa.Table, filters: pa.Table) -> pa.Table:
    maybe = CuckooFilter.load(filters.column("cells")[0].as_py()).has(_keys(rows)) if len(filters) and len(rows) else np.zeros(len(rows), bool)
    return pa.table([rows.column("k1"), rows.column("k2"), maybe], schema=_PROBE)


def _change(add: bool):
    def run(rows: pa.Table, filters: pa.Table) -> pa.Table:
        if not len(filters):
            return _build(rows)
        if not len(rows):
            return filters.select(_FILTER.names).cast(_FILTER)
        f = CuckooFilter.load(filters.column("cells")[0].as_py())
        full = not f.add(_keys(rows)) if add else f.remove(_keys(rows)) is not None
        return pa.table([pa.array([rows.column("shard")[0].as_py()], pa.int32()), [f.dump()], [full]], schema=_FILTER)

    return run


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, version, line_no, k1, k2, blank): version tells texts under one doc_id apart."""
    own = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    key = line_key(F.col("line"))
    blank = key == ""
    # Blank lines get keys of their own: they meet nothing in the table, and spread over the shards.
    k1 = F.when(blank, F.xxhash64("doc_id", "version", "line_no")).otherwise(F.xxhash64(key))
    return own.select("doc_id", "version", "line_no", k1.alias("k1"), F.xxhash64(F.lit(7), key).alias("k2"), blank.alias("blank"))


class LineStore:
    """The store under one folder; every change writes a new version and leaves the old one readable."""

    def __init__(self, spark: SparkSession, path: str, shards: int | None = None):
        self.spark, self.path, self.version = prepare(spark), path, 0
        self.shards = shards or max(16, 4 * partitions(spark))

    def _read(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/{name}/v{self.version}") if self.version else None

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        to = f"{self.path}/{name}/v{self.version + 1}"
        df.write.mode("overwrite").parquet(to)
        return self.spark.read.parquet(to)

    @property
    def ledger(self) -> DataFrame:
        return self._read("ledger")

    @property
    def table(self) -> DataFrame:
        return self._read("table")

    @property
    def filters(self) -> DataFrame:
        return self._read("filters")

    def _tally(self, lines: DataFrame) -> DataFrame:
        """References and kept place by line; combined before the shuffle, so a line that all share is no hot key."""
        shard = F.pmod(F.col("k1"), F.lit(self.shards)).cast("int")
        return lines.where(~F.col("blank")).groupBy("k1", "k2").agg(F.count("*").alias("refs"), F.min(F.struct("doc_id", "version", "line_no")).alias("kept")).withColumn("shard", shard)

    def insert(self, docs: DataFrame) -> LineStore:
        """Adds documents; rows that are in the store already (same doc_id and text) are left out."""
        lines = document_lines(docs).distinct()
        old = self.ledger
        if old is not None:
            known = old.select(F.col("doc_id").alias("d"), F.col("version").alias("v")).distinct()
            lines = lines.join(known, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left_anti")
        if old is None:
            ledger = self._write(lines, "ledger")
            table = self._write(self._tally(ledger), "table")
            self._write(self._filters_of(table), "filters")
        else:
            fresh = self.spark.read.parquet(self._stage(lines, "lines"))
            self._write(old.unionByName(fresh), "ledger")
            new = self._tally(fresh)
            probed = new.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_probe, "k1 long, k2 long, maybe boolean")
            new = self.spark.read.parquet(self._stage(new.join(probed, ["k1", "k2"]), "probed"))
            may = new.where("maybe").drop("maybe")
            # The filters are right when they say no: those lines skip the exact table.
            hit = self.table.join(may.select("k1", "k2"), ["k1", "k2"], "left_semi")
            merged = hit.unionByName(may).groupBy("k1", "k2", "shard").agg(F.sum("refs").alias("refs"), F.min("kept").alias("kept"))
            rest = self.table.join(may.select("k1", "k2"), ["k1", "k2"], "left_anti")
            table = self._write(rest.unionByName(merged).unionByName(new.where("not maybe").drop("maybe")), "table")
            added = new.join(self.table.select("k1", "k2"), ["k1", "k2"], "left_anti")
            self._refilter(added, table, add=True)
        self.version += 1
        return self

    def delete(self, doc_ids: DataFrame) -> LineStore:
        """Takes out all documents with these ids; a null id takes out the documents without one."""
        ids = doc_ids.select(F.col("doc_id").cast("long").alias("gone")).distinct()
        same = F.col("doc_id").eqNullSafe(F.col("gone"))
        gone = self._tally(self.ledger.join(ids, same, "left_semi")).select("k1", "k2", F.col("refs").alias("less"))
        ledger = self._write(self.ledger.join(ids, same, "left_anti"), "ledger")
        left = self.spark.read.parquet(self._stage(self.table.join(gone, ["k1", "k2"], "left").withColumn("less", F.coalesce("less", F.lit(0))), "left"))
        touched = left.where("less > 0 and refs > less").select("k1", "k2")
        kept = self._tally(ledger.join(touched, ["k1", "k2"], "left_semi"))
        table = self._write(left.where("less = 0").drop("less").unionByName(kept), "table")
        self._refilter(left.where("refs <= less").drop("less"), table, add=False)
        self.version += 1
        return self

    def _stage(self, df: DataFrame, name: str) -> str:
        to = f"{self.path}/stage/{name}-{self.version}"
        df.write.mode("overwrite").parquet(to)
        return to

    def _filters_of(self, table: DataFrame) -> DataFrame:
        return table.select("shard", "k1", "k2").groupBy("shard").applyInArrow(_build, _FILTER_DDL)

    def _refilter(self, rows: DataFrame, table: DataFrame, add: bool) -> None:
        changed = rows.select("shard", "k1", "k2").groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_change(add), _FILTER_DDL)
        if self._write(changed, "filters").where("full").limit(1).count():
            self._write(self._filters_of(table), "filters")

    def dropped(self) -> DataFrame:
        """(doc_id, version, drops): for each live document one flag per line."""
        kept = self.table.where("refs > 1").select("k1", "k2", "kept")
        here = F.struct("doc_id", "version", "line_no")
        lines = self.ledger
        flagged = lines.join(kept, ["k1", "k2"], "left").select("doc_id", "version", "line_no", (F.col("kept").isNotNull() & ~F.col("blank") & ~here.eqNullSafe(F.col("kept"))).alias("drop"))
        return flagged.groupBy("doc_id", "version").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "drop"))), lambda x: x["drop"]).alias("drops"))

    def dedup(self, docs: DataFrame) -> DataFrame:
        """The given documents as (row, kept_text, n_lines, n_removed); row has all their columns."""
        rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"].cast("string")).alias("v"), docs["text"].cast("string").alias("t"))
        flags = self.dropped()
        joined = rows.join(flags, rows["id"].eqNullSafe(flags["doc_id"]) & (rows["v"] == flags["version"]) & rows["t"].isNotNull(), "left")
        lines = F.split("t", "\n")
        kept = F.filter(lines, lambda _, i: ~F.get("drops", i))
        return joined.select("row", F.array_join(kept, "\n").alias("kept_text"), F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(kept)).cast("long").alias("n_removed"))


def _fresh_store(spark: SparkSession) -> LineStore:
    return LineStore(spark, f"{shared_dir(spark)}/line-store-{uuid.uuid4().hex}")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) of every row, lines that stand earlier in the corpus dropped.

    A null text stays null, with null counts; an empty one has one blank line. Rows with one doc_id
    and one text are one document and come out alike; other texts under that doc_id are documents of
    their own, ordered by a fingerprint of the text. A null doc_id sorts first. Ties don't exist:
    (doc_id, fingerprint, line number) is unique. An empty table gives no rows.
    """
    out = _fresh_store(docs.sparkSession).insert(docs).dedup(docs)
    counted = lambda c: F.when(F.col("row.text").isNotNull(), F.col(c)).alias(c)
    return out.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("kept_text").alias("text"), counted("n_lines"), counted("n_removed"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with all their columns, text and n_chars being what dedup_lines() leaves.

    A document that loses lines and keeps none but blank ones is left out.
    """
    out = _fresh_store(docs.sparkSession).insert(docs).dedup(docs)
    out = out.where(F.col("n_removed").isNull() | (F.col("n_removed") == 0) | (F.btrim("kept_text", F.lit(" \t\r\n")) != ""))
    own = {"text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    return out.select(*[own.get(f.name, F.col("row").getField(f.name)).cast(f.dataType).alias(f.name) for f in docs.schema])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM l),
d AS (SELECT *, CASE WHEN key = '' THEN 1 ELSE row_number() OVER (PARTITION BY key ORDER BY doc_id, n) END AS r FROM k)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE r = 1), '') AS text, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE r > 1) AS BIGINT) AS n_removed
FROM d GROUP BY doc_id
"""
