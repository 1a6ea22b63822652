"""Quality by a log-likelihood ratio of n-gram multinomials (operator 6).

Two multinomials over word n-grams are counted over all documents: one of the trusted target
(documents with a good label), one of the raw corpus. A document's score is the mean, over its
n-grams, of the log ratio of the two; it is kept when that is at least `threshold`.

The model grows with the corpus: every n-gram that occurs FREQUENT times or more has an exact count
of its own. Rarer ones, too rare to tell the two apart, share hashed buckets; so do all of them while
there are no more of them than buckets.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.llm.kernels import CHUNK, EXACT, U, batch, words
from paperlake.llm.packing import pack_ints, unpack_ints
from paperlake.session import partitions, prepare, shared_dir

BUCKETS, ORDERS, SMOOTHING, THRESHOLD = 1 << 16, (1, 2), 1.0, -0.06
FREQUENT = 64
#: N-grams of one file of the model; a task holds one file at a time, and several are read once for SPAN bytes of text.
SLICE, SPAN = 4_000_000, 16 << 20
#: Trusted ids up to this many are sent to every task (8 bytes each); beyond it they are joined by a shuffle.
SENT_IDS = 4_000_000
_MOVED = pa.schema([("part", pa.int64()), ("grams", pa.binary()), ("target", pa.binary()), ("raw", pa.binary())])
_COUNT = pa.schema([("gram", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("target", pa.int64()), ("raw", pa.int64())])
_SCORE = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("score", pa.float64()), ("keep", pa.bool_())])


def grams(w, orders=ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """(row, 48-bit fingerprint) of every n-gram."""
    rows, prints = [], []
    for n in orders:
        at, h = w.windows(n)
        rows.append(w.row[at])
        prints.append(h >> U(16))
    return np.concatenate(rows), np.concatenate(prints)


def bucket_of(gram: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    return ((gram >> U(16)) * U(buckets) >> U(32)).astype(np.int64)


def features(w, orders=ORDERS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram."""
    row, gram = grams(w, orders)
    return row, bucket_of(gram, buckets)


def _sums(gram: np.ndarray, target: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams in order, with their sums."""
    order = np.argsort(gram, kind="stable")
    gram = gram[order]
    start = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, np.int64)
    add = lambda x: np.add.reduceat(x[order], start) if len(start) else np.zeros(0, np.int64)
    return gram[start], add(target), add(raw)


def _count_rows(orders, parts):
    def run(batches):
        held, size = [], 0

        def moved():
            gram, target, raw = _sums(*map(np.concatenate, zip(*held)))
            part = ((gram >> U(16)) * U(parts) >> U(32)).astype(np.int64)
            cut = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
            out = [(int(part[x]), pack_ints(gram[x:y].astype(np.int64)), pack_ints(target[x:y]), pack_ints(raw[x:y])) for x, y in zip(cut[:-1], cut[1:])]
            return batch(_MOVED, **dict(zip(_MOVED.names, zip(*out))))

        for rows in batches:
            trusted = rows.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j, w, _ in words(rows.column(0), EXACT):
                row, gram = grams(w, orders)
                if len(gram):
                    held.append(_sums(gram, trusted[i:j][row].astype(np.int64), np.ones(len(gram), np.int64)))
                    size += len(held[-1][0])
                if size > SLICE:
                    yield moved()
                    held, size = [], 0
        if held:
            yield moved()

    return run


def _merge(buckets: int, frequent: int):
    """Frequent n-grams by themselves, the others by bucket; n: how many distinct ones a row stands for."""

    def run(table: pa.Table) -> pa.Table:
        gram, target, raw = (np.concatenate([unpack_ints(x.as_py()) for x in table.column(c)]) for c in ("grams", "target", "raw"))
        gram, target, raw = _sums(gram.astype(U), target, raw)
        bucket = bucket_of(gram, buckets)
        often = raw >= frequent
        # within a part buckets are in order
        b = bucket[~often]
        start = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
        add = lambda x: np.add.reduceat(x, start) if len(start) else np.zeros(0, np.int64)
        k = int(often.sum())
        return pa.table(
            [
                pa.array(np.r_[gram[often].astype(np.int64), np.zeros(len(start), np.int64)], mask=np.arange(k + len(start)) >= k),
                pa.array(np.r_[bucket[often], b[start]].astype(np.int32)),
                pa.array(np.r_[np.ones(k, np.int64), add(np.ones(len(b), np.int64))]),
                pa.array(np.r_[target[often], add(target[~often])]),
                pa.array(np.r_[raw[often], add(raw[~often])]),
            ],
            schema=_COUNT,
        )

    return run


def _slices(files: list[str], ratio):
    """(n-grams in order, their log ratios) of each file of the model; a single one is kept."""
    kept = []

    def read(uri):
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        with fs.open_input_file(path) as f:
            t = pyarrow.parquet.read_table(f)
        gram = t["gram"].to_numpy().astype(U)
        order = np.argsort(gram)
        return gram[order], ratio(t["target"].to_numpy(), t["raw"].to_numpy())[order]

    def run():
        if len(files) > 1:
            return map(read, files)
        if not kept:
            kept.extend(map(read, files))
        return kept

    return run


def _score_rows(orders, buckets, model, files, ratio, threshold):
    def run(batches):
        weights, slices = model.value, _slices(files, ratio)
        for rows in batches:
            texts = rows.column(1)
            n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for i, j, w, _ in words(texts, EXACT, CHUNK if len(files) < 2 else SPAN):
                row, gram = grams(w, orders)
                value = weights[bucket_of(gram, buckets)]
                for own, log_ratio in slices():
                    if len(own):
                        at = np.minimum(np.searchsorted(own, gram), len(own) - 1)
                        value = np.where(own[at] == gram, log_ratio[at], value)
                n[i:j] = np.bincount(row, minlength=j - i)
                total[i:j] = np.bincount(row, value, minlength=j - i)
            score = total / np.maximum(n, 1)
            none = (n == 0) | ~np.array(texts.is_valid())
            keep = ~none & (score >= threshold)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), pa.array(score, mask=none), pa.array(keep)], schema=_SCORE)

    return run


def count_ngrams(docs: DataFrame, trusted: DataFrame, orders=ORDERS, buckets: int = BUCKETS, frequent: int = FREQUENT) -> DataFrame:
    """(gram, bucket, n, target, raw) counts over all documents, exact: a row for each n-gram that occurs `frequent`
    times or more, and rows without `gram` for the n others of a bucket; trusted: doc_id of the target's documents."""
    good = trusted.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("good")).distinct()
    ids = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    if good.limit(SENT_IDS + 1).count() <= SENT_IDS:
        good = F.broadcast(good)
    marked = ids.join(good, F.col("id") == F.col("good"), "left").select("text", F.col("good").isNotNull().alias("trusted"))
    parts = max(16, 4 * partitions(prepare(docs.sparkSession)))
    moved = marked.mapInArrow(_count_rows(orders, parts), "part long, grams binary, target binary, raw binary")
    return moved.groupBy("part").applyInArrow(_merge(buckets, frequent), "gram long, bucket int, n long, target long, raw long")


class Ratios:
    """Log ratio of counts; both multinomials, of `size` n-grams and buckets, are smoothed towards the raw corpus."""

    def __init__(self, target: int, raw: int, size: int, smoothing: float = SMOOTHING):
        self.target, self.raw, self.size, self.smoothing = target, raw, size, smoothing

    def __call__(self, target: np.ndarray, raw: np.ndarray) -> np.ndarray:
        if not self.target:
            return np.zeros(len(raw))
        base = (raw + self.smoothing) / (self.raw + self.smoothing * self.size)
        strength = self.smoothing * self.size * self.target / max(self.raw, 1)
        return np.log((target + strength * base) / (self.target + strength) / base)


def score_documents(docs: DataFrame, trusted: DataFrame, orders=ORDERS, buckets: int = BUCKETS, threshold: float = THRESHOLD, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_features, score, keep) of every row.

    Null, empty and blank texts have no n-gram: n_features 0, score null, keep false. Without any
    trusted document every score is 0. A score equal to the threshold is kept. Rows that stand twice
    count twice and come out twice; a null doc_id stays null and is never trusted; an empty table
    gives no rows. Columns other than doc_id and text are not read. The counts of frequent n-grams
    stay in files of the shared folder, which tasks read slice by slice; only the buckets' go to the driver.
    """
    spark = prepare(docs.sparkSession)
    path = f"{shared_dir(spark)}/ngrams-{uuid.uuid4().hex}"
    count_ngrams(docs, trusted, orders, buckets, frequent).write.parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "target", "raw")], F.count("gram")).first()
    distinct, target, raw, own = map(int, sums)
    files = []
    if distinct <= buckets:  # they stay in their buckets
        own, shared = 0, counts
    else:
        shared = counts.where("gram IS NULL")
    if own:
        counts.where("gram IS NOT NULL").select("gram", "target", "raw").repartition(-(-own // SLICE), "gram").write.parquet(f"{path}/own")
        files = sorted(spark.read.parquet(f"{path}/own").inputFiles())
    ratio = Ratios(target, raw, buckets + own)
    got = shared.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toPandas()
    seen = np.zeros((2, buckets))
    seen[0, got["bucket"]], seen[1, got["bucket"]] = got["target"], got["raw"]
    model = spark.sparkContext.broadcast(ratio(*seen))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_score_rows(orders, buckets, model, files, ratio, threshold), "doc_id long, n_features long, score double, keep boolean")


def trusted_documents(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and toxic = 0").select("doc_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), trusted_documents(spark.read.parquet(f"{sf_dir}/labels.parquet")))
