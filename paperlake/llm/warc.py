"""WARC archives and revisit resolution (operator 2).

Records are rows; a payload is known by its digest. Only headers (no payload) are shuffled by
digest: each digest's first response is the original, later responses become revisit records that
name it, and revisit records of existing archives are joined with the response that they revisit.
Archives are written from the executors as one gzip member per record, each with fresh headers.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.session import prepare, shared_dir

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payload after which a task starts another archive.
ARCHIVE_BYTES = 1 << 30
DATE = "2020-01-01T00:00:00Z"
RECORD = "record_id string, type string, uri string, date string, digest string, http string, refers_to_id string, refers_to_uri string, refers_to_date string, payload binary"
_NAMES = [c.split()[0] for c in RECORD.split(", ")]
_SCHEMA = pa.schema([(n, pa.binary() if n == "payload" else pa.string()) for n in _NAMES])
_OK = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def sha1(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header's value: line breaks would end it."""
    return " ".join(value.split())


def record_bytes(r: dict) -> bytes:
    """One record with fresh headers: lengths and digests are made from what is written."""
    payload = r["payload"] or b""
    revisit = r["type"] == "revisit"
    http = (r["http"] or "").encode()
    block = http + (b"" if not http else f"Content-Length: {len(payload)}\r\n\r\n".encode()) + (b"" if revisit else payload)
    if revisit:
        block = http + b"\r\n" if http else b""
    head = [("WARC-Type", r["type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["uri"]), ("WARC-Payload-Digest", r["digest"]), ("WARC-Block-Digest", sha1(block))]
    if revisit:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", r["refers_to_id"]), ("WARC-Refers-To-Target-URI", r["refers_to_uri"]), ("WARC-Refers-To-Date", r["refers_to_date"])]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {_clean(v)}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


class _Plain(io.RawIOBase):
    """A gzip file of many members, or a plain file, as one stream of bounded memory."""

    def __init__(self, raw):
        self.raw, self.rest, self.zip = raw, b"", None
        self.held = raw.read(2)
        self.packed = self.held == b"\x1f\x8b"

    def readable(self):
        return True

    def readinto(self, into):
        while not self.rest:
            more = self.held or self.raw.read(1 << 18)
            self.held = b""
            if not more:
                return 0
            if not self.packed:
                self.rest = more
                break
            self.zip = self.zip or zlib.decompressobj(31)
            try:
                self.rest = self.zip.decompress(more)
            except zlib.error:
                return 0  # a damaged end: what came before counts
            if self.zip.eof:
                self.held, self.zip = self.zip.unused_data, None
        n = min(len(into), len(self.rest))
        into[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def parse(raw) -> Iterator[dict]:
    """Records of a WARC file; a record that is cut off is left out, blank lines between records don't matter."""
    stream = io.BufferedReader(_Plain(raw), 1 << 18)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = head.get("content-length", "")
        block = stream.read(int(size) if size.isdigit() else 0)
        if not size.isdigit() or len(block) < int(size):
            continue
        http, cut, payload = block.partition(b"\r\n\r\n") if "application/http" in head.get("content-type", "") else (b"", b"", block)
        lines = [x for x in http.decode("utf-8", "replace").split("\r\n") if x and not x.lower().startswith("content-length:")]
        kind = head.get("warc-type", "unknown")
        yield {
            "record_id": head.get("warc-record-id"), "type": kind, "uri": head.get("warc-target-uri"), "date": head.get("warc-date"),
            "digest": head.get("warc-payload-digest") or (sha1(payload) if kind == "response" else None), "http": "".join(f"{x}\r\n" for x in lines) or None,
            "refers_to_id": head.get("warc-refers-to"), "refers_to_uri": head.get("warc-refers-to-target-uri"), "refers_to_date": head.get("warc-refers-to-date"),
            "payload": None if kind == "revisit" else payload,
        }


def _batches(rows: Iterator[dict], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    some, held = [], 0
    for r in rows:
        some.append(r)
        held += len(r["payload"] or b"")
        if held >= size or len(some) >= 5000:
            yield pa.RecordBatch.from_pylist(some, schema=_SCHEMA)
            some, held = [], 0
    if some:
        yield pa.RecordBatch.from_pylist(some, schema=_SCHEMA)


def _open_rows(batches):
    for rows in batches:
        for path in rows.column(0).to_pylist():
            files, at = pafs.FileSystem.from_uri(path)
            with files.open_input_stream(at, compression=None) as f:
                yield from _batches(parse(f))


def read_archives(paths: DataFrame) -> DataFrame:
    """Records of the archives whose URIs the column `path` has; files are streamed, not held."""
    # Spark takes the records to be as few as the paths; joins of them below are hinted, or it would broadcast them.
    return paths.select(F.col("path").cast("string")).mapInArrow(_open_rows, RECORD)


def page_records(pages: DataFrame) -> DataFrame:
    """A response record for each page. Rows without page_id or html give none; a page that stands twice is one."""
    own = pages.where(F.col("page_id").isNotNull() & F.col("html").isNotNull()).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("uri"), F.col("html").cast("string").cast("binary").alias("payload"))
    digest = F.sha1("payload")
    key = F.md5(F.concat_ws("\n", F.col("page_id").cast("string"), F.coalesce("uri", F.lit("")), digest))
    name = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(key, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    none = F.lit(None).cast("string")
    return own.select("page_id", name.alias("record_id"), F.lit("response").alias("type"), "uri", F.lit(DATE).alias("date"), digest.alias("digest"), F.lit(_OK).alias("http"), none.alias("refers_to_id"), none.alias("refers_to_uri"), none.alias("refers_to_date"), "payload")


def find_originals(heads: DataFrame, order: list[str]) -> DataFrame:
    """(record_id, type, refers_to_id, refers_to_uri, refers_to_date): what each record becomes.

    heads has record headers without payloads. The first response of a digest, by `order` and then
    record_id, stays one; others become revisits of it. Combined before the shuffle, so a payload
    that millions of pages share makes no hot task on its way to the minimum.
    """
    rank = F.struct(*[F.col(c).alias(f"by_{c}") for c in order], "record_id", "uri", "date")
    first = heads.where(F.col("type") == "response").groupBy("digest").agg(F.min(rank).alias("first"))
    own = heads.select("record_id", "type", "digest").distinct()
    joined = own.hint("merge").join(first.hint("merge"), "digest", "left")
    same = F.col("first.record_id") == F.col("record_id")
    later = (F.col("type") == "revisit") | ~same
    to = lambda c: F.when(later, F.col(f"first.{c}"))
    return joined.select("record_id", F.when((F.col("type") == "response") & ~same, "revisit").otherwise(F.col("type")).alias("type"), to("record_id").alias("refers_to_id"), to("uri").alias("refers_to_uri"), to("date").alias("refers_to_date"))


def deduplicate(records: DataFrame, order: list[str]) -> DataFrame:
    """Records with all but the first response of each digest turned into revisits; revisits name their original.

    A revisit whose digest no response has keeps the reference that it came with.
    """
    plan = find_originals(records.drop("payload"), order)
    old = [c for c in ("refers_to_id", "refers_to_uri", "refers_to_date")]
    kept = records.select(*[F.col(c).alias(f"old_{c}") if c in (*old, "type") else F.col(c) for c in _NAMES]).dropDuplicates(["record_id"])
    out = kept.hint("merge").join(plan.hint("merge"), "record_id")
    return out.select(*[(F.when(F.col("type") != "revisit", F.col("payload")).alias("payload") if c == "payload" else F.coalesce(c, f"old_{c}").alias(c) if c in old else F.col(c)) for c in _NAMES])


def _write_rows(folder: str):
    def run(batches):
        # A task that runs again writes the same names anew; names appear only when files are whole.
        task = TaskContext.get()
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        part, out, size, done = 0, None, 0, []
        temporary = ""

        def close():
            nonlocal out
            if out is not None:
                out.close()
                name = f"{root}/part-{task.partitionId():06d}-{part:04d}.warc.gz"
                files.move(temporary, name)
                done.append((f"{folder}/{name.rpartition('/')[2]}", count))
                out = None

        count = 0
        for rows in batches:
            for r in rows.to_pylist():
                if out is None:
                    temporary = f"{root}/.{uuid.uuid4().hex}"
                    out, size, count = files.open_output_stream(temporary, compression=None), 0, 0
                blob = gzip.compress(record_bytes(r), 6, mtime=0)
                out.write(blob)
                size, count = size + len(blob), count + 1
                if size >= ARCHIVE_BYTES:
                    close()
                    part += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    return run


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes records as .warc.gz files below `folder` (a URI that all executors reach); (path, records) of each file.

    The list is kept beside the archives, so that reading it doesn't write them again.
    """
    spark = prepare(records.sparkSession)
    records.select(*_NAMES).mapInArrow(_write_rows(f"{folder}/archives"), "path string, records long").write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records with refers_to_id, refers_to_uri and refers_to_date of the response that each revisit repeats, found by digest."""
    heads = records.drop("payload")
    first = heads.where("type = 'response'").groupBy("digest").agg(F.min(F.struct("date", "record_id", "uri")).alias("first"))
    return records.drop("refers_to_id", "refers_to_uri", "refers_to_date").hint("merge").join(first.hint("merge"), "digest", "left").select(*[c for c in _NAMES if not c.startswith("refers")], *[F.when(F.col("type") == "revisit", F.col(f"first.{c}")).alias(f"refers_to_{n}") for c, n in (("record_id", "id"), ("uri", "uri"), ("date", "date"))])


def resolve_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """(page_id, url, record_type, digest, refers_to_page, payload_bytes) of the pages as deduplicated archives hold them.

    The pages go into archives under `folder`, those that repeat a payload as revisits of the page
    with the least id that has it. The archives are read again and revisits resolved: digest is the
    payload's SHA-1 in hexadecimal, refers_to_page the original's page_id (null for originals), and
    payload_bytes the size of the payload that the record resolves to. Rows without page_id or html
    are not archived; equal rows are one record; a null url stays null; an empty html is a payload of
    0 bytes; an empty table gives no rows. Only page_id, url and html are read.
    """
    spark = prepare(pages.sparkSession)
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    rows = page_records(pages)
    # The digest column is hexadecimal in rows, and so it is in the headers: "sha1:" marks the algorithm.
    manifest = write_archives(deduplicate(rows, ["page_id"]).withColumn("digest", F.concat(F.lit("sha1:"), "digest")), folder)
    back = read_archives(manifest.select("path").repartition(max(1, spark.sparkContext.defaultParallelism)))
    heads = back.select("record_id", "type", "digest", F.length("payload").cast("long").alias("bytes"))
    originals = heads.where("type = 'response'").groupBy("digest").agg(F.first("record_id").alias("of"), F.first("bytes").alias("payload_bytes"))
    ids = rows.select("page_id", F.col("uri").alias("url"), "record_id").distinct()
    resolved = heads.drop("bytes").hint("merge").join(originals.hint("merge"), "digest").hint("merge").join(ids.hint("merge"), "record_id").hint("merge").join(ids.select(F.col("record_id").alias("of"), F.col("page_id").alias("first_page")).hint("merge"), "of")
    return resolved.select("page_id", "url", F.col("type").alias("record_type"), F.substring("digest", 6, 40).alias("digest"), F.when(F.col("type") == "revisit", F.col("first_page")).alias("refers_to_page"), "payload_bytes")


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = """
WITH p AS (SELECT DISTINCT page_id, url, html, sha1(html) AS digest FROM pages WHERE page_id IS NOT NULL AND html IS NOT NULL)
SELECT page_id, url, CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type, digest,
       CASE WHEN page_id > min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to_page, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes
FROM p WINDOW w AS (PARTITION BY digest)
"""
