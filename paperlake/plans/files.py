"""Queries that write documents as PDF files and read them with the kernel, and those of scalar functions."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.functions import text as fn
from paperlake.operators.pages import changes, code_points, letters, number, unions
from paperlake.session import by_path, parts, prepare
from paperlake.sources.reader import Corpus, LaidOut, parse_properties
from paperlake.sources.writer import text_pdf

COLUMNS, ROWS = 60, 50


#: Bytes of files that are sent at once.
_SENT = 4 << 20


def _write_rows(batches):
    for rows in batches:
        paths, files, size = [], [], 0
        for path, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            flat = text.replace("\n", " ")
            lines = [flat[i : i + COLUMNS] for i in range(0, len(flat), COLUMNS)]
            paths.append(path)
            files.append(text_pdf([lines[i : i + ROWS] for i in range(0, len(lines), ROWS)] or [[]], title=text[:20]))
            size += len(files[-1])
            if size > _SENT:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(files, pa.binary())], names=["path", "content"])
                paths, files, size = [], [], 0
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(files, pa.binary())], names=["path", "content"])


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): each document as a PDF of 60 x 50 characters a page; those of one path follow each other."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return by_path(docs.select(F.col("doc_id").cast("string").alias("path"), "text"), docs).mapInArrow(_write_rows, "path string, content binary")


def _corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus.of(document_files(spark, sf_dir), include_images=False)


def pdf_documents(spark, sf_dir):
    """Each file has a title, the beginning of its text; an empty one, which metadata doesn't tell from none, is an empty string."""
    title = F.when(F.col("error").isNull(), F.coalesce("metadata.title", F.lit(""))).alias("title")
    return parse_properties(document_files(spark, sf_dir)).select("path", "page_count", "pdf_version", "is_encrypted", "is_linearized", title, "error")


def _counted(own: LaidOut):
    """The characters of each page: number, extent, sums of their places, and a hash of the text.

    Documents of one path follow each other, so all of a page's characters are here; they lie upon each other.
    An empty document has a row without a page that counts the document, as in the SQL.
    """
    paths = own.paths.to_pylist()
    doc = np.cumsum([k > 0 and p != paths[k - 1] for k, p in enumerate(paths)])
    file = np.cumsum(own.numbers == 0) - 1
    page, text, box = own.page, own.text, own.box
    if len(doc) and file[-1] > doc[-1]:
        codes = code_points("".join(text.to_pylist()))
        order = np.lexsort((codes, number(changes(page)), own.numbers[page], doc[page]))
        page, text, box = page[order], letters(codes[order]), [v[order] for v in box]
    at = np.flatnonzero(changes(doc[page], own.numbers[page]))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(at, len(page)), pa.int32()), text), "")
    hashes = [md5(t.as_buffer(), usedforsecurity=False).hexdigest() for t in joined.cast(pa.binary())]
    sums = [np.add.reduceat(v, at) if len(at) else v for v in box[:2]]
    empty = np.flatnonzero((own.numbers == 0) & (np.bincount(file, np.bincount(own.page, minlength=own.count))[file] == 0)) if len(doc) else at
    first = empty[changes(doc[empty])]
    counts = np.append(np.diff(np.append(at, len(page))), np.bincount(doc[empty])[doc[first]] if len(empty) else first)
    numbers = [pa.array(np.append(v, np.zeros(len(first))), mask=np.arange(len(at) + len(first)) >= len(at)) for v in (*unions(box, at), *sums)]
    own.hidden = np.isin(np.arange(own.count), first)
    return np.append(page[at], first), counts, *numbers, pa.array(hashes + [md5(b"", usedforsecurity=False).hexdigest()] * len(first), pa.string())


def pdf_chars(spark, sf_dir):
    return _corpus(spark, sf_dir).laid_out("path string, page long, n long, x0 double, y0 double, x1 double, y1 double, sum_x0 double, sum_y0 double, content string", _counted)


def pdf_page_text(spark, sf_dir):
    """Text of the pages, through files, kernel and layout, in one pass."""
    return _corpus(spark, sf_dir).page_text


def pdf_corpus_report(spark, sf_dir):
    """Documents and pages by number of pages, and percentiles of their length."""
    c = parse_properties(document_files(spark, sf_dir))
    return c.agg(F.count("*").alias("n"), F.sum("page_count").alias("pages"), F.avg("page_count").alias("mean"), F.percentile("page_count", F.lit(0.5)).alias("p50"), F.percentile("page_count", F.lit(0.95)).alias("p95"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def font_flags(spark, sf_dir):
    """Flags of font names made of part names and types."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    style = F.element_at(F.array(*map(F.lit, ("Times-BoldItalic", "Courier", "ABCDEF+SansSerif-Oblique", "Georgia-Heavy", "Helvetica", "DejaVuSansMono"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    name = F.concat(F.col("p_brand"), F.lit("+"), style)
    return part.select("p_partkey", fn.bare_font(name).alias("bare"), fn.font_flags(name, F.col("p_size")).cast("long").alias("flags"))


def text_similarity(spark, sf_dir):
    """Word and trigram scores of each turn of a conversation against the one before."""
    from pyspark.sql import Window

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    apart = turns.select("conv_id", "turn", "text").repartition(parts(turns), "conv_id")
    before = apart.withColumn("wanted", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("wanted IS NOT NULL")
    text, wanted = F.col("text"), F.col("wanted")
    scored = before.select("conv_id", "turn", fn.set_scores(fn.words(text), fn.words(wanted)).alias("w"), fn.trigram_jaccard(text, wanted).alias("t"), fn.replacements(text).cast("long").alias("undecoded"))
    return scored.select("conv_id", "turn", *[F.round(F.col("w")[k], 9).alias(k) for k in ("precision", "recall", "jaccard")], F.round("t", 9).alias("trigram"), "undecoded")


def affine_boxes(spark, sf_dir):
    """Boxes under a turn and a scale, and packed colours, from order lines."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    m = [F.lit(v) for v in (0.0, 2.0, -2.0, 0.0, 5.0, 7.0)]
    box = fn.transformed_box(m, [F.lit(0.0), F.lit(0.0), F.col("l_quantity"), F.col("l_linenumber").cast("double")])
    colour = fn.rgb(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 100)
    return li.select("l_orderkey", "l_linenumber", *[b.alias(n) for b, n in zip(box, ("x0", "y0", "x1", "y1"))], colour.alias("colour"))


_FLAT = "replace(text, chr(10), ' ')"
_PAGES = f"""
d AS (SELECT CAST(doc_id AS VARCHAR) AS path, {_FLAT} AS t, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT path, t, text, CAST(greatest(ceil(length(t) / 3000), 1) AS BIGINT) AS n FROM d)"""
QUERIES = {f.__name__: f for f in (pdf_documents, pdf_chars, pdf_page_text, pdf_corpus_report, font_flags, text_similarity, affine_boxes)}
ORACLE_SQL = {
    "pdf_documents": f"WITH {_PAGES} SELECT path, n AS page_count, '1.4' AS pdf_version, false AS is_encrypted, false AS is_linearized, substr(text, 1, 20) AS title, CAST(NULL AS VARCHAR) AS error FROM p",
    "pdf_corpus_report": f"WITH {_PAGES} SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS pages, avg(n) AS mean, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.95) AS p95, CAST(0 AS BIGINT) AS failed FROM p",
    "pdf_chars": f"""WITH {_PAGES},
q AS (SELECT path, unnest(string_split(t, '')) AS c, unnest(range(length(t))) AS i FROM p),
x AS (SELECT path, i // 3000 AS page, i, c, CAST(72 + 6 * (i % 60) AS DOUBLE) AS x0, CAST(720 - 14 * (i % 3000 // 60) AS DOUBLE) AS y0 FROM q)
SELECT path, page, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x0) + 6 AS x1, max(y0) + 10 AS y1, sum(x0) AS sum_x0, sum(y0) AS sum_y0, md5(string_agg(c, '' ORDER BY i)) AS content FROM x GROUP BY path, page""",
    "pdf_page_text": f"""WITH {_PAGES},
g AS (SELECT path, n, unnest(range(n)) AS page, t FROM p),
l AS (SELECT path, page, substr(t, CAST(page * 3000 + k * 60 + 1 AS BIGINT), CAST(60 AS BIGINT)) AS line, k FROM (SELECT path, page, t, unnest(range(50)) AS k FROM g)),
f AS (SELECT path, page, string_agg(line || chr(10), '' ORDER BY k) || chr(10) AS text FROM l WHERE length(line) > 0 GROUP BY path, page)
SELECT g.path, g.page, coalesce(f.text, '') AS text FROM g LEFT JOIN f USING (path, page)""",
    "font_flags": """WITH f AS (SELECT p_partkey, p_size, ['Times-BoldItalic', 'Courier', 'ABCDEF+SansSerif-Oblique', 'Georgia-Heavy', 'Helvetica', 'DejaVuSansMono'][p_partkey % 6 + 1] AS s FROM part),
b AS (SELECT p_partkey, p_size, s AS bare, lower(s) AS n FROM f)
SELECT p_partkey, bare, CAST(CASE WHEN regexp_matches(n, 'italic|oblique') OR p_size & 64 <> 0 THEN 2 ELSE 0 END
 + CASE WHEN regexp_matches(n, 'times|serif|georgia|garamond|roman') AND NOT contains(n, 'sans') OR p_size & 2 <> 0 THEN 4 ELSE 0 END
 + CASE WHEN regexp_matches(n, 'courier|mono|consol|typewriter') OR p_size & 1 <> 0 THEN 8 ELSE 0 END
 + CASE WHEN regexp_matches(n, 'bold|black|heavy') OR p_size & 262144 <> 0 THEN 16 ELSE 0 END AS BIGINT) AS flags FROM b""",
    "text_similarity": r"""WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS wanted FROM conversations),
w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda z: z <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(wanted), '\s+'), lambda z: z <> '')) AS b,
 list_distinct(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3))) AS x, list_distinct(list_transform(range(1, length(wanted) - 1), lambda i: substr(wanted, i, 3))) AS y FROM t WHERE wanted IS NOT NULL),
s AS (SELECT *, len(list_intersect(a, b)) AS k, len(list_intersect(x, y)) AS g FROM w)
SELECT conv_id, turn, round(CASE WHEN len(a) > 0 THEN k / len(a) ELSE 0.0 END, 9) AS "precision", round(CASE WHEN len(b) > 0 THEN k / len(b) ELSE 0.0 END, 9) AS recall,
 round(CASE WHEN len(a) + len(b) - k > 0 THEN k / (len(a) + len(b) - k) ELSE 0.0 END, 9) AS jaccard, round(CASE WHEN len(x) + len(y) - g > 0 THEN g / (len(x) + len(y) - g) ELSE 0.0 END, 9) AS trigram,
 CAST(length(text) - length(replace(text, chr(65533), '')) AS BIGINT) AS undecoded FROM s""",
    "affine_boxes": """SELECT l_orderkey, l_linenumber, CAST(-2.0 * l_linenumber + 5 AS DOUBLE) AS x0, CAST(7.0 AS DOUBLE) AS y0, CAST(5.0 AS DOUBLE) AS x1, CAST(2.0 * l_quantity + 7 AS DOUBLE) AS y1,
 CAST(floor(l_discount * 255 + 0.5) AS BIGINT) * 65536 + CAST(floor(l_tax * 255 + 0.5) AS BIGINT) * 256 + CAST(floor(least(l_quantity / 100, 1.0) * 255 + 0.5) AS BIGINT) AS colour FROM lineitem""",
}
