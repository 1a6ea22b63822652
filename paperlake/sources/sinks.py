"""Tables to files: text, JSON lines, YAML outlines, Markdown and PNG."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.sources.reader import Corpus

SEPARATOR = "\n­\n"


def stem(path: str = "path"):
    return F.regexp_extract(F.col(path), r"([^/]*?)(?:\.[^./]*)?$", 1)


def write_text(corpus: Corpus, folder: str) -> None:
    """One folder a document, its pages parted by SEPARATOR."""
    corpus.text.select(stem().alias("doc"), "text").write.mode("overwrite").partitionBy("doc").option("lineSep", "\n").text(folder)


def json_blocks(corpus: Corpus) -> DataFrame:
    """(path, json) of all blocks and images; image bytes are in base 64."""
    blocks = corpus.blocks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", "block_no", F.array("x0", "y0", "x1", "y1").alias("bbox"), "text", "lines"))).alias("blocks"))
    images = corpus.images.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", "seq", "bbox", "width", "height", "bpc", "colorspace", "xref", "ext", F.base64("image").alias("image")))).alias("images"))
    return corpus.documents.select("path").join(blocks, "path", "left").join(images, "path", "left").select("path", F.to_json(F.struct("blocks", "images")).alias("json"))


def write_json(corpus: Corpus, folder: str) -> None:
    json_blocks(corpus).select(stem().alias("doc"), F.col("json").alias("value")).write.mode("overwrite").partitionBy("doc").text(folder)


def corpus_index(corpus: Corpus) -> DataFrame:
    """One record a document: its metadata and its pages' texts, numbered from 1."""
    pages = corpus.page_text.groupBy("path").agg(F.array_sort(F.collect_list(F.struct((F.col("page") + 1).alias("page"), "text"))).alias("pages"))
    return corpus.documents.select("path", "page_count", "metadata").join(pages, "path", "left")


def write_index(corpus: Corpus, folder: str) -> None:
    corpus_index(corpus).write.mode("overwrite").json(folder)


def yaml_outline(corpus: Corpus) -> DataFrame:
    """(path, yaml): the outline with two spaces a level."""
    quoted = F.replace(F.replace(F.col("title"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit('- title: "'), quoted, F.lit('"\n'), F.repeat(F.lit("  "), F.col("level")), F.lit("page: "), F.coalesce(F.col("page") + 1, F.lit(0)).cast("string"), F.lit("\n"))
    rows = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return corpus.toc.groupBy("path").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "").alias("yaml"))


def markdown(corpus: Corpus) -> DataFrame:
    """(path, markdown): blocks whose characters are larger than the document's usual ones become headings."""
    chars = corpus.chars.where("not rotated")
    body = chars.groupBy("path", "size").agg(F.count("*").alias("n")).groupBy("path").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("body"))
    blocks = corpus.blocks.select("path", "page", "block_no", "text", "x0", "y0", "x1", "y1")
    inside = (F.col("b.path") == F.col("c.path")) & (F.col("b.page") == F.col("c.page")) & (F.col("c.x0") >= F.col("b.x0")) & (F.col("c.x1") <= F.col("b.x1")) & (F.col("c.y0") >= F.col("b.y0")) & (F.col("c.y1") <= F.col("b.y1"))
    sized = blocks.alias("b").join(chars.alias("c"), inside).groupBy("b.path", "b.page", "b.block_no").agg(F.first("b.text").alias("text"), F.avg("c.size").alias("size"))
    over = F.col("size") - F.col("body")
    flat = F.btrim(F.regexp_replace("text", r"\s*\n\s*", " "))
    line = F.when(over > 1.5, F.concat(F.lit("## "), flat)).when(over > 0.5, F.concat(F.lit("### "), flat)).otherwise(flat)
    rows = F.array_sort(F.collect_list(F.struct("page", "block_no", line.alias("line"))))
    return sized.join(body, "path").groupBy("path").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n\n").alias("markdown"))


def png(width: int, height: int, pixels: bytes, channels: int = 3) -> bytes:
    """An 8-bit PNG of grey (1), RGB (3) or RGBA (4) rows."""
    if len(pixels) != width * height * channels:
        raise ValueError("the pixels don't fill the image")

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    row = width * channels
    raw = b"".join(b"\0" + pixels[i * row : (i + 1) * row] for i in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
