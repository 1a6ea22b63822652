"""PDF files to tables: one Arrow-batched kernel per file, the rest is DataFrame operations."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.operators import layout
from paperlake.operators.pages import BOX, Pages, Rows, changes, code_points, letters, number, page_texts, read_order, rects_of
from paperlake.session import prepare
from paperlake.sources.document import METADATA
from paperlake.sources.kernel import read

_CHARS = pa.list_(pa.struct([("c", pa.string()), ("x0", pa.float64()), ("y0", pa.float64()), ("x1", pa.float64()), ("y1", pa.float64()), ("size", pa.float64()), ("rotated", pa.bool_())]))
_REFS = pa.list_(pa.struct([("name", pa.string()), ("x0", pa.float64()), ("y0", pa.float64()), ("x1", pa.float64()), ("y1", pa.float64())]))
_IMAGES = pa.list_(pa.struct([("seq", pa.int64()), ("bbox", pa.list_(pa.float64())), ("width", pa.int64()), ("height", pa.int64()), ("bpc", pa.int32()), ("colorspace", pa.string()), ("xref", pa.int64()), ("ext", pa.string()), ("image", pa.binary())]))
_LINKS = pa.list_(pa.struct([("kind", pa.string()), ("bbox", pa.list_(pa.float64())), ("uri", pa.string()), ("to_page", pa.int64()), ("to_point", pa.list_(pa.float64())), ("name", pa.string()), ("file", pa.string()), ("remote_page", pa.int64())]))
_TOC = pa.list_(pa.struct([("level", pa.int32()), ("title", pa.string()), ("page", pa.int64()), ("kind", pa.string()), ("uri", pa.string()), ("to_point", pa.list_(pa.float64())), ("name", pa.string())]))
_PAGE = pa.struct([("rect", pa.list_(pa.float64())), ("font", pa.string()), ("flags", pa.int32()), ("chars", _CHARS), ("image_refs", _REFS), ("images", _IMAGES), ("links", _LINKS), ("type3_char_count", pa.int64()), ("undecoded_byte_count", pa.int64()), ("inline_image_count", pa.int64()), ("error", pa.string())])
_SCHEMA = pa.schema([("path", pa.string()), ("page_count", pa.int64()), ("pdf_version", pa.string()), ("is_encrypted", pa.bool_()), ("is_linearized", pa.bool_()), ("metadata", pa.struct([(k, pa.string()) for k in METADATA])), ("error", pa.string()), ("pages", pa.list_(_PAGE)), ("toc", _TOC)])
DDL = (
    "path string, page_count long, pdf_version string, is_encrypted boolean, is_linearized boolean, metadata struct<" + ",".join(f"{k}:string" for k in METADATA) + ">, error string, "
    "pages array<struct<rect:array<double>,font:string,flags:int,chars:array<struct<c:string,x0:double,y0:double,x1:double,y1:double,size:double,rotated:boolean>>,"
    "image_refs:array<struct<name:string,x0:double,y0:double,x1:double,y1:double>>,"
    "images:array<struct<seq:long,bbox:array<double>,width:long,height:long,bpc:int,colorspace:string,xref:long,ext:string,image:binary>>,"
    "links:array<struct<kind:string,bbox:array<double>,uri:string,to_page:long,to_point:array<double>,name:string,file:string,remote_page:long>>,"
    "type3_char_count:long,undecoded_byte_count:long,inline_image_count:long,error:string>>, "
    "toc array<struct<level:int,title:string,page:long,kind:string,uri:string,to_point:array<double>,name:string>>"
)


_BARE = pa.schema([f if f.name != "pages" else pa.field("pages", pa.list_(pa.struct([g for g in _PAGE if g.name != "chars"]))) for f in _SCHEMA])


#: A batch is sent at so many characters, files or bytes of files.
_FULL = 1 << 17, 256, 16 << 20


def _batch(files: list[tuple[str, dict]]) -> pa.RecordBatch:
    """Rows of files. Characters are many, so they are set column by column."""
    pages = [p for _, got in files for p in got["pages"]]
    chars = [p.pop("chars") for p in pages]
    for page in pages:
        page["image_refs"] = [i._asdict() for i in page["image_refs"]]
    bare = pa.RecordBatch.from_pylist([{"path": path, **got} for path, got in files], schema=_BARE)
    text = letters(code_points("".join(t for c in chars for t in c.text)))
    numbers = [pa.array(np.concatenate([np.zeros(0), *(np.frombuffer(c.columns[k]) for c in chars)])) for k in range(5)]
    rotated = pa.array(np.frombuffer(b"".join(c.rotated for c in chars), bool))
    borders = np.cumsum([0, *map(len, chars)]).astype(np.int32)
    own = pa.ListArray.from_arrays(pa.array(borders), pa.StructArray.from_arrays([text, *numbers, rotated], fields=list(_CHARS.value_type)))
    lists = bare.column("pages")
    whole = pa.ListArray.from_arrays(lists.offsets, pa.StructArray.from_arrays([own if f.name == "chars" else lists.values.field(f.name) for f in _PAGE], fields=list(_PAGE)))
    return pa.RecordBatch.from_arrays([whole if f.name == "pages" else bare.column(f.name) for f in _SCHEMA], schema=_SCHEMA)


def _rows(images: bool, content: bool = True):
    """Batches of files; those of one path that follow each other stay in one batch."""

    def run(batches):
        waiting, size = [], np.zeros(3, int)
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if (size >= _FULL).any() and path != waiting[-1][0]:
                    yield _batch(waiting)
                    waiting, size = [], np.zeros(3, int)
                data = raw.as_buffer().to_pybytes() if raw.is_valid else b""
                got = read(data, images, content)
                waiting.append((path, got))
                size += sum(len(p["chars"]) for p in got["pages"]), 1, len(data)
        if waiting:
            yield _batch(waiting)

    return run


def parse_properties(files: DataFrame) -> DataFrame:
    """The documents table alone: pages are counted but not read."""
    prepare(files.sparkSession)
    return Corpus(files.select(F.col("path").cast("string"), "content").mapInArrow(_rows(False, False), DDL)).documents


def parse_files(files: DataFrame, images: bool = True) -> DataFrame:
    """One row per file (path, content) with everything nested; a bad file has an error and no pages."""
    prepare(files.sparkSession)
    return files.select(F.col("path").cast("string"), "content").mapInArrow(_rows(images), DDL)


def read_files(spark: SparkSession, paths: str | Iterable[str], pattern: str = "*.pdf") -> DataFrame:
    """Files below folders, or the files named."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(paths if isinstance(paths, str) else list(paths))


_LINES = "array<struct<line:long,text:string,bbox:array<double>,spans:array<struct<x0:double,span:long,text:string,y0:double,x1:double,y1:double>>>>"
_BLOCKS = f"path string, page long, block_no long, col int, x0 double, y0 double, x1 double, y1 double, text string, lines {_LINES}, dropped boolean, reading_no long"
#: Characters that are laid out at once.
_AT_ONCE = 1 << 18


class LaidOut:
    """Pages of several files: path and number of each, its media box or None, characters by column, and their blocks."""

    def __init__(self, batch: pa.RecordBatch, rotated: bool):
        lists = batch.column("pages")
        pages, sizes = lists.flatten(), pc.list_value_length(lists).fill_null(0).to_numpy()
        self.count, self.include_rotated = len(pages), rotated
        self.paths = batch.column("path").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        self.numbers = np.arange(self.count) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        #: Pages whose number isn't told, if any.
        self.hidden: np.ndarray | None = None
        self.given = pc.struct_field(pages, "rect").to_pylist()
        own = pc.struct_field(pages, "chars")
        self.page = np.repeat(np.arange(self.count), pc.list_value_length(own).fill_null(0).to_numpy())
        chars = own.flatten()
        self.text = pc.struct_field(chars, "c")
        self.box = [pc.struct_field(chars, k).to_numpy(zero_copy_only=False) for k in BOX]
        self.rotated = pc.struct_field(chars, "rotated").to_numpy(zero_copy_only=False).astype(bool)

    def _part(self, which: np.ndarray, axes: tuple) -> Pages:
        at = np.flatnonzero(which)
        return Pages(self.page[at], [self.box[k][at] for k in axes], self.text.take(pa.array(at)))

    @cached_property
    def _parts(self) -> list[tuple[Pages, tuple]]:
        """Upright characters and, if asked for, rotated ones with their axes changed; the axes."""
        turned = [(1, 0, 3, 2)] if self.include_rotated else []
        return [(self._part(self.rotated == (k > 0), axes), axes) for k, axes in enumerate([(0, 1, 2, 3), *turned])]

    @cached_property
    def _order(self) -> np.ndarray:
        return np.argsort(np.concatenate([p.blocks.page for p, _ in self._parts]), kind="stable")

    @cached_property
    def blocks(self) -> Rows:
        """A page's upright blocks, then the rotated ones."""
        own = [(p.blocks, axes) for p, axes in self._parts]
        boxes = [np.concatenate([b.box[axes[k]] for b, axes in own]) for k in range(4)]
        joined = lambda name: np.concatenate([getattr(b, name) for b, _ in own])
        out = Rows(joined("page"), joined("no"), boxes, pa.concat_arrays([b.text for b, _ in own]), joined("col")).take(self._order)
        out.no = number(changes(out.page))
        return out

    @cached_property
    def rects(self) -> np.ndarray:
        return rects_of(self.given, self.blocks)

    def block_rows(self):
        b = self.blocks
        order, no = read_order(b, self.rects)
        reading, dropped = np.full(len(b.page), -1), np.ones(len(b.page), bool)
        reading[order], dropped[order] = no, False
        lines = pa.concat_arrays([p.nested(k > 0) for k, (p, _) in enumerate(self._parts)]).take(pa.array(self._order))
        return b.page, b.no, b.col.astype(np.int32), *b.box, b.text, lines, dropped, reading

    def rect_rows(self):
        return np.arange(self.count), pa.ListArray.from_arrays(pa.array(np.arange(self.count + 1) * 4, pa.int32()), pa.array(self.rects.ravel()))

    def text_rows(self):
        order, _ = read_order(self.blocks, self.rects)
        return np.arange(self.count), page_texts(self.blocks.take(order), self.count)


def _parts(batch: pa.RecordBatch):
    """Slices of whole files with about _AT_ONCE characters; those of one path that follow each other stay together."""
    lists = batch.column("pages")
    chars = pc.list_value_length(pc.struct_field(lists.flatten(), "chars")).fill_null(0).to_numpy()
    ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy())
    total = np.append(0, np.cumsum(chars))[ends]
    paths, first, sent = batch.column("path").to_pylist(), 0, 0
    for k in range(len(paths)):
        if k + 1 == len(paths) or total[k] - sent >= _AT_ONCE and paths[k] != paths[k + 1]:
            yield batch.slice(first, k + 1 - first)
            first, sent = k + 1, total[k]


class Corpus:
    """Tables of a set of parsed files; each is a plan over the nested rows, so unused columns are never unpacked.

    Layout takes one pass over whole pages, in the pass that parses where the rows aren't persisted. Files are
    laid out one by one, also those that share a path.
    """

    def __init__(self, parsed: DataFrame, include_rotated: bool = False, files: DataFrame | None = None):
        self.parsed, self.include_rotated, self.files = parsed, include_rotated, files

    @classmethod
    def of(cls, files: DataFrame, include_images: bool = True, include_rotated: bool = False) -> Corpus:
        """Of files (path, content)."""
        return cls(parse_files(files, include_images), include_rotated, files)

    @classmethod
    def load(cls, spark: SparkSession, paths: str | Iterable[str], include_images: bool = True, include_rotated: bool = False) -> Corpus:
        return cls.of(read_files(spark, paths), include_images, include_rotated)

    def persist(self, path: str) -> Corpus:
        """Writes the parsed rows, so that the tables don't parse the files again."""
        self.parsed.write.mode("overwrite").parquet(path)
        return Corpus(self.parsed.sparkSession.read.parquet(path), self.include_rotated)

    def laid_out(self, ddl: str, make) -> DataFrame:
        """What make(LaidOut) has: the page, and the columns of ddl after path and page."""
        names, rotated, parse = [c.split()[0] for c in re.sub("<.*>", "", ddl).split(", ")], self.include_rotated, None if self.files is None else _rows(False)

        def run(batches):
            for batch in parse(batches) if parse else batches:
                for part in _parts(batch):
                    own = LaidOut(part, rotated)
                    page, *columns = make(own)
                    columns = [own.paths.take(pa.array(page)), pa.array(own.numbers, mask=own.hidden).take(pa.array(page)), *columns]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

        if parse:
            source = self.files.select(F.col("path").cast("string"), "content")
        else:
            source = self.parsed.select("path", F.transform("pages", lambda p: F.struct(p["rect"].alias("rect"), p["chars"].alias("chars"))).alias("pages"))
        prepare(source.sparkSession)
        return source.mapInArrow(run, ddl)

    @property
    def documents(self) -> DataFrame:
        return self.parsed.select("path", "page_count", "pdf_version", "is_encrypted", "is_linearized", "metadata", "error")

    @property
    def _pages(self) -> DataFrame:
        return self.parsed.select("path", F.posexplode("pages").alias("page", "p")).withColumn("page", F.col("page").cast("long"))

    def _each(self, name: str) -> DataFrame:
        return self._pages.select("path", "page", F.posexplode(f"p.{name}").alias("seq", "v")).withColumn("seq", F.col("seq").cast("long"))

    @property
    def chars(self) -> DataFrame:
        return self._each("chars").select("path", "page", "seq", "v.*")

    @property
    def image_refs(self) -> DataFrame:
        return self._each("image_refs").select("path", "page", "seq", "v.*")

    @property
    def images(self) -> DataFrame:
        return self._pages.select("path", "page", F.explode("p.images").alias("v")).select("path", "page", "v.*")

    @property
    def links(self) -> DataFrame:
        return self._each("links").select("path", "page", "seq", "v.*")

    @property
    def toc(self) -> DataFrame:
        return self.parsed.select("path", F.posexplode("toc").alias("seq", "v")).select("path", F.col("seq").cast("long").alias("seq"), "v.*")

    @property
    def _blocks(self) -> DataFrame:
        return self.laid_out(_BLOCKS, LaidOut.block_rows)

    @property
    def all_blocks(self) -> DataFrame:
        return self._blocks.drop("dropped", "reading_no")

    @property
    def rects(self) -> DataFrame:
        return self.laid_out("path string, page long, rect array<double>", LaidOut.rect_rows)

    @property
    def blocks(self) -> DataFrame:
        """Blocks in reading order."""
        return self._blocks.where("not dropped").drop("dropped", "block_no").withColumnRenamed("reading_no", "block_no")

    @property
    def page_text(self) -> DataFrame:
        return self.laid_out("path string, page long, text string", LaidOut.text_rows)

    @property
    def pages(self) -> DataFrame:
        """(path, page, rect, is_scanned, diagnostics, error)"""
        blocks, rects = self._blocks, self.rects
        outside = blocks.groupBy("path", "page").agg(F.count_if("dropped").alias("out_of_page_block_count"))
        scanned = layout.scanned_pages(self._pages, blocks.where("not dropped"), self.image_refs, rects)
        rotated = F.size(F.filter("p.chars", lambda c: c["rotated"])).cast("long")
        own = self._pages.select("path", "page", rotated.alias("rotated_char_count"), "p.type3_char_count", "p.undecoded_byte_count", "p.inline_image_count", "p.error")
        joined = own.join(rects, ["path", "page"]).join(scanned, ["path", "page"]).join(outside, ["path", "page"], "left")
        counts = F.struct("rotated_char_count", "type3_char_count", "undecoded_byte_count", F.coalesce("out_of_page_block_count", F.lit(0)).alias("out_of_page_block_count"), "inline_image_count")
        return joined.select("path", "page", "rect", "is_scanned", counts.alias("diagnostics"), "error")

    @property
    def text(self) -> DataFrame:
        """(path, text): a document's pages, parted by a line with a soft hyphen."""
        one = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda r: r["text"])
        return self.page_text.groupBy("path").agg(F.array_join(one, "\n\u00ad\n").alias("text"))
