"""Files, documents and pages as objects: extract(), extract_many(), open_document() and extract_links().

Each is a small plan over the tables of paperlake.sources.reader; whole collections are better
served by the tables themselves.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.operators import layout
from paperlake.sources.reader import Corpus

MODES = ("text", "dict", "blocks")


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else "file:" + os.path.abspath(path)


def _corpus(spark: SparkSession, paths: list[str], images: bool, rotated: bool) -> Corpus:
    missing = [p for p in paths if "://" not in p and not os.path.exists(p)]
    if missing:
        raise ValueError(f"cannot open file: {missing[0]}")
    corpus = Corpus.load(spark, [_uri(p) for p in paths], images, rotated)
    corpus.parsed.persist()
    return corpus


def block_dicts(corpus: Corpus) -> list[dict]:
    """Blocks with their lines and spans, by path, page and reading order."""
    rows = corpus.blocks.join(corpus._pages.select("path", "page", "p.font", "p.flags"), layout.KEY).orderBy(*layout.KEY, "block_no").collect()
    out = []
    for r in rows:
        lines = []
        for line in r.lines:
            spans = [{"bbox": [s.x0, s.y0, s.x1, s.y1], "text": s.text, "font": r.font, "size": layout.SIZE, "color": 0, "flags": r.flags} for s in line.spans]
            lines.append({"bbox": list(line.bbox), "spans": spans})
        out.append({"path": r.path, "page": r.page, "type": 0, "bbox": [r.x0, r.y0, r.x1, r.y1], "lines": lines})
    return out


def image_dicts(corpus: Corpus) -> list[dict]:
    return [r.asDict() | {"bbox": list(r.bbox), "image": bytes(r.image)} for r in corpus.images.orderBy("path", "page", "seq").collect()]


def _link(r) -> dict[str, Any]:
    link = {k: v for k, v in r.asDict().items() if k not in ("path", "page", "seq")}
    return link | {"from": list(r.bbox), "bbox": list(r.bbox), "page": r.page}


class Page:
    def __init__(self, document: Document, number: int):
        self.parent, self.number = document, number
        self._row = document._page_rows[number]
        self.rect = self.bbox = list(self._row.rect)
        self.is_scanned, self.diagnostics = self._row.is_scanned, self._row.diagnostics.asDict()

    def _blocks(self) -> list[dict]:
        return [b for b in self.parent._blocks if b["page"] == self.number]

    def get_text(self, mode: str = "text") -> Any:
        """text: lines with line breaks; dict: blocks, lines and spans; blocks: (x0, y0, x1, y1, text, number, type)."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        blocks, images = self._blocks(), self.get_images()
        text = lambda b, end: "".join("".join(s["text"] for s in line["spans"]) + end for line in b["lines"])
        if mode == "text":
            return "".join(text(b, "\n") + "\n" for b in blocks)
        if mode == "dict":
            own = [{"number": self.number} | {k: v for k, v in b.items() if k not in ("path", "page")} for b in blocks]
            return {"width": self.rect[2] - self.rect[0], "height": self.rect[3] - self.rect[1], "blocks": own + [{"number": self.number, "type": 1} | i for i in images]}
        rows = [(*b["bbox"], text(b, ""), n, 0) for n, b in enumerate(blocks)]
        return rows + [(*i["bbox"], "", len(rows) + n, 1) for n, i in enumerate(images)]

    def get_images(self) -> list[dict]:
        return [i for i in self.parent._images if i["page"] == self.number]

    def get_links(self) -> list[dict]:
        return [x for x in self.parent._links if x["page"] == self.number]

    def get_pixmap(self, dpi: int = 150, output: str | None = None):
        raise NotImplementedError("pages are not rendered")


class Document:
    """One file, read when opened."""

    def __init__(self, spark: SparkSession, path: str, include_images: bool = True, include_rotated: bool = False):
        corpus = _corpus(spark, [path], include_images, include_rotated)
        own = corpus.documents.first()
        if own is None or own.error:
            corpus.parsed.unpersist()
            raise ValueError(own.error if own else f"cannot open file: {path}")
        self.path, self.page_count, self.pdf_version = path, own.page_count, own.pdf_version
        self.is_encrypted, self.is_linearized = own.is_encrypted, own.is_linearized
        self.metadata = own.metadata.asDict() | {"format": f"PDF {own.pdf_version}" if own.pdf_version else None, "encryption": "yes" if own.is_encrypted else None, "size": None}
        self._page_rows = {r.page: r for r in corpus.pages.collect()}
        self._blocks, self._images = block_dicts(corpus), image_dicts(corpus)
        self._links = [_link(r) for r in corpus.links.orderBy("page", "seq").collect()]
        self._toc = corpus.toc.orderBy("seq").collect()
        corpus.parsed.unpersist()

    def __len__(self) -> int:
        return self.page_count

    def __getitem__(self, number: int) -> Page:
        at = number + self.page_count if number < 0 else number
        if not 0 <= at < self.page_count:
            raise IndexError(f"page {number} of {self.page_count}")
        return Page(self, at)

    load_page = __getitem__

    def __iter__(self) -> Iterator[Page]:
        return (self[k] for k in range(self.page_count))

    def get_toc(self, simple: bool = True) -> list:
        """[level, title, page from 1, or 0 if unresolved], and a dict with the target if not simple."""
        out = []
        for r in self._toc:
            row = [r.level, r.title, 0 if r.page is None else r.page + 1]
            out.append(row if simple else [*row, {"page0": r.page, "kind": r.kind, "uri": r.uri, "to_point": r.to_point, "name": r.name}])
        return out

    def close(self) -> None:
        """Nothing is held open."""

    def __enter__(self) -> Document:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def open_document(spark: SparkSession, path: str, include_images: bool = True, include_rotated: bool = False) -> Document:
    return Document(spark, path, include_images, include_rotated)


def _page_dict(r) -> dict:
    return {"page": r.page, "rect": list(r.rect), "is_scanned": r.is_scanned, "diagnostics": r.diagnostics.asDict()}


def extract_many(spark: SparkSession, paths: list[str], include_images: bool = False, include_pages: bool = False, include_rotated: bool = False) -> list:
    """[path, [blocks, images(, pages)]] of each file, in the order given; a file that fails has []."""
    if not paths:
        return []
    corpus = _corpus(spark, list(dict.fromkeys(paths)), include_images, include_rotated)
    failed = {r.path for r in corpus.documents.where("error IS NOT NULL").collect()}
    blocks, images = block_dicts(corpus), image_dicts(corpus) if include_images else []
    pages = [(r.path, _page_dict(r)) for r in corpus.pages.orderBy("path", "page").collect()] if include_pages else []
    corpus.parsed.unpersist()
    plain = lambda d: {k: v for k, v in d.items() if k != "path"}
    out = []
    for path in paths:
        uri = _uri(path)
        parts = [[plain(b) for b in blocks if b["path"] == uri], [plain(i) for i in images if i["path"] == uri]]
        out.append([path, [] if uri in failed else parts + ([[p for own, p in pages if own == uri]] if include_pages else [])])
    return out


def extract(spark: SparkSession, path: str, include_images: bool = True, include_pages: bool = False, include_rotated: bool = False) -> list:
    """[blocks, images(, pages)] of one file; a file that can't be read raises ValueError."""
    own = extract_many(spark, [path], include_images, include_pages, include_rotated)[0][1]
    if not own:
        raise ValueError(f"cannot read {path}")
    return own


def extract_links(spark: SparkSession, path: str) -> list[dict]:
    corpus = Corpus.load(spark, _uri(path), False)
    return [_link(r) for r in corpus.links.orderBy("page", "seq").collect()]


def text_table(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text) of any number of files."""
    return Corpus.load(spark, paths, False).text.orderBy(F.col("path"))
