"""python -m paperlake.cli extract|info|toc: text, properties and outlines of files."""

from __future__ import annotations

import argparse
import glob
import json
import os
import sys

from paperlake.api import Document, open_document
from paperlake.functions.text import selected_pages
from paperlake.sources.sinks import SEPARATOR


def inputs(patterns: list[str]) -> list[str]:
    return [f for p in patterns for f in (sorted(glob.glob(p)) or [p])]


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("paperlake").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _extract(doc: Document, args) -> str:
    pages = [doc[k] for k in (selected_pages(args.pages, len(doc)) if args.pages else range(len(doc)))]
    if args.format == "text":
        return SEPARATOR.join(p.get_text("text") for p in pages)
    return json.dumps([p.get_text("dict" if args.format == "json" else "blocks") for p in pages], ensure_ascii=False, default=str)


def _info(doc: Document) -> str:
    kinds = [(sum(b["type"] == 0 for b in d["blocks"]), sum(b["type"] == 1 for b in d["blocks"])) for d in (p.get_text("dict") for p in doc)]
    rows = [{"page": p.number, "text_blocks": t, "image_blocks": i, "is_scanned": p.is_scanned} for p, (t, i) in zip(doc, kinds)]
    return json.dumps({"path": doc.path, "pages": len(doc), "version": doc.pdf_version, "encrypted": doc.is_encrypted, "metadata": doc.metadata, "scanned": sum(r["is_scanned"] for r in rows), "by_page": rows}, ensure_ascii=False, indent=1)


def _toc(doc: Document, args) -> str:
    toc = doc.get_toc()
    if not toc:
        print("(no outline)", file=sys.stderr)
    return json.dumps(toc, ensure_ascii=False) if args.format == "json" else "\n".join(f"{'  ' * (level - 1)}{title} {page}" for level, title, page in toc)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="paperlake")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("extract", "info", "toc"):
        c = commands.add_parser(name)
        c.add_argument("paths", nargs="+")
        if name != "info":
            c.add_argument("--format", default="text", choices=("text", "json", "blocks") if name == "extract" else ("text", "json"))
        if name == "extract":
            c.add_argument("--pages")
            c.add_argument("--output")
            c.add_argument("--rotated", action="store_true")
    args = parser.parse_args(argv)
    spark = _session()
    for path in inputs(args.paths):
        try:
            doc = open_document(spark, path, include_rotated=getattr(args, "rotated", False))
        except ValueError as e:
            print(f"{path}: {e}", file=sys.stderr)
            continue
        out = _extract(doc, args) if args.command == "extract" else _info(doc) if args.command == "info" else _toc(doc, args)
        if getattr(args, "output", None):
            os.makedirs(args.output, exist_ok=True)
            name = os.path.splitext(os.path.basename(path))[0] + (".txt" if args.format == "text" else ".json")
            with open(os.path.join(args.output, name), "w", encoding="utf-8") as f:
                f.write(out)
        elif out:
            print(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
