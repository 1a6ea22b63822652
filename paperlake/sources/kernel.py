"""One file's bytes to rows of all tables."""

from __future__ import annotations

from paperlake.sources.content import Chars, Scan
from paperlake.sources.document import METADATA, Document
from paperlake.sources.extras import Places, image_of, outline, page_links, xobjects
from paperlake.sources.fonts import page_fonts
from paperlake.sources.objects import ParseError, Stream, number

PAGE = [0.0, 0.0, 612.0, 792.0]
_FAULTS = (ParseError, RecursionError, ValueError, TypeError, KeyError, IndexError, OverflowError, AttributeError)


def _contents(doc: Document, page: dict) -> bytes:
    own = page.get(b"Contents")
    parts = own if isinstance(own, list) else [own]
    if not isinstance(own, list):
        whole = doc.get(own)
        parts = whole if isinstance(whole, list) else [own]
    streams = [doc.get(p) for p in parts]
    return b"\n".join(doc.body(s) for s in streams if isinstance(s, Stream))


def _page(doc: Document, ref, fonts: dict, images: bool) -> dict:
    page = doc.get(ref)
    resources = doc.get(page.get(b"Resources"))
    keys = page_fonts(doc, resources, fonts)
    scan = Scan(keys, xobjects(doc, resources, fonts)).run(_contents(doc, page))
    media = page.get(b"MediaBox")
    rect = [number(v) for v in media] if isinstance(media, list) and len(media) == 4 else None
    first = min(keys, default=None)
    found = []
    for seq, i in enumerate(scan.images if images else []):
        ref = scan.sources[seq]
        got = image_of(doc, ref) if ref is not None else None
        if got:
            found.append({"seq": seq, "bbox": [i.x0, i.y0, i.x1, i.y1], **got})
    return {
        "rect": rect if rect and None not in rect else None,
        "font": first.decode("utf-8", "replace") if first else "Helvetica",
        "flags": keys[first].flags if first else 0,
        "chars": scan.chars,
        "image_refs": scan.images,
        "images": found,
        "type3_char_count": scan.type3,
        "undecoded_byte_count": scan.undecoded,
        "inline_image_count": scan.inline,
        "error": None,
    }


def _stub(error: str) -> dict:
    return {"rect": PAGE, "font": "Helvetica", "flags": 0, "chars": Chars(), "image_refs": [], "images": [], "type3_char_count": 0, "undecoded_byte_count": 0, "inline_image_count": 0, "error": error, "links": []}


def read(data: bytes, images: bool = True, content: bool = True) -> dict:
    """Document properties with pages, links and outline; a page that fails is an empty one with its error."""
    out = {"page_count": 0, "pdf_version": None, "is_encrypted": False, "is_linearized": False, "metadata": dict.fromkeys(METADATA), "error": None, "pages": [], "toc": []}
    try:
        doc = Document(data)
        pages = doc.pages()
    except _FAULTS as e:
        return out | {"error": str(e)}
    places, fonts = Places(doc, pages), {}
    for ref in pages if content else []:
        try:
            page = _page(doc, ref, fonts, images)
        except _FAULTS as e:
            page = _stub(str(e))
        try:
            page["links"] = page_links(doc, doc.get(ref), places)
        except _FAULTS:
            page["links"] = []
        out["pages"].append(page)
    try:
        out["toc"] = outline(doc, places) if content else []
    except _FAULTS:
        out["toc"] = []
    return out | {"page_count": len(pages), "pdf_version": doc.version(), "is_encrypted": doc.trailer.get(b"Encrypt") is not None, "is_linearized": doc.linearized(), "metadata": doc.metadata()}
