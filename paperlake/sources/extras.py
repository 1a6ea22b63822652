"""Images, links and the outline of a document."""

from __future__ import annotations

from paperlake.sources import filters
from paperlake.sources.content import IDENTITY, Form
from paperlake.sources.document import Document
from paperlake.sources.fonts import page_fonts
from paperlake.sources.objects import Hex, Literal, Name, ParseError, Ref, Stream, bytes_of, integer, number, text_of

EXTENSIONS = {b"DCTDecode": "jpeg", b"JPXDecode": "jp2", b"JBIG2Decode": "jbig2", b"CCITTFaxDecode": "tiff"}


def xobjects(doc: Document, resources, cache: dict, made: dict | None = None) -> dict:
    """Name to Form for forms, to the stream's Ref (or Stream) for everything else; `made` holds the forms met so far."""
    made = {} if made is None else made
    own = doc.get(resources.get(b"XObject")) if isinstance(resources, dict) else None
    out: dict = {}
    for name, ref in (own if isinstance(own, dict) else {}).items():
        try:
            stream = doc.get(ref)
        except ParseError:
            continue
        if not isinstance(stream, Stream):
            continue
        if stream.dict.get(b"Subtype") == Name(b"Form"):
            if id(stream) in made:
                out[name] = made[id(stream)]
                continue
            matrix = [number(v) for v in stream.dict.get(b"Matrix", [])] if isinstance(stream.dict.get(b"Matrix"), list) else []
            try:
                data = doc.body(stream)
            except ParseError:
                continue
            inside = doc.get(stream.dict.get(b"Resources"))
            inner: dict = {}
            out[name] = made[id(stream)] = Form(data, tuple(matrix) if len(matrix) == 6 and None not in matrix else IDENTITY, page_fonts(doc, inside, cache), inner)
            inner.update(xobjects(doc, inside, cache, made))
        else:
            out[name] = ref
    return out


def image_of(doc: Document, ref) -> dict | None:
    """An image object's properties and bytes: compressed formats as they stand, the rest inflated."""
    stream = doc.get(ref)
    if not isinstance(stream, Stream) or stream.dict.get(b"Subtype") != Name(b"Image"):
        return None
    d = stream.dict
    space = d.get(b"ColorSpace")
    space = space[0] if isinstance(space, list) and space else space
    colorspace = "DeviceRGB" if space is None or isinstance(space, Ref) else space.decode("latin-1") if isinstance(space, Name) else "Unknown"
    used = filters.names(d.get(b"Filter"))
    ext = next((EXTENSIONS[f] for f in used if f in EXTENSIONS), "png")
    data = stream.data
    if ext == "png" and b"FlateDecode" in used:
        try:
            data = filters.flate(data)
        except ParseError:
            pass
    whole = lambda k, default: integer(doc.get(d.get(k))) if integer(doc.get(d.get(k))) is not None else default
    return {"width": whole(b"Width", 0), "height": whole(b"Height", 0), "bpc": whole(b"BitsPerComponent", 8), "colorspace": colorspace, "xref": ref.num if isinstance(ref, Ref) else 0, "ext": ext, "image": data}


def _point(dest: list) -> list[float] | None:
    if len(dest) >= 4 and dest[1] == Name(b"XYZ"):
        x, y = number(dest[2]), number(dest[3])
        return [x, y] if x is not None and y is not None else None
    return None


def _plain(value) -> str:
    return bytes(value).decode("utf-8", "replace") if isinstance(value, (Name, Literal, Hex)) else ""


class Places:
    """Destinations: page objects to page numbers, and the name tree."""

    def __init__(self, doc: Document, pages: list[Ref]):
        self.doc, self.number_of = doc, {ref.num: k for k, ref in enumerate(pages)}

    def page(self, target) -> int | None:
        return self.number_of.get(target.num) if isinstance(target, Ref) else integer(target) if integer(target) is not None else None

    def named(self, name: bytes) -> list | None:
        doc = self.doc
        try:
            root = doc.catalog()
            names = doc.get(root.get(b"Names"))
            found = self._search(doc.get(names.get(b"Dests")), name, 0) if isinstance(names, dict) else None
            if found is None:
                old = doc.get(root.get(b"Dests"))
                found = old.get(name) if isinstance(old, dict) else None
            found = doc.get(found)
        except ParseError:
            return None
        found = doc.get(found.get(b"D")) if isinstance(found, dict) else found
        return found if isinstance(found, list) else None

    def _search(self, node, name: bytes, depth: int):
        if not isinstance(node, dict) or depth > 50:
            return None
        limits = self.doc.get(node.get(b"Limits"))
        if isinstance(limits, list) and len(limits) == 2:
            lo, hi = (bytes_of(v) or b"" for v in limits)
            if not lo <= name <= hi:
                return None
        leaves = self.doc.get(node.get(b"Names"))
        if isinstance(leaves, list):
            for key, value in zip(leaves[::2], leaves[1::2]):
                if bytes_of(key) == name:
                    return value
        kids = self.doc.get(node.get(b"Kids"))
        for kid in kids if isinstance(kids, list) else []:
            found = self._search(self.doc.get(kid), name, depth + 1)
            if found is not None:
                return found
        return None


_LINK = ("kind", "bbox", "uri", "to_page", "to_point", "name", "file", "remote_page")


def page_links(doc: Document, page: dict, places: Places) -> list[dict]:
    """Link annotations of a page; any that can't be read takes the page's others with it."""
    out = []
    annotations = doc.get(page.get(b"Annots"))
    for ref in annotations if isinstance(annotations, list) else []:
        a = doc.get(ref)
        if not isinstance(a, dict) or a.get(b"Subtype") != Name(b"Link"):
            continue
        rect = doc.get(a.get(b"Rect"))
        sides = [number(v) for v in rect if number(v) is not None][:4] if isinstance(rect, list) else []
        link = dict.fromkeys(_LINK) | {"bbox": sides if len(sides) == 4 else [0.0] * 4}
        if not _action(doc, doc.get(a.get(b"A")), link, places):
            _destination(doc, doc.get(a.get(b"Dest")), link, places)
        if link["kind"]:
            out.append(link)
    return out


def _destination(doc: Document, dest, link: dict, places: Places) -> None:
    if dest is None:
        return
    if isinstance(dest, list):
        link |= {"kind": "goto", "to_page": places.page(dest[0]) if dest else None, "to_point": _point(dest)}
    else:
        link |= {"kind": "named", "name": _plain(dest) or None}


def _action(doc: Document, action, link: dict, places: Places) -> bool:
    kind = action.get(b"S") if isinstance(action, dict) else None
    if kind == Name(b"URI"):
        link |= {"kind": "uri", "uri": _plain(doc.get(action.get(b"URI"))) or None}
    elif kind == Name(b"GoTo"):
        _destination(doc, doc.get(action.get(b"D")), link, places)
    elif kind == Name(b"Named"):
        link |= {"kind": "named", "name": _plain(action.get(b"N")) or None}
    elif kind in (Name(b"Launch"), Name(b"GoToR")):
        file = doc.get(action.get(b"F"))
        file = doc.get(file.get(b"UF") or file.get(b"F")) if isinstance(file, dict) else file
        link |= {"kind": "launch" if kind == Name(b"Launch") else "gotor", "file": _plain(file) or None}
        dest = doc.get(action.get(b"D"))
        if kind == Name(b"GoToR") and isinstance(dest, list) and dest:
            link |= {"remote_page": integer(dest[0]), "to_point": _point(dest)}
    else:
        return False
    return link["kind"] is not None


def outline(doc: Document, places: Places) -> list[dict]:
    """Entries depth first, level 1 at the top; an entry that was seen before ends its branch."""
    out: list[dict] = []
    seen: set[int] = set()
    root = doc.get(doc.catalog().get(b"Outlines"))
    waiting = [(root.get(b"First"), 1)] if isinstance(root, dict) else []
    while waiting:
        ref, level = waiting.pop()
        if not isinstance(ref, Ref) or ref.num in seen:
            continue
        seen.add(ref.num)
        item = doc.get(ref)
        if not isinstance(item, dict):
            continue
        entry = {"level": level, "title": text_of(bytes_of(item.get(b"Title"))) or "", "page": None, "kind": None, "uri": None, "to_point": None, "name": None}
        dest, action = doc.get(item.get(b"Dest")), doc.get(item.get(b"A"))
        if dest is None and isinstance(action, dict):
            if action.get(b"S") == Name(b"URI"):
                entry |= {"kind": "uri", "uri": _plain(doc.get(action.get(b"URI"))) or None}
            else:
                dest = doc.get(action.get(b"D"))
        if isinstance(dest, (Name, Literal, Hex)):
            entry["name"] = (bytes(dest) if isinstance(dest, Name) else bytes_of(dest) or b"").decode("utf-8", "replace")
            dest = places.named(bytes(dest) if isinstance(dest, Name) else bytes_of(dest) or b"")
        if isinstance(dest, list) and dest:
            entry |= {"kind": "goto", "page": places.page(dest[0]), "to_point": _point(dest)}
        elif entry["name"] is not None:
            entry["kind"] = "named"
        out.append(entry)
        waiting += [(item.get(b"Next"), level), (item.get(b"First"), level + 1)]
    return out
