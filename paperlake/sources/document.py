"""One file: cross-reference tables and their recovery, objects, the page tree and document properties."""

from __future__ import annotations

import re

from paperlake.sources import filters
from paperlake.sources.crypto import Decryptor
from paperlake.sources.objects import HEADER, Hex, Literal, Name, ParseError, Ref, Stream, bytes_of, integer, parse, parse_indirect, skip, text_of

MAX_SECTIONS = 100
METADATA = {"title": b"Title", "author": b"Author", "subject": b"Subject", "keywords": b"Keywords", "creator": b"Creator", "producer": b"Producer", "creationDate": b"CreationDate", "modDate": b"ModDate"}
_ROW = re.compile(rb"[\0\t\n\r ]*(\d+)[\0\t\n\r ]+(\d+)[\0\t\n\r ]+([nf])")
_SUBSECTION = re.compile(rb"[\0\t\n\r ]*(\d+)[\0\t\n\r ]+(\d+)(?![^\0\t\n\r ])")
_OBJECT = re.compile(rb"(?<![0-9])(\d+)[\0\t\n\r ]+(\d+)[\0\t\n\r ]+obj(?![a-zA-Z])")


class Document:
    """Objects are parsed when asked for; a missing, free or dangling one is None."""

    def __init__(self, data: bytes):
        self.data, self.cache, self.members = data, {}, {}
        #: number -> ("at", offset) or ("in", stream number, index)
        self.entries: dict[int, tuple] = {}
        self.trailer: dict = {}
        self.decryptor: Decryptor | None = None
        try:
            self._read_sections()
            self._check_root()
        except (ParseError, RecursionError):
            self._recover()
        if self.trailer.get(b"Encrypt") is not None:
            ids = self.trailer.get(b"ID")
            entry = self.get(self.trailer[b"Encrypt"])
            if not isinstance(entry, dict):
                raise ParseError("no encryption dictionary")
            self.decryptor = Decryptor(entry, (bytes_of(ids[0]) or b"") if isinstance(ids, list) and ids else b"")
            self.cache.clear()
            self.members.clear()

    # Cross-reference sections, the newest first.

    def _read_sections(self) -> None:
        at = self.data.rfind(b"startxref", max(0, len(self.data) - 1024))
        if at < 0:
            raise ParseError("no startxref")
        offset, _ = parse(self.data, at + 9)
        seen: set[int] = set()
        while isinstance(offset, int) and offset not in seen and len(seen) < MAX_SECTIONS:
            seen.add(offset)
            try:
                entries, trailer = self._section(offset)
            except ParseError:
                if len(seen) == 1:
                    raise
                break
            for num, entry in entries.items():
                self.entries.setdefault(num, entry)
            if len(seen) == 1:
                if not isinstance(trailer.get(b"Root"), Ref) or integer(trailer.get(b"Size")) is None:
                    raise ParseError("a trailer needs /Root and /Size")
                self.trailer = trailer
            offset = integer(trailer.get(b"Prev"))

    def _section(self, offset: int) -> tuple[dict, dict]:
        data = self.data
        if not 0 <= offset < len(data):
            raise ParseError("cross-reference offset outside the file")
        at = skip(data, offset)
        if data[at : at + 4] != b"xref":
            _, stream = parse_indirect(data, at)
            if not isinstance(stream, Stream):
                raise ParseError("no cross-reference section", data, at)
            return self._stream_section(stream)
        at += 4
        out: dict[int, tuple] = {}
        while data[skip(data, at) :][:7] != b"trailer":
            m = _SUBSECTION.match(data, at)
            if not m:
                raise ParseError("bad cross-reference subsection", data, at)
            at = m.end()
            for num in range(int(m[1]), int(m[1]) + int(m[2])):
                row = _ROW.match(data, at)
                if not row:
                    raise ParseError("bad cross-reference row", data, at)
                at = row.end()
                out.setdefault(num, ("at", int(row[1])) if row[3] == b"n" else ("free",))
        trailer, _ = parse(data, skip(data, at) + 7)
        if not isinstance(trailer, dict):
            raise ParseError("no trailer dictionary", data, at)
        return out, trailer

    def _stream_section(self, stream: Stream) -> tuple[dict, dict]:
        d = stream.dict
        widths = d.get(b"W")
        if not (isinstance(widths, list) and len(widths) == 3 and all(isinstance(w, int) and 0 <= w <= 8 for w in widths) and sum(widths)):
            raise ParseError("bad /W of a cross-reference stream")
        raw = self._predicted(stream)
        size = integer(d.get(b"Size")) or 0
        index = d.get(b"Index") if isinstance(d.get(b"Index"), list) else [0, size]
        a, b, c = widths
        out: dict[int, tuple] = {}
        at = 0
        for first, n in zip(index[::2], index[1::2]):
            for num in range(first, first + n):
                row = raw[at : at + a + b + c]
                if len(row) < a + b + c:
                    return out, d
                at += len(row)
                kind = int.from_bytes(row[:a], "big") if a else 1
                x, y = int.from_bytes(row[a : a + b], "big"), int.from_bytes(row[a + b :], "big")
                if kind > 2:
                    raise ParseError("unknown type of cross-reference entry")
                out.setdefault(num, (("free",), ("at", x), ("in", x, y))[kind])
        return out, d

    @staticmethod
    def _predicted(stream: Stream) -> bytes:
        return filters.decode(stream.data, stream.dict.get(b"Filter"), stream.dict.get(b"DecodeParms"))

    def _check_root(self) -> None:
        entry = self.entries.get(self.trailer[b"Root"].num)
        if entry is None or entry[0] == "free" or entry[0] == "at" and b"obj" not in self.data[entry[1] : entry[1] + 32]:
            raise ParseError("the root isn't where the table says")

    def _recover(self) -> None:
        """Every `n g obj` of the file; later ones of a number hold, and the first catalogue with pages is the root."""
        self.entries, self.trailer, self.cache = {}, {}, {}
        root = None
        for m in _OBJECT.finditer(self.data):
            self.entries[int(m[1])] = ("at", m.start())
            try:
                value, _ = parse(self.data, m.end())
            except (ParseError, RecursionError):
                continue
            if root is None and isinstance(value, dict) and value.get(b"Type") == Name(b"Catalog") and isinstance(value.get(b"Pages"), Ref):
                root = Ref(int(m[1]), int(m[2]))
        if root is None:
            raise ParseError("no cross-reference table and no catalogue")
        self.trailer = {b"Root": root, b"Size": max(self.entries) + 1}

    # Objects.

    def load(self, num: int):
        if num in self.cache:
            return self.cache[num]
        entry, value = self.entries.get(num), None
        if entry and entry[0] == "at":
            _, value = parse_indirect(self.data, entry[1])
            if self.decryptor and not (isinstance(self.trailer.get(b"Encrypt"), Ref) and self.trailer[b"Encrypt"].num == num):
                generation = int(HEADER.match(self.data, entry[1])[2])
                value = self.decryptor.value(value, num, generation)
        elif entry and entry[0] == "in":
            value = self._members(entry[1]).get(num)
        self.cache[num] = value
        return value

    def _members(self, num: int) -> dict:
        if num in self.members:
            return self.members[num]
        out = self.members[num] = {}
        entry = self.entries.get(num)
        if not entry or entry[0] != "at":
            return out
        try:
            stream = self.load(num)
            if not isinstance(stream, Stream):
                return out
            body = self.body(stream)
            first, n, at = integer(stream.dict.get(b"First")) or 0, integer(stream.dict.get(b"N")) or 0, 0
            for _ in range(n):
                own, at = parse(body, at)
                offset, at = parse(body, at)
                try:
                    out.setdefault(own, parse(body, first + offset)[0])
                except (ParseError, TypeError):
                    continue
        except (ParseError, TypeError):
            pass
        return out

    def get(self, value):
        """What a reference points to, or the value itself."""
        return self.load(value.num) if isinstance(value, Ref) else value

    def body(self, stream: Stream) -> bytes:
        used, parms = (self.get(stream.dict.get(k)) for k in (b"Filter", b"DecodeParms"))
        parms = [self.get(p) for p in parms] if isinstance(parms, list) else parms
        return filters.decode(stream.data, used, parms)

    # Pages.

    def catalog(self) -> dict:
        root = self.get(self.trailer.get(b"Root"))
        if not isinstance(root, dict):
            raise ParseError("no catalogue")
        return root

    def walk_pages(self) -> list[Ref]:
        """Leaves of the page tree in order; a node that was seen before is not entered again."""
        out: list[Ref] = []
        seen: set[int] = set()
        pages = self.catalog().get(b"Pages")
        if not isinstance(pages, Ref):
            raise ParseError("the catalogue has no /Pages")
        waiting = [pages]
        while waiting:
            ref = waiting.pop()
            node = self.get(ref)
            if not isinstance(node, dict):
                continue
            kind = node.get(b"Type")
            if kind == Name(b"Page"):
                out.append(ref)
            elif kind == Name(b"Pages") and ref.num not in seen:
                seen.add(ref.num)
                kids = self.get(node.get(b"Kids"))
                waiting += [k for k in reversed(kids if isinstance(kids, list) else []) if isinstance(k, Ref)]
        return out

    def pages(self) -> list[Ref]:
        """The page tree's leaves or, where it fails or is empty, all page objects by their place in the file."""
        try:
            if found := self.walk_pages():
                return found
        except (ParseError, RecursionError):
            pass
        found = []
        for num, entry in self.entries.items():
            try:
                value = self.load(num) if entry[0] != "free" else None
            except (ParseError, RecursionError):
                continue
            if isinstance(value, dict) and value.get(b"Type") == Name(b"Page"):
                box = entry if entry[0] == "at" else (*self.entries.get(entry[1], ("at", 0))[:2], entry[2])
                found.append(((box[1], entry[2] if entry[0] == "in" else 0), Ref(num, 0)))
        return [ref for _, ref in sorted(found)]

    def page_count(self) -> int:
        pages = self.get(self.catalog().get(b"Pages"))
        if pages is None:
            raise ParseError("the catalogue has no /Pages")
        count = integer(pages.get(b"Count")) if isinstance(pages, dict) else None
        return count if count is not None else len(self.pages())

    # Properties.

    def metadata(self) -> dict[str, str | None]:
        try:
            info = self.get(self.trailer.get(b"Info"))
        except ParseError:
            info = None
        info = info if isinstance(info, dict) else {}
        return {k: text_of(bytes_of(info.get(v))) if isinstance(info.get(v), (Literal, Hex)) else None for k, v in METADATA.items()}

    def version(self) -> str | None:
        m = re.match(rb"%PDF-([^\r\n]*)", self.data)
        return m[1].decode("utf-8", "replace").strip() if m else None

    def linearized(self) -> bool:
        first = min(((e[1], n) for n, e in self.entries.items() if e[0] == "at"), default=None)
        try:
            value = self.load(first[1]) if first else None
        except ParseError:
            return False
        return isinstance(value, dict) and integer(value.get(b"Linearized")) == 1
