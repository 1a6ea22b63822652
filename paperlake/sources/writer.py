"""A plain PDF writer: pages of monospaced lines, with optional extras. Fixtures are made with it."""

from __future__ import annotations

import re
import zlib

_SPECIAL = re.compile(rb"[()\\]")


def _text(line: str) -> bytes:
    return _SPECIAL.sub(rb"\\\g<0>", line.encode("latin-1", "replace"))


def page_content(lines: list[str], left: float = 72, top: float = 720, leading: float = 14, size: float = 10) -> bytes:
    body = [f"BT /F1 {size:g} Tf {leading:g} TL 1 0 0 1 {left:g} {top:g} Tm".encode()]
    body += [b"(" + _text(line) + b") Tj T*" for line in lines]
    return b"\n".join([*body, b"ET"])


FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /FirstChar 0 /Widths [" + b"600 " * 256 + b"] >>"


def assemble(objects: dict[int, bytes], trailer: bytes = b"", root: int = 1) -> bytes:
    """A file of the numbered objects with a classic cross-reference table."""
    out, at = bytearray(b"%PDF-1.4\n"), {}
    for num, body in sorted(objects.items()):
        at[num] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (num, body)
    start, size = len(out), max(objects) + 1
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size
    out += b"".join(b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 65535 f \n" for n in range(1, size))
    out += b"trailer\n<< /Size %d /Root %d 0 R %s >>\nstartxref\n%d\n%%%%EOF\n" % (size, root, trailer, start)
    return bytes(out)


def stream(data: bytes, extra: bytes = b"", flate: bool = True) -> bytes:
    if flate:
        data, extra = zlib.compress(data, 6), extra + b" /Filter /FlateDecode"
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), extra, data)


def text_pdf(pages: list[list[str]], flate: bool = True, title: str | None = None) -> bytes:
    """A document of pages, each a list of lines."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: FONT}
    kids, num = [], 5
    for lines in pages:
        objects[num] = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (num + 1)
        objects[num + 1] = stream(page_content(lines), flate=flate)
        kids.append(b"%d 0 R" % num)
        num += 2
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(kids))
    trailer = b""
    if title is not None:
        objects[4] = b"<< /Title <FEFF%s> >>" % title.encode("utf-16-be").hex().encode()
        trailer = b"/Info 4 0 R"
    return assemble(objects, trailer)
