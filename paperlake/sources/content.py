"""Content streams to positioned characters and image references."""

from __future__ import annotations

import re
from array import array
from typing import NamedTuple

import numpy as np

from paperlake.sources.fonts import Font
from paperlake.sources.objects import unescape

FORM_DEPTH = 3
#: Strings of as many bytes or more are set as arrays.
LONG = 8
_TOKEN = re.compile(
    rb"[\0\t\n\f\r ]+|%[^\r\n]*|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:-\d*)?)|/(?P<name>[^\0\t\n\f\r ()<>\[\]{}/%]*)|(?P<hex><[0-9A-Fa-f\0\t\n\f\r ]*>)|(?P<dict><<|>>)|(?P<open>\()|(?P<array>[\[\]])|(?P<op>[A-Za-z'\"*]+[0-9]?)|.",
    re.S,
)
_PARENTHESES = re.compile(rb"[()\\]")
_INLINE_END = re.compile(rb"[\0\t\n\f\r ]EI(?=[\0\t\n\f\r ]|\Z)")
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class Char(NamedTuple):
    c: str
    x0: float
    y0: float
    x1: float
    y1: float
    size: float
    rotated: bool


class Chars:
    """Characters in content order. They are many, so they are kept by column: text in pieces, the rest in arrays."""

    def __init__(self):
        self.text: list[str] = []
        #: x0, y0, x1, y1 and size.
        self.columns = [array("d") for _ in range(5)]
        self.rotated = bytearray()

    def __len__(self) -> int:
        return len(self.rotated)

    def __iter__(self):
        return (Char(c, *v, bool(r)) for c, *v, r in zip("".join(self.text), *self.columns, self.rotated))

    def add(self, c: str, x0: float, y0: float, x1: float, y1: float, size: float, rotated: bool) -> None:
        self.text.append(c)
        for column, v in zip(self.columns, (x0, y0, x1, y1, size)):
            column.append(v)
        self.rotated.append(rotated)

    def add_line(self, text: str, x0: np.ndarray, y0: float, x1: np.ndarray, y1: float, size: float) -> None:
        self.text.append(text)
        for column, v in zip(self.columns, (x0, y0, x1, y1, size)):
            column.frombytes(v.tobytes()) if isinstance(v, np.ndarray) else column.extend(array("d", [v]) * len(text))
        self.rotated.extend(bytes(len(text)))


class Image(NamedTuple):
    name: str
    x0: float
    y0: float
    x1: float
    y1: float


class Form(NamedTuple):
    data: bytes
    matrix: tuple
    fonts: dict
    #: What its own resources name, before the page's.
    xobjects: dict = {}  # noqa: RUF012


def multiply(a: tuple, b: tuple) -> tuple:
    """First a, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def box(m: tuple, x0: float, y0: float, x1: float, y1: float) -> tuple[float, float, float, float]:
    """The upright box around a transformed rectangle."""
    xs = [m[0] * x + m[2] * y + m[4] for x in (x0, x1) for y in (y0, y1)]
    ys = [m[1] * x + m[3] * y + m[5] for x in (x0, x1) for y in (y0, y1)]
    return min(xs), min(ys), max(xs), max(ys)


class Scan:
    """What a page's content shows."""

    def __init__(self, fonts: dict[bytes, Font], xobjects: dict):
        self.xobjects, self.page_fonts = xobjects, fonts
        self.chars = Chars()
        self.images: list[Image] = []
        #: The object of each image, None for inline ones and unknown names.
        self.sources: list = []
        self.type3 = self.undecoded = self.inline = 0

    def run(self, data: bytes, fonts: dict[bytes, Font] | None = None, ctm: tuple = IDENTITY, depth: int = 0, own: dict | None = None) -> Scan:
        _Interpreter(self, self.page_fonts if fonts is None else fonts, ctm, depth, own or {}).run(data)
        return self


class _Interpreter:
    def __init__(self, scan: Scan, fonts: dict[bytes, Font], ctm: tuple, depth: int, own: dict):
        self.scan, self.fonts, self.ctm, self.depth, self.own = scan, fonts, ctm, depth, own
        self.saved: list[tuple] = []
        self.tm = self.tlm = IDENTITY
        self.font: Font | None = None
        self.size, self.spacing, self.word, self.scale, self.leading = 12.0, 0.0, 0.0, 1.0, 0.0
        self.before = len(scan.chars)

    def run(self, data: bytes) -> None:
        stack: list = []
        arrays: list[list] = []
        at, n = 0, len(data)
        match = _TOKEN.match
        while at < n:
            m = match(data, at)
            at = m.end()
            kind = m.lastgroup
            if kind is None:
                continue
            into = arrays[-1] if arrays else stack
            if kind == "number":
                raw = m["number"]
                cut = raw.find(b"-", 1)
                into.append(float(raw[:cut] if cut > 0 else raw))
            elif kind == "name":
                into.append(m["name"])
            elif kind == "open":
                start, depth = at, 1
                while depth and (p := _PARENTHESES.search(data, at)):
                    at = p.end()
                    if p[0] == b"\\":
                        at += 1
                    else:
                        depth += 1 if p[0] == b"(" else -1
                if depth:
                    return
                into.append(("s", unescape(data[start : at - 1])))
            elif kind == "hex":
                digits = m["hex"].translate(None, b"<>\0\t\n\f\r ")
                into.append(("s", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())))
            elif kind == "array":
                if m["array"] == b"[":
                    arrays.append([])
                elif arrays:
                    whole = arrays.pop()
                    (arrays[-1] if arrays else stack).append(whole)
            elif kind == "op":
                if m["op"] == b"BI":
                    start = re.compile(rb"(?<![^\0\t\n\f\r >\]/])ID[\0\t\n\f\r ]").search(data, at)
                    end = _INLINE_END.search(data, start.end() - 1) if start else None
                    if not end:
                        return
                    at = end.end()
                    self.scan.inline += 1
                    self.scan.images.append(Image("inline", *box(self.ctm, 0, 0, 1, 1)))
                    self.scan.sources.append(None)
                else:
                    self.operate(m["op"], stack)
                stack, arrays = [], []

    @staticmethod
    def numbers(stack: list, n: int) -> list[float] | None:
        own = stack[-n:]
        return own if len(own) == n and all(isinstance(v, float) for v in own) else None

    def operate(self, op: bytes, s: list) -> None:
        take = self.numbers
        if op == b"Tj":
            if s and isinstance(s[-1], tuple):
                self.show(s[-1][1])
        elif op == b"TJ":
            if s and isinstance(s[-1], list):
                self.show_spaced(s[-1])
        elif op in (b"Td", b"TD"):
            if v := take(s, 2):
                if op == b"TD":
                    self.leading = -v[1]
                self.maybe_space(v[0], v[1])
                self.move(v[0], v[1])
        elif op == b"Tm":
            if v := take(s, 6):
                self.maybe_space(v[4] - self.tm[4], v[5] - self.tm[5])
                self.tm = self.tlm = tuple(v)
        elif op == b"T*":
            self.move(0, -self.leading)
        elif op == b"Tf":
            if len(s) >= 2 and isinstance(s[-1], float):
                self.size = s[-1]
                self.font = self.fonts.get(bytes(s[-2])) if isinstance(s[-2], bytes) else None
        elif op == b"Tc":
            self.spacing = (take(s, 1) or [self.spacing])[0]
        elif op == b"Tw":
            self.word = (take(s, 1) or [self.word])[0]
        elif op == b"Tz":
            self.scale = (take(s, 1) or [self.scale * 100])[0] / 100
        elif op == b"TL":
            self.leading = (take(s, 1) or [self.leading])[0]
        elif op == b"'":
            self.move(0, -self.leading)
            self.operate(b"Tj", s)
        elif op == b'"':
            if len(s) >= 3 and isinstance(s[-3], float) and isinstance(s[-2], float):
                self.word, self.spacing = s[-3], s[-2]
            self.move(0, -self.leading)
            self.operate(b"Tj", s)
        elif op == b"BT":
            self.tm = self.tlm = IDENTITY
        elif op == b"q":
            self.saved.append(self.ctm)
        elif op == b"Q":
            if self.saved:
                self.ctm = self.saved.pop()
        elif op == b"cm":
            if v := take(s, 6):
                self.ctm = multiply(tuple(v), self.ctm)
        elif op == b"Do":
            if s and isinstance(s[-1], bytes):
                self.paint(bytes(s[-1]))

    def paint(self, name: bytes) -> None:
        form = self.own.get(name, self.scan.xobjects.get(name))
        if isinstance(form, Form):
            if self.depth < FORM_DEPTH:
                self.scan.run(form.data, form.fonts | self.fonts, multiply(form.matrix, self.ctm), self.depth + 1, self.own | form.xobjects)
        else:
            self.scan.images.append(Image(name.decode("utf-8", "replace"), *box(self.ctm, 0, 0, 1, 1)))
            self.scan.sources.append(form)

    def move(self, tx: float, ty: float) -> None:
        t = self.tlm
        self.tm = self.tlm = (*t[:4], t[4] + tx * t[0] + ty * t[2], t[5] + tx * t[1] + ty * t[3])

    def show_spaced(self, items: list) -> None:
        k = max(self.size / 12, 0.5)
        for item in items:
            if isinstance(item, tuple):
                self.show(item[1])
            elif isinstance(item, float):
                if -700 * k < item < -150 * k and self.before < len(self.scan.chars):
                    self.space()
                self.advance(-item * self.size * self.scale / 1000)

    def advance(self, tx: float) -> None:
        t = self.tm
        self.tm = (*t[:4], t[4] + tx * t[0], t[5] + tx * t[1])

    def show_long(self, raw: bytes, m: tuple, y0: float, y1: float) -> bool:
        """show() for an upright string of one-byte codes, as arrays; false if a code isn't one character."""
        scan, font, size = self.scan, self.font, self.size
        codes = np.frombuffer(raw, np.uint8)
        text = font.by_byte[0][codes] if font else codes.astype(np.uint32)
        if font and (text == font.MANY).any():
            return False
        widths = (font.by_byte[1][codes] * size / 1000 if font else np.full(len(raw), 0.6 * size)) * self.scale
        steps = widths + self.spacing * self.scale
        if self.word:
            steps[codes == 32] += self.word * self.scale
        ends = np.cumsum(steps)
        x = np.concatenate(([0.0], ends[:-1]))
        left, right = m[4] + x * m[0], m[4] + (x + widths) * m[0]
        swapped = None if (ordered := left <= right).all() else ~ordered
        if swapped is not None:
            left, right = np.where(swapped, right, left), np.where(swapped, left, right)
        text = text.tobytes().decode("utf-32-le", "surrogatepass")
        scan.chars.add_line(text, left, y0, right, y1, size)
        scan.undecoded += text.count("\ufffd")
        if font and font.type3:
            scan.type3 += len(raw)
        self.advance(float(ends[-1]))
        return True

    def show(self, raw: bytes) -> None:
        font, size, scan = self.font, self.size, self.scan
        step = 2 if font and font.two_bytes(raw) else 1
        m = multiply(self.tm, self.ctm)
        turned = abs(m[1]) > 1e-6 or abs(m[2]) > 1e-6
        sized = font and (font.cid or font.widths or font.type0)
        note, extra, x = scan.chars.add, self.spacing * self.scale, 0.0
        y0, y1 = sorted((m[5], m[3] * size + m[5]))
        if step == 1 and not turned and len(raw) >= LONG and self.show_long(raw, m, y0, y1):
            return
        at, n = 0, len(raw)
        while at < n:
            width = min(step, n - at)
            code = int.from_bytes(raw[at : at + width], "big")
            at += width
            text = font.decode(code, width) if font else chr(code)
            w = 0.6 * size if not font else 0.5 * size if turned and not sized else font.width(code) * size / 1000
            w *= self.scale
            if font and font.type3:
                scan.type3 += 1
            scan.undecoded += text.count("�")
            each = w / max(len(text), 1)
            for k, c in enumerate(text):
                if turned:
                    note(c, *box(m, x + k * each, 0, x + (k + 1) * each, size), size, True)
                else:
                    left, right = m[4] + (x + k * each) * m[0], m[4] + (x + (k + 1) * each) * m[0]
                    note(c, left, y0, right, y1, size, False) if left <= right else note(c, right, y0, left, y1, size, False)
            x += w + extra + (self.word * self.scale if width == 1 and code == 32 else 0)
        self.advance(x)

    def space(self) -> None:
        x, y = multiply(self.tm, self.ctm)[4:]
        self.scan.chars.add(" ", x, y, x + 0.25 * self.size, y + self.size, self.size, False)

    def maybe_space(self, dx: float, dy: float) -> None:
        """A move along the line by a space's width stands for a space."""
        scan = self.scan
        if self.size and abs(dy) <= 0.3 * self.size and 0.15 <= dx / self.size <= 1.0 and len(scan.chars) > self.before and not scan.chars.text[-1][-1].isspace():
            self.space()
