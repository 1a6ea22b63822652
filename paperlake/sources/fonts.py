"""Fonts: codes to text and widths."""

from __future__ import annotations

import re
import struct
import unicodedata
from bisect import bisect_right
from functools import cached_property

import numpy as np

from paperlake.sources.objects import Name, ParseError, Ref, Stream, integer, number

_ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆", "dotaccent": "̇", "dieresis": "̈", "ring": "̊", "hungarumlaut": "̋", "caron": "̌", "cedilla": "̧", "ogonek": "̨", "commaaccent": "̦"}
_PLAIN = """space 20 exclam 21 quotedbl 22 numbersign 23 dollar 24 percent 25 ampersand 26 quotesingle 27 parenleft 28 parenright 29 asterisk 2a plus 2b comma 2c hyphen 2d
period 2e slash 2f zero 30 one 31 two 32 three 33 four 34 five 35 six 36 seven 37 eight 38 nine 39 colon 3a semicolon 3b less 3c equal 3d greater 3e question 3f at 40
bracketleft 5b backslash 5c bracketright 5d asciicircum 5e underscore 5f grave 60 braceleft 7b bar 7c braceright 7d asciitilde 7e exclamdown a1 cent a2 sterling a3
currency a4 yen a5 brokenbar a6 section a7 dieresis a8 copyright a9 ordfeminine aa guillemotleft ab logicalnot ac registered ae macron af degree b0 plusminus b1
acute b4 mu b5 paragraph b6 periodcentered b7 cedilla b8 ordmasculine ba guillemotright bb onequarter bc onehalf bd threequarters be questiondown bf AE c6 Eth d0
multiply d7 Oslash d8 Thorn de germandbls df ae e6 eth f0 divide f7 oslash f8 thorn fe OE 152 oe 153 florin 192 circumflex 2c6 caron 2c7 breve 2d8 dotaccent 2d9
ring 2da ogonek 2db tilde 2dc hungarumlaut 2dd endash 2013 emdash 2014 quoteleft 2018 quoteright 2019 quotesinglbase 201a quotedblleft 201c quotedblright 201d
quotedblbase 201e dagger 2020 daggerdbl 2021 bullet 2022 ellipsis 2026 perthousand 2030 guilsinglleft 2039 guilsinglright 203a fraction 2044 Euro 20ac trademark 2122
minus 2212 fi fb01 fl fb02 ff fb00 ffi fb03 ffl fb04 dotlessi 131 Lslash 141 lslash 142 Dcroat 110 dcroat 111 infinity 221e notequal 2260 lessequal 2264 greaterequal 2265
partialdiff 2202 summation 2211 product 220f radical 221a integral 222b approxequal 2248 lozenge 25ca Omega 3a9 Delta 394 arrowleft 2190 arrowup 2191 arrowright 2192
arrowdown 2193 arrowboth 2194 universal 2200 existential 2203 element 2208 similar 223c congruent 2245 perpendicular 22a5 multiplydot 22c5 club 2663 diamond 2666
heart 2665 spade 2660 nbspace a0 softhyphen ad""".split()
_GREEK = "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa Lambda Mu Nu Xi Omicron Pi Rho . Sigma Tau Upsilon Phi Chi Psi Omega".split()


def _glyph_names() -> dict[str, str]:
    out = {n: chr(int(c, 16)) for n, c in zip(_PLAIN[::2], _PLAIN[1::2])}
    for letter in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
        out[letter] = letter
        for name, mark in _ACCENTS.items():
            whole = unicodedata.normalize("NFC", letter + mark)
            if len(whole) == 1:
                out.setdefault(letter + name, whole)
    for i, name in enumerate(_GREEK):
        if name != ".":
            out.setdefault(name, chr(0x391 + i))
            out.setdefault(name.lower(), chr(0x3B1 + i))
    out["sigma1"] = "ς"
    return out


GLYPHS = _glyph_names()
_ALPHABET = dict(zip(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ")) | dict(zip(b"abcdefghijklmnopqrstuvwxyz", "αβχδεφγηιϕκλμνοπθρστυϖωξψζ"))
SYMBOL = _ALPHABET | {c: chr(c) for c in b" !#%&()+,./0123456789:;<=>?[]_{|}"} | dict(zip([0x22, 0x24, 0x27, 0x2A, 0x2D, 0x40, 0x5C, 0x5E, 0x7E], "∀∃∋∗−≅∴⊥∼")) | dict(zip(range(0xA0, 0xD7), "€ϒ′≤⁄∞ƒ♣♦♥♠↔←↑→↓°±″≥×∝∂•÷≠≡≈…⏐⎯↵ℵℑℜ℘⊗⊕∅∩∪⊃⊇⊄⊂⊆∈∉∠∇®©™∏√")) | dict(zip(range(0xD7, 0xE6), "⋅¬∧∨⇔⇐⇑⇒⇓◊〈®©™∑"))
DINGBATS = {0x20: " "} | {c: chr(0x2701 + c - 0x21) for c in range(0x21, 0x7F)} | {c: chr(0x2776 + c - 0xB6) for c in range(0xB6, 0xD4)} | {0xD4: "➔"}
CMSY = {0x00: "−", 0x01: "⋅", 0x02: "×", 0x03: "∗", 0x06: "±", 0x0E: "∘", 0x0F: "•", 0x14: "≤", 0x15: "≥", 0x21: "→", 0x20: "←", 0x31: "∞", 0x32: "∈", 0x5B: "∪", 0x5C: "∩", 0x66: "{", 0x67: "}", 0x6A: "|"}
_TOKENS = re.compile(rb"<([0-9A-Fa-f\s]*)>|\b(begin|end)(bfchar|bfrange)\b|(\[)|(\])")
_PUT = re.compile(rb"dup\s+(\d+)\s*/([^\s/]+)\s+put")


def bare(name: str) -> str:
    """A font's name without the mark of a subset."""
    return name.partition("+")[2] if "+" in name else name


def builtin(name: str) -> dict[int, str] | None:
    name = bare(name).lower()
    if name.startswith("symbol"):
        return SYMBOL
    if "dingbats" in name:
        return DINGBATS
    return CMSY if name.startswith("cmsy") else None


def glyph(name: str) -> str | None:
    if name in GLYPHS:
        return GLYPHS[name]
    m = re.fullmatch(r"uni([0-9A-Fa-f]{4,6})", name)
    code = int(m[1], 16) if m else -1
    return chr(code) if 0 <= code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def style_flags(name: str, descriptor: int = 0) -> int:
    """Italic 2, serif 4, monospaced 8 and bold 16, from the descriptor's bits or the name."""
    n = bare(name).lower()
    has = lambda *parts: any(p in n for p in parts)
    italic = descriptor & 64 or has("italic", "oblique")
    serif = descriptor & 2 or has("times", "serif", "georgia", "garamond", "roman") and not has("sans")
    mono = descriptor & 1 or has("courier", "mono", "consol", "typewriter")
    bold = descriptor & 262144 or has("bold", "black", "heavy")
    return 2 * bool(italic) + 4 * bool(serif) + 8 * bool(mono) + 16 * bool(bold)


class CMap:
    """A ToUnicode map: single codes and ranges, by the number of a code's bytes."""

    def __init__(self, raw: bytes):
        self.one: dict[tuple[int, int], str] = {}
        self.ranges: list[tuple[int, int, int, bytes]] = []
        kind, pending, nested = None, [], None
        for m in _TOKENS.finditer(raw):
            if m[2]:
                kind, pending, nested = (m[3] if m[2] == b"begin" else None), [], None
            elif not kind:
                continue
            elif m[4]:
                nested = []
            elif m[5]:
                if kind == b"bfrange" and len(pending) == 2 and nested is not None:
                    size, lo = len(pending[0]), int.from_bytes(pending[0], "big")
                    for k, word in enumerate(nested):
                        self.one[size, lo + k] = word.decode("utf-16-be", "replace")
                pending, nested = [], None
            else:
                digits = re.sub(rb"\s", b"", m[1])
                word = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
                if nested is not None:
                    nested.append(word)
                    continue
                pending.append(word)
                if kind == b"bfchar" and len(pending) == 2:
                    self.one[len(pending[0]), int.from_bytes(pending[0], "big")] = pending[1].decode("utf-16-be", "replace")
                    pending = []
                elif kind == b"bfrange" and len(pending) == 3:
                    self.ranges.append((len(pending[0]), int.from_bytes(pending[0], "big"), int.from_bytes(pending[1], "big"), pending[2]))
                    pending = []

    def get(self, code: int, size: int) -> str | None:
        found = self.one.get((size, code))
        if found is not None:
            return found
        for n, lo, hi, base in self.ranges:
            if n == size and lo <= code <= hi and base:
                whole = int.from_bytes(base, "big") + code - lo
                try:
                    return whole.to_bytes(len(base), "big").decode("utf-16-be", "replace")
                except OverflowError:
                    return None
        return None

    def __bool__(self) -> bool:
        return bool(self.one or self.ranges)


def truetype_reverse(data: bytes) -> dict[int, str]:
    """Glyph number to character from a font's Unicode tables; the first mapping of a glyph holds."""
    out: dict[int, str] = {}

    def note(gid: int, code: int) -> None:
        if gid and 0 < code < 0x110000 and not 0xD800 <= code < 0xE000:
            out.setdefault(gid, chr(code))

    try:
        (n,) = struct.unpack_from(">H", data, 4)
        tables = {data[12 + 16 * i : 16 + 16 * i]: struct.unpack_from(">I", data, 20 + 16 * i)[0] for i in range(n)}
        base = tables.get(b"cmap")
        if base is None:
            return out
        (n,) = struct.unpack_from(">H", data, base + 2)
        for i in range(n):
            platform, encoding, offset = struct.unpack_from(">HHI", data, base + 4 + 8 * i)
            if platform not in (0, 3) or platform == 3 and encoding not in (0, 1, 10):
                continue
            at = base + offset
            (form,) = struct.unpack_from(">H", data, at)
            if form == 0:
                for c, gid in enumerate(data[at + 6 : at + 262]):
                    note(gid, c)
            elif form == 4:
                half = struct.unpack_from(">H", data, at + 6)[0] // 2
                ends, starts, deltas, ranges = (struct.unpack_from(f">{half}H", data, at + o) for o in (14, 16 + 2 * half, 16 + 4 * half, 16 + 6 * half))
                for k in range(half):
                    for c in range(starts[k], ends[k] + 1):
                        if c == 0xFFFF:
                            continue
                        gid = c
                        if ranges[k]:
                            (gid,) = struct.unpack_from(">H", data, at + 16 + 6 * half + 2 * k + ranges[k] + 2 * (c - starts[k]))
                            if not gid:
                                continue
                        note((gid + deltas[k]) & 0xFFFF, c)
            elif form == 6:
                first, count = struct.unpack_from(">HH", data, at + 6)
                for k, gid in enumerate(struct.unpack_from(f">{count}H", data, at + 10)):
                    note(gid, first + k)
            elif form in (12, 13):
                (groups,) = struct.unpack_from(">I", data, at + 12)
                for k in range(min(groups, 1 << 16)):
                    lo, hi, gid = struct.unpack_from(">III", data, at + 16 + 12 * k)
                    for c in range(lo, min(hi, lo + 0xFFFF) + 1):
                        note(gid + (c - lo if form == 12 else 0), c)
    except struct.error:
        pass
    return out


class Font:
    MANY = 0xFFFFFFFF

    def __init__(self, doc, entry: dict):
        base = doc.get(entry.get(b"BaseFont"))
        self.name = base.decode("latin-1") if isinstance(base, Name) else "Unknown"
        kind = entry.get(b"Subtype")
        self.type0, self.type3 = kind == Name(b"Type0"), kind == Name(b"Type3")
        widths = entry.get(b"Widths")
        self.widths = [float(w) if type(w) is int else number(doc.get(w)) or 0.0 for w in widths] if isinstance(widths, list) else []
        self.first, self.default = integer(entry.get(b"FirstChar")) or 0, 1000.0
        self.builtin = builtin(self.name)
        self.cmap, self.differences, self.reverse, self.cid = None, {}, {}, []
        descriptor = doc.get(entry.get(b"FontDescriptor"))
        to_unicode = doc.get(entry.get(b"ToUnicode"))
        if isinstance(to_unicode, Stream):
            self.cmap = CMap(doc.body(to_unicode))
        encoding = doc.get(entry.get(b"Encoding"))
        if isinstance(encoding, dict):
            self._differences(encoding.get(b"Differences"))
        below = doc.get(entry.get(b"DescendantFonts"))
        if self.type0 and isinstance(below, list) and below:
            cid = doc.get(below[0])
            if isinstance(cid, dict):
                descriptor = doc.get(cid.get(b"FontDescriptor")) or descriptor
                self.default = number(cid.get(b"DW")) if number(cid.get(b"DW")) is not None else 1000.0
                self._cid_widths(cid.get(b"W"))
        bits = 0
        if isinstance(descriptor, dict):
            bits = integer(descriptor.get(b"Flags")) or 0
            if not self.type0 and number(descriptor.get(b"MissingWidth")) is not None:
                self.default = number(descriptor[b"MissingWidth"])
            file = doc.get(descriptor.get(b"FontFile2"))
            if isinstance(file, Stream) and not self.cmap:
                self.reverse = truetype_reverse(doc.body(file))
            file = doc.get(descriptor.get(b"FontFile"))
            if isinstance(file, Stream) and not self.differences:
                self.differences = {int(c): n.decode("latin-1") for c, n in _PUT.findall(doc.body(file))}
        self.flags = style_flags(self.name, bits)

    def _differences(self, values) -> None:
        code = 0
        for v in values if isinstance(values, list) else []:
            if integer(v) is not None:
                code = v & 255
            elif isinstance(v, Name):
                self.differences[code] = v.decode("latin-1")
                code = (code + 1) & 255

    def _cid_widths(self, values) -> None:
        """`first [w ...]` and `first last w`, as sorted (first, last, widths)."""
        i = 0
        values = values if isinstance(values, list) else []
        while i + 1 < len(values):
            lo = integer(values[i])
            if lo is None:
                break
            if isinstance(values[i + 1], list):
                own = [number(w) or 0.0 for w in values[i + 1]]
                self.cid.append((lo, lo + len(own) - 1, own))
                i += 2
            elif i + 2 < len(values):
                self.cid.append((lo, integer(values[i + 1]) or 0, [number(values[i + 2]) or 0.0]))
                i += 3
            else:
                break
        self.cid.sort(key=lambda r: r[0])
        self.cid_first = [r[0] for r in self.cid]

    def decode(self, code: int, size: int) -> str:
        if self.cmap:
            found = self.cmap.get(code, size)
            if found:
                return found
        if size == 1 and code in self.differences:
            found = glyph(self.differences[code])
            if found:
                return found
        if size == 2:
            return self.reverse.get(code, "�")
        if self.builtin and code in self.builtin:
            return self.builtin[code]
        return chr(code) if code < 256 else "�"

    def width(self, code: int) -> float:
        if self.type0:
            if self.cid:
                k = bisect_right(self.cid_first, code) - 1
                if k >= 0 and code <= self.cid[k][1]:
                    own = self.cid[k][2]
                    return own[code - self.cid[k][0]] if len(own) > 1 else own[0]
            return self.default
        at = code - self.first
        return self.widths[at] if 0 <= at < len(self.widths) else self.default

    @cached_property
    def by_byte(self) -> tuple[np.ndarray, np.ndarray]:
        """Code point (MANY if it isn't one) and width of each code of one byte."""
        if self.cmap or self.differences or self.builtin:
            texts = [self.decode(k, 1) for k in range(256)]
            chars = np.array([ord(t) if len(t) == 1 else self.MANY for t in texts], np.uint32)
        else:
            chars = np.arange(256, dtype=np.uint32)
        return chars, np.array([self.width(k) for k in range(256)], float)

    def two_bytes(self, raw: bytes) -> bool:
        return self.type0 or bool(self.reverse) and not all(32 <= c < 127 for c in raw)


def page_fonts(doc, resources, cache: dict) -> dict[bytes, Font]:
    """Fonts of a resource dictionary by key; a font that can't be read is left out."""
    fonts = doc.get(resources.get(b"Font")) if isinstance(resources, dict) else None
    out = {}
    for key, value in (fonts if isinstance(fonts, dict) else {}).items():
        at = value.num if isinstance(value, Ref) else None
        if at is None or at not in cache:
            try:
                entry = doc.get(value)
                font = Font(doc, entry) if isinstance(entry, dict) else None
            except (ParseError, RecursionError):
                font = None
            if at is not None:
                cache[at] = font
        else:
            font = cache[at]
        if font:
            out[key] = font
    return out
