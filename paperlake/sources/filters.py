"""Stream filters and the row predictors of cross-reference streams."""

from __future__ import annotations

import re
import zlib

import numpy as np

from paperlake.sources.objects import Name, ParseError


def flate(data: bytes) -> bytes:
    try:
        return zlib.decompress(data)
    except zlib.error as e:
        raise ParseError(f"FlateDecode: {e}") from None


def lzw(data: bytes, early: int = 1) -> bytes:
    """Codes of 9 to 12 bits, most significant first; the width grows `early` codes before the table outgrows it."""
    table: list[bytes] = []
    out, width, bits, held, last = [], 9, 0, 0, None

    def fresh():
        table[:] = [bytes([i]) for i in range(256)] + [b"", b""]

    fresh()
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFFFF, bits + 8
        while bits >= width:
            bits -= width
            code = held >> bits & ((1 << width) - 1)
            if code == 257:
                return b"".join(out)
            if code == 256:
                fresh()
                width, last = 9, None
                continue
            if code < len(table):
                word = table[code]
            elif code == len(table) and last is not None:
                word = last + last[:1]
            else:
                raise ParseError("LZWDecode: a code that isn't in the table")
            out.append(word)
            if last is not None and len(table) < 4096:
                table.append(last + word[:1])
            last = word
            if len(table) + early >= 1 << width and width < 12:
                width += 1
    return b"".join(out)


def ascii85(data: bytes) -> bytes:
    data = data.translate(None, b"\0\t\n\f\r ")
    data = data[2:] if data.startswith(b"<~") else data
    data = data.partition(b"~")[0]
    out, group = bytearray(), []
    for c in data:
        if c == 122 and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (sum(d * 85 ** (4 - i) for i, d in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
        else:
            raise ParseError("ASCII85Decode: a byte outside its alphabet")
    if len(group) > 1:
        n = len(group)
        group += [84] * (5 - n)
        out += (sum(d * 85 ** (4 - i) for i, d in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")[: n - 1]
    return bytes(out)


def run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def ascii_hex(data: bytes) -> bytes:
    raw = re.sub(rb"[\0\t\n\f\r ]", b"", data.partition(b">")[0])
    try:
        return bytes.fromhex((raw + b"0" * (len(raw) % 2)).decode("latin-1"))
    except ValueError:
        raise ParseError("ASCIIHexDecode: a byte that is no digit") from None


#: Filters whose output may have been predicted.
PREDICTED = (b"FlateDecode", b"LZWDecode")
FILTERS = {b"FlateDecode": flate, b"LZWDecode": lzw, b"ASCII85Decode": ascii85, b"RunLengthDecode": run_length, b"ASCIIHexDecode": ascii_hex}


def names(value) -> list[bytes]:
    """The filters of a stream dictionary's /Filter; a reference names none."""
    if isinstance(value, Name):
        return [bytes(value)]
    return [bytes(v) for v in value if isinstance(v, Name)] if isinstance(value, list) else []


def decode(data: bytes, filters, parms=None) -> bytes:
    """All filters in turn, each with its parameters; one that isn't known leaves the bytes as they are."""
    parms = parms if isinstance(parms, list) else [parms]
    for k, f in enumerate(names(filters)):
        own = parms[k] if k < len(parms) and isinstance(parms[k], dict) else {}
        whole = lambda key, default: v if isinstance(v := own.get(key, default), int) else default  # noqa: B023, E731
        if f == b"LZWDecode":
            data = lzw(data, whole(b"EarlyChange", 1))
        else:
            data = FILTERS[f](data) if f in FILTERS else data
        if f in PREDICTED and whole(b"Predictor", 1) >= 10:
            bits = whole(b"Colors", 1) * whole(b"BitsPerComponent", 8)
            data = unpredict(data, (whole(b"Columns", 1) * bits + 7) // 8, whole(b"Predictor", 1), max(bits // 8, 1))
    return data


def unpredict(data: bytes, columns: int, predictor: int, step: int = 1) -> bytes:
    """Rows of `columns` bytes with a filter byte each, pixels of `step` bytes; a partial last row stays as it is."""
    if predictor < 10:
        return data
    if columns <= 0:
        raise ParseError("a predictor needs columns")
    above, out = np.zeros(columns, np.uint8), []
    whole = len(data) // (columns + 1)
    for r in range(whole):
        kind = data[r * (columns + 1)]
        row = np.frombuffer(data, np.uint8, columns, r * (columns + 1) + 1).copy()
        if kind == 2:
            row += above
        elif kind == 1:
            for i in range(step):
                row[i::step] = np.cumsum(row[i::step], dtype=np.uint64).astype(np.uint8)
        elif kind in (3, 4):
            for i in range(columns):
                up = int(above[i])
                left, corner = (int(row[i - step]), int(above[i - step])) if i >= step else (0, 0)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = left if a <= b and a <= c else up if b <= c else corner
                row[i] = (int(row[i]) + guess) & 255
        out.append(row.tobytes())
        above = row
    return b"".join(out) + data[whole * (columns + 1) :]
