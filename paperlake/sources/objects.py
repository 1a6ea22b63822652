"""The object grammar: bytes to Python values.

null, booleans and numbers are Python's; a name is a Name, strings are Literal (escapes as they
stand) or Hex (hexadecimal text), a dictionary is a dict whose first entry of a key holds, `n g R`
is a Ref and a stream a Stream.
"""

from __future__ import annotations

import re
from typing import NamedTuple

SPACE = b"\0\t\n\r "
_DELIMITERS = b"()<>[]{}/%"
_SKIP = re.compile(rb"(?:[\0\t\n\r ]+|%[^\r\n]*)*")
_REGULAR = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]*")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_REFERENCE = re.compile(rb"(\d+)[\0\t\n\r ]+(\d+)[\0\t\n\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_INTEGERS = re.compile(rb"\[((?:[\0\t\n\r ]*+[+-]?\d{1,18}+(?=[\0\t\n\r \]]))*+)[\0\t\n\r ]*+\]")
HEADER = re.compile(rb"[\0\t\n\r ]*(\d+)[\0\t\n\r ]+(\d+)[\0\t\n\r ]+obj")
_PARENTHESES = re.compile(rb"[()\\]")


class ParseError(ValueError):
    """Says where, and what stands there."""

    def __init__(self, what: str, data: bytes = b"", at: int = 0):
        near = bytes(data[max(0, at - 16) : at + 16])
        super().__init__(f"{what} at byte {at}: {near!r}" if data else what)


class Name(bytes):
    pass


class Literal(bytes):
    pass


class Hex(bytes):
    pass


class Ref(NamedTuple):
    num: int
    gen: int


class Stream(NamedTuple):
    dict: dict
    data: bytes


def skip(data: bytes, at: int) -> int:
    return _SKIP.match(data, at).end()


def _name(data: bytes, at: int) -> tuple[Name, int]:
    end = _REGULAR.match(data, at + 1).end()
    raw = data[at + 1 : end]
    if b"#" in raw:
        out, i = bytearray(), 0
        while i < len(raw):
            if raw[i] == 35 and i + 2 < len(raw):
                try:
                    out.append(int(raw[i + 1 : i + 3], 16))
                except ValueError:
                    raise ParseError("bad # escape in a name", data, at + i) from None
                i += 3
            else:
                out.append(raw[i])
                i += 1
        raw = bytes(out)
    return Name(raw), end


def _literal(data: bytes, at: int) -> tuple[Literal, int]:
    depth, i = 1, at + 1
    while m := _PARENTHESES.search(data, i):
        i = m.end()
        if m[0] == b"\\":
            i += 1
        elif m[0] == b"(":
            depth += 1
        else:
            depth -= 1
            if not depth:
                return Literal(data[at + 1 : i - 1]), i
    raise ParseError("string without end", data, at)


def parse(data: bytes, at: int = 0, depth: int = 0):
    """(value, end) of the object that begins at `at`, after white space and comments."""
    at = skip(data, at)
    if at >= len(data):
        raise ParseError("end of data", data, at)
    if depth > 400:
        raise ParseError("nested too deeply", data, at)
    c = data[at : at + 1]
    if c == b"/":
        return _name(data, at)
    if c == b"(":
        return _literal(data, at)
    if c == b"<":
        if data[at + 1 : at + 2] == b"<":
            out: dict = {}
            at = skip(data, at + 2)
            while data[at : at + 2] != b">>":
                if data[at : at + 1] != b"/":
                    raise ParseError("a key must be a name", data, at)
                key, at = _name(data, at)
                value, at = parse(data, at, depth + 1)
                out.setdefault(bytes(key), value)
                at = skip(data, at)
            return out, at + 2
        end = data.find(b">", at)
        raw = data[at + 1 : end]
        if end < 0 or raw.translate(None, b"0123456789abcdefABCDEF" + SPACE + b"\f"):
            raise ParseError("bad hexadecimal string", data, at)
        return Hex(raw), end + 1
    if c == b"[":
        if m := _INTEGERS.match(data, at):  # such as widths
            return [int(v) for v in m[1].replace(b"\0", b" ").split()], m.end()
        values = []
        at = skip(data, at + 1)
        while data[at : at + 1] != b"]":
            value, at = parse(data, at, depth + 1)
            values.append(value)
            at = skip(data, at)
        return values, at + 1
    m = _REFERENCE.match(data, at)
    if m:
        return Ref(int(m[1]), int(m[2])), m.end()
    m = _NUMBER.match(data, at)
    if m:
        raw = m[0]
        if raw.strip(b"+-").isdigit():
            value = int(raw)
            return (value if -(1 << 63) <= value < 1 << 63 else 0), m.end()
        return float(raw), m.end()
    end = _REGULAR.match(data, at).end()
    word = data[at:end]
    if word in (b"true", b"false", b"null"):
        return {b"true": True, b"false": False, b"null": None}[bytes(word)], end
    raise ParseError("no object", data, at)


def parse_indirect(data: bytes, at: int):
    """(number, value) of `n g obj ... ` at `at`; a stream's bytes follow /Length if direct and right, else endstream."""
    m = HEADER.match(data, at)
    if not m:
        raise ParseError("no indirect object", data, at)
    value, end = parse(data, m.end())
    if isinstance(value, dict):
        at = skip(data, end)
        if data[at : at + 6] == b"stream":
            at += 6
            at += 2 if data[at : at + 2] == b"\r\n" else 1 if data[at : at + 1] in (b"\n", b"\r") else 0
            size = value.get(b"Length")
            if isinstance(size, int) and not isinstance(size, bool) and 0 <= size <= len(data) - at and data[skip(data, at + size) :][:9] == b"endstream":
                return int(m[1]), Stream(value, data[at : at + size])
            end = data.find(b"endstream", at)
            if end < 0:
                raise ParseError("stream without end", data, at)
            body = data[at:end]
            body = body[:-2] if body.endswith(b"\r\n") else body[:-1] if body[-1:] in (b"\n", b"\r") else body
            return int(m[1]), Stream(value, body)
    return int(m[1]), value


_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|[\r\n])|(.)|\Z)", re.S)
_LETTERS = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def unescape(raw: bytes) -> bytes:
    """A literal string's bytes."""
    if b"\\" not in raw:
        return bytes(raw)
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1] else b"" if m[2] else _LETTERS.get(m[3], m[3] or b""), raw)


def unhex(raw: bytes) -> bytes | None:
    """Bytes of hexadecimal text, an odd digit completed by 0; None if anything else is in it."""
    try:
        return bytes.fromhex((raw + b"0" * (len(raw) % 2)).decode("ascii")) if not raw.translate(None, b"0123456789abcdefABCDEF") else None
    except ValueError:
        return None


def bytes_of(value) -> bytes | None:
    """A string object's bytes."""
    if isinstance(value, Literal):
        return unescape(value)
    if isinstance(value, Hex):
        return unhex(value.translate(None, SPACE + b"\f"))
    return None


def text_of(raw: bytes | None) -> str | None:
    """A text string: UTF-16BE after its mark, else UTF-8 with replacements; empty gives None."""
    if not raw:
        return None
    return (raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("utf-8", "replace")) or None


def number(value) -> float | None:
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def integer(value) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) else None
