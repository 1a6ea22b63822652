"""The byte kernel on generated files."""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperlake.sources import crypto, filters, objects
from paperlake.sources.content import Form, Scan
from paperlake.sources.fonts import CMap, Font, builtin, glyph, style_flags, truetype_reverse
from paperlake.sources.kernel import read
from paperlake.sources.objects import Hex, Literal, Name, ParseError, Ref, Stream, parse
from paperlake.sources.sinks import png
from paperlake.sources.writer import FONT, assemble, page_content, stream, text_pdf


def text(page: dict) -> str:
    return "".join(c.c for c in page["chars"])


def one_page(content: bytes = b"", resources: bytes = b"/Font << /F1 3 0 R >>", page: bytes = b"", catalog: bytes = b"", more: dict | None = None, trailer: bytes = b"") -> bytes:
    return assemble(
        {
            1: b"<< /Type /Catalog /Pages 2 0 R %s >>" % catalog,
            2: b"<< /Type /Pages /Count 1 /Kids [5 0 R] >>",
            3: FONT,
            5: b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << %s >> /Contents 6 0 R %s >>" % (resources, page),
            6: stream(content),
            **(more or {}),
        },
        trailer,
    )


@pytest.mark.parametrize(
    ("source", "value"),
    [(b"42", 42), (b"-17", -17), (b"+3.5", 3.5), (b".5", 0.5), (b"99999999999999999999", 0), (b"true", True), (b"null", None), (b"/A#20B", Name(b"A B")), (b"/", Name(b"")), (b"(a(b)c\\))", Literal(b"a(b)c\\)")), (b"<48 65>", Hex(b"48 65")), (b"[1 [2] /X]", [1, [2], Name(b"X")]), (b"<< /A 1 /A 2 >>", {b"A": 1}), (b"12 0 R", Ref(12, 0)), (b"% note\n7", 7)],
)
def test_objects(source, value):
    got, _ = parse(source)
    assert got == value and type(got) is type(value)


@pytest.mark.parametrize("source", [b"", b"/A#GZx", b"(open", b"<4G>", b"<< 1 2 >>", b"truex", b"[1 2"])
def test_bad_objects(source):
    with pytest.raises(ParseError):
        parse(source)


def test_strings():
    assert objects.unescape(rb"a\n\050\\\)\q" + b"\\\r\nz") == b"a\n(\\)qz"
    assert objects.unhex(b"414") == b"A@" and objects.unhex(b"4 1") is None
    assert objects.text_of(b"\xfe\xff\x00A\xd8\x3d\xde\x00") == "A😀" and objects.text_of(b"") is None


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300))
def test_filters_round_trip(data):
    assert filters.flate(zlib.compress(data)) == data
    assert filters.ascii85(base64.a85encode(data) + b"~>") == data
    assert filters.ascii_hex(data.hex().encode() + b">") == data
    runs = b"".join(bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(0, len(data), 128)) + b"\x80"
    assert filters.run_length(runs) == data
    assert filters.decode(zlib.compress(data).hex().encode() + b">", [Name(b"ASCIIHexDecode"), Name(b"FlateDecode")]) == data


def test_lzw_and_unknown_filters():
    bits = "".join(f"{c:09b}" for c in (256, 45, 258, 258, 65, 259, 66, 257))
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert filters.lzw(packed) == b"-----A---B"
    assert filters.decode(b"x", Name(b"Strange")) == b"x"
    with pytest.raises(ParseError):
        filters.flate(b"broken")


def lzw_codes(data: bytes, early: int) -> bytes:
    """An encoder that never resets its table, with codes that widen `early` entries before they must."""
    table, codes, word = {bytes([i]): i for i in range(256)}, [], b""
    out, width, entries = f"{256:09b}", 9, 257
    for c in data:
        if word + bytes([c]) in table:
            word += bytes([c])
            continue
        codes.append(table[word])
        table[word + bytes([c])] = len(table) + 2
        word = bytes([c])
    for code in [*codes, table[word], 257]:
        out += f"{code:0{width}b}"
        entries += 1
        if entries + early >= 1 << width and width < 12:
            width += 1
    return int(out.ljust(-(-len(out) // 8) * 8, "0"), 2).to_bytes(-(-len(out) // 8), "big")


@pytest.mark.parametrize("early", [0, 1])
def test_lzw_of_wider_codes(early):
    data = b"".join(hashlib.sha256(bytes([i])).digest() for i in range(90))
    packed = lzw_codes(data, early)
    parms = {b"EarlyChange": early}
    assert filters.decode(packed, Name(b"LZWDecode"), [parms]) == data
    assert early == 0 or filters.decode(packed, Name(b"LZWDecode")) == data


def test_predicted_rows_of_three_colours():
    rows = [bytes(range(k, k + 6)) for k in (1, 50)]
    left = b"".join(b"\1" + r[:3] + bytes((r[i] - r[i - 3]) & 255 for i in range(3, 6)) for r in rows)
    parms = {b"Predictor": 11, b"Colors": 3, b"Columns": 2}
    assert filters.decode(zlib.compress(left), Name(b"FlateDecode"), parms) == b"".join(rows)


def test_images_of_forms():
    form = b"<< /Type /XObject /Subtype /Form /Resources << /XObject << /I 10 0 R /F 9 0 R >> >> /Length 5 >>\nstream\n/I Do\nendstream"
    image = lambda w: b"<< /Subtype /Image /Width %d /Height 1 /Length 1 >>\nstream\nx\nendstream" % w
    more = {9: form, 10: image(7), 11: image(8)}
    page = read(one_page(b"/F Do /I Do", b"/XObject << /F 9 0 R /I 11 0 R >>", more=more))["pages"][0]
    assert page["error"] is None and [i["width"] for i in page["images"]] == [7, 8]


def test_predictors():
    rows = bytes([0, 1, 2, 3, 1, 1, 1, 1, 2, 1, 1, 1, 3, 2, 2, 2, 4, 1, 1, 1])
    assert filters.unpredict(rows, 3, 12) == bytes([1, 2, 3, 1, 2, 3, 2, 3, 4, 3, 5, 6, 4, 6, 7])
    assert filters.unpredict(bytes([0, 1, 2, 9]), 2, 12) == bytes([1, 2, 9])
    with pytest.raises(ParseError):
        filters.unpredict(b"x", 0, 12)


def test_aes_and_rc4_vectors():
    assert crypto.aes_cbc(bytes(range(16)), bytes(16) + bytes.fromhex("69c4e0d86a7b0430d8cdb78070b4c55a")).hex() == "00112233445566778899aabbccddeeff"
    assert crypto.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


def test_text_metadata_and_recovery():
    file = text_pdf([["Hello (world)", "second"], ["page two"]], title="Tïtle")
    got = read(file)
    assert [text(p) for p in got["pages"]] == ["Hello (world)second", "page two"] and got["metadata"]["title"] == "Tïtle" and got["pdf_version"] == "1.4"
    for broken in (file.replace(b"startxref", b"startnone"), file[: file.rfind(b"xref\n0")], file.replace(b"startxref\n", b"startxref\n9")):
        got = read(broken)
        assert [text(p) for p in got["pages"]] == ["Hello (world)second", "page two"] and got["error"] is None
    assert read(b"junk")["error"] and read(b"")["error"]


def test_damaged_page_leaves_the_others():
    file = text_pdf([["first"], ["second"]])
    at = file.index(b"stream\n", file.index(b"6 0 obj")) + 7
    got = read(file[:at] + b"\0" * 8 + file[at + 8 :])
    assert got["pages"][0]["error"] and got["pages"][0]["rect"] == [0, 0, 612, 792] and text(got["pages"][1]) == "second"


def test_update_sections():
    base = text_pdf([["old text"]])
    body = b"6 0 obj\n" + stream(page_content(["new text"])) + b"\nendobj\n"
    start = int(base.rsplit(b"startxref\n", 1)[1].split()[0])
    at = len(base)
    tail = b"xref\n6 1\n%010d 00000 n \ntrailer\n<< /Size 7 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at, start, at + len(body))
    assert text(read(base + body + tail)["pages"][0]) == "new text"


def test_object_streams():
    members = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [4 0 R] /Count 1 >>", 3: FONT, 4: b"<< /Type /Page /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> /Contents 5 0 R >>"}
    head, body = b"", b""
    for num, value in members.items():
        head += b"%d %d " % (num, len(body))
        body += value + b" "
    out, at = bytearray(b"%PDF-1.5\n"), {}
    for num, blob in ((5, stream(page_content(["packed"]))), (6, stream(head + body, b"/Type /ObjStm /N 4 /First %d" % len(head)))):
        at[num] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (num, blob)
    start = len(out)
    rows = [(0, 0, 0), *[(2, 6, i) for i in range(4)], (1, at[5], 0), (1, at[6], 0), (1, start, 0)]
    raw, above = b"", bytes(4)
    for kind, x, y in rows:
        row = struct.pack(">BHB", kind, x, y)
        raw += b"\x02" + bytes((a - b) & 255 for a, b in zip(row, above))
        above = row
    out += b"7 0 obj\n" + stream(raw, b"/Type /XRef /W [1 2 1] /Size 8 /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 4 >>") + b"\nendobj\nstartxref\n%d\n%%%%EOF" % start
    got = read(bytes(out))
    assert text(got["pages"][0]) == "packed" and got["pdf_version"] == "1.5"


def _encrypted(v: int, r: int, size: int, wrong: bool = False) -> bytes:
    owner, rights, first = b"o" * 32, -4, b"0123456789abcdef"
    key = hashlib.md5(crypto.PAD + owner + (rights & 0xFFFFFFFF).to_bytes(4, "little") + first).digest()
    for _ in range(50 if r >= 3 else 0):
        key = hashlib.md5(key[:size]).digest()
    key = key[:size]
    if r == 2:
        user = crypto.rc4(key, crypto.PAD)
    else:
        user = crypto.rc4(key, hashlib.md5(crypto.PAD + first).digest())
        for i in range(1, 20):
            user = crypto.rc4(bytes(k ^ i for k in key), user)
        user = user.ljust(32, b"\0")
    if wrong:
        user = bytes(32)
    content = page_content(["secret text"])
    own = hashlib.md5(key + (6).to_bytes(3, "little") + b"\0\0").digest()[: min(size + 5, 16)]
    objs = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Count 1 /Kids [5 0 R] >>",
        3: FONT,
        5: b"<< /Type /Page /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> /Contents 6 0 R >>",
        6: stream(crypto.rc4(own, content), flate=False),
        9: b"<< /Filter /Standard /V %d /R %d /Length %d /P %d /O <%s> /U <%s> >>" % (v, r, size * 8, rights, owner.hex().encode(), user.hex().encode()),
    }
    return assemble(objs, b"/Encrypt 9 0 R /ID [<%s> <00>]" % first.hex().encode())


def test_encryption():
    for v, r, size in ((1, 2, 5), (2, 3, 16)):
        got = read(_encrypted(v, r, size))
        assert text(got["pages"][0]) == "secret text" and got["is_encrypted"]
        assert "password" in read(_encrypted(v, r, size, wrong=True))["error"]
    assert "not supported" in read(_encrypted(5, 6, 32))["error"]


def test_content_operators():
    show = lambda content, **k: text(read(one_page(content, **k))["pages"][0])
    assert show(b"BT /F1 12 Tf [(A) -100 (B) -200 (C)] TJ ET") == "AB C"
    assert show(b"BT /F1 12 Tf 14 TL (a) Tj (b) ' 1 2 (c) \" ET") == "abc"
    assert show(b"BT /F1 10 Tf (a) Tj 5 0 Td (b) Tj 50 0 Td (c) Tj ET") == "a bc"
    page = read(one_page(b"q 2 0 0 2 10 20 cm BT /F1 10 Tf 1 0 0 1 5 5 Tm (x) Tj ET Q BT 0 1 -1 0 300 300 Tm /F1 10 Tf (r) Tj ET"))["pages"][0]
    x, r = page["chars"]
    assert (x.x0, x.y0, x.x1, x.y1, x.rotated) == (20, 30, 32, 50, False) and r.rotated and (r.x0, r.y0) == (290, 300)


def test_inline_images_and_forms():
    page = read(one_page(b"q 100 0 0 50 10 10 cm BI /W 1 /H 1 ID xEIy EI Q BT /F1 9 Tf (after) Tj ET"))["pages"][0]
    assert page["inline_image_count"] == 1 and text(page) == "after" and page["image_refs"][0][1:] == (10, 10, 110, 60)
    forms = {f"F{k}".encode(): Form(b"BT (%d) Tj ET /F%d Do" % (k, k + 1), (1, 0, 0, 1, 0, 0), {}) for k in range(1, 6)}
    assert "".join(c.c for c in Scan({}, forms).run(b"/F1 Do").chars) == "123"
    nothing = read(one_page(b"BT /F1 9 Tf (a) Tj ET BI /W 1 ID never"))["pages"][0]
    assert text(nothing) == "a" and nothing["inline_image_count"] == 0


def test_images():
    image = stream(b"\x01\x02\x03", b"/Subtype /Image /Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceRGB")
    jpeg = stream(b"\xff\xd8", b"/Subtype /Image /Width 4 /Height 3 /Filter /DCTDecode", flate=False)
    page = read(one_page(b"q 9 0 0 9 0 0 cm /I Do Q /J Do /Missing Do", b"/XObject << /I 7 0 R /J 8 0 R >>", more={7: image, 8: jpeg}))["pages"][0]
    assert [i.name for i in page["image_refs"]] == ["I", "J", "Missing"]
    assert [(i["seq"], i["ext"], i["width"], i["image"], i["colorspace"], i["xref"]) for i in page["images"]] == [(0, "png", 1, b"\x01\x02\x03", "DeviceRGB", 7), (1, "jpeg", 4, b"\xff\xd8", "DeviceRGB", 8)]


def test_links_and_outline():
    page = b"/Annots [<< /Subtype /Link /Rect [1 2 3 4] /A << /S /URI /URI (http://x) >> >> << /Subtype /Link /Rect [0 0 1 1] /Dest [5 0 R /XYZ 7 8 0] >> << /Subtype /Link /A << /S /Named /N /NextPage >> >> << /Subtype /Link /A << /S /GoToR /F (o.pdf) /D [3 /XYZ 1 2 0] >> >> << /Subtype /Link /A << /S /Launch /F (run) >> >> << /Subtype /Text >>]"
    more = {
        10: b"<< /First 11 0 R >>",
        11: b"<< /Title (One) /Dest (here) /Next 12 0 R /First 13 0 R >>",
        12: b"<< /Title <FEFF00540077006F> /A << /S /URI /URI (http://y) >> /Next 11 0 R >>",
        13: b"<< /Title (Below) /Dest [5 0 R /Fit] >>",
        14: b"<< /Kids [15 0 R 16 0 R] >>",
        15: b"<< /Limits [(a) (b)] /Names [(a) [5 0 R /Fit]] >>",
        16: b"<< /Limits [(h) (z)] /Names [(here) << /D [5 0 R /XYZ 3 4 0] >>] >>",
    }
    got = read(one_page(page=page, catalog=b"/Outlines 10 0 R /Names << /Dests 14 0 R >>", more=more))
    assert [(x["kind"], x["uri"], x["to_page"], x["to_point"], x["name"], x["file"], x["remote_page"]) for x in got["pages"][0]["links"]] == [
        ("uri", "http://x", None, None, None, None, None),
        ("goto", None, 0, [7, 8], None, None, None),
        ("named", None, None, None, "NextPage", None, None),
        ("gotor", None, None, [1, 2], None, "o.pdf", 3),
        ("launch", None, None, None, None, "run", None),
    ]
    assert [(t["level"], t["title"], t["page"], t["to_point"], t["uri"]) for t in got["toc"]] == [(1, "One", 0, [3, 4], None), (2, "Below", 0, None, None), (1, "Two", None, None, "http://y")]


class _Doc:
    @staticmethod
    def get(v):
        return v

    @staticmethod
    def body(s):
        return s.data


def test_fonts():
    cmap = CMap(b"1 beginbfchar <01> <00660069> endbfchar 2 beginbfrange <10> <12> <0041> <20> <21> [<0061> <0062>] endbfrange")
    assert [cmap.get(c, 1) for c in (1, 0x11, 0x21, 0x30)] == ["fi", "B", "b", None] and cmap.get(1, 2) is None
    simple = Font(_Doc, {b"BaseFont": Name(b"AB+Times-Bold"), b"FirstChar": 65, b"Widths": [700, 650], b"Encoding": {b"Differences": [66, Name(b"eacute"), Name(b"uni20AC")]}})
    assert [simple.decode(c, 1) for c in (65, 66, 67)] == ["A", "é", "€"] and (simple.width(65), simple.width(90)) == (700, 1000) and simple.flags == 20
    wide = Font(_Doc, {b"Subtype": Name(b"Type0"), b"ToUnicode": Stream({}, b"beginbfchar <0001> <0058> endbfchar"), b"DescendantFonts": [{b"DW": 500, b"W": [1, [300, 400], 10, 12, 250]}]})
    assert [wide.width(c) for c in (1, 2, 3, 11)] == [300, 400, 500, 250] and wide.decode(1, 2) == "X" and wide.decode(9, 2) == "�"
    assert builtin("ABC+Symbol")[97] == "α" and glyph("nothing") is None and style_flags("X+CourierNew-Oblique") == 10


def test_truetype_reverse():
    table = struct.pack(">HHHHHHH", 4, 32, 0, 4, 0, 0, 0) + struct.pack(">HH", 66, 0xFFFF) + b"\0\0" + struct.pack(">HH", 65, 0xFFFF) + struct.pack(">hh", -60, 1) + struct.pack(">HH", 0, 0)
    cmap = struct.pack(">HHHHI", 0, 1, 3, 1, 12) + table
    font = struct.pack(">IHHHH", 0x10000, 1, 0, 0, 0) + b"cmap" + struct.pack(">III", 0, 28, len(cmap)) + cmap
    assert truetype_reverse(font) == {5: "A", 6: "B"} and truetype_reverse(b"bad") == {}


def test_png():
    blob = png(2, 1, b"\1\2\3\4\5\6")
    assert blob[:8] == b"\x89PNG\r\n\x1a\n" and zlib.decompress(blob[41 : 41 + struct.unpack(">I", blob[33:37])[0]]) == b"\0\1\2\3\4\5\6"
    with pytest.raises(ValueError):
        png(2, 2, b"")
