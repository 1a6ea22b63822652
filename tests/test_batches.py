"""Files in batches, and the kernel's shortcuts for arrays of numbers and long strings."""

from __future__ import annotations

import pyarrow as pa
import pytest

from paperlake.sources import content
from paperlake.sources.content import Scan
from paperlake.sources.document import Document
from paperlake.sources.fonts import Font
from paperlake.sources.objects import Name, Ref, parse
from paperlake.sources.reader import _rows
from paperlake.sources.writer import text_pdf


def test_small_files_share_a_batch():
    files = pa.RecordBatch.from_pydict({"path": [str(k) for k in range(40)], "content": [text_pdf([["one"], ["two"]][: k % 3], title=str(k)) for k in range(40)]})
    (got,) = _rows(True)([files])
    assert got.column("path").to_pylist() == files.column("path").to_pylist()
    assert [["".join(c["c"] for c in p["chars"]) for p in pages] for pages in got.column("pages").to_pylist()] == [["one", "two"][: k % 3] for k in range(40)]


@pytest.mark.parametrize("raw", [b"[]", b"[ ]", b"[1]", b"[ 1\0-2\r\n+3 ]", b"[1 2.5 3]", b"[1 0 R 7]", b"[1%c\n2]", b"[99999999999999999999 1]", b"[[1 2] 3]"])
def test_arrays_of_numbers(raw):
    want = {b"[ 1\0-2\r\n+3 ]": [1, -2, 3], b"[1]": [1], b"[1 2.5 3]": [1, 2.5, 3], b"[1 0 R 7]": [Ref(1, 0), 7], b"[1%c\n2]": [1, 2], b"[99999999999999999999 1]": [0, 1], b"[[1 2] 3]": [[1, 2], 3]}
    assert parse(raw + b" x") == (want.get(raw, []), len(raw))


@pytest.mark.parametrize("state", [b"", b"3 Tc", b"2 Tw", b"80 Tz", b"1 Tc 4 Tw -50 Tz", b"-1 0 0 1 0 0 cm", b"0 0 0 -1 5 5 cm"])
def test_long_strings_as_short_ones(state, monkeypatch):
    data = state + b" BT /F1 10 Tf 1 0 0 1 72.3 700.7 Tm (Some words (in) a line, \\351\\200) Tj 0 -14 Td [(spaced out) -300 (further on)] TJ ET"
    entry = {b"BaseFont": Name(b"Courier"), b"FirstChar": 32, b"Widths": [500 + 3.3 * k for k in range(120)]}
    for fonts in ({}, {b"F1": Font(Document(text_pdf([["x"]])), entry)}):
        long = [tuple(c) for c in Scan(fonts, {}).run(data).chars]
        with monkeypatch.context() as m:
            m.setattr(content, "LONG", 1 << 30)
            assert long == [tuple(c) for c in Scan(fonts, {}).run(data).chars] and len(long) > 40
