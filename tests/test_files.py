"""Files on disk through reader, API, sinks, stream and command line."""

from __future__ import annotations

import json

import pytest

from paperlake import api, cli
from paperlake.functions.text import selected_pages
from paperlake.sources import sinks
from paperlake.sources.reader import Corpus
from paperlake.sources.writer import assemble, page_content, stream, text_pdf
from paperlake.streaming.files import ingest


def _outlined() -> bytes:
    font = b"<< /Type /Font /BaseFont /Courier /FirstChar 0 /Widths [" + b"600 " * 256 + b"] >>"
    content = page_content(["Large title"], size=24) + b"\n" + page_content(["body text " * 5] * 4, top=500)
    return assemble({
        1: b"<< /Type /Catalog /Pages 2 0 R /Outlines 7 0 R >>", 2: b"<< /Type /Pages /Count 1 /Kids [5 0 R] >>", 3: font,
        5: b"<< /Type /Page /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> /XObject << /I 9 0 R >> >> /Contents 6 0 R /Annots [<< /Subtype /Link /Rect [0 0 9 9] /A << /S /URI /URI (http://x) >> >>] >>",
        6: stream(content + b" q 20 0 0 20 5 5 cm /I Do Q"), 7: b"<< /First 8 0 R >>", 8: b'<< /Title (A "part") /Dest [5 0 R /Fit] >>',
        9: stream(b"abc", b"/Subtype /Image /Width 1 /Height 1"),
    })


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    (at / "sub").mkdir()
    (at / "a.pdf").write_bytes(text_pdf([["first page"], ["second page"]], title="A"))
    (at / "sub" / "b.pdf").write_bytes(_outlined())
    (at / "bad.pdf").write_bytes(b"nothing")
    (at / "note.txt").write_text("not read")
    return at


def test_tables(spark, folder):
    c = Corpus.load(spark, f"file:{folder}")
    docs = {r.path.rsplit("/", 1)[1]: r for r in c.documents.collect()}
    assert set(docs) == {"a.pdf", "b.pdf", "bad.pdf"} and docs["a.pdf"].page_count == 2 and docs["bad.pdf"].error and docs["a.pdf"].metadata.title == "A"
    text = {(r.path.rsplit("/", 1)[1], r.page): r.text for r in c.page_text.collect()}
    assert text["a.pdf", 1] == "second page\n\n" and text["b.pdf", 0].startswith("Large title\n\nbody text")
    assert c.images.count() == 1 and c.links.first().uri == "http://x" and c.toc.first().title == 'A "part"'
    assert {r.is_scanned for r in c.pages.collect()} == {False}


def test_documents(spark, folder):
    with api.open_document(spark, f"{folder}/a.pdf") as doc:
        assert len(doc) == 2 and doc[-1].get_text() == "second page\n\n" and doc.get_toc() == [] and [p.number for p in doc] == [0, 1]
        assert doc[0].get_text("blocks")[0][4:] == ("first page", 0, 0) and doc[0].get_text("dict")["blocks"][0]["lines"][0]["spans"][0]["font"] == "F1"
        with pytest.raises(IndexError):
            doc[2]
        with pytest.raises(ValueError):
            doc[0].get_text("html")
        with pytest.raises(NotImplementedError):
            doc[0].get_pixmap()
    other = api.open_document(spark, f"{folder}/sub/b.pdf")
    assert other.get_toc() == [[1, 'A "part"', 1]] and other[0].get_links()[0]["uri"] == "http://x" and other[0].get_images()[0]["image"] == b"abc"
    assert api.extract_links(spark, f"{folder}/sub/b.pdf")[0]["kind"] == "uri"
    for path in ("bad.pdf", "missing.pdf"):
        with pytest.raises(ValueError):
            api.open_document(spark, f"{folder}/{path}")


def test_extract_many(spark, folder):
    paths = [f"{folder}/sub/b.pdf", f"{folder}/bad.pdf", f"{folder}/a.pdf"]
    got = api.extract_many(spark, paths, include_images=True, include_pages=True)
    assert [p for p, _ in got] == paths and got[1][1] == [] and len(got[0][1][1]) == 1 and [p["page"] for p in got[2][1][2]] == [0, 1]
    blocks, images = api.extract(spark, paths[2])
    assert [b["page"] for b in blocks] == [0, 1] and images == []
    assert api.extract_many(spark, []) == []


def test_sinks(spark, folder, tmp_path):
    c = Corpus.load(spark, f"file:{folder}").persist(f"{tmp_path}/parsed")
    sinks.write_text(c, f"{tmp_path}/text")
    assert "second page" in "".join(p.read_text() for p in (tmp_path / "text" / "doc=a").glob("*.txt"))
    sinks.write_json(c, f"{tmp_path}/json")
    assert json.loads("".join(p.read_text() for p in (tmp_path / "json" / "doc=b").glob("*.txt")))["images"][0]["image"] == "YWJj"
    sinks.write_index(c, f"{tmp_path}/index")
    assert {r.page_count for r in spark.read.json(f"{tmp_path}/index").collect()} >= {1, 2}
    assert sinks.yaml_outline(c).first().yaml == '- title: "A \\"part\\""\n  page: 1\n'
    assert {r.markdown.splitlines()[0] for r in sinks.markdown(c).collect()} >= {"## Large title"}


def test_stream(spark, folder, tmp_path):
    for _ in range(2):
        ingest(spark, f"file:{folder}", f"{tmp_path}/table", f"{tmp_path}/state").awaitTermination()
    assert Corpus(spark.read.parquet(f"{tmp_path}/table")).documents.count() == 3


def test_command_line(spark, folder, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    assert cli.main(["extract", f"{folder}/a.pdf", f"{folder}/bad.pdf", "--pages", "1-", "--output", str(tmp_path)]) == 0
    assert (tmp_path / "a.txt").read_text() == "second page\n\n" and "bad.pdf" in capsys.readouterr().err
    assert cli.main(["toc", f"{folder}/sub/*.pdf"]) == 0 and 'A "part" 1' in capsys.readouterr().out
    assert cli.main(["info", f"{folder}/a.pdf"]) == 0 and json.loads(capsys.readouterr().out)["pages"] == 2


def test_page_selection():
    assert selected_pages("0,3,5-8", 7) == [0, 3, 5, 6] and selected_pages("5-", 7) == [5, 6] and selected_pages("-2,1", 7) == [0, 1, 2] and selected_pages("9", 7) == []
