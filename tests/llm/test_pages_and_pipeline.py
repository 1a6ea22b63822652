"""WARC, HTML and the pipeline."""

from __future__ import annotations

import gzip
import io
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from paperlake.llm import decontaminate, html_text, warc

PAGES = "page_id long, url string, html string"


@pytest.fixture
def pages(spark):
    rows = [(1, "http://a", "<p>same"), (2, "http://b", "<p>other é"), (3, "http://c", "<p>same"), (3, "http://c", "<p>same"), (4, None, "<p>same"), (5, "http://e", None), (None, "http://f", "x"), (6, "http://g", ""), (7, "http://h\r\nX: y", "z" * 300_000)]
    return spark.createDataFrame(rows, PAGES)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_warc_pages(spark, pages, tmp_path):
    got = {r.page_id: r for r in warc.resolve_pages(pages.selectExpr("*", "1 AS digest", "2 AS payload", "'t' AS type"), f"file://{tmp_path}/w").collect()}
    assert set(got) == {1, 2, 3, 4, 6, 7}
    assert [(got[k].record_type, got[k].refers_to_page, got[k].payload_bytes) for k in (1, 2, 3, 4, 6, 7)] == [("response", None, 7), ("response", None, 11), ("revisit", 1, 7), ("revisit", 1, 7), ("response", None, 0), ("response", None, 300_000)]
    assert warc.resolve_pages(pages.limit(0), f"file://{tmp_path}/none").count() == 0


def test_archives_have_fresh_headers(spark, pages, tmp_path):
    warc.resolve_pages(pages, f"file://{tmp_path}/w")
    records = []
    for path in (tmp_path / "w" / "archives").glob("*.warc.gz"):
        whole = gzip.decompress(path.read_bytes())
        for head, _, rest in [m.partition(b"\r\n\r\n") for m in re.split(rb"(?=WARC/1\.1\r\n)", whole) if m]:
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            block = rest[: int(fields["Content-Length"])]
            assert rest[len(block) :] == b"\r\n\r\n" and warc.sha1(block) == fields["WARC-Block-Digest"]
            records.append(fields["WARC-Type"])
            assert ("WARC-Refers-To" in fields) == (fields["WARC-Type"] == "revisit") and "X" not in fields
    assert sorted(records) == ["response"] * 4 + ["revisit"] * 2


def test_existing_archives(spark, tmp_path):
    base = {"uri": "http://u", "date": "2021-01-01T00:00:00Z", "http": "HTTP/1.1 200 OK\r\nA: b\r\n", "refers_to_id": None, "refers_to_uri": None, "refers_to_date": None}
    kinds = [("<a>", "response", "d1", b"one"), ("<b>", "revisit", "d1", None), ("<c>", "revisit", "d9", None), ("<d>", "response", "d1", b"one"), ("<e>", "response", "d2", b"")]
    blobs = [warc.record_bytes(base | {"record_id": i, "type": t, "digest": d, "payload": p}) for i, t, d, p in kinds]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(b) for b in blobs) + gzip.compress(b"WARC/1.1\r\nContent-Length: 99\r\n\r\ncut"))
    (tmp_path / "y.warc").write_bytes(blobs[4])
    read = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz",)], "path string"))
    assert [(r.record_id, r.type, r.digest, r.payload and bytes(r.payload)) for r in read.collect()] == [(i, t, d, p if t == "response" and p else b"" if t == "response" else None) for i, t, d, p in kinds]
    assert {r.record_id: r.refers_to_id for r in warc.resolve_revisits(read).collect()} == {"<a>": None, "<b>": "<a>", "<c>": None, "<d>": None, "<e>": None}
    assert {r.record_id: (r.type, r.refers_to_id) for r in warc.deduplicate(read, ["date"]).collect()} == {"<a>": ("response", None), "<b>": ("revisit", "<a>"), "<c>": ("revisit", None), "<d>": ("revisit", "<a>"), "<e>": ("response", None)}
    assert [r["record_id"] for r in warc.parse(io.BytesIO(blobs[4]))] == ["<e>"]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain &amp; <b>bold</b>\n text", "plain & bold text"),
        ("<p>a<p>b", "a\n\nb"),
        ("<div>a<div>b</div>c</div>", "a\nb\nc"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<ul><li>one<li>two<ol start=3><li>x<li value=9>y</ol></ul>", "- one\n- two\n\n  3. x\n  9. y"),
        ("<table><tr><th>Name<th>N<tr><td>Apple pie<td>1</table>", "Name      | N\nApple pie | 1"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
        ("<table><tr><td colspan=2>wide one<tr><td>a<td>b</table>", "wide one\na | b"),
        ("<head><title>t</title><style>p{}</style></head><body>x<script>var a='<p>no';</script>y", "xy"),
        ("a<span hidden>no</span><i style='display: none'>no</i><template>no</template>b", "ab"),
        ("<pre>  x\n    y</pre>", "  x\n    y"),
        ("<details><summary>S</summary>no</details><details open><summary>S</summary>yes</details>", "S\n\nS\nyes"),
        ("<p>a</b></div>b<!-- no <p> -->c", "abc"),
        ("x < y & z", "x < y & z"),
        ("<b><p>a</b>b</p>c", "ab\n\nc"),
        ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
        ("<blockquote>q<p>r</blockquote>", "  q\n\n  r"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("<textarea><b>t</textarea>", "<b>t"),
    ],
)
def test_rendering(html, text):
    assert html_text.render(html) == text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<br>", "<h1>", "</h1>", "w1 ", "w2 ", "w3 ", "&lt;", "< ", "<!--x-->"]), max_size=40))
def test_all_words_are_kept(parts):
    out = html_text.render("".join(parts))
    for w in ("w1", "w2", "w3"):
        assert out.count(w) == "".join(parts).count(w)


def test_html_edges(spark, pages):
    assert rows(html_text.extract_text(pages.selectExpr("*", "1 AS text", "2 AS n_chars"))) == rows(html_text.extract_text(pages))
    assert html_text.extract_text(pages.where("html IS NULL")).first().text is None and html_text.extract_text(pages.limit(0)).count() == 0
    assert "deep" in html_text.render("<div>" * 50_000 + "deep") and len(html_text.render("a " * 200_000)) > 390_000


def test_pipeline_stages(spark):
    """What each stage does is checked on its own input; the whole is the stages in turn."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, seen[-1], sf).collect(), docs.schema)
        assert out.columns == names and 0 < out.count() <= seen[-1].count(), name
        seen.append(out)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    leaks = {r.doc_id for r in decontaminate.overlaps(seen[3], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert ids[4] == ids[3] - leaks
    final = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in final.collect()} == ids[4] and final.where("NOT round_trip").count() == 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>Let <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math>.</p>", "Let x= 1 2 ."),
        ("<p><math><semantics><mi>y</mi><annotation encoding='TeX'>\\\\y</annotation></semantics></math> holds</p>", "y holds"),
        ("<p>A <svg><title>t</title><desc>d</desc><defs><text>no</text></defs>loose<g><circle r='1'/><text x='1'>Jan<tspan>uary</tspan></text><text>Feb</text></g><text display='none'>no</text></svg> B</p>", "A January Feb B"),
        ("<svg><foreignObject><p>in</p></foreignObject></svg><p>out</p>", "in\n\nout"),
        ("<svg><path d='M0'/><p>after an open svg</p>", "after an open svg"),
        ("<svg><style>text{}</style><script>x</script></svg><desc>shown</desc>", "shown"),
    ],
)
def test_formulas_and_labels_of_drawings(html, text):
    assert html_text.render(html) == text
