"""Layout in one pass over pages: odd documents against SQL, and plans that keep characters out of rows."""

from __future__ import annotations

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from paperlake.plans.registry import ORACLE_SQL, QUERIES

IN_ONE_PASS = [
    "grid_blocks",
    "grid_lines",
    "page_text",
    "scanned_pages",
    "reading_order",
    "grid_spans",
    "page_rects",
    "outside_blocks",
    "grid_columns",
]
TEXTS = [None, "", " ", "\n" * 5, "a", " " * 3500 + "b", "x y z", "中é\U0001f600 b"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Null, empty and repeated documents, and some that end at a row's or a page's end."""
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab" + " " * rng.choice([1, 9, 40]) + "\né中\U0001f600\r\t") for _ in range(n)) for n in (59, 60, 61, 2999, 3000, 3001, 6100, 280_000)]
    rows = [*enumerate(texts), (6, texts[6]), (14, texts[14]), (15, None), (None, "x")]
    folder = tmp_path_factory.mktemp("odd")
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]}), folder / "documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", [*IN_ONE_PASS, "pdf_documents", "pdf_chars"])
def test_odd_documents(spark, odd, name, tmp_path):
    if name not in ORACLE_SQL:
        pytest.skip("no SQL")
    if name == "pdf_chars":  # files are written in Latin-1
        table = pq.read_table(f"{odd}/documents.parquet")
        texts = [t and t.encode("latin-1", "replace").decode("latin-1") for t in table["text"].to_pylist()]
        odd = str(tmp_path)
        pq.write_table(table.set_column(1, "text", pa.array(texts)), f"{odd}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{odd}/documents.parquet')")
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, odd).select(*names).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", [*IN_ONE_PASS, "pdf_chars"])
def test_characters_stay_arrays(spark, odd, name):
    plan = QUERIES[name](spark, odd)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "collect_list" not in plan and "Window" not in plan and "MapInArrow" in plan
