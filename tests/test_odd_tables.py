"""Queries against their SQL on small tables with odd rows."""

import duckdb
import pytest
from corpusloom.plans import catalog


def differing(spark, folder, name, table, rows, schema):
    """Rows of the query and of its SQL that the other does not have."""
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    got = catalog.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    want = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    want, got = sorted(want.fetchall(), key=repr), sorted((tuple(r) for r in got.select(*names).collect()), key=repr)
    return [r for r in got if r not in want], [r for r in want if r not in got]


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("size", [46_340, 46_341, 140_000])
def test_measures_of_long_texts(spark, tmp_path, size):
    rows = [(1, "x" * size, "en", "s", size), (2, "short", "en", "s", 5)]
    assert differing(spark, tmp_path, "text_measures", "documents", rows, DOCUMENTS) == ([], [])


def test_measures_of_odd_texts(spark, tmp_path):
    texts = [None, "", " ", "😀 marks 😀", "x" * 39 + "😀y", "\U0010ffff" * 40, "\uffff", "é" * 51, "x" * ((1 << 20) - 1), "x" * (1 << 20), "x" * (3 << 20)]
    assert differing(spark, tmp_path, "text_measures", "documents", [(n, t, "en", "s", 1) for n, t in enumerate(texts)], DOCUMENTS) == ([], [])


#: Texts that are null, blank or begin or end with what captions pass over, and a null id.
CAPTIONED = [None, "", " ", "\n", "- a list", "– dash", ": a", "..", "\ttab", "a\rb", "a\r\nb", "y\r", "a\u2028b", "\u2029", "z\x85", " " * 31 + "late", "x" * 29 + " y", "Figure 3: of it", "\rTable 4: of it", "\x01", "a\x02b\x02", "\u3000x\u3000"]
CAPTIONED = [(n, t, "en", "s", 1) for k, t in enumerate(CAPTIONED) for n in (2 * k, 2 * k + 1)] + [(None, t, "en", "s", 1) for t in ("text", None)]


@pytest.mark.parametrize("name", ["chunks_with_figures", "figure_chunks"])
def test_figures_of_odd_texts(spark, tmp_path, name):
    assert differing(spark, tmp_path, name, "documents", CAPTIONED, DOCUMENTS) == ([], [])


def test_regions_of_texts_with_lines(spark, tmp_path):
    rows = [(4, "token = 'a'\nkey: b", "en", "s", 18), (9, "- a\n- b\nc", "en", "s", 9), (14, "Figure 2 of a page", "en", "s", 18), (19, None, "en", "s", 0), (24, "", "en", "s", 0), (20, "x", "en", "s", 1), (23, "x", "en", "s", 1)]
    assert differing(spark, tmp_path, "region_kinds", "documents", rows, DOCUMENTS) == ([], [])


@pytest.mark.parametrize("name", ["main_content", "best_elements"])
@pytest.mark.parametrize("cut", ["&amp", "&am", "&", "&quot", "&copy;", "&lt", "&#38;"])
def test_pages_with_cut_references(spark, tmp_path, name, cut):
    long = "Some words of a text. " * 22 + "wordwordwordwo"  # with the heading 500 characters, or fewer by a reference that is read
    html = f"<html><head><title>A title of a page {cut}</title></head><body><article><h1>A title of a page {cut}</h1><p>{long} {cut} b &amp;amp &quot;</p></article><footer>&copy;</footer></body></html>"
    rows = [(n, f"http://h{n}.com/en/", html) for n in range(1, 5)]
    assert differing(spark, tmp_path, name, "pages", rows, "page_id long, url string, html string") == ([], [])
