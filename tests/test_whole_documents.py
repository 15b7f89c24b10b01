"""The contract queries over long documents: whole texts reach their slots, and SQL still names every row."""

import re

import duckdb
import pytest

import __spark_entry__
from lexweave.plans import fixtures, queries

WORDS = [f"word{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(900)]
NAMES = (
    "page_split format_dispatch numeric_sections numeric_subsections appendix_blocks article_units article_subunits roman_units roman_subunits fallback_units semantic_units "
    "chunk_projection index_build_stats document_metadata path_metadata company_from_filename"
).split()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("long"))
    text = "\n".join("## 5. ARTICLE II, l'article il: " + " ".join(WORDS[at : at + 12]) + ("\n \n" if at % 60 == 0 else "") for at in range(0, 900, 12))
    rows = [(i, text[i:], "en") for i in range(4)] + [(4, None, "en"), (5, "", "en"), (7, "single line", None), (10, "Inc. 1.1 (a)\nBank, x", "de"), (None, "no id", "en")]
    rows += [(20 + i, " ".join(WORDS[:n]), "fr") for i, n in enumerate((255, 256, 257, 472, 473))] + [(24 + 4 * n, "\n".join([" ".join(WORDS[:100])] * n), "fr") for n in range(1, 6)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    return folder


def plain_contract(doc_id, text):
    lines = ["w" + re.sub("[^A-Za-z]+", " ", x).strip().lower().replace("article", "item") for x in (text or "").split("\n")]
    lines = [x for x in lines if x != "w"]
    half = (len(lines) + 1) // 2
    slots = {"{b1}": "\n".join(lines[:half]) or "w", "{b2}": "\n".join(lines[half:]) or "w"}
    return re.sub(r"\{b[12]\}", lambda m: slots[m[0]], fixtures.TEMPLATES[3 if doc_id is None else doc_id % 4])


def test_contracts_hold_every_word(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.markdown for r in fixtures.contracts(docs).collect()}
    assert got == {i: plain_contract(i, t) for i, t in texts.items()}
    assert all(word in got[i] for i in range(4) for word in WORDS)


@pytest.mark.parametrize("name", NAMES)
def test_long_contracts_equal_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    sql = con.sql(__spark_entry__.oracle_sql()[name])
    rows = queries.QUERIES[name](spark, sf)
    columns = sorted(rows.columns)
    assert sorted(sql.columns) == columns
    order = lambda row: tuple((v is None, str(v)) for v in row)
    found = [tuple(r[c] for c in columns) for r in rows.collect()]
    assert sorted(found, key=order) == sorted((tuple(r[sql.columns.index(c)] for c in columns) for r in sql.fetchall()), key=order)
    if name == "chunk_projection":
        assert max(r.child_chunk_count for r in rows.collect()) > 2
