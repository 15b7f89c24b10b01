"""The one-pass segmenter against the window formulation, on random and odd documents."""

import random

import pytest
from pyspark.sql import functions as F

from lexweave.operators import machine, segment
from lexweave.plans import queries

POOL = [
    "1. Term", "2. Payment of sums", "## 3. Foo", "Appendix", "## Appendix", "text", "", "", "1.1 sub words. More", "- 2.1 Fees: due", "### 2.2.1 Deep", "12. 5 no", "more text.", "ARTICLE I", "article iv", "TITLE HERE",
    "Section 1.1 Terms.", "SECTION 2.2 CAPS", "(a) First item. words", "(b) Second", "Section 3.1 Foo bar", "ARTICLE II", "## I. General", "## c. foo", "A. Lettered", "§ 3 Price.", "## § 4 Sum (1) x", "(1) Area. words", "(2) Limits: few",
    "## II. Next", "Schedule One", "Restricted Key Words follow", "- item", "é Ünïcode line", "ÉTÉ", "  odd", "I. Short", " ", "WHEREAS x",
]


def made(spark, seed, n):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        words = pick.sample(POOL, pick.randrange(3, 12))
        pages = ["\n".join(pick.choice(words) for _ in range(pick.randrange(0, 14))) for _ in range(pick.randrange(1, 4))]
        rows.append((f"d{i}.txt", "<<<PAGE_BREAK>>>".join(pages)))
    return spark.createDataFrame([*rows, ("none.txt", None), ("empty.txt", "")], "source string, markdown string")


@pytest.mark.parametrize("keep_lead_in", [False, True])
def test_units_equal_the_windows(spark, keep_lead_in):
    docs = segment.documents(made(spark, 5, 500)).cache()
    assert {r.format for r in docs.select("format").distinct().collect()} == {"article", "roman", "numeric", "fallback"}
    columns = ["source", "unit_index", *segment.UNIT_COLUMNS, "page_numbers", "text"]
    rows = lambda df: {(r.source, r.unit_index): tuple(r) for r in df.select(*columns).collect()}
    got, want = rows(machine.units(docs, keep_lead_in)), rows(segment.units_by_windows(docs, keep_lead_in))
    for at in sorted(want.keys() | got.keys()):
        assert got.get(at) == want.get(at), at
    assert len(want) > 1000


def test_no_exchange(spark):
    plan = segment.semantic_units(made(spark, 6, 20))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    assert segment.semantic_units(made(spark, 6, 20).where(F.lit(False))).count() == 0


CUTS = [
    ("article", (), lambda d: segment.article_sections(segment.lines(d))), ("article", ("section",), lambda d: segment.article_subunits(segment.article_sections(segment.lines(d)))),
    ("roman", (), lambda d: segment.roman_sections(segment.lines(d))), ("roman", ("roman", "letter", "paragraph"), lambda d: segment.roman_subunits(segment.roman_sections(segment.lines(d)))),
    ("numeric", (), lambda d: segment.numeric_sections(segment.lines(d))), ("numeric", ("top",), lambda d: segment.numeric_subsections(segment.numeric_sections(segment.lines(d)))),
    ("numeric", ("appendix",), lambda d: segment.appendix_blocks(segment.numeric_sections(segment.lines(d)).where("section_type = 'appendix'"))),
]


@pytest.mark.parametrize(("name", "kinds", "windows"), CUTS)
def test_one_format_and_some_cuts_equal_the_windows(spark, name, kinds, windows):
    docs = segment.documents(made(spark, 8, 250)).cache()
    want, got = windows(docs.where(F.col("format") == name)), machine.units(docs, only=name, kinds=kinds)
    if kinds == ("appendix",):
        got = got.where("section_type = 'appendix'")
    own = [c for c in ("source", *segment.UNIT_COLUMNS, "page_numbers", "text") if c in want.columns]
    rows = lambda df: sorted(map(repr, df.select(*own).collect()))
    assert rows(got) == rows(want) != []


@pytest.mark.parametrize("name", ["article_units", "article_subunits", "numeric_sections", "numeric_subsections", "appendix_blocks", "roman_units", "roman_subunits"])
def test_queries_of_one_format_shuffle_nothing(spark, sf_dir, name):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
