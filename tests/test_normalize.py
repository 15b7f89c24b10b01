"""Hand-derived cases of the normalisation rules."""

import pytest
from pyspark.sql import functions as F

from lexweave.functions import normalize as n

CASES = [
    ("## 5.Term of this Agreement", "## 5. Term of this Agreement"),
    ("13.5Governing Law", "13.5 Governing Law"),
    ("§ 4Independence", "## § 4 Independence"),
    ("## § 9 Final provisions(1) Force majeure", "## § 9 Final provisions\n(1) Force majeure"),
    ("##§ 8 Foo", "## § 8 Foo"),
    ("a particle ii b", "a p\narticle ii b"),
    ("## 5. 2 Foo bar", "5.2 Foo bar"),
    ("5.2. 3 Foo", "5.2.3 Foo"),
    ("text ( a ) more .", "text (a) more."),
    ("“x” – y z • w", '"x" - y z - w'),
    ("before\n 12 \nafter", "before\n\nafter"),
    ("Appendix  \nfoo", "## Appendix\nfoo"),
    ("ﬁne ①", "fine 1"),
    ("", ""),
]


@pytest.fixture(scope="module")
def normal(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "i int, t string")
    return {r.i: r.x for r in rows.select("i", n.normalise_text(F.col("t")).alias("x")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(i, normal):
    assert normal[i] == CASES[i][1]


def plain_settled(text, rules):
    import re

    while True:
        after = text
        for pattern, by in rules:
            after = re.sub(pattern.replace("(?mdU)", "(?m)"), by.replace("$", "\\"), after)
        if after == text:
            return text
        text = after


def test_rules_that_repeat_until_nothing_changes(spark):
    import random

    rnd = random.Random(3)
    texts = ["".join(rnd.choice(["## ", "1. ", "2.3 ", "4.\n", "## 5.\n", "x ", "\n", "6.7. ", "- ", "### "]) for _ in range(rnd.randint(1, 25))) for _ in range(300)]
    texts += ["## 1.\n" * 12 + "## 2.3 x", "", "plain"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for rules in (n.FALSE_HEADERS, n.BROKEN_NUMBERS):
        got = {r.i: r.x for r in rows.select("i", n.settled(F.col("t"), rules).alias("x")).collect()}
        assert [got[i] for i in range(len(texts))] == [plain_settled(t, rules) for t in texts]


def test_titles(spark):
    rows = [("13.5 Governing Law; Jurisdiction. And so on",), ("10.2 Indemnification:",), ("12.1 MA recognizes that the Technology in source form",), ("1.1 " + "w " * 15 + ".",)]
    got = spark.createDataFrame(rows, "t string").select(n.infer_title(F.col("t"))).collect()
    assert [r[0] for r in got] == ["Governing Law; Jurisdiction", "Indemnification", None, None]
    row = spark.createDataFrame([(" a  b .;", "O'NEIL x_y")], "a string, b string").select(n.clean_title(F.col("a"), 1), n.title_case(F.col("b"))).first()
    assert tuple(row) == ("a", "O'Neil X_Y")


def test_most_texts_meet_no_unicode_pattern(spark):
    """Tokens of ASCII texts are those of the Unicode pattern, which only other texts meet; so are signs before which a line is broken."""
    from lexweave.functions import normalize
    from lexweave.operators import chunk

    texts = ["a_b c1, d!\x1c\x0b(e)\x85", "é_b 漢1, d x", "plain\x1fwords\x7f", "", None, "x (1) y\n(2) z", "a ARTICLE I\nARTICLE II é ARTICLE III", "ſection 1.1 x ſection 2.2 y", "a ## § 1 B\n## § 2 C", "( iv ) (v ) ( x) (y)", "a . b .c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    whole = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))
    for r in rows.select(chunk.tokens(F.col("text")).alias("got"), whole.alias("want")).collect():
        assert r.got == r.want
    old = {"A": r"(?idU)(?<!\n)(ARTICLE\s+[IVXLC]+\b)", "S": r"(?idU)(?<!\n)(Section\s+\d+\.\d+\s+)", "(": r"(?dU)(?<!\n)(\(\d+\)\s+)", "#": r"(?idU)(?<!\n)(##\s*§\s*\d+(?:\.\d+)*\s+[A-Z])"}
    for rule, by in zip((normalize.BREAKS[0], normalize.BREAKS[1], normalize.BREAKS[4], normalize.BREAKS[3]), ("A", "S", "(", "#"), strict=True):
        assert rule[0] != old[by]
        same = rows.where(~F.regexp_replace("text", rule[0], rule[1]).eqNullSafe(F.regexp_replace("text", old[by], rule[1])))
        assert same.count() == 0
    spread = [r.text for r in rows.select(normalize.rewrite(F.col("text"), normalize.BREAKS[:1]).alias("text")).collect()]
    assert spread[6] == "a \nARTICLE I\nARTICLE II é \nARTICLE III"


def test_texts_beyond_ascii_are_not_taken_for_headings_in_other_cases(spark):
    """The cheap look for a word lets through all that Unicode's case rules take for it, and no other text beyond ASCII."""
    from lexweave.functions.normalize import says

    rows = ["an ARTICLE", "artıcle", "ARTİCLE", "ſection 1.1 x", "§ 2 é", "artcle é"]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", says("article")(F.col("t")).alias("a"), says("section")(F.col("t")).alias("s"))
    assert [(r.a, r.s) for r in found.orderBy("i").collect()] == [(True, False), (True, False), (True, False), (False, True), (False, False), (False, False)]


def test_titles_of_texts_without_a_sign_that_ends_one(spark):
    texts = ["1.1 Length. Long", "1.2 no sign\nat all 3.4 or 5:6", "1.3 At the end.\x1c", "2.1 Fees: due", "2.2 Ends in a digit 1.", "2.3 a.٣ b.", ".", "", "1.4 one.two", "3.1 x:\u2003y", None]
    shown = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in shown.orderBy("i").select(n.infer_title(n.F.col("t"))).collect()]
    assert got == ["Length", None, "At the end", "Fees", "Ends in a digit 1", "a.٣ b", None, None, None, "x", None]
    plan = shown.select(n.infer_title(n.F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert r"[.:](?!\d)" in plan  # the look
