"""Segmentation: page-marked contracts to semantic units.

Pages, scores and the choice of format are computed inside each row. The line-level formats share one frame of
lines, laid out by source once; headings open islands (running sums), context is carried by windows over the same
layout, so a document costs one shuffle of its lines. Subunits are cut inside the row again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metadata import stem
from ..functions.normalize import PAGE_BREAK, clean_title, holds, infer_title, nfkc, normalise_page, strip
from ..sources.shared import written
from .chunk import tokens

#: Heading patterns in Java spelling.
TOP_SECTION = r"(?mdU)^(?:##\s*)?(\d{1,2})\.\s+(?!\d)([^\n]{1,200})$"
ARTICLE = r"(?imdU)^ARTICLE\s+([IVXLC]+)\s*$"
SECTION = r"(?imdU)^Section\s+(\d+\.\d+)\s+(.{1,140}?)(?:\.\s*$|\s*$)"
ROMAN = r"(?imdU)^##\s*([IVXLC]+)\.\s+(.{1,120}?)\s*$"
PARAGRAPH = r"(?imdU)^(?:##\s*)?§\s*(\d+(?:\.\d+)*)\s+(.{1,160}?)(?=\s*\(\d+\)\s+|\.\s*$|$)"
LETTER = r"(?imdU)^(?:##\s*)?([A-Z])\.\s+(.{1,160})$"
LETTER_ITEM = r"(?imdU)^\(([a-z])\)\s+([^.\n]{1,100})(?:\.)?(?:\s|$)"
NUMBER_ITEM = r"(?imdU)^\((\d+)\)\s+(.{1,120}?)(?=\.\s|:\s|$)"
SUBSECTION = r"(?mdU)^(?:[-•]\s*|#{2,3}\s*)?(\d+(?:\.\d+)+)(?=\s)"
APPENDIX = r"(?idU)^(##\s*)?Appendix\s*$"
APPENDIX_TITLE = r"^[A-Z][A-Za-z0-9/&'\"(). -]{2,80}$"
APPENDIX_PHRASES = ("Restricted Key Words", "Restricted Trademark Terms")
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
THRESHOLDS = {"article": 3, "roman": 2, "numeric": 2}
_CUT = "\x01"

UNIT_COLUMNS = (
    "section_type", "article_number", "article_title", "section_number", "section_title", "roman_section_number", "roman_section_title",
    "subsection_number", "subsection_title", "subunit_label", "subunit_title", "roman_subunit_label", "roman_subunit_title",
)


def documents(raw: DataFrame) -> DataFrame:
    """source, pages (array of page_no and text; blank pages leave gaps), full_text, the three marker scores and format."""
    marked = raw.select("source", nfkc(F.coalesce("markdown", F.lit(""))).alias("markdown"))
    pages = F.transform(F.split("markdown", PAGE_BREAK), lambda p, i: F.struct((i + 1).alias("page_no"), normalise_page(p).alias("text")))
    rows = marked.select("source", F.filter(pages, lambda p: p.getField("text") != "").alias("pages"))
    rows = rows.withColumn("full_text", F.array_join(F.transform("pages", lambda p: p.getField("text")), "\n\n"))
    full = F.col("full_text")
    count = lambda pattern: F.regexp_count(full, F.lit(pattern))
    scores = {
        "article_score": count(ARTICLE) + count(SECTION), "roman_score": F.when(holds("##")(full), count(ROMAN)).otherwise(0) + F.when(holds("§")(full), count(PARAGRAPH)).otherwise(0),
        "numeric_score": count(TOP_SECTION),
    }
    # of the scores themselves, not of their columns: what reads the format alone counts no further than it must
    chosen = F.when(scores["article_score"] >= THRESHOLDS["article"], "article").when(scores["roman_score"] >= THRESHOLDS["roman"], "roman")
    chosen = chosen.when(scores["numeric_score"] >= THRESHOLDS["numeric"], "numeric").otherwise("fallback")
    return rows.select("*", *[score.alias(name) for name, score in scores.items()], chosen.alias("format"))


def lines(docs: DataFrame) -> DataFrame:
    """A row per line: source, page_no, line_no, line (stripped)."""
    # outer: else a filter on the number of pages is pushed below and normalises them again
    paged = docs.select("source", F.explode_outer("pages").alias("page")).where("page is not null")
    split = paged.select("source", "page.page_no", F.posexplode(F.split("page.text", LINE_END)).alias("line_no", "line"))
    return split.select("source", "page_no", "line_no", strip(F.col("line")).alias("line"))


_ORDER = ("page_no", "line_no")


def _run(*keys: str, last: int = 0) -> Window:
    """From the first line of a document (or of the further keys) to this one, or to the one before (last -1)."""
    return Window.partitionBy("source", *keys).orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, last)


def _carry(column: Column, *keys: str, last: int = 0) -> Column:
    return F.last(column, ignorenulls=True).over(_run(*keys, last=last))


def _group(flat: DataFrame, attributes: list[str]) -> DataFrame:
    """Lines with unit number ``u`` and text ``out`` to units: a blank line stays only after text of its own unit."""
    before = F.lag("out").over(Window.partitionBy("source", "u").orderBy(*_ORDER))
    kept = flat.withColumn("before", before).where((F.col("out") != "") | (F.coalesce("before", F.lit("")) != ""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "line_no", "out"))), lambda x: x.getField("out")), "\n")
    pages = F.array_sort(F.collect_set(F.when(F.col("out") != "", F.col("page_no"))))
    units = kept.groupBy("source", "u").agg(strip(text).alias("text"), pages.alias("page_numbers"), *[F.max(a).alias(a) for a in attributes])
    return units.where("text != ''")


def numeric_sections(split: DataFrame) -> DataFrame:
    """Numbered top sections; an appendix line opens an appendix and ends the numbering for the rest of the document."""
    appendix = F.col("line").rlike(APPENDIX)
    flat = split.withColumn("appendix", appendix).withColumn("in_appendix", F.max("appendix").over(_run()))
    flat = flat.withColumn("top", ~F.col("in_appendix") & F.col("line").rlike(TOP_SECTION))
    number, title = (F.when(F.col("top"), strip(F.regexp_extract("line", TOP_SECTION, g))) for g in (1, 2))
    flat = flat.withColumn("number", number).withColumn("title", title).withColumn("u", F.sum((F.col("appendix") | F.col("top")).cast("int")).over(_run()))
    out = F.when(F.col("appendix"), "## Appendix").when(F.col("top"), F.format_string("## %s. %s", "number", "title")).otherwise(F.col("line"))
    units = _group(flat.withColumn("out", out), ["number", "title", "appendix"])
    kind = F.when(F.col("appendix"), "appendix").when(F.col("number").isNotNull(), "body").otherwise("front_matter")
    heading = F.when(F.col("appendix"), "Appendix").otherwise(F.coalesce("title", F.lit("Front Matter")))
    return units.select("source", "u", kind.alias("section_type"), F.col("number").alias("section_number"), heading.alias("section_title"), "text", "page_numbers")


def article_sections(split: DataFrame) -> DataFrame:
    """Sections ``Section X.Y`` under the article before them; an article's title is the capital line right after it."""
    said = F.col("line") != ""
    flat = split.withColumn("article", F.when(said, F.col("line").rlike(ARTICLE)))
    after = F.coalesce(_carry(F.col("article"), last=-1), F.lit(False))
    capital = (F.upper("line") == F.col("line")) & (F.lower("line") != F.col("line")) & (F.length("line") <= 120)
    flat = flat.withColumn("is_article", F.coalesce("article", F.lit(False))).withColumn("is_title", said & ~F.col("is_article") & after & capital)
    flat = flat.withColumn("is_section", said & ~F.col("is_article") & ~F.col("is_title") & F.col("line").rlike(SECTION))
    event = F.when(F.col("is_article") | F.col("is_section"), F.col("is_section"))
    flat = flat.withColumn("opened", F.coalesce(_carry(event, last=-1), F.lit(False))).withColumn("article_seq", F.sum(F.col("is_article").cast("int")).over(_run()))
    numeral = _carry(F.when(F.col("is_article"), F.upper(F.regexp_extract("line", ARTICLE, 1))))
    flat = flat.withColumn("numeral", numeral).withColumn("named", _carry(F.when(F.col("is_title"), F.col("line")), "article_seq"))
    flat = flat.withColumn("u", F.sum((F.col("is_section") | F.col("is_article") & F.col("opened")).cast("int")).over(_run()))
    at = lambda c: F.when(F.col("is_section"), c)
    flat = flat.select(
        "source", *_ORDER, "line", "u", "is_article", "is_section", at(F.col("numeral")).alias("article_number"), at(F.col("named")).alias("article_title"),
        at(F.regexp_extract("line", SECTION, 1)).alias("section_number"), at(clean_title(F.regexp_extract("line", SECTION, 2))).alias("title"),
    )
    header = F.concat_ws("\n", F.concat(F.lit("ARTICLE "), F.col("article_number")), "article_title", F.format_string("Section %s %s", "section_number", "title"))
    flat = flat.where("not is_article").withColumn("out", F.when(F.col("is_section"), header).otherwise(F.col("line")))
    units = _group(flat, ["article_number", "article_title", "section_number", "title"])
    body = F.col("section_number").isNotNull()
    heading = F.when(body, F.col("title")).when(F.col("u") == 0, "Front Matter").otherwise("Article Boundary")
    kind = F.when(body, "body").otherwise("front_matter")
    return units.select("source", "u", kind.alias("section_type"), "article_number", "article_title", "section_number", heading.alias("section_title"), "text", "page_numbers")


def roman_sections(split: DataFrame) -> DataFrame:
    """Roman headings, then lettered ones, then paragraph signs, in this order of precedence; the roman context carries on.
    A roman unit that is its heading alone goes."""
    line = F.col("line")
    flat = split.withColumn("kind", F.when(line.rlike(ROMAN), "roman").when(line.rlike(LETTER), "letter").when(line.rlike(PARAGRAPH), "paragraph"))
    part = lambda g: strip(F.when(F.col("kind") == "roman", F.regexp_extract(line, ROMAN, g)).when(F.col("kind") == "letter", F.regexp_extract(line, LETTER, g)).when(F.col("kind") == "paragraph", F.regexp_extract(line, PARAGRAPH, g)))
    flat = flat.withColumn("number", part(1)).withColumn("title", clean_title(part(2))).withColumn("u", F.sum(F.col("kind").isNotNull().cast("int")).over(_run()))
    roman = F.col("kind") == "roman"
    flat = flat.withColumn("roman_number", _carry(F.when(roman, F.upper("number")))).withColumn("roman_title", _carry(F.when(roman, F.col("title"))))
    above = F.when((F.col("roman_number") != "") & (F.col("roman_title") != ""), F.format_string("## %s. %s", "roman_number", "roman_title"))
    out = F.when(roman, F.format_string("## %s. %s", "roman_number", "roman_title")).when(F.col("kind") == "letter", F.format_string("## %s. %s", "number", "title"))
    out = out.when(F.col("kind") == "paragraph", F.concat_ws("\n", above, F.format_string("## § %s %s", "number", "title"))).otherwise(line)
    headed = F.col("kind").isNotNull()
    flat = flat.select("source", *_ORDER, "u", "kind", out.alias("out"), "number", "title", F.when(headed, F.col("roman_number")).alias("roman_number"), F.when(headed, F.col("roman_title")).alias("roman_title"))
    units = _group(flat, ["kind", "number", "title", "roman_number", "roman_title"])
    bare = F.coalesce((F.col("kind") == "roman") & (F.col("text") == F.rtrim(F.format_string("## %s. %s", "roman_number", "roman_title"))), F.lit(False))
    kind = F.when(F.col("kind").isNull(), "front_matter").otherwise("body")
    return units.where(~bare).select(
        "source", "u", kind.alias("section_type"), F.col("roman_number").alias("roman_section_number"), F.col("roman_title").alias("roman_section_title"),
        F.when(F.col("kind") != "roman", F.col("number")).alias("section_number"), F.coalesce("title", F.lit("Front Matter")).alias("section_title"), "text", "page_numbers",
    )


def fallback_units(docs: DataFrame) -> DataFrame:
    """Paragraphs between blank lines, numbered, without pages."""
    parts = F.filter(F.transform(F.split("full_text", "\n\n"), strip), lambda p: p != "")
    rows = docs.select("source", F.posexplode_outer(parts).alias("u", "text")).where("u is not null")
    none = F.array().cast("array<int>")
    return rows.select("source", "u", F.lit("body").alias("section_type"), F.concat(F.lit("Paragraph "), (F.col("u") + 1).cast("string")).alias("section_title"), "text", none.alias("page_numbers"))


def _cut(text: Column, marker: str) -> Column:
    """The text cut before each match of a marker: the part before the first, then a part per match."""
    return F.transform(F.split(F.regexp_replace(text, marker, _CUT + "$0"), _CUT), strip)


def _pieces(units: DataFrame, body: Column, parts: Column) -> DataFrame:
    """Each unit's parts as rows ``p, part``; a unit outside ``body`` or with one part stays whole, with p null."""
    cut = F.when(body & (F.size(parts) > 1), parts)
    rows = units.withColumn("_parts", cut)
    return rows.select("*", F.posexplode_outer("_parts").alias("p", "part")).drop("_parts")


def numeric_subsections(sections: DataFrame) -> DataFrame:
    """Body sections cut at lines numbered below the section's own number; other units stay whole."""
    mine = F.concat(F.lit(r"(?mdU)^(?:[-•]\s*|#{2,3}\s*)?("), F.coalesce("section_number", F.lit("0")), F.lit(r"\.\d+(?:\.\d+)*)(?=\s)"))
    marked = F.regexp_replace(F.col("text"), mine, F.lit(_CUT + "$0"))
    rows = _pieces(sections, F.col("section_type") == "body", F.transform(F.split(marked, _CUT), strip))
    heading = strip(F.format_string("## %s. %s", "section_number", "section_title"))
    rows = rows.where(F.col("p").isNull() | (F.col("p") > 0) | ((F.col("part") != "") & (F.col("part") != heading)))
    block = strip(F.regexp_replace("part", r"(?U)^(?:[-•]\s*|#{2,3}\s*)", ""))
    later = F.col("p") > 0
    rows = rows.withColumn("text", F.when(later, block).otherwise(F.coalesce("part", "text")))
    number = F.when(later, F.regexp_extract("text", r"(?U)^(\d+(?:\.\d+)+)", 1))
    return rows.withColumn("subsection_number", number).withColumn("subsection_title", F.when(later, infer_title(F.col("text")))).drop("part")


def article_subunits(sections: DataFrame, keep_lead_in: bool = False) -> DataFrame:
    """Body sections cut at ``(a) Title``; the lead-in before the first goes with the header, unless it is to be kept."""
    rows = _pieces(sections, F.col("section_type") == "body", _cut(F.col("text"), LETTER_ITEM))
    lead = F.lit(keep_lead_in) & (F.col("part") != "")
    rows = rows.where(F.col("p").isNull() | (F.col("p") > 0) | lead)
    later = F.col("p") > 0
    label, title = (F.when(later, F.regexp_extract("part", LETTER_ITEM, g)) for g in (1, 2))
    return rows.withColumn("subunit_label", F.lower(label)).withColumn("subunit_title", strip(title)).withColumn("text", F.coalesce("part", "text")).drop("part")


def roman_subunits(sections: DataFrame, keep_lead_in: bool = False) -> DataFrame:
    """Body sections cut at ``(1) Title``, each under the headings above it; the text before the first goes."""
    rows = _pieces(sections, F.col("section_type") == "body", _cut(F.col("text"), NUMBER_ITEM))
    rows = rows.where(F.col("p").isNull() | (F.col("p") > 0) | (F.lit(keep_lead_in) & (F.col("part") != "")))
    said = lambda *c: (F.col(c[0]) != "") & (F.col(c[1]) != "")
    prefix = F.concat_ws(
        "\n", F.when(said("roman_section_number", "roman_section_title"), F.format_string("## %s. %s", "roman_section_number", "roman_section_title")),
        F.when(said("section_number", "section_title"), F.format_string("## § %s %s", "section_number", "section_title")),
    )
    later = F.col("p") > 0
    label, title = (F.when(later, strip(F.regexp_extract("part", NUMBER_ITEM, g))) for g in (1, 2))
    under = F.when((prefix == "") | F.col("part").startswith(prefix), F.col("part")).otherwise(F.concat(prefix, F.lit("\n"), F.col("part")))
    rows = rows.withColumn("subunit_label", label).withColumn("subunit_title", clean_title(title, 10))
    return rows.withColumn("text", F.when(later, strip(under)).otherwise(F.coalesce("part", "text"))).drop("part")


def appendix_blocks(sections: DataFrame) -> DataFrame:
    """Appendix units cut at heading-like lines; the first block is called Appendix. Other units stay whole."""
    line = F.transform(F.split("text", "\n"), strip)
    phrase = lambda x: x.contains(APPENDIX_PHRASES[0]) | x.contains(APPENDIX_PHRASES[1])
    opens = lambda x: (x != "## Appendix") & (x.startswith("## ") | (F.length(x) <= 120) & ~x.startswith("-") & (phrase(x) | x.rlike(APPENDIX_TITLE)))
    marked = F.transform(line, lambda x, i: F.when((i > 0) & opens(x), F.concat(F.lit(_CUT), x)).otherwise(x))
    rows = _pieces(sections, F.col("section_type") == "appendix", F.transform(F.split(F.array_join(marked, "\n"), _CUT), strip))
    own = F.col("section_type") == "appendix"
    title = F.when(own & (F.coalesce("p", F.lit(0)) == 0), "Appendix").when(own, strip(F.replace(F.get(F.split("part", "\n"), F.lit(0)), F.lit("## "), F.lit(""))))
    return rows.withColumn("subunit_title", title).withColumn("text", F.coalesce("part", "text")).drop("part")


def _complete(units: DataFrame) -> DataFrame:
    for name in UNIT_COLUMNS:
        if name not in units.columns:
            units = units.withColumn(name, F.lit(None).cast("string"))
    if "p" not in units.columns:
        units = units.withColumn("p", F.lit(0))
    return units.select("source", "u", F.coalesce("p", F.lit(0)).alias("p"), *UNIT_COLUMNS, "page_numbers", "text")


def units_by_windows(docs: DataFrame, keep_lead_in: bool = False) -> DataFrame:
    """The units of documents() by windows over a table of lines: each document goes through the branch of its format only."""
    of = lambda name: docs.where(F.col("format") == name)
    numeric = written(numeric_sections(lines(of("numeric"))), "numeric")
    branches = [
        article_subunits(article_sections(lines(of("article"))), keep_lead_in),
        roman_subunits(roman_sections(lines(of("roman"))), keep_lead_in),
        numeric_subsections(numeric.where("section_type != 'appendix'")),
        appendix_blocks(numeric.where("section_type = 'appendix'")),
        fallback_units(of("fallback")),
    ]
    units = _complete(branches[0])
    for branch in branches[1:]:
        units = units.unionByName(_complete(branch))
    index = F.row_number().over(Window.partitionBy("source").orderBy("u", "p"))
    return units.withColumn("unit_index", index).select("source", "unit_index", *UNIT_COLUMNS, "page_numbers", "text")


def semantic_units(raw: DataFrame, keep_lead_in: bool = False, pages: DataFrame | None = None, about: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """Raw documents (source, markdown) to semantic units with ids and token counts (of the stand-in tokenizer), in one pass without a
    shuffle. ``pages`` is documents(raw), if that is written already; ``about``, as in machine.units, a column of each document beside its units."""
    from .machine import units

    docs = documents(raw) if pages is None else pages
    name = F.concat(stem(F.col("source")), F.lit("|unit|"), F.col("unit_index").cast("string"))
    return units(docs, keep_lead_in, about=about).select(
        "source", "unit_index", name.alias("semantic_unit_id"), *UNIT_COLUMNS, "page_numbers", "text", F.size(tokens(F.col("text"))).alias("semantic_unit_token_count"), *(() if about is None else ("about",))
    )
