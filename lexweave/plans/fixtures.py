"""Contracts made in the query from the documents' whole texts, and their expected rows in SQL.

A text's lines are its letters in lower case (no line of it can then look like a heading), each behind a ``w``; the one word that
stands for a heading anywhere in a line is swapped. The first half of the lines fills one slot of a template, the rest the other."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = "<<<PAGE_BREAK>>>"
#: Templates by doc_id mod 4.
TEMPLATES = (
    "## MASTER AGREEMENT\nAcme Web, Inc., and Beta LLC, made with acme web inc,\nWHEREAS Gamma Corp, joins them,\n\nARTICLE I\nDEFINITIONS\nSection 1.1 Terms.\nLead words\n(a) First item. {b1}\n"
    + "(b) Second item. More\n" + PAGE + "ARTICLE II\nSection 2.1 Scope\n{b2}\n\n\nSection 2.2 Notices.\nBy letter\nARTICLE III\nSECTION 9 RULES\nSection 3.1 Last Words.\nend",
    "Front {b1}\n\n1. Term\n1.1 Length. Long\n- 1.2 {b2}\n" + PAGE + "2. Payment\nWords\n\n2.1 Fees: due\n### 2.2.1 Deep\n## Appendix\nSchedule One\n- item\n3. Not a section",
    "Preamble {b1}\n## I. General\n## § 1 Scope\nLead\n(1) Area. {b2}\n(2) Limits: few\n" + PAGE + "## II. Payment\nwords\nA. Lettered\nmore\n## § 2 Price\nend\n## C. Foo\nlast",
    "{b1}\nplain line\n\n\n{b2} again\n" + PAGE + "\n" + PAGE + "tail words",
)
FORMATS = ("article", "numeric", "roman", "fallback")


def _lines(text: Column) -> Column:
    """Over the whole text before it is split; letters are listed one by one, since Java looks such up in a table, and ranges through calls."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{string.ascii_letters}\n]+", " ")
    lines = F.transform(F.split(F.replace(F.lower(letters), F.lit("article"), F.lit("item")), "\n"), lambda x: F.trim(x))
    return F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.concat(F.lit("w"), x))


def contracts(docs: DataFrame) -> DataFrame:
    """doc_id, source and markdown; a contract per document, of its whole text. A document without an id is named by its text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("0"), F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 15), 16, 10)))
    source = F.concat(F.lit("data/raw/CUAD_v1/full_contract_pdf/Part_I/"), F.coalesce("lang", F.lit("xx")), F.lit("/GoodDoc"), name, F.lit("Inc_20070810_S-1.pdf"))
    rows = docs.select("doc_id", source.alias("source"), F.coalesce(F.pmod("doc_id", F.lit(4)), F.lit(3)).alias("kind"), _lines(F.col("text")).alias("lines"))
    half = F.ceil(F.size("lines") / 2).cast("int")
    joined = lambda part: F.when(F.size(part) > 0, F.array_join(part, "\n")).otherwise("w")
    slots = {"{b1}": joined(F.slice("lines", F.lit(1), half)), "{b2}": joined(F.slice("lines", half + 1, F.size("lines")))}
    rows = rows.select("doc_id", "source", "kind", slots["{b1}"].alias("b1"), slots["{b2}"].alias("b2"))
    chosen = None
    for i, template in enumerate(TEMPLATES):
        built = F.concat(*[F.col(part[1:-1]) if part in slots else F.lit(part) for part in re.split(r"(\{b[12]\})", template) if part])
        chosen = F.when(F.col("kind") == i, built) if chosen is None else chosen.when(F.col("kind") == i, built)
    return rows.select("doc_id", "source", chosen.alias("markdown"))


#: The same lines and paths in SQL, as the common table ``c``.
SQL = """c0 AS (SELECT *, coalesce(doc_id::VARCHAR, '0' || ('0x' || substring(md5(coalesce(text, '')), 1, 15))::BIGINT) AS name, ['w' || replace(lower(y), 'article', 'item') FOR y IN
  [trim(regexp_replace(z, '[^A-Za-z]+', ' ', 'g')) FOR z IN string_split(coalesce(text, ''), chr(10))] IF y <> ''] AS lines FROM documents),
c1 AS (SELECT *, ((len(lines) + 1) // 2)::INT AS half FROM c0),
c AS (SELECT name, coalesce(doc_id % 4, 3) AS kind, 'data/raw/CUAD_v1/full_contract_pdf/Part_I/' || coalesce(lang, 'xx') || '/GoodDoc' || name || 'Inc_20070810_S-1.pdf' AS source, coalesce(lang, 'xx') AS lang,
  CASE WHEN len(lines) = 0 THEN 'w' ELSE array_to_string(lines[1:half], chr(10)) END AS b1, CASE WHEN len(lines) < 2 THEN 'w' ELSE array_to_string(lines[half + 1:], chr(10)) END AS b2 FROM c1)"""


def value_sql(v: object) -> str:
    """A number, None, or a string with {b1} and {b2}."""
    if v is None:
        return "NULL"
    if not isinstance(v, str):
        return str(v)
    quoted = "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return quoted.replace("{b1}", "' || b1 || '").replace("{b2}", "' || b2 || '")


def rows_sql(kind: int, columns: tuple[str, ...], rows: list[tuple], more: str = "") -> str:
    """Expected rows of one template, over ``c``."""
    parts = [f"SELECT source{more}, {', '.join(f'{value_sql(v)} AS {c}' for c, v in zip(columns, row, strict=True))} FROM c WHERE kind = {kind}" for row in rows]
    return " UNION ALL ".join(parts)
