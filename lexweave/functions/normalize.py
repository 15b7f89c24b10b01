"""Text normalisation as column expressions; only Unicode NFKC and title case need Python, on rows that need them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PAGE_BREAK = "<<<PAGE_BREAK>>>"
#: Characters that are replaced one for one.
LITERALS = ("\u00a0\u037e\u201c\u201d\u2018\u2019\u00b7\u2022\u2013\u2014", " ;\"\"''----")
#: A range that holds all of them, for a look at a text.
LITERAL = "[\u00a0\u00b7\u037e\u2013-\u2022]"
#: Rewriting rules (pattern, replacement) in their order. Java spelling: (?d) so that only \n ends a line, (?U) for Unicode classes.
SPACING = (
    (r"(?mdU)^(\s*##\s*\d+)\.([A-Za-z])", "$1. $2"),
    (r"(?mdU)^(\s*\d+)\.([A-Za-z])", "$1. $2"),
    (r"(?mdU)^(\s*(?:##\s*)?\d+\.\d+(?:\.\d+)*)\s*([A-Za-z])", "$1 $2"),
    (r"(?mdU)^(\s*(?:##\s*)?§\s*\d+(?:\.\d+)*)\s*([A-Za-z])", "$1 $2"),
)
#: Page marks of a parser and page numbers.
ARTIFACTS = (
    (r"(?mdU)^Source:\s+.*?<PARSED TEXT FOR PAGE:\s*\d+\s*/\s*\d+>\s*", ""),
    (r"(?mdU)^\s*\d+\s*$", ""),
)
#: Line breaks before headings and items. What stands before the first sign is looked at behind it, where few places are left.
BREAKS = (
    (r"(?idU)(A(?<!\n.)RTICLE\s+[IVXLC]+\b)", "\n$1"),
    (r"(?idU)(S(?<!\n.)ection\s+\d+\.\d+\s+)", "\n$1"),
    (r"(?idU)(#(?<!\n.)#\s*[IVXLC]+\.\s+[A-Z])", "\n$1"),
    (r"(?idU)(#(?<!\n.)#\s*§\s*\d+(?:\.\d+)*\s+[A-Z])", "\n$1"),
    (r"(?dU)(\((?<!\n.)\d+\)\s+)", "\n$1"),
    (r"(?imdU)^(?!##\s)(§\s*\d+(?:\.\d+)*\s+.{1,160}?)(?:\s*(?=\(\d+\))|\s*$)", "## $1"),
)
#: Headings with paragraph signs.
PARAGRAPH_SIGNS = (
    (r"(?imdU)^##\s*§", "## §"),
    (r"(?idU)(#(?<!\n.)#\s*§\s*\d+(?:\.\d+)*)", "\n$1"),
    (r"(?imdU)^(##\s*§\s*\d+(?:\.\d+)*\s+.*?)(\(\d+\)\s+)", "$1\n$2"),
    (r"(?imdU)^(§\s*\d+(?:\.\d+)*\s+.*?)(\(\d+\)\s+)", "$1\n$2"),
)
#: Line breaks before numbered items.
ITEMS = ((r"(?dU)\s(\((?<!\n\s\()\d+\)\s+)", "\n$1"),)
#: Numbers that only look like headings, until nothing changes.
FALSE_HEADERS = (
    (r"(?mdU)^##\s*(\d+)\.\s+(\d+(?:\.\d+)*)\s+", "$1.$2 "),
    (r"(?mdU)^##\s*(\d+\.\d+(?:\.\d+)*)\s+", "$1 "),
)
#: Numbers with a gap inside, until nothing changes.
BROKEN_NUMBERS = (
    (r"(?mdU)^(\s*(?:#{2,3}\s*)?(?:[-•]\s*)?)(\d+)\.\s+(\d+)(?=\s)", "$1$2.$3"),
    (r"(?mdU)^(\s*(?:#{2,3}\s*)?(?:[-•]\s*)?)(\d+\.\d+)\.\s+(\d+)(?=\s)", "$1$2.$3"),
)
#: White space, brackets and the appendix heading.
TIDY = (
    (r"[ \t]{2,}|\t", " "),  # single spaces stay as they are
    (r"\n{3,}", "\n\n"),
    (r"(?U)\s+\.", "."),
    (r"(?iU)\(\s*([a-zivx\d]+)\s*\)", "($1)"),
    (r"(?mdU)^Appendix\s*$", "## Appendix"),
)
#: What each pass of the repeated rules that changes something takes away at least one of.
FEWER = {FALSE_HEADERS: "##", BROKEN_NUMBERS: r"(?U)\d\.\s"}


def rewrite(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def bound(text: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a text that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(text), use), F.lit(0))


def guarded(text: Column, needed: Callable[[Column], Column], rules: tuple[tuple[str, str], ...]) -> Column:
    """The rules, on texts that have what all of them need: most texts then cost one cheap look."""
    return bound(text, lambda t: F.when(needed(t), rewrite(t, rules)).otherwise(t))


def holds(sign: str) -> Callable[[Column], Column]:
    return lambda t: t.contains(sign)


def finds(pattern: str) -> Callable[[Column], Column]:
    return lambda t: t.rlike(pattern)


def beyond_ascii(text: Column) -> Column:
    return F.length(text) != F.octet_length(text)


#: Letters beyond ASCII that stand for one of its own where case does not count.
OTHER_CASES = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}


def says(word: str) -> Callable[[Column], Column]:
    """Whether a text may hold a word in any case, without Unicode's case rules, which take longer."""
    return finds("".join(f"[{c.upper()}{c}{OTHER_CASES.get(c, '')}]" for c in word))


def settled(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The rules again and again until nothing changes, on texts with what each pass takes away: one pass, and where a rule
    still matches as many as there are signs."""
    sign, needed = FEWER[rules], NEEDED[rules]
    again = lambda t: F.aggregate(F.sequence(F.lit(1), F.regexp_count(t, F.lit(sign))), t, lambda a, _: rewrite(a, rules))
    matches = lambda t: reduce(lambda a, b: a | b, [t.rlike(p) for p, _ in rules])
    once = lambda t: bound(rewrite(t, rules), lambda x: F.when(matches(x), again(x)).otherwise(x))
    return bound(text, lambda t: F.when(needed(t), once(t)).otherwise(t))


#: What a text has that one of the repeated rules changes: rare signs first, what stands before them is looked at behind them.
NEEDED = {
    FALSE_HEADERS: lambda t: t.contains("##") & t.rlike(r"(?U)##\s*\d+\.\s*\d"),
    BROKEN_NUMBERS: lambda t: t.contains(".") & t.rlike(r"(?U)\.(?<=\d\.)\s+\d"),
}


#: White space as Unicode has it, and the four separators that Python strips too.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(WHITE))


def strip_long(text: Column) -> Column:
    """The same for long texts: a trim goes over all of a text, so the two ends are looked at first."""
    white = lambda t, at: F.lit(WHITE).contains(F.substring(t, at, 1))
    return bound(text, lambda t: F.when(white(t, 1) | white(t, -1), strip(t)).otherwise(t))


@F.arrow_udf(StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    parts = [text.slice(at, 256).to_pylist() for at in range(0, len(text), 256)]
    made = [pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in part], pa.string()) for part in parts]
    return pa.concat_arrays(made) if made else text


@F.pandas_udf(StringType())
def _title(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t.title())


def nfkc(text: Column) -> Column:
    """A Python function gets every row, whatever condition stands around it: ASCII texts go to it as nulls."""
    other = F.when(beyond_ascii(text), text)
    return F.coalesce(_nfkc(other), text)


def normalise_page(text: Column) -> Column:
    """All rules but NFKC, which comes first (it may run on whole documents: the page mark is ASCII)."""
    text = bound(text, lambda t: F.when(beyond_ascii(t) & t.rlike(LITERAL), F.translate(t, *LITERALS)).otherwise(t))
    text = guarded(text, lambda t: t.contains(".") & t.rlike(r"(?U)\.(?<=\d\.)[A-Za-z]"), SPACING[:2])
    text = guarded(text, lambda t: t.contains(".") & t.rlike(r"(?U)\.(?<=\d\.)\d"), SPACING[2:3])
    text = guarded(guarded(text, holds("§"), SPACING[3:]), holds("Source:"), ARTIFACTS[:1])
    text = rewrite(text, ARTIFACTS[1:])
    text = guarded(guarded(text, says("article"), BREAKS[:1]), says("section"), BREAKS[1:2])
    text = guarded(text, holds("##"), BREAKS[2:4])
    text = guarded(text, holds("("), BREAKS[4:5])
    text = guarded(text, holds("§"), BREAKS[5:] + PARAGRAPH_SIGNS)
    text = guarded(text, lambda t: t.contains("(") & t.rlike(r"(?U)\(\d+\)\s"), ITEMS)
    text = settled(settled(text, FALSE_HEADERS), BROKEN_NUMBERS)
    text = guarded(guarded(text, lambda t: t.contains("  ") | t.contains("\t"), TIDY[:1]), holds("\n\n\n"), TIDY[1:2])
    text = guarded(text, finds(r"(?U)\.(?<=\s\.)"), TIDY[2:3])
    # brackets without white space inside stay as they are
    gap = lambda t: t.contains("(") & (t.rlike(r"(?U)\(\s") | t.rlike(r"(?U)\)(?<=\s\))"))
    return strip_long(guarded(guarded(text, gap, TIDY[3:4]), holds("Appendix"), TIDY[4:]))


def normalise_text(text: Column) -> Column:
    return normalise_page(nfkc(text))


#: Fixed values of headings: signs stripped at their ends, and words kept of a heading's title; the number before a
#: subsection's text, where its title ends, signs stripped from it, and its longest length in letters and words.
HEADING_ENDS, HEADING_WORDS = " .;,:", 14
LEAD_NUMBER, TITLE_END, TITLE_ENDS, TITLE_CHARS, TITLE_WORDS = r"(?U)^\d+\.\d+(?:\.\d+)*\s+", r"(?dU)^(.+?)[.:](?:\s|$)", " ;,.-:", 120, 14


def _flat(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"(?U)\s+", " ")


def clean_title(title: Column, max_words: int = HEADING_WORDS) -> Column:
    """White space collapsed, signs at the ends stripped, the first words (14 for headings, 10 for subunits)."""
    return F.array_join(F.slice(F.split(F.btrim(_flat(title), F.lit(HEADING_ENDS)), " "), 1, max_words), " ")


def infer_title(text: Column, max_chars: int = TITLE_CHARS, max_words: int = TITLE_WORDS) -> Column:
    """What stands between a subsection's number and the first sign that ends a word, if short enough; else null."""
    said = F.regexp_extract(strip(F.regexp_replace(_flat(text), LEAD_NUMBER, "")), TITLE_END, 1)
    short = lambda t: (t != "") & (F.length(t) <= max_chars) & (F.size(F.split(t, r"(?U)\s+")) <= max_words)
    # a text of which no such sign stands before anything but a digit has no title: long texts then cost one look
    return F.when(text.rlike(r"[.:](?!\d)"), F.get(F.filter(F.array(F.btrim(said, F.lit(TITLE_ENDS))), short), F.lit(0)))


def title_case(title: Column) -> Column:
    """Every letter after a non-letter upper, the rest lower; null for an empty title."""
    return _title(F.nullif(title, F.lit("")))
