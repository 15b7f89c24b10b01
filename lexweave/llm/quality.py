"""Quality rules, line first: rules judge every line, failing lines go, and documents that lose too much text go.

Line rules (a line without a word is neither judged nor lost):
  symbols     more than one of ``#*$%&|<>`` to four words, in a line of four words or more; else to one word
  shouting    three words or more, of whose letters over 60 in 100 are upper case
  bangs       ``!`` in number at least half the words, three words or more
  stutter     a third of the words or more equal the word before, six words or more
  unended     4 to 25 words and a letter or digit at the end, in a text of whose lines of that length half or more have an end; not
              a heading (at most 12 words, at the start or after a blank line), and not wrapped: the next line's first word would
              not fit into the text's width, its longest line of up to 25 words
  wordless    3 to 25 words, over half of them without a letter or digit
  code        at most 25 words with a bracket or comment sign of program code at the end
  navigation  a ``|``, ``»`` or ``>`` between words, or two other separators, with at most 12 words in all; a navigation phrase
              alone; at most 12 words, all of them words of such phrases and two of them names of pages
  boilerplate boilerplate phrases that are half or more of a line of at most 25 words; a copyright line with a year of at most 12 words
  repeated    equal to an earlier line
A document is kept if its base counts pass and its failing lines hold at most half of its words.

Defined cases: a null or empty text has no words, fails the base rule and is rejected; a text that loses exactly half of its
words is kept; a very long text is read whole; repeated rows and null doc_ids are judged each; an empty table gives no row;
further columns of any name are ignored by the report and kept by the filter.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, slices, words_of

WINDOW = 5
MAX_LOST = 0.5
#: Words that a heading has at most.
HEADING = 12
#: Lines that consist of one of these only; further names of pages; phrases that mark boilerplate.
NAVIGATION = (
    "home", "next", "previous", "back", "back to top", "menu", "search", "login", "log in", "sign in", "sign up", "share", "read more", "more", "comments", "reply",
    "contact", "contact us", "about", "about us", "skip to content", "skip to main content", "site map",
)
PAGES = ("home", "menu", "search", "login", "logout", "register", "contact", "about", "share", "comments", "reply", "sitemap", "faq", "help", "blog", "news", "account", "cart", "privacy", "terms")
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "we use cookies", "site uses cookies", "website uses cookies", "accept cookies",
    "accept all cookies", "enable javascript", "subscribe to our newsletter", "sign up for our newsletter", "follow us on", "click here to", "lorem ipsum", "powered by wordpress",
)
SEPARATORS = ("·", "•", "›", "/", "::")
CODE_ENDS = ("{", "}", ");", "*/", "-->")
COPYRIGHT = r"^[\x20\x09-\x0D]*(copyright|\(c\)|©).*(19|20)[0-9][0-9]"
NAV_WORDS = frozenset(w for phrase in NAVIGATION + PAGES for w in phrase.split())
_SYMBOL = bytes(c for c in range(256) if c not in b"#*$%&|<>")
_UPPER, _LETTERS, _OTHER = (bytes(c for c in range(256) if not keep(c)) for keep in (lambda c: 65 <= c <= 90, lambda c: c < 128 and 65 <= c & 0xDF <= 90, lambda c: c >= 128))
_NAV = re.compile(rb"[^a-z0-9\x80-\xff]+")
NAVIGATION_LINES, BOILERPLATE_PARTS = ({x.encode() for x in NAVIGATION}, [x.encode() for x in BOILERPLATE])


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = words_of(text)
    n = len(words)
    if not n:
        return 0, 0, 0 if not text else len(text.encode("utf-8", "surrogatepass").translate(None, _SYMBOL)), 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return n, chars, len(raw.translate(None, _SYMBOL)), len(lines) - len(set(lines)), repeat_words(words)


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    if len(index) == len(words):
        return 0
    base, key, span = len(index), ids, 1
    while span < window:
        if (key.max() + 1) * float(base) >= 2**62:  # rank the keys so far, so that the packing stays exact
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key[:-1] * base + ids[span:]
        span += 1
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


_PUNCTUATION = bytes(c for c in range(128) if not chr(c).isalnum() and not chr(c).isspace())
_SEPARATORS, _CODE_ENDS, _PAGES, _NAV_WORDS = ({x.encode() for x in words} for words in (SEPARATORS, CODE_ENDS, PAGES, NAV_WORDS))
_COPYRIGHT = re.compile(COPYRIGHT.encode())


def _ended(line: bytes) -> bool:
    """Whether a line's last sign is no letter or digit."""
    last = line.rstrip()[-4:].decode("utf-8", "ignore")[-1:]
    return not last or unicodedata.category(last)[0] not in "LN"


def unended_lines(lines: list[bytes], words: list[list[bytes]]) -> set[int]:
    """The places of lines that stop without an end where the text's lines have ends: 4 to 25 words, unless they are headings or
    wrapped. Nothing is judged where most such lines have no end, as in wrapped prose and poems."""
    judged = [i for i, w in enumerate(words) if 4 <= len(w) <= 25]
    bare = [i for i in judged if not _ended(lines[i])]
    if not bare or 2 * len(bare) > len(judged):
        return set()
    size = lambda x: len(x) if x.isascii() else len(x.decode("utf-8", "surrogatepass"))
    width, out = max(size(x) for x, w in zip(lines, words, strict=True) if len(w) <= 25), set()
    for i in bare:
        heading = len(words[i]) <= HEADING and (i == 0 or not words[i - 1])
        after = words[i + 1] if i + 1 < len(words) else []
        wrapped = bool(after) and size(lines[i]) + 1 + size(after[0]) > width
        if not heading and not wrapped:
            out.add(i)
    return out


def line_fails(line: bytes, words: list[bytes], unended: bool = False) -> bool:
    """Whether a line fails, told whether it is one of the unended lines."""
    n = len(words)
    symbols = len(line.translate(None, _SYMBOL))
    if 4 * symbols > n and (symbols > n or n >= 4):
        return True
    if n >= 3:
        if 2 * line.count(b"!") >= n:
            return True
        upper, letters, other = (len(line.translate(None, x)) for x in (_UPPER, _LETTERS, _OTHER))
        if 10 * (upper + other) > 6 * letters:  # else upper-case letters can't exceed 60 in 100
            text = line.decode("utf-8", "surrogatepass")
            if 10 * sum(map(str.isupper, text)) > 6 * sum(map(str.isalpha, text)):
                return True
    if n >= 6 and 3 * sum(map(bytes.__eq__, words, words[1:])) >= n:
        return True
    if n > 25:
        return False
    if unended or n >= 3 and 2 * len(line.translate(None, _PUNCTUATION).split()) < n or line.rstrip().endswith(tuple(_CODE_ENDS)):
        return True
    low = line.lower()
    if n <= 12:
        if b" | " in line or b" \xc2\xbb " in line or b" > " in line or sum(w in _SEPARATORS for w in words) >= 2 or _COPYRIGHT.match(low):
            return True
        named = _NAV.sub(b" ", low).strip()
        found = named.split()
        if named in NAVIGATION_LINES or all(w in _NAV_WORDS for w in found) and sum(w in _PAGES for w in found) >= 2:
            return True
    return any(x in low for x in BOILERPLATE_PARTS) and 2 * sum(len(x.split()) for x in BOILERPLATE_PARTS if x in low) >= n


def clean(text: str | None) -> tuple[str, int]:
    """The text without failing lines, and the words that went."""
    if not text:
        return "", 0
    out, seen, lost = [], set(), 0
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    split = [line.split() for line in lines]
    bare = unended_lines(lines, split)
    for i, (line, words) in enumerate(zip(lines, split, strict=True)):
        if words:
            if line in seen or line_fails(line, words, i in bare):
                lost += len(words)
            else:
                out.append(line)
            seen.add(line)
        else:
            out.append(line)
    return (b"\n".join(out).decode("utf-8", "surrogatepass") if lost else text), lost


SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lost_words bigint, base_failed boolean, kept boolean"


def judge(docs: DataFrame, with_text: bool = False, max_lost: float = MAX_LOST) -> DataFrame:
    """A row per document with its counts and verdict; with_text adds the cleaned text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            counts = [base_counts(t) for t in texts]
            cleaned = [clean(t) for t in texts]
            failed = [c[0] < 10 or 100 * c[4] > 20 * c[0] for c in counts]
            kept = [not f and lost <= max_lost * c[0] for f, c, (_, lost) in zip(failed, counts, cleaned, strict=True)]
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(5)]
            columns += [pa.array([x[1] for x in cleaned], pa.int64()), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "base_failed", "kept"]
            if with_text:
                columns.append(pa.array([x[0] for x in cleaned], pa.string()))
                names.append("cleaned")
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA + (", cleaned string" if with_text else ""))


def keep_good(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """The kept documents with all their columns; failing lines are gone from their texts."""

    def decide(texts: list) -> tuple[list, list]:
        flags, out = [], []
        for text in texts:
            n, _, _, _, repeated = base_counts(text)
            cleaned, lost = clean(text)
            flags.append(n >= 10 and 100 * repeated <= 20 * n and lost <= max_lost * n)
            out.append(cleaned if lost else text)
        return flags, out

    return keep_rows(docs, decide)
