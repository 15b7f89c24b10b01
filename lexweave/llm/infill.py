"""Fill-in-middle transformation: a text is cut at two of its token ends into prefix, middle and suffix, and put together with
sentinels, middle last, so that a left-to-right model learns to fill gaps.

A token is a run of ASCII letters, or any other code point. All rows of an Arrow batch are cut together on its UTF-8 buffer: a table
gives the class of each byte; a byte begins a token unless it is inside a code point or is a letter after a letter; the mask is reset
where a text begins; its cumulative sums give each text's number of tokens and, by binary search, the places of both cuts of all rows.

Cuts and form are drawn from a hash of seed and doc_id, so that they do not change with partitions or attempts. Forms:
  plain  the text itself: an empty text, one that holds a sentinel, and ``1 - rate`` of the others
  psm    <P>prefix<S>suffix<M>middle
  spm    <S>suffix<P>prefix<M>middle

Defined cases: a null or empty text is plain and has an empty output; a null doc_id is drawn for as the empty string; repeated rows
are transformed each, alike; a text of one token may have an empty prefix, middle or suffix; both cuts may be the same; a very long
text is read whole; an empty table gives no row; further columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buffers import BYTE_CLASS, INSIDE, LETTER, Ranks, Texts, code_points
from .common import slices

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
RATE, SPM_RATE = 90, 20
SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def token_starts(texts: Texts) -> np.ndarray:
    """A mask of the bytes that begin a token."""
    kind = BYTE_CLASS[texts.data]
    starts = kind != INSIDE
    letter = kind == LETTER
    starts[1:] &= ~(letter[1:] & letter[:-1])
    starts[texts.inner()] = True
    return starts


def cuts(texts: Texts, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of each text, and the places (2 by texts) where prefix and middle end: after draw % (tokens + 1) tokens each."""
    ranks = Ranks(token_starts(texts))
    edges = ranks.before(texts.ends)
    n = np.diff(edges)
    units = np.sort(draws % (n + 1), axis=0)
    places = ranks.place((edges[:-1] + units).ravel()).reshape(units.shape)
    return n, np.minimum(places, texts.ends[1:])  # after the last token: where the text ends


def _arranged(texts: Texts, at: np.ndarray, form: np.ndarray) -> list[bytes]:
    raw, out = memoryview(texts.data), []
    for start, a, b, end, kind in zip(texts.ends[:-1].tolist(), *at.tolist(), texts.ends[1:].tolist(), form.tolist(), strict=True):
        prefix, middle, suffix = raw[start:a], raw[a:b], raw[b:end]
        if kind == "psm":
            out.append(b"".join((PREFIX.encode(), prefix, SUFFIX.encode(), suffix, MIDDLE.encode(), middle)))
        elif kind == "spm":
            out.append(b"".join((SUFFIX.encode(), suffix, PREFIX.encode(), prefix, MIDDLE.encode(), middle)))
        else:
            out.append(bytes(raw[start:end]))
    return out


def transform(batch: pa.RecordBatch, rate: int = RATE, spm_rate: int = SPM_RATE) -> pa.RecordBatch:
    """doc_id, text and four draws of each row to the columns of SCHEMA."""
    column = batch.column(1)
    texts = Texts.of(column)
    draws = np.array([batch.column(k).to_numpy() for k in range(2, 6)])
    n, at = cuts(texts, draws[:2])
    held = reduce(pc.or_, (pc.match_substring(column, s) for s in SENTINELS))
    plain = pc.fill_null(held, True).to_numpy(zero_copy_only=False) | (n == 0) | (draws[2] % 100 >= rate)
    form = np.where(plain, "plain", np.where(draws[3] % 100 < spm_rate, "spm", "psm"))
    chars = code_points(texts)
    sizes = np.diff([chars.before(x) for x in (texts.ends[:-1], *at)], axis=0)
    output = pa.array(_arranged(texts, at, form), pa.binary()).cast(pa.string())
    columns = [pa.array(n), pa.array(form, pa.string()), *(pa.array(x, pa.int64(), mask=plain) for x in sizes), output]
    return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, seed: str = "1", rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """A row per document: its tokens, form, the code points of prefix and middle (null where plain), and the output text. ``rate``
    in a hundred documents are transformed, ``spm_rate`` of them suffix first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield transform(batch, rate, spm_rate)

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", digest.alias("digest"))
    draws = [F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]
    return rows.select("doc_id", "text", *draws).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text of an output: its parts are found by the sentinels, which no part holds, and joined in their first order."""
    inner = F.substr(output, F.lit(len(PREFIX) + 1))

    def joined(second: str, prefix_first: bool) -> Column:
        lead = F.substring_index(inner, second, 1)
        rest = F.substr(inner, F.length(lead) + len(second) + 1)
        other = F.substring_index(rest, MIDDLE, 1)
        middle = F.substr(rest, F.length(other) + len(MIDDLE) + 1)
        return F.concat(lead, middle, other) if prefix_first else F.concat(other, middle, lead)

    return F.when(form == "plain", output).when(form == "psm", joined(SUFFIX, True)).otherwise(joined(PREFIX, False))


def digests(docs: DataFrame) -> DataFrame:
    """fill_in_middle with hashes of the output, and of the text restored from it, in place of the output."""
    rows = fill_in_middle(docs)
    back = restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
