"""Benchmark decontamination: a broadcast hash set of normalised test n-grams scans training token windows.

A window is 13 consecutive item words; an item of fewer words (but not none) is one window. Every document
window whose hash is in the set is verified by its word ids, so results are exact. Test sets beyond
MAX_WINDOWS are scanned in blocks of that many windows; the blocks' hits are merged per row, by a written row key.

Defined cases: a null or empty text has no words, no hit and the hash of an empty item list; a very long text is scanned
whole, a text at a time; repeated rows are judged each; null and repeated doc_ids are rows like any other; an item_id on
several rows is one item with the windows of all; an item without an item_id marks words, but is not listed; an item
without a text or word marks nothing; exactly one word in twenty is contaminated; empty documents give no row and an empty
benchmark contaminates nothing; further columns of any name are ignored by the report and kept by the filter.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, materialise, slices

WINDOW = 13
#: Windows in one broadcast set (about 200 bytes each); larger test sets take several scans.
MAX_WINDOWS = 500_000
_MULTIPLIER = 0x9E3779B97F4A7C15
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def normal_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` ids."""
    n = ids.size - length + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(length):
        out *= np.uint64(_MULTIPLIER)
        out += ids[k : k + out.size]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


@dataclass
class WindowSet:
    """Windows by length: their hashes, a bit filter, and the items of each exact window."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    by_length: dict[int, tuple[np.ndarray, dict[bytes, list[str]]]] = field(default_factory=dict)

    @classmethod
    def of(cls, windows: list[tuple[str | None, tuple[bytes, ...]]]) -> WindowSet:
        out, exact = cls(), defaultdict(lambda: defaultdict(set))
        for item, words in windows:
            ids = np.array([out.vocabulary.setdefault(w, len(out.vocabulary) + 1) for w in words], np.uint64)
            exact[len(words)][ids.tobytes()].add(item)
        for length, seen in exact.items():
            flags = np.zeros(1 << 20, bool)
            flags[(np.concatenate([rolling(np.frombuffer(k, np.uint64), length) for k in seen]) >> np.uint64(44)).astype(np.int64)] = True
            out.by_length[length] = flags, {k: sorted(v - {None}) for k, v in seen.items()}
        return out

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie inside a window, and the items that occur."""
        hit, items = np.zeros(len(words), bool), set()
        if not words or not self.by_length:
            return hit, items
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words], np.uint64)
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for length, (flags, exact) in self.by_length.items():
            if len(words) < length:
                continue
            clean = unknown[length:] == unknown[:-length]
            if not clean.any():
                continue
            places = np.flatnonzero(clean & flags[(rolling(ids, length) >> np.uint64(44)).astype(np.int64)])
            for at in places.tolist():
                found = exact.get(ids[at : at + length].tobytes())
                if found is not None:
                    hit[at : at + length] = True
                    items.update(found)
        return hit, items


def benchmark_windows(benchmark: DataFrame, length: int = WINDOW) -> Iterator[tuple[str | None, tuple[bytes, ...]]]:
    """Every window of every item, streamed to the driver partition by partition."""
    for row in benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null").toLocalIterator():
        words = normal_words(row.text)
        for at in range(max(1, len(words) - length + 1) if words else 0):
            yield row.item, tuple(words[at : at + length])


def _blocks(windows: Iterator, size: int) -> Iterator[list]:
    """Lists of at most ``size`` windows; one empty list if there is none."""
    yield list(islice(windows, size))
    while block := list(islice(windows, size)):
        yield block


def _spans(hit: np.ndarray) -> list[int]:
    """[start, end, start, end ...] of the runs of hit words."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).tolist()


#: Names a row where rows are scanned more than once; doc_ids can be null or repeated.
ROW_KEY = "_decontamination_row"
HITS = f"{ROW_KEY} bigint, doc_id bigint, n_words bigint, spans array<int>, items array<string>"
REPORT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<int>"


def _report(ids: list, n_words: list, hits: list[tuple[list[int], list[str]]]) -> pa.RecordBatch:
    n_hit = [sum(s[1::2]) - sum(s[::2]) for s, _ in hits]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(i) for _, i in hits], pa.int64()),
            pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for _, i in hits], pa.string()),
            pa.array([h > 0 and 20 * h >= n for h, n in zip(n_hit, n_words, strict=True)], pa.bool_()),
            pa.array([s for s, _ in hits], pa.list_(pa.int32())),
        ],
        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
    )


def _scanner(shared, report: bool):
    """Rows of doc_id and text to REPORT; rows of row key, doc_id and text to HITS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in slices(batches):
            hits, n = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                words = normal_words(text)
                hit, items = windows.scan(words)
                n.append(len(words))
                hits.append((_spans(hit), sorted(items)))
            if report:
                yield _report(batch.column(0).to_pylist(), n, hits)
            else:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([s for s, _ in hits], pa.list_(pa.int32())), pa.array([i for _, i in hits], pa.list_(pa.string()))],
                    names=[ROW_KEY, "doc_id", "n_words", "spans", "items"],
                )

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        hits = []
        for n, spans, items in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            hit = np.zeros(n, bool)
            for part in spans:
                for a, b in zip(part[::2], part[1::2], strict=True):
                    hit[a:b] = True
            hits.append((_spans(hit), sorted(set().union(*items))))
        yield _report(batch.column(0).to_pylist(), batch.column(1).to_pylist(), hits)


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key each, written, so that every scan sees the same keys."""
    return materialise(docs.withColumn(ROW_KEY, F.monotonically_increasing_id()), "decontamination-rows")


def _merged(keyed: DataFrame, blocks: Iterator[list]) -> DataFrame:
    """ROW_KEY, doc_id, n_words, and the spans and items of all blocks, per row. Blocks after the first add rows with hits only."""
    sc, hits = keyed.sparkSession.sparkContext, None
    rows = keyed.select(ROW_KEY, F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    for block in blocks:
        part = rows.mapInArrow(_scanner(sc.broadcast(WindowSet.of(block)), False), HITS)
        hits = part if hits is None else hits.unionAll(part.where(F.size("spans") > 0))
    return hits.groupBy(ROW_KEY).agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, max_windows: int = MAX_WINDOWS, length: int = WINDOW) -> DataFrame:
    """A row per row of docs: its words, hit words, spans (word offsets) and items. One scan without a shuffle while
    the test set fits one block; else a scan per block over the written rows, merged by row key."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    blocks = _blocks(benchmark_windows(benchmark, length), max_windows)
    block, after = next(blocks), next(blocks, None)
    if not after:
        return docs.mapInArrow(_scanner(docs.sparkSession.sparkContext.broadcast(WindowSet.of(block)), True), REPORT)
    return _merged(_keyed(docs), chain([block, after], blocks)).drop(ROW_KEY).mapInArrow(_merge, REPORT)


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, max_windows: int = MAX_WINDOWS, length: int = WINDOW) -> DataFrame:
    """The rows that are not contaminated, with all their columns. A test set of one block needs no shuffle."""
    blocks = _blocks(benchmark_windows(benchmark, length), max_windows)
    block, after = next(blocks), next(blocks, None)
    if after:
        keyed = _keyed(docs)
        # _merge names its first column doc_id: here it carries the row key
        merged = _merged(keyed, chain([block, after], blocks)).select(F.col(ROW_KEY).alias("doc_id"), "n_words", "spans", "items")
        bad = merged.mapInArrow(_merge, REPORT).where("contaminated").select(F.col("doc_id").alias(ROW_KEY))
        return keyed.join(bad, ROW_KEY, "left_anti").select(docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(WindowSet.of(block))

    def decide(texts: list) -> tuple[list, None]:
        flags = []
        for text in texts:
            words = normal_words(text)
            n = int(shared.value.scan(words)[0].sum())
            flags.append(not (n > 0 and 20 * n >= len(words)))
        return flags, None

    return keep_rows(docs, decide)
