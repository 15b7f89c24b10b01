"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..sources.shared import completed, release, shared_dir, spread, table
from ..sources.shared import written as materialise

__all__ = ["completed", "keep_rows", "materialise", "release", "shared_dir", "slices", "spread", "table", "words_of"]
#: Rows, and bytes of text, that a worker turns into Python objects at once; a longer text comes alone.
SLICE_ROWS = 256
SLICE_BYTES = 16 << 20


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
        lengths = np.zeros(batch.num_rows, np.int64)
        for column in texts:
            lengths += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            fits = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right"))
            end = max(start + 1, min(start + rows, fits))
            yield batch.slice(start, end - start)
            start = end


def keep_rows(docs: DataFrame, decide: Callable[[list], tuple[list, list | None]]) -> DataFrame:
    """Filter documents in one scan without a shuffle, whatever columns they have.

    decide(texts) gives a flag per row and, or None, new texts; where a text changes, n_chars (if there) follows it."""
    schema = docs.schema
    names = schema.names
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            flags, new = decide(texts)
            columns = list(batch.columns)
            if new is not None:
                changed = [a != b for a, b in zip(texts, new, strict=True)]
                columns[at] = pa.array(new, columns[at].type)
                if size is not None and any(changed):
                    sizes = [len(t) if c else n for t, c, n in zip(new, changed, columns[size].to_pylist(), strict=True)]
                    columns[size] = pa.array(sizes, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(flags, pa.bool_()))

    return docs.mapInArrow(run, schema)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; a null text has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
