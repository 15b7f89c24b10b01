"""Whole-batch numpy work on the UTF-8 buffer of an Arrow text column: no row becomes a Python object."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a mask that are summed up at once.
BLOCK = 4 << 20
#: Classes of a byte: a sign, an ASCII letter, or inside a code point.
SIGN, LETTER, INSIDE = 0, 1, 2
BYTE_CLASS = np.full(256, SIGN, np.uint8)
BYTE_CLASS[ord("A") : ord("Z") + 1] = BYTE_CLASS[ord("a") : ord("z") + 1] = LETTER
BYTE_CLASS[0x80:0xC0] = INSIDE


@dataclass
class Texts:
    """The bytes of all texts of a batch behind each other; text i lies at ends[i] to ends[i + 1]. A null text is empty."""

    data: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        column = pc.fill_null(column, "")
        wide = pa.types.is_large_string(column.type)
        _, ends, data = column.buffers()
        ends = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        return cls(whole[ends[0] : ends[-1]], ends - ends[0])

    def inner(self) -> np.ndarray:
        """The places where a text that is not empty begins."""
        return self.ends[:-1][self.ends[1:] > self.ends[:-1]]


class Ranks:
    """Counts and places of the set bytes of a mask, from cumulative sums of one block at a time."""

    def __init__(self, mask: np.ndarray, block: int = BLOCK):
        self.mask, self.block = mask, block
        starts = np.arange(0, mask.size, block)
        self.sums = np.append(0, np.cumsum(np.add.reduceat(mask, starts, dtype=np.int64))) if mask.size else np.zeros(1, np.int64)

    def _by_block(self, wanted: np.ndarray, blocks: np.ndarray):
        order = np.argsort(blocks, kind="stable")
        edges = np.flatnonzero(np.diff(blocks[order], prepend=-1))
        for rows in np.split(order, edges[1:]):
            if rows.size:
                at = int(blocks[rows[0]])
                yield rows, at, np.cumsum(self.mask[at * self.block : (at + 1) * self.block], dtype=np.int32)

    def before(self, places: np.ndarray) -> np.ndarray:
        """How many bytes are set before each place."""
        out, places = np.zeros(places.size, np.int64), np.asarray(places, np.int64)
        for rows, at, sums in self._by_block(places, np.minimum(places // self.block, max(self.sums.size - 2, 0))):
            inside = places[rows] - at * self.block
            out[rows] = self.sums[at] + np.where(inside > 0, sums[inside - 1] if sums.size else 0, 0)
        return out

    def place(self, numbers: np.ndarray) -> np.ndarray:
        """Where the set byte of each number (from 0) lies; the mask's size if there is none."""
        out, numbers = np.full(numbers.size, self.mask.size, np.int64), np.asarray(numbers, np.int64)
        there = np.flatnonzero(numbers < self.sums[-1])
        wanted = numbers[there]
        for rows, at, sums in self._by_block(wanted, np.searchsorted(self.sums, wanted, "right") - 1):
            out[there[rows]] = at * self.block + np.searchsorted(sums, wanted[rows] - self.sums[at] + 1, "left")
        return out


def code_points(texts: Texts) -> Ranks:
    """Ranks of the bytes that begin a code point."""
    return Ranks((BYTE_CLASS != INSIDE)[texts.data])


def runs(texts: Texts, member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of bytes of a class (member: by byte), ``least`` long or longer, inside one text."""
    mask = np.zeros(texts.data.size + 1, np.int8)
    mask[:-1] = member[texts.data]
    edge = np.diff(mask, prepend=np.int8(0))
    starts, ends = edge == 1, edge == -1
    inner = texts.inner()
    cut = inner[(inner > 0)]
    cut = cut[(mask[cut] == 1) & (mask[cut - 1] == 1)]  # a run may not go on into the next text
    starts[cut] = ends[cut] = True
    a, b = np.flatnonzero(starts), np.flatnonzero(ends)
    long = b - a >= least
    return a[long], b[long]
