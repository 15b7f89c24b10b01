"""SimHash near-duplicates with Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into three segments of 21 or 22 bits. Four differing bits leave one of:
an equal segment beside one with two differing bits at most (keys: the equal segment, and every codeword that the
other segment or a one-bit neighbour of it decodes to), or two segments with one differing bit each (keys: pairs of
codewords, one segment's own with the other's six, each way). So fingerprints that differ in four bits or fewer
share a key. Fingerprints of a key are compared, and only a spanning forest of the verified links is kept, so a
group of n gives n - 1 links at most. Keys with more fingerprints than GROUP are dealt out as pairs of blocks.

Defined cases: a null or wordless text has fingerprint zero and links like any other; fewer than four words are one
shingle; a very long text is hashed whole; equal fingerprints are one node; repeated rows stay; a row with a null doc_id links
others like any row but never names a component, so a component of such rows alone has a null component_id; an empty table
gives no row; further columns of any name don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from . import golay
from .common import materialise, slices, words_of
from .components import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
GROUP = 8192
#: Tells rows that share a doc_id apart.
TEXT_HASH = "_simhash_text"
NAMED, NAMELESS = "_simhash_id", "_simhash_null"
SEGMENTS = ((0, 21), (21, 21), (42, 22))
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint as an unsigned number: a bit is set if it is in over half of the shingles' hashes."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words).lower()  # bytes: A-Z only
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digests = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)])
    raw = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    if len(raw) < 512:
        counts = np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(raw[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(raw)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (as a signed bigint) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of its fingerprint) of all keys."""
    parts = [(prints >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [golay.near(p) for p in parts]
    index, keys, owners = np.arange(prints.size), [], []

    def put(tag: int, left: np.ndarray, codes: np.ndarray, exists: np.ndarray, flip: bool = False) -> None:
        both = (left[:, None] << 12 | codes) if not flip else (codes << 12 | left[:, None])
        keys.append(((both << 4) | tag)[exists])
        owners.append(np.broadcast_to(index[:, None], codes.shape)[exists])

    tag = 0
    for i in range(3):
        for j in range(3):
            own, more, real = near[j]
            codes = np.column_stack([own, more])
            exists = np.column_stack([np.ones(own.size, bool), real])
            if i != j:
                put(tag, parts[i], codes, exists)  # segment i equal, j within two bits
                tag += 1
            if i < j:
                put(6 + i + j, near[i][0], codes, exists)  # i and j within one bit each
                put(6 + i + j, own, near[i][1], near[i][2], flip=True)
    return np.concatenate(keys), np.concatenate(owners)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4096):
        prints, roots = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        keys, owners = keys_of(prints.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[owners]), pa.array(roots[owners])], names=["key", "fp", "root"])


def forest(prints: np.ndarray, roots: np.ndarray, max_bits: int = MAX_BITS) -> tuple[list[int], list[int]]:
    """Links that connect what is connected within max_bits among these fingerprints: a search that compares each
    reached one with those not yet reached."""
    left, right = [], []
    rest = np.arange(prints.size)
    while rest.size > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and rest.size:
            at = queue.pop()
            close = np.bitwise_count(prints[rest] ^ prints[at]) <= max_bits
            if close.any():
                reached = rest[close].tolist()
                left += [int(roots[at])] * len(reached)
                right += roots[reached].tolist()
                queue += reached
                rest = rest[~close]
    return left, right


SMALL = 16
_PAIRS = "deferred boolean, key bigint, u bigint, v bigint"


def _linker(group: int, max_bits: int):
    """Rows sorted by key to links; the rows of a key with more than ``group`` fingerprints come out deferred."""

    def table(deferred: bool, key, u, v) -> pa.RecordBatch:
        n = len(u)
        arrays = [pa.array(np.full(n, deferred)), pa.array(np.broadcast_to(key, n)), pa.array(u, pa.int64()), pa.array(v, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["deferred", "key", "u", "v"])

    def runs(key: np.ndarray, fp: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        sizes = np.diff(np.append(starts, key.size))
        size = np.repeat(sizes, sizes)
        left, right = [], []
        if (sizes > 1).any():
            small = np.flatnonzero((size > 1) & (size <= SMALL))
            k, f, r = key[small], fp[small], root[small]
            for lag in range(1, min(SMALL, small.size)):
                same = k[lag:] == k[:-lag]
                if not same.any():
                    break
                same &= np.bitwise_count(f[lag:] ^ f[:-lag]) <= max_bits
                left.append(r[:-lag][same])
                right.append(r[lag:][same])
        for at in np.flatnonzero(sizes > SMALL).tolist():
            run = slice(starts[at], starts[at] + sizes[at])
            if sizes[at] > group:
                yield table(True, key[run], root[run], fp[run].view(np.int64))
            else:
                u, v = forest(fp[run], root[run], max_bits)
                left.append(np.array(u, np.int64))
                right.append(np.array(v, np.int64))
        if left:
            yield table(False, np.int64(0), np.concatenate(left), np.concatenate(right))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, None
        for batch in batches:
            key, fp, root = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            fp = fp.view(np.uint64)
            if held is not None:
                key, fp, root = (np.concatenate(x) for x in zip(held, (key, fp, root), strict=True))
                held = None
            if large is not None:
                n = int(np.argmax(key != large)) if (key != large).any() else key.size
                yield table(True, key[:n], root[:n], fp[:n].view(np.int64))
                key, fp, root = key[n:], fp[n:], root[n:]
            if not key.size:
                continue
            large = None
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield from runs(key[:last], fp[:last], root[:last])
            held = key[last:], fp[last:], root[last:]
            if held[0].size > group:
                yield table(True, held[0], held[2], held[1].view(np.int64))
                held, large = None, int(key[-1])
        if held is not None:
            yield from runs(*held)

    return run


def links(distinct: DataFrame, max_bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """Links (u, v) between the roots of distinct fingerprints (fp, root) that connect all within max_bits (4 at most)."""
    keyed = distinct.select("fp", "root").mapInArrow(_emit_keys, "key bigint, fp bigint, root bigint")
    found = materialise(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_linker(group, max_bits), _PAIRS), "simhash-pairs")
    rest = found.where("deferred").select("key", F.col("v").alias("fp"), F.col("u").alias("root"))
    blocks = rest.groupBy("key").agg(F.ceil(F.count("*") / group).cast("int").alias("n"))
    dealt = rest.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("fp"), "n").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp", "root")
    more = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_linker(2**62, max_bits), _PAIRS)
    return found.where("not deferred").select("u", "v").unionAll(more.select("u", "v"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable). Fingerprints are
    the nodes, whoever owns them; a component is named after its owners at the end."""
    prints = materialise(fingerprints(docs), "simhash-prints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    member = components(links(distinct.select("fp", F.col("fp").alias("root"))))
    linked = materialise(member.join(distinct, member.node == distinct.fp).select("fp", "component", "least"), "simhash-linked")
    named = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(named, "component").select(F.col("fp").alias("node"), "component_id", F.lit(True).alias("found"))
    labelled = distinct.join(named, distinct.fp == named.node, "left").select("fp", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return prints.join(labelled, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: the one with the smallest doc_id, then the smallest hash
    of its text. Groups are of texts, so rows that only share a doc_id stay apart; of repeated rows one stays. Rows with a null
    doc_id are told apart by their texts, and come after all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(found.view(np.int64))], names=[NAMED, TEXT_HASH, NAMELESS, "fp"])

    named = docs.withColumns({TEXT_HASH: F.xxhash64("text"), NAMED: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), NAMELESS: F.col("doc_id").isNull()})
    rows = named.select(NAMED, "text", TEXT_HASH, NAMELESS)
    prints = materialise(rows.mapInArrow(run, f"{NAMED} bigint, {TEXT_HASH} bigint, {NAMELESS} boolean, fp bigint"), "simhash-prints")
    distinct = materialise(prints.select("fp", F.col("fp").alias("root")).distinct(), "simhash-distinct")
    member = components(links(distinct))
    labelled = prints.join(member, prints.fp == member.node, "left").select(NAMELESS, NAMED, TEXT_HASH, F.coalesce("component", "fp").alias("component"))
    kept = labelled.groupBy("component").agg(F.min(F.struct(NAMELESS, NAMED, TEXT_HASH)).alias("first")).select("first.*")
    key = [NAMELESS, NAMED, TEXT_HASH]
    return named.join(kept, key, "left_semi").dropDuplicates(key).select(docs.columns)
