"""Language-model scoring: stupid backoff of order ORDER, computed relationally.

Every document is scored by the counts of all the others (its own are taken off), so that a text is not its own evidence:
  S(w | u .. h) = c(u .. h w) / c(u .. h) if c(u .. h w) > 0, else ALPHA * S(w | .. h);  S(w) = c(w) / N if c(w) > 0, else ALPHA / (N + 1).

1. Documents are cut into blocks; a block lists its distinct words' hashes and its tokens as places in that list.
2. A block sends its distinct n-grams with their counts, once each, to the count table, which is partitioned by the leading
   bits of the 64-bit n-gram hash. A frequent n-gram is thereby one entry per block, however many documents hold it.
3. Up to GROUP blocks meet in a bucket and their counts are summed. If there are more blocks, the sums of each group are nodes
   that are split by further bits and meet again, so every n-gram is summed up a tree: a node has at most GROUP children, a
   bucket as many entries as a block, and rows grow with the blocks times the tree's height, not with blocks times buckets.
4. The totals come down the same tree to the blocks that asked, and each block sums the logarithms per document.

N-grams are told apart by their hashes alone: of 10^12 distinct ones a given one is mistaken with a chance of 5 in 10^8.
Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Defined cases: a null or empty text has no token and scores 0; an
empty table gives no row; the only document of a corpus sees no counts; a very long text is a block of its own; repeated rows
are documents of their own, and so are rows with a null doc_id; further columns of any name don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import materialise, slices, words_of

ALPHA = 0.4
#: Words of an n-gram at most.
ORDER = 2
#: UTF-8 bytes of text in a block, and n-gram entries in a bucket, about.
BLOCK_BYTES = 5_000_000
BUCKET_ENTRIES = 800_000
#: Nodes that meet in a bucket, and hash bits that a level of the tree is cut by.
GROUP = 256
BITS = 8
_BLOCKS = "block bigint, n_tokens bigint, docs binary, lengths binary, tokens binary, words binary"


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Numbers (ascending ones as differences), byte planes apart, compressed."""
    if ascending and values.size:
        values = np.concatenate([values[:1], np.diff(values)])
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(raw: bytes, kind: type, ascending: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    values = np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)
    return np.cumsum(values, dtype=kind) if ascending else values


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hashes of n-grams from those of all words but the last, and of the last."""
    hashes = left * np.uint64(0x9E3779B97F4A7C15) + right
    hashes ^= hashes >> np.uint64(31)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(32)
    return hashes


def _grams(tokens: np.ndarray, lengths: np.ndarray, words: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each order: the hashes of the distinct n-grams, the place among them of the one that ends at each token (-1: the
    text has not so many words yet), and their counts."""
    out = [(words, tokens.astype(np.int64), np.bincount(tokens, minlength=words.size))]
    if not tokens.size:
        return out * order
    begins = np.zeros(tokens.size, np.int64)
    at = np.cumsum(lengths) - lengths
    begins[at[lengths > 0]] = at[lengths > 0]
    since = np.arange(tokens.size) - np.maximum.accumulate(begins)
    for k in range(2, order + 1):
        hashes, place, _ = out[-1]
        ends = np.flatnonzero(since >= k - 1)
        full = np.full(tokens.size, -1)
        pair, found, counts = np.unique(place[ends - 1] * words.size + tokens[ends], return_inverse=True, return_counts=True)
        full[ends] = found
        out.append((_mixed(hashes[pair // words.size], words[pair % words.size]), full, counts))
    return out


def _opened(row: dict, order: int) -> tuple:
    """A block's lengths, tokens, words, n-grams, and the order that sorts the hashes of all its n-grams."""
    lengths, tokens = unpack(row["lengths"], np.int32).astype(np.int64), unpack(row["tokens"], np.int32)
    words = unpack(row["words"], np.uint64, True)
    grams = _grams(tokens, lengths, words, order)
    return lengths, tokens, words, grams, np.argsort(np.concatenate([h for h, _, _ in grams]), kind="stable")


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    def make(seq: int, ids: list, index: dict[bytes, int], texts: list[np.ndarray]) -> dict:
        flat = np.concatenate(texts)
        hashes = np.array([xxh64_intdigest(w, 42) for w in index], np.uint64)
        order = np.argsort(hashes, kind="stable")
        place = np.empty(order.size, np.int32)
        place[order] = np.arange(order.size, dtype=np.int32)
        docs = pa.BufferOutputStream()
        with pa.ipc.new_stream(docs, pa.schema([("doc_id", pa.int64())])) as out:
            out.write_batch(pa.record_batch([pa.array(ids, pa.int64())], names=["doc_id"]))
        return {
            "block": TaskContext.get().partitionId() << 32 | seq, "n_tokens": flat.size, "docs": docs.getvalue().to_pybytes(),
            "lengths": pack(np.array(list(map(len, texts)), np.int32)), "tokens": pack(place[flat] if flat.size else flat), "words": pack(hashes[order], True),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, size, ids, index, texts = 0, 0, [], {}, []
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())

        def out() -> pa.RecordBatch:
            made = make(seq, ids, index, texts)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(made.values(), kinds, strict=True)], names=list(made))

        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc)
                words = words_of((text or "").translate(_LOWER))
                texts.append(np.array([index.setdefault(w, len(index)) for w in words], np.int32))
                size += sum(map(len, words)) + len(words)
                if size >= block_bytes:
                    yield out()
                    seq, size, ids, index, texts = seq + 1, 0, [], {}, []
        if ids:
            yield out()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _BLOCKS)


_LOWER = {c: c + 32 for c in range(65, 91)}
_NODES = "path bigint, node bigint, keys binary, counts binary"
_PIECES = "path bigint, grp bigint, owner bigint, node bigint, keys binary, counts binary"
_REPLIES = "owner bigint, node bigint, path bigint, totals binary"
_KINDS = {"bigint": pa.int64(), "binary": pa.binary()}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    names, kinds = zip(*(x.split(" ") for x in schema.split(", ")), strict=True)
    return pa.table([pa.array([r[i] for r in rows], _KINDS[k]) for i, k in enumerate(kinds)], names=list(names))


def _pieces(path: int, node: int, keys: np.ndarray, counts: np.ndarray, done: int, bits: int, groups: int) -> list[tuple]:
    """A node's n-grams, whose hashes share their first ``done`` bits, cut by the next ``bits`` ones."""
    group = xxh64_intdigest(node.to_bytes(8, "big", signed=True)) % groups
    if not bits:
        return [(path, group, path, node, pack(keys, True), pack(counts))]
    part = (keys << np.uint64(done)) >> np.uint64(64 - bits)
    edges = np.searchsorted(part, np.arange((1 << bits) + 1, dtype=np.uint64)).tolist()
    return [(path << bits | b, group, path, node, pack(keys[x:y], True), pack(counts[x:y])) for b, (x, y) in enumerate(zip(edges, edges[1:], strict=False)) if y > x]


def _of_blocks(order: int, bits: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            _, _, _, grams, sort = _opened(row, order)
            keys, counts = np.concatenate([h for h, _, _ in grams])[sort], np.concatenate([c for _, _, c in grams])[sort]
            yield from _table(_pieces(0, row["block"], keys, counts, 0, bits, groups), _PIECES).to_batches()

    return run


def _of_nodes(done: int, bits: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            cut = _pieces(row["path"], row["node"], unpack(row["keys"], np.uint64, True), unpack(row["counts"], np.int64), done, bits, groups)
            yield from _table(cut, _PIECES).to_batches()

    return run


def _summed(pieces: pa.Table) -> tuple[list, list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The keys and counts of each piece, the order that sorts all keys, the distinct keys' starts in it, keys and counts."""
    keys = [unpack(k, np.uint64, True) for k in pieces.column("keys").to_pylist()]
    counts = [unpack(c, np.int64) for c in pieces.column("counts").to_pylist()]
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    start = np.flatnonzero(np.append(True, np.diff(flat[order]) != 0))
    return keys, counts, order, start, flat[order[start]], np.add.reduceat(np.concatenate(counts)[order], start)


def _merge(key: tuple, pieces: pa.Table) -> pa.Table:
    """The pieces of a group as one node."""
    *_, keys, counts = _summed(pieces)
    return _table([(key[0].as_py(), key[1].as_py(), pack(keys, True), pack(counts))], _NODES)


def _answer(pieces: pa.Table, totals: np.ndarray | None = None) -> pa.Table:
    """To each piece the totals of its n-grams, less its own counts (mostly zeros, which pack well). The totals of a group
    are its sums, unless they came down from other groups."""
    keys, counts, order, start, distinct, sums = _summed(pieces)
    spread = np.empty(order.size, np.int64)
    spread[order] = np.repeat(sums if totals is None else totals + sums, np.diff(np.append(start, order.size)))
    ends, out = np.cumsum([k.size for k in keys]).tolist(), []
    for owner, node, path, end, own in zip(*(pieces.column(c).to_pylist() for c in ("owner", "node", "path")), ends, counts, strict=True):
        out.append((owner, node, path, pack(spread[end - own.size : end] - own)))
    return _table(out, _REPLIES)


def _hand_down(pieces: pa.Table, replies: pa.Table) -> pa.Table:
    parts = sorted(zip(replies.column("path").to_pylist(), replies.column("totals").to_pylist(), strict=True))
    return _answer(pieces, np.concatenate([unpack(t, np.int64) for _, t in parts]))


def totals(pieces: DataFrame, n_nodes: int, done: int, group: int, bits: int = BITS) -> DataFrame:
    """Replies to pieces whose hashes share ``done`` bits within a path and which come from n_nodes nodes at most."""
    grouped = pieces.groupBy("path", "grp")
    groups = -(-n_nodes // group)
    if groups == 1:
        return grouped.applyInArrow(lambda table: _answer(table), _REPLIES)
    nodes = materialise(grouped.applyInArrow(_merge, _NODES), "lm-nodes")
    bits = min(bits, 64 - done)
    above = totals(nodes.mapInArrow(_of_nodes(done, bits, -(-groups // group)), _PIECES), groups, done + bits, group, bits)
    return grouped.cogroup(above.select(F.col("owner").alias("path"), F.col("node").alias("grp"), F.col("path").alias("part"), "totals").groupBy("path", "grp")).applyInArrow(
        lambda left, right: _hand_down(left, right.drop_columns("path").rename_columns({"part": "path"})), _REPLIES
    )


def _scores(n_total: int, alpha: float, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            lengths, tokens, _, grams, sort = _opened(row, order)
            others = np.empty(sort.size, np.int64)
            others[sort] = np.concatenate([np.zeros(0, np.int64), *(unpack(r["totals"], np.int64) for r in row["replies"] or [])])
            doc, first = np.repeat(np.arange(lengths.size), lengths), 0
            seen: list[np.ndarray] = []  # by order: how often other documents hold the n-gram that ends at each token
            for hashes, place, counts in grams:
                total = others[first : first + hashes.size] + counts
                first += hashes.size
                here = np.flatnonzero(place >= 0)
                found = np.zeros(tokens.size, np.int64)
                found[here] = total[place[here]] - _own(doc[here], place[here], hashes.size)
                seen.append(found)
            left = (n_total - lengths)[doc].astype(np.float64)
            log = np.log10(np.where(seen[0] > 0, seen[0] / np.maximum(left, 1), alpha / (left + 1))) if tokens.size else np.zeros(0)
            backed = np.zeros(tokens.size, bool)
            for k in range(1, order):
                there = grams[k][1] >= 0
                known = np.flatnonzero(there & (seen[k] > 0))
                backed = there & (seen[k] == 0) | backed & ~there
                log[backed & there] += np.log10(alpha)
                log[known] = np.log10(seen[k][known] / seen[k - 1][known - 1])
            n_backoff = np.bincount(doc[backed], minlength=lengths.size)
            total = np.bincount(doc, weights=log, minlength=lengths.size).astype(np.float64)
            ids = pa.ipc.open_stream(row["docs"]).read_all().column("doc_id").combine_chunks()
            mean = total / np.maximum(lengths, 1)
            columns = [ids, pa.array(lengths), pa.array(n_backoff.astype(np.int64)), pa.array(np.round(total, 4)), pa.array(np.round(mean, 6))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_backoff", "log10_score", "mean_log10"])

    return run


def _own(doc: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
    """How often each token's n-gram is in its own document."""
    _, at, counts = np.unique(doc * max(n, 1) + gram, return_inverse=True, return_counts=True)
    return counts[at] if at.size else np.zeros(0, np.int64)


SCHEMA = "doc_id bigint, n_tokens bigint, n_backoff bigint, log10_score double, mean_log10 double"


def score(docs: DataFrame, alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES, bucket_entries: int = BUCKET_ENTRIES, group: int = GROUP, order: int = ORDER, bits: int = BITS) -> DataFrame:
    """A row per document: n_tokens, n_backoff (tokens scored without all of the history that they have), log10_score and its mean."""
    cut = materialise(blocks(docs, block_bytes), "lm-blocks")
    n_total, n_blocks = cut.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    first = min(bits, int(order * n_total // bucket_entries).bit_length())
    pieces = cut.select("block", "lengths", "tokens", "words").mapInArrow(_of_blocks(order, first, max(1, -(-n_blocks // group))), _PIECES)
    told = totals(pieces, max(1, n_blocks), first, group, bits)
    replies = told.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("path", "totals"))).alias("replies"))
    joined = cut.select("block", "docs", "lengths", "tokens", "words").join(replies.withColumnRenamed("node", "block"), "block", "left")
    return joined.mapInArrow(_scores(n_total, alpha, order), SCHEMA)


def sql(order: int = ORDER, alpha: float = ALPHA) -> str:
    """The same in SQL: counts of all documents less those of the own one."""
    later = range(2, order + 1)
    history = "".join(f", lag(w, {k - 1}) OVER o AS h{k}" for k in later)
    gram = {k: ", ".join([f"h{i}" for i in range(k, 1, -1)] + ["w"]) for k in range(1, order + 1)}
    counts = ", ".join(f"count(*) OVER (PARTITION BY {g}) - count(*) OVER (PARTITION BY rid, {g}) AS c{k}" for k, g in gram.items())
    before = "".join(f", lag(c{k - 1}) OVER o AS b{k}" for k in later)
    score = f"log10(CASE WHEN c1 > 0 THEN c1 / n ELSE {alpha} / (n + 1) END)"
    for k in later:
        score = f"CASE WHEN has{k} AND c{k} > 0 THEN log10(c{k} / b{k}) ELSE CASE WHEN has{k} THEN log10({alpha}) ELSE 0 END + {score} END"
    backed = " ".join(f"WHEN has{k} THEN c{k} = 0" for k in reversed(later)) or "WHEN false THEN false"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS l FROM documents),
t AS (SELECT rid, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM d),
p AS (SELECT rid, i, w{history} FROM t WINDOW o AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT rid, i{"".join(f", h{k} IS NOT NULL AS has{k}" for k in later)}, {counts} FROM p),
b AS (SELECT *{before} FROM c WINDOW o AS (PARTITION BY rid ORDER BY i)),
n AS (SELECT rid, doc_id, len(l) AS own, (SELECT count(*) FROM t) - len(l) AS n FROM d),
e AS (SELECT rid, CASE {backed} ELSE false END AS backed, {score} AS s FROM b JOIN n USING (rid)),
r AS (SELECT rid, count(*) FILTER (WHERE backed) AS n_backoff, sum(s) AS total FROM e GROUP BY rid)
SELECT doc_id, own::BIGINT AS n_tokens, coalesce(n_backoff, 0)::BIGINT AS n_backoff, round(coalesce(total, 0), 4)::DOUBLE AS log10_score,
  round(coalesce(total, 0) / greatest(own, 1), 6)::DOUBLE AS mean_log10 FROM n LEFT JOIN r USING (rid)
"""


SQL = sql()
