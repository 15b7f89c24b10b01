"""Approximate dense search: inverted lists over k-means centroids, with product-quantised residuals and exact rescoring.

``fit`` learns centroids and the residuals' codebooks from a bounded sample (SAMPLE vectors, by hash of their ids, held by the driver).
``build`` assigns every vector to its nearest centroid and writes a table with a folder per list: codes of PIECES bytes beside the vectors.
A search reads the lists nearest to each query alone. Tasks first tell how good the best codes are, at GRAINS ranks a query, which gives a
floor that RESCORED * k candidates reach; these are scored by their vectors where they lie, and only each task's k best leave it.
``depth`` finds how many candidates that takes for a recall, since more vectors share a code as the table grows, and ``tune`` how
many lists; ``exact`` goes on to all lists that could still hold one of the best:
no vector of a list lies farther from its centroid than the list's radius, which bounds its score.

Defined cases: null vectors and ids are left out; vectors are compared by direction, and a zero vector has score zero; ties go to the
smaller id; a table of fewer vectors than lists has a list each; an empty table cannot be fitted."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written
from .retrieval import PORTION, QUERY_BLOCK, RANKED, _best, top_k

#: Vectors that are learned from; rounds of k-means; codes are bytes.
SAMPLE, ROUNDS, CODES = 20_000, 12, 256
PIECES, RESCORED = 8, 16
#: Ranks of the best codes that a task tells of; entries of a task's matrix of code scores; pairs that are scored by their vectors at once.
GRAINS, ENTRIES, PAIRS = 64, 8 << 20, 1 << 16
#: Queries that ``tune`` compares with the exhaustive search.
TUNED_ON = 128


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _means(rows: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """k-means; an empty group begins anew at the row that lies worst."""
    centres = rows[rng.choice(len(rows), n, replace=False)].copy()
    for _ in range(ROUNDS):
        far = (centres**2).sum(1)[None] - 2 * rows @ centres.T
        near = far.argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        sizes = np.bincount(near, minlength=n)
        worst = iter(np.argsort(-far[np.arange(len(rows)), near]))
        for at in np.flatnonzero(sizes == 0):
            sums[at], sizes[at] = rows[next(worst)], 1
        centres = sums / sizes[:, None]
    return centres


@dataclass(frozen=True)
class Codebook:
    """Centroids (lists by size), and for each piece of a residual its centres (pieces by codes by size of a piece, zero-filled)."""

    centroids: np.ndarray
    pieces: np.ndarray

    def _cut(self, rows: np.ndarray) -> np.ndarray:
        """Rows in pieces of one size: (pieces, rows, size)."""
        count, _, size = self.pieces.shape
        full = np.zeros((len(rows), count * size))
        full[:, : rows.shape[1]] = rows
        return full.reshape(len(rows), count, size).transpose(1, 0, 2)

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The list of each unit vector, the code of its residual, and the residual's length."""
        near = ((self.centroids**2).sum(1)[None] - 2 * rows @ self.centroids.T).argmin(1)
        rest = rows - self.centroids[near]
        cut = self._cut(rest)
        codes = [((book**2).sum(1)[None] - 2 * piece @ book.T).argmin(1) for piece, book in zip(cut, self.pieces, strict=True)]
        return near, np.array(codes, np.uint8).T, np.linalg.norm(rest, axis=1)

    def decoded(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the codes (rows by pieces) of vectors of these lists stand for: centroids with the residuals' centres."""
        rest = np.concatenate([book[codes[:, p]] for p, book in enumerate(self.pieces)], axis=1)
        return self.centroids[lists] + rest[:, : self.centroids.shape[1]]


def fit(vectors: DataFrame, lists: int | None = None, pieces: int = PIECES, sample: int = SAMPLE, seed: int = 7) -> Codebook:
    """Learn from ``sample`` vectors (id, vector) at most; by default as many lists as the root of all vectors."""
    there = vectors.where("id is not null and vector is not null")
    rows = there.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toPandas()["vector"]
    if not len(rows):
        raise ValueError("no vector to learn from")
    rows, rng = _unit(np.stack(rows.to_numpy()).astype(np.float64)), np.random.default_rng(seed)
    lists = max(1, min(len(rows), lists or int(there.count() ** 0.5)))
    centroids = _means(rows, lists, rng)
    size = -(-rows.shape[1] // pieces)
    blank = Codebook(centroids, np.zeros((pieces, 1, size)))
    rest = rows - centroids[blank.assign(rows)[0]]
    books = [_means(piece, min(CODES, len(rows)), rng) for piece in blank._cut(rest)]
    return Codebook(centroids, np.stack(books))


@dataclass(frozen=True)
class Lists:
    """A built index: where its tables are, its codebook, and by list the radius and the number of vectors."""

    path: str
    book: Codebook
    radii: np.ndarray
    sizes: np.ndarray

    def table(self, spark: SparkSession, wanted: np.ndarray) -> DataFrame:
        """Only the folders of the wanted lists are read, many of them by a task."""
        rows = spark.read.schema("id bigint, code binary, vector array<float>, list int").parquet(f"{self.path}/vectors").where(F.col("list").isin([int(x) for x in wanted]))
        return rows.coalesce(2 * spark.sparkContext.defaultParallelism)


def build(vectors: DataFrame, path: str, book: Codebook) -> Lists:
    """Assign every vector and write the tables. Lists are dealt out by rebalancing, so that Spark splits a large one."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(book)  # its size is a parameter: lists and codes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PORTION):
                part = batch.slice(start, PORTION)
                rows = _unit(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1))
                near, codes, far = shared.value.assign(rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(far)], names=["id", "vector", "list", "code", "far"])

    rows = vectors.where("id is not null and vector is not null").select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
    rows = written(rows.mapInArrow(run, "id bigint, vector array<float>, list int, code binary, far double"), "lists")
    rows.select("id", "code", "vector", "list").hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/vectors")
    radii, sizes = np.zeros(len(book.centroids)), np.zeros(len(book.centroids), np.int64)
    for r in rows.groupBy("list").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():  # a row per list
        radii[r["list"]], sizes[r["list"]] = r["far"], r["n"]
    return Lists(path, book, radii, sizes)


def _kept(rows: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k best of each query among (place of the query, id, score, list): the higher score, then the smaller id."""
    query, own, score, _ = rows
    order = np.lexsort((own, -score, query))
    query = query[order]
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if query.size else np.zeros(0, np.int64)
    keep = np.arange(query.size) - np.repeat(first, np.diff(np.append(first, query.size))) < k
    return [column[order][keep] for column in rows]


def _scan(spark: SparkSession, index: Lists, query_ids: np.ndarray, queries: np.ndarray, wanted: np.ndarray, keep: int) -> DataFrame:
    """The ``keep`` best (query_id, id, score, list) per query and task of the wanted lists (queries by lists), by vectors."""
    lists = np.flatnonzero(wanted.any(0) & (index.sizes > 0))
    shared = spark.sparkContext.broadcast((query_ids, queries, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, by_list = shared.value
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32)]  # place of the query, id, score, list
        for batch in batches:
            for start in range(0, batch.num_rows, PORTION):
                part = batch.slice(start, PORTION)
                own, there = part.column(0).to_numpy(), part.column(2).to_numpy()
                held = _unit(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(own.size, -1))
                for number in np.unique(there):
                    who, at = np.flatnonzero(by_list[:, number]), np.flatnonzero(there == number)
                    scores = np.round(asked[who] @ held[at].T, 6)
                    least = np.partition(scores, -keep, axis=1)[:, -keep] if at.size > keep else scores.min(axis=1, initial=np.inf)
                    place, column = np.nonzero(scores >= least[:, None])  # with all that tie with the last
                    more = who[place], own[at[column]], scores[place, column], np.full(place.size, number, np.int32)
                    best = _kept([np.concatenate(x) for x in zip(best, more, strict=True)], keep)
        if best[0].size:
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), *map(pa.array, best[1:])], names=["query_id", "id", "score", "list"])

    return index.table(spark, lists).select("id", "vector", "list").mapInArrow(run, f"{RANKED}, list int")


def _blocks(queries: DataFrame, block: int = QUERY_BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A stated query set in blocks of ids and unit vectors."""
    pending = []
    for row in queries.select(F.col("query_id").cast("bigint").alias("query_id"), "vector").where("query_id is not null and vector is not null").toLocalIterator():
        pending.append(row)
        if len(pending) == block:
            yield np.array([r.query_id for r in pending], np.int64), _unit(np.array([r.vector for r in pending], np.float64))
            pending = []
    if pending:
        yield np.array([r.query_id for r in pending], np.int64), _unit(np.array([r.vector for r in pending], np.float64))


def _nearest(index: Lists, rows: np.ndarray, probes: int) -> np.ndarray:
    """Which lists each query reads (queries by lists): those of the ``probes`` nearest centroids."""
    near = rows @ index.book.centroids.T
    out = np.zeros(near.shape, bool)
    np.put_along_axis(out, np.argsort(-near, axis=1)[:, :probes], True, axis=1)
    return out


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"{RANKED}, rank int")


def _by_code(part: pa.RecordBatch, asked: np.ndarray, by_list: np.ndarray, book: Codebook) -> np.ndarray:
    """Scores (queries by rows) of rows (id, code, list, ...) by their codes; without end below where a query does not read the list."""
    there = part.column(2).to_numpy()
    codes = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
    return np.where(by_list[:, there], asked @ book.decoded(there, codes).T, -np.inf)


def _floors(spark: SparkSession, index: Lists, ids: np.ndarray, rows: np.ndarray, wanted: np.ndarray, number: int) -> np.ndarray:
    """By query a code score that at least ``number`` of its vectors reach, and not many more: each task has the scores at every grain-th rank
    of its own best, and of all these together the one is taken above which grains enough lie."""
    grain = -(-number // GRAINS)
    ranks = -(-number // grain)
    shared = spark.sparkContext.broadcast((ids, rows, wanted, index.book))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, by_list, book = shared.value
        best = np.full((ids.size, ranks * grain), -np.inf)
        for batch in batches:
            for start in range(0, batch.num_rows, PORTION):
                scores = _by_code(batch.slice(start, PORTION), asked, by_list, book)
                best = np.partition(np.concatenate([best, scores], axis=1), scores.shape[1], axis=1)[:, scores.shape[1] :]
        told = np.sort(best, axis=1)[:, ::-1][:, grain - 1 :: grain]
        place, rank = np.nonzero(told > -np.inf)
        if place.size:
            yield pa.RecordBatch.from_arrays([pa.array(ids[place]), pa.array(rank.astype(np.int64)), pa.array(told[place, rank])], names=["query_id", "id", "score"])

    found = top_k(index.table(spark, np.flatnonzero(wanted.any(0) & (index.sizes > 0))).select("id", "code", "list").mapInArrow(run, RANKED), ranks)
    floors = {r.query_id: r.floor for r in found.groupBy("query_id").agg(F.when(F.count("*") == ranks, F.min("score")).alias("floor")).collect()}  # a row per query of the block
    return np.array([-np.inf if floors.get(int(i)) is None else floors[int(i)] - 1e-9 for i in ids])


def _approximate(spark: SparkSession, index: Lists, ids: np.ndarray, rows: np.ndarray, wanted: np.ndarray, k: int, rescored: int) -> DataFrame:
    """The k best of each query among its ``rescored`` * k best by code. Candidates are scored in the tasks that hold them."""
    least = int((wanted * index.sizes).sum(1).max(initial=0))
    floors = _floors(spark, index, ids, rows, wanted, rescored * k) if rescored * k < least else np.full(ids.size, -np.inf)
    shared = spark.sparkContext.broadcast((ids, rows, wanted, index.book, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, by_list, book, floor = shared.value
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # place of the query, id and score, so far
        for batch in batches:
            for start in range(0, batch.num_rows, PORTION):
                part = batch.slice(start, PORTION)
                own = part.column(0).to_numpy()
                coded = _by_code(part, asked, by_list, book)
                place, at = np.nonzero((coded >= floor[:, None]) & (coded > -np.inf))
                vectors = _unit(part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(own.size, -1))
                for cut in range(0, place.size, PAIRS):
                    query, row = place[cut : cut + PAIRS], at[cut : cut + PAIRS]
                    scores = np.round(np.einsum("ij,ij->i", asked[query], vectors[row]), 6)
                    best = _best([np.concatenate(x) for x in zip(best, (query, own[row], scores), strict=True)], k)
        if best[0].size:
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "id", "score"])

    held = index.table(spark, np.flatnonzero(wanted.any(0) & (index.sizes > 0)))
    return top_k(held.select("id", "code", "list", "vector").mapInArrow(run, RANKED), k).select("query_id", "id", "score", "rank")


def search(queries: DataFrame, index: Lists, k: int = 10, probes: int = 8, rescored: int = RESCORED) -> DataFrame:
    """Approximate cosine top-k of (query_id, vector): (query_id, id, score, rank). The ``rescored`` * k best by code are scored exactly."""
    spark, out = queries.sparkSession, None
    for ids, rows in _blocks(queries, max(1, min(QUERY_BLOCK, ENTRIES // (rescored * k + PORTION)))):
        part = _approximate(spark, index, ids, rows, _nearest(index, rows, probes), k, rescored)
        out = part if out is None else out.unionAll(part)
    return _empty(spark) if out is None else out


def exact(queries: DataFrame, index: Lists, k: int = 10, probes: int = 8) -> tuple[DataFrame, float]:
    """The exact top-k, and the share of lists that a query read on average. The nearest lists are read first, then, per query, those
    whose bound reaches the k-th score so far."""
    spark, out, shares, counts = queries.sparkSession, None, 0.0, 0
    there = index.sizes > 0
    for ids, rows in _blocks(queries):
        wanted = _nearest(index, rows, probes) & there
        first = written(top_k(_scan(spark, index, ids, rows, wanted, k), k).select("query_id", "id", "score"), "lists-first")
        floors = {r.query_id: r.floor for r in first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("floor")).collect()}  # a row per query of the block
        floor = np.array([-np.inf if floors.get(int(i)) is None else floors[int(i)] for i in ids])
        bound = rows @ index.book.centroids.T + index.radii[None]
        more = (bound >= floor[:, None] - 1e-5) & ~wanted & there
        part = first
        if more.any():
            part = first.unionAll(_scan(spark, index, ids, rows, more, k).select("query_id", "id", "score"))
        part = top_k(part, k).select("query_id", "id", "score", "rank")
        shares, counts = shares + float((wanted | more).sum()), counts + len(ids)
        out = part if out is None else out.unionAll(part)
    return (_empty(spark) if out is None else out), shares / max(1, counts * int(there.sum()))


def recall(found: DataFrame, true: DataFrame) -> float:
    """The share of the true (query_id, id) pairs that were found."""
    pairs = true.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return pairs.agg(F.count("hit") / F.greatest(F.count("*"), F.lit(1))).first()[0]


def _tried(queries: DataFrame, index: Lists, k: int) -> tuple[DataFrame, DataFrame]:
    """TUNED_ON of the queries, and their exact rows."""
    some = written(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(TUNED_ON), "lists-tuned")
    return some, written(exact(some, index, k)[0], "lists-true")


def depth(queries: DataFrame, index: Lists, k: int = 10, wanted: float = 0.95, least: int = RESCORED) -> int:
    """How many times k candidates have to be scored exactly (by doubling) for this recall over all lists, on TUNED_ON of the queries.
    At the latest all vectors are, which misses none."""
    (some, true), total, rescored = _tried(queries, index, k), len(index.sizes), least
    while rescored * k < int(index.sizes.sum()) and recall(search(some, index, k, total, rescored), true) < wanted:
        rescored *= 2
    return rescored


def tune(queries: DataFrame, index: Lists, k: int = 10, wanted: float = 0.95, rescored: int = RESCORED) -> int:
    """The least number of lists (by doubling, then halving) that gives this recall on TUNED_ON of the queries."""
    some, true = _tried(queries, index, k)
    total = int((index.sizes > 0).sum())
    low, high = 0, 1
    while high < total and recall(search(some, index, k, high, rescored), true) < wanted:
        low, high = high, min(total, 2 * high)
    while high - low > max(1, high // 8):
        middle = (low + high) // 2
        low, high = (low, middle) if recall(search(some, index, k, middle, rescored), true) >= wanted else (middle, high)
    return high


def save(index: Lists, spark: SparkSession) -> None:
    """Put the codebook beside the tables."""
    held = {"centroids": index.book.centroids.tolist(), "pieces": index.book.pieces.tolist(), "radii": index.radii.tolist(), "sizes": index.sizes.tolist()}
    spark.createDataFrame([(json.dumps(held),)], "book string").coalesce(1).write.mode("overwrite").text(f"{index.path}/book")


def load(spark: SparkSession, path: str) -> Lists:
    held = {k: np.array(v) for k, v in json.loads(spark.read.text(f"{path}/book").first()[0]).items()}
    return Lists(path, Codebook(held["centroids"], held["pieces"]), held["radii"], held["sizes"])
