"""Questions over an index: retrieve, rerank, format the context, build the prompt, and optionally generate."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sparse
from ..operators import pruned, retrieval
from ..sources.config import Config
from ..sources.index import Embedder, HashEmbedder, embed
from ..sources.shared import written

#: Queries up to which an index is searched by its blocks; the terms of all documents are read once for more.
PRUNED_QUERIES = 16
Scorer = Callable[[Column, Column], Column]


def search(queries: DataFrame, index: dict[str, DataFrame], config: Config = Config(), factory: Callable[[], Embedder] = HashEmbedder, prefix: str = "query: ", scorer: Scorer = retrieval.lexical_scorer) -> DataFrame:
    """(query_id, id, score, rank) of queries (query_id, query) by the configured method. The search runs on the numbers that the
    index gave its chunks; the few ranked ones get their chunk ids after it."""

    def dense() -> DataFrame:
        asked = embed(queries, factory, "query_id", "query", prefix, config.embed_batch).select(F.col("id").alias("query_id"), "vector")
        return retrieval.dense_top_k(asked, index["dense"], config.k_dense)

    def by_terms() -> DataFrame:
        asked = written(sparse.postings(queries, "query_id", "query", mode=config.hash_mode), "asked")
        changes = index["changes"].join(asked.select("bucket").distinct(), "bucket", "left_semi")  # of few buckets, before they are summed
        weights = sparse.weights(changes, index["n"].scalar())
        weighted = asked.join(weights, "bucket").select(F.col("id").alias("query_id"), "bucket", (F.col("weight") * F.col("idf")).alias("asked"))
        if asked.select("id").distinct().count() > PRUNED_QUERIES:
            return retrieval.sparse_scan(weighted, index["terms"], config.k_sparse)
        return pruned.search(weighted, index["blocks"], index["terms"], config.k_sparse, index["dead"]).found

    def ranked_again(ranked: DataFrame) -> DataFrame:
        return retrieval.rerank(written(ranked, "ranked"), queries, index["chunks"].select("id", F.col("page_content").alias("text")), config.k_rerank, scorer)

    found = retrieval.retrieve(config.method, dense, by_terms, config.k_fused, config.rank_constant, ranked_again if config.rerank else None)
    return written(found, "found").join(index["chunks"].select("id", "chunk_id"), "id").select("query_id", F.col("chunk_id").alias("id"), "score", "rank")


def answer(queries: DataFrame, index: dict[str, DataFrame], config: Config = Config(), generate: Callable[[list[str]], list[str]] | None = None, factory: Callable[[], Embedder] = HashEmbedder, scorer: Scorer = retrieval.lexical_scorer) -> DataFrame:
    """(query_id, prompt), and answer if a generator is given: a function from prompts to texts, called per batch."""
    rows = index["chunks"].select(F.col("chunk_id").alias("id"), F.col("page_content").alias("text"), "title", "document_title", "source", "source_path")
    prompts = retrieval.build_prompt(retrieval.format_context(written(search(queries, index, config, factory, scorer=scorer), "shown"), rows), queries)
    if generate is None:
        return prompts

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(answer=generate(part["prompt"].tolist()))

    return prompts.mapInPandas(run, "query_id bigint, prompt string, answer string")
