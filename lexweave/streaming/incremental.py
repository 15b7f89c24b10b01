"""Incremental indexing: a stream of page-marked texts, parsed per micro-batch and added to an index as a segment.

Parsing is stateless per document, so a micro-batch needs no state. A batch is committed to the index under its stream's id and number:
one that runs again after a failure is found there and not added twice, and another stream, or a new checkpoint, replaces documents as
any writer does, but no segment."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.config import Config
from ..sources.index import Embedder, HashEmbedder, open_index, upsert_index


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark keeps in a stream's checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def follow(spark: SparkSession, folder: str, path: str, checkpoint: str, available_now: bool = True, factory: Callable[[], Embedder] = HashEmbedder, config: Config = Config()) -> StreamingQuery:
    """Index new text files of a folder into ``path``; run again, it takes up where it stopped."""
    lines = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    raw = lines.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("markdown"))

    def store(batch: DataFrame, batch_id: int) -> None:
        upsert_index(batch, path, factory, config, batch=(stream_id(spark, checkpoint), batch_id))

    query = raw.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if available_now else query).start()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The live chunks."""
    return open_index(spark, path)["chunks"]
