"""Corpus sources: files under a folder, and extraction of page-marked text from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Extractor = Callable[[str, bytes], str | None]


def list_files(spark: SparkSession, root: str, suffix: str = ".pdf") -> DataFrame:
    """path, source (relative to the root) and length of the files with a suffix, in any case, at any depth. A missing
    root is an error. Their content is read only where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    source = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), r"^.*?\Q" + base + r"\E/", "")
    return files.where(F.lower("path").endswith(suffix.lower())).select("path", source.alias("source"), "length", "content")


def first_documents(files: DataFrame, max_documents: int | None) -> DataFrame:
    """The first files by name, chosen by their names alone: only theirs is the content that is read."""
    if max_documents is None:
        return files
    return files.join(files.select("source").orderBy("source").limit(max_documents), "source", "left_semi")


def extract(files: DataFrame, extractor: Extractor) -> DataFrame:
    """source and markdown of each file, through a pluggable extractor (a PDF parser is not part of this library). A file that
    yields nothing gives no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(s, extractor(s, bytes(c))) for s, c in zip(batch["source"], batch["content"], strict=True)]
            yield pd.DataFrame([o for o in out if o[1]], columns=["source", "markdown"])

    return files.select("source", "content").mapInPandas(run, "source string, markdown string")


def text_extractor(_: str, content: bytes) -> str:
    """For files that already hold page-marked text."""
    return content.decode("utf-8", "replace")
