"""Command line: build an index from a folder of page-marked texts, or ask a question of one."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import retrieval
from .plans.rag import answer
from .sources.config import factory, load_config
from .sources.corpus import extract, first_documents, list_files, text_extractor
from .sources.index import HashEmbedder, build_index, open_index, upsert_index


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexweave")
    parser.add_argument("--config")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build")
    build.add_argument("folder")
    build.add_argument("index", nargs="?", help="folder of the index; by default that of the settings")
    build.add_argument("--add", action="store_true", help="add to an index that is there")
    build.add_argument("--suffix", default=".txt")
    build.add_argument("--max-documents", type=int)
    ask = commands.add_parser("ask")
    ask.add_argument("index", nargs="?", help="folder of the index; by default that of the settings")
    ask.add_argument("question")
    given = parser.parse_args(args)
    spark, config = SparkSession.builder.getOrCreate(), load_config(given.config)
    path, embedder = given.index or config.index_path, factory(config.embedding_model) or HashEmbedder
    if given.command == "build":
        files = first_documents(list_files(spark, given.folder, given.suffix), given.max_documents)
        store = upsert_index if given.add else build_index
        stored, failed = store(extract(files, text_extractor), path, embedder, config, factory(config.tokenizer))
        print(f"stored {stored}, failed {failed}")
        return 0
    question = given.question.strip()
    if not question:
        parser.error("the question is empty")
    queries = spark.createDataFrame([(0, question)], "query_id bigint, query string")
    model = factory(config.rerank_model)
    scorer = retrieval.model_scorer(model, config.rerank_batch) if model else retrieval.lexical_scorer
    print(answer(queries, open_index(spark, path), config, factory=embedder, scorer=scorer).first().prompt)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
