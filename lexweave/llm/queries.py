"""The registered queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import assembly, bpe, chat, decontaminate, html, infill, langid, leaks, licences, lm, oracle, quality, simhash, urls
from .common import spread, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spread(table(spark, sf_dir, "documents")))


def op2_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread(table(spark, sf_dir, "documents")))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(spread(table(spark, sf_dir, "documents")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")).drop("spans")


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(spread(table(spark, sf_dir, "pages")), table(spark, sf_dir, "labels"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"), digest=True)


def op7_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spread(table(spark, sf_dir, "pages")))


def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(spread(table(spark, sf_dir, "documents")))


def op9_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(spread(table(spark, sf_dir, "documents")))


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(table(spark, sf_dir, "conversations"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.digests(spread(table(spark, sf_dir, "documents")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(spread(table(spark, sf_dir, "documents")))


def op13_sale_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.assemble(table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_language_id, op2_simhash_golay, op3_line_quality, op4_decontaminate, op5_url_rules,
        op6_bpe, op7_html_consensus, op8_stupid_backoff, op9_licence_rules, op10_tool_calls, op11_secret_scan, op12_fill_in_middle, op13_sale_assembly,
    )
}
ORACLE: dict[str, str] = {
    "op3_line_quality": oracle.QUALITY,
    "op4_decontaminate": oracle.CONTAMINATION,
    "op5_url_rules": oracle.URLS,
    "op8_stupid_backoff": lm.SQL,
    "op9_licence_rules": oracle.LICENCES,
    "op12_fill_in_middle": oracle.INFILL,
}
