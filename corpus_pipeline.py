"""The training-corpus pipeline: quality rules, language ID, near-dedup, decontamination, BPE.

STAGES are (name, function) with function(spark, docs, sf_dir) -> DataFrame; each works on all its predecessor kept.

Defined cases of every stage: an empty table gives an empty one; further columns of any name are kept by all stages but the last;
very long texts are read whole.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexweave.llm import bpe, decontaminate, langid, quality, simhash
from lexweave.llm.common import completed, release, spread, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; failing lines go from the kept ones. Null and empty texts go; repeated rows and null doc_ids are judged
    each; a text that loses exactly half of its words stays."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go: null texts, texts without letters and texts unlike every labelled language.
    Repeated rows and null doc_ids are judged each; where nothing is labelled only texts without letters go."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the smallest doc_id's, then the smallest text hash's, and one of repeated
    rows. Null texts are a group; rows with a null doc_id come after all others, by their texts."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go. Rows are judged each by their own text, also repeated ones and those with a null doc_id; null texts
    stay; exactly one hit word in twenty is contaminated; an empty benchmark rejects nothing."""
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of each document: a row per row; a null text has no token."""
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's output is written; what a stage wrote on its way, and its input, are deleted then."""
    docs, source = spread(table(spark, sf_dir, "documents")), True
    for name, stage in STAGES[:-1]:
        done = completed(partial(stage, spark, docs, sf_dir), name)
        if not source:
            release(docs)
        docs, source = done, False
    return STAGES[-1][1](spark, docs, sf_dir)


#: The near-duplicate components and the language classifier are not expressible in SQL.
ORACLE_SQL = None
