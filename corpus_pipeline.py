"""The corpus pipeline: quality rules, toxicity, near-duplicates, benchmark decontamination and packing, in this order.

Each stage reads what its predecessor kept, as Parquet. All but the last return the columns of ``documents``.

Defined cases: null and empty texts fail the quality rules. Rows that share an id are told apart by their text; of equal ones, and of near copies, one
stays, that of the smallest id, and rows without an id take no part in that choice. A row repeats in a stage's result if it repeats in its
input and the stage doesn't compare rows. Empty tables give empty results. Extra columns pass through to the packing stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigloom.llm import common, decontaminate, packing, quality, simhash, toxicity
from sigloom.llm.queries import PACK_END_ID, table, tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The labels are those of all documents, so the classifier is fitted on the texts that reach this stage."""
    return toxicity.drop_toxic(docs, toxicity.train_on(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), end_id=PACK_END_ID)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Expectation-maximisation, the classifier, SimHash and packing are beyond SQL; tests/llm holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. A stage's result is written, then what it wrote on the way and its predecessor's result are deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with common.scratch_scope(spark):
            docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}", lasting=True)
        if before is not None:
            common.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
