"""A training corpus from `documents`: five stages, each written as Parquet and read again.

toxicity: documents that the model rejects go.
near_dedup: of each group of near duplicates (five-word shingles, similarity 0.8) the row of least id stays.
decontamination: documents that hold a benchmark item go.
secrets: what the scan reports is replaced by a mark; no document goes.
packing: what is left becomes token sequences of 2048.

Rows are named by their id and text, so a row without doc_id is judged like any
other, and of rows that share an id each by its own text; of rows equal in both
near_dedup keeps one.  Null, empty and blank texts pass all stages that drop
documents; equally good rows of a group are told apart by id, then by a hash of the
text.  Long texts are looked at whole.  Empty tables pass through, and other columns
may have any name.  All but the last stage return the columns that they were given;
packing returns pieces: doc_id, start, length, doc_tokens, sequence_id, offset,
padded_to, begins, ends, ids, ids_crc32.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import load, matching, written
from llm.op3_decontaminate import contaminated
from llm.op5_toxicity import not_toxic
from llm.op6_packing import packed, vocabulary
from llm.op7_secrets import redacted
from llm.op8_minhash import one_of_each


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return not_toxic(docs, load(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return matching(docs, contaminated(docs, load(spark, sf_dir, "benchmark")), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs, *vocabulary()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: Edit automata, exact set links after signatures, and byte-pair encoding are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
