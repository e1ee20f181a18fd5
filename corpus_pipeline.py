"""The corpus pipeline: stages over `documents`, each written and reread.

A stage works on all rows its predecessor kept.  The quality classifier drops
the documents it rejects, SimHash keeps one document of each group, the
decontamination drops documents in which a benchmark item occurs, the PII stage
generalises the spans it finds, and the last returns each document's token
digests.  Null texts, repeated rows, empty tables and further columns are
handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shoplens.llm import bpe, decontam, pii, quality_cotrain, simhash
from shoplens.llm.common import table, written
from shoplens.llm.queries import bpe_digests, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_cotrain.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs, shingle=3, max_bits=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_digests(bpe.encode_decode(docs, tokenizer_path()))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("PII", sanitise),
    ("BPE encoding and decoding", tokenise),
]

#: The stages learn a model, form components and run a tokenizer: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
