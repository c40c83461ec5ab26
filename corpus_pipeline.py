"""A training-corpus pipeline over the ``documents`` table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last keep the columns
of ``documents``.  The stages: quality rules drop documents; of near-duplicates one stays;
documents that hold benchmark items go; sources are mixed to target weights, a row for
each drawn copy; token ids are written as equal-length sequences, and the rows returned,
one a drawn copy, are read back from those files.

Defined cases: null texts are empty and fail the quality rules; null ids, null sources, repeated
rows and columns of any name pass through as each stage's operator says; an empty table gives an
empty result.  Texts of any length are worked on as a whole.

SQL cannot express the sketches, the latent space, the draws or the tokenizer, so
``ORACLE_SQL`` is None; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slotframe.llm import decontaminate, minhash, mixing, quality, tokens
from slotframe.llm.common import materialize, new_dir, release, release_since, scratch_mark
from slotframe.llm.registry import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.read_documents(spark, tokens.write_tokens(docs, tokenizer_path(), new_dir(spark, "tokens")))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are a table in the shared folder, and what it was made from goes.

    The token files of the last stage stay.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        mark = scratch_mark()
        after = materialize(stage(spark, docs, sf_dir), name)
        if name != STAGES[-1][0]:
            release_since(spark, mark, after)
        release(docs)
        docs = after
    return docs
