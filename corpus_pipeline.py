"""A training-data pipeline over the documents table: five stages, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each result
to the shared folder and reads it back, so a lost executor costs the current stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hazardframe.llm import bpe, latent, signature_join, suffix_dedup, toxicity
from hazardframe.llm.queries import table, tokenizer_file
from hazardframe.operators.common import materialise

#: Near duplicates share four fifths of their five-word shingles.
SHINGLE_WORDS, SHINGLE_PERCENT = 5, 80
#: Repeated strings of this many bytes go; 51 words of one byte and what parts them are no shorter.
REPEATED_BYTES = 101


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.is_held_out())
    return toxicity.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return signature_join.one_of_each(docs, SHINGLE_WORDS, SHINGLE_PERCENT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.cleaned(docs, REPEATED_BYTES)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return latent.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenised(docs, tokenizer_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: The stages are a trained model, sketches and an iterative join: no SQL says them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs


PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_ORACLES: dict[str, str] = {}
