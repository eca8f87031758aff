"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, source mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm import decontaminate, mixing, near_dedup, queries, token_output, toxicity
from clauseloom.llm.common import staged, table

#: Documents with a toxicity score of this or more go.
TOXIC = 0.5
#: The mix may leave documents out: the least rate.
LEAST_RATE = 0.0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score is under ``TOXIC``; the machine learns from the labelled documents of docs."""
    machine = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, machine, "__toxicity").where(F.col("__toxicity") < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.deduplicated(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of a benchmark item occurs."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say, so that the domains' tokens meet ``queries.TARGETS``; those of domains
    that have too many tokens, or want none, go by their rates. A table without labelled rows stays as it is."""
    return mixing.mixed(docs, mixing.domain_rows(docs, table(spark, sf_dir, "labels")), queries.TARGETS, LEAST_RATE)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, read back from the token files."""
    return token_output.write_and_read(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
    ("token_output", write_token_files),
]

#: The toxicity model, the mix and the token files are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}", "snappy")
    return docs
