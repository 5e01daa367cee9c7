"""The training-corpus pipeline: quality, near-duplicates, decontamination, secrets, token ids.

Each stage calls one operator of ``sparklex.llm`` on all that the stage before it kept:

1. ``quality``: documents that the rule ensemble scores below 0.5 go;
2. ``near_duplicates``: SimHash links over five-word shingles, completed to all pairs of a Jaccard similarity of 0.8 at
   least; of each component the document with the smallest id stays;
3. ``decontamination``: documents that hold a benchmark item go;
4. ``secrets``: every secret is replaced by its kind in brackets and ``n_chars`` is counted anew;
5. ``tokens``: per document the packed token ids, their number and the digests of the ids and of the decoded bytes.

Nulls in any column, empty and very long texts, repeated rows, empty tables and further columns are handled as each
operator's docstring says; a document with a null id passes the second stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparklex.llm import byte_bpe, latent_leaks, rule_ensemble, secrets, simhash
from sparklex.plans.scratch import Scratch, tidy


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rule_ensemble.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = latent_leaks.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keys=tuple(docs.columns))
    return rows.where(F.size("leaks") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(docs, byte_bpe.public_ranks(spark), with_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", redaction), ("tokens", tokens)]
#: Trees, likelihoods and merges are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; what lies between two stages is a written table, of which the last one
    stays for the result to read."""
    scratch, done = Scratch(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with tidy(spark):
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(done)
        done = docs
    return STAGES[-1][1](spark, docs, sf_dir)
