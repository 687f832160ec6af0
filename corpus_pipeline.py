"""From raw documents to token ids: five stages, each over all that the one before kept, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slate.llm import bpe, cdc, langid, minhash_forest, mixing
from slate.llm.common import free, save
from slate.llm.queries import MIX_TARGETS, domains
from slate.operators.rows import number_rows


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, without a letter) go; rows without doc_id and repeated rows are judged like any other."""
    return langid.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the row of the smallest doc_id stays.

    Rows without doc_id stay. Where a doc_id repeats, rows are compared each on its own, in the order of doc_id and text
    digest, so that other texts of the id stay.
    """
    known, node = docs.where("doc_id is not null"), F.col("doc_id")
    number, other = free(docs.columns, "__node", "__id")
    if known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        known, node = number_rows(known, ["doc_id", F.xxhash64("text"), "text"], number), F.col(number)
    found = minhash_forest.near_duplicates(known.select(node.alias("doc_id"), "text"), width=5, percent=80).where("kept").select(F.col("doc_id").alias(other))
    kept = known.join(found, node == F.col(other), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.union(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents stay in the first one only; a document left without a word goes.

    Null texts and rows without doc_id stay as they are; rows of one doc_id are cut each by its own text.
    """
    return cdc.strip_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its rate asks for, so that domains get their target shares of tokens.

    Documents that are most likely good or plain are never dropped: the total is set so that their rates are 1 at least.
    Rows without doc_id stay as they are; rows of one doc_id have one rate.
    """
    return mixing.apply_mix(docs, domains(spark, sf_dir), MIX_TARGETS, whole=("good", "plain"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (and of each of its copies), with the decoded text's digest; a null text has none."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", tokenize),
]
#: SQL can't express learned stages; tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
