"""A training-data pipeline over `documents`: five stages, each an operator of codefacts.llm.

Every stage works on all that the one before kept, is written as Parquet and read again.  Rows
without doc_id pass the stages that decide by doc_id as they are.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.llm import bpe, fmindex, minhash, mixing, toxicity
from codefacts.llm.common import save, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_REST = ("lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject.  Null and empty texts stay, unless the
    prior alone rejects them; an empty table gives an empty one."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=_REST).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five-word shingles, similarity 0.8): that
    of the smallest doc_id.  Where a doc_id is repeated, one of its rows stays."""
    docs = docs.select(*COLUMNS)
    kept = save(minhash.near_duplicates(docs, percent=80, shingle=5).where("kept and doc_id is not null").groupBy("doc_id").count(), "kept")
    stay = docs.join(kept.select("doc_id"), "doc_id", "left_semi").select(*COLUMNS)
    if not kept.where("count > 1").isEmpty():
        stay = stay.dropDuplicates(["doc_id"])
    return stay.unionByName(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 13-word windows that a document of smaller doc_id has too;
    those of which nothing is left go."""
    cut = fmindex.remove_repeats(docs, window=13, with_text=True, keep=("lang", "source"))
    left = cut.where("n_removed = 0 or n_removed < n_words")
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document as often as its source's budget takes it whole, and the leading words of
    the one that the budget cuts.

    Each row is taken by its own size, so rows without doc_id and rows that repeat one count like
    others.  Null texts and texts without words are never taken; an empty table gives an empty mix.
    """
    plan = mixing.mix(docs.select(*COLUMNS), keep=("text", "lang", "n_chars")).where("taken > 0")
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    mixed = plan.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).withColumn("left", F.least("size", F.col("taken") - (F.col("copy") - 1) * F.col("size")))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(F.col("left") == F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(words, 1, F.col("left").cast("int")), " "))
    mixed = mixed.withColumn("text", text)
    return mixed.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text of the mix, and what they decode to: a row for each row, null texts
    like empty ones; an empty table gives an empty result."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, remembered=200_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("mix", mix_sources),
    ("bpe", encode),
]

#: No SQL engine expresses these stages; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, name)
    return docs
