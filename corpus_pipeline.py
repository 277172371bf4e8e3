"""From raw documents to tokens: language, quality, near-duplicates, mixture, BPE.

Every stage but the last returns the columns of documents, whatever their names, as it carries whole rows in a struct;
very long texts count whole, repeated rows and ties are decided by the operators' rules, and an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm import bpe, langid, minhash, mixing, quality
from candlewick.llm.common import row_of, table, written

#: None: SQL can express none of the learned stages; tests compare the stages with brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the nearest-centroid model accepts; null and letterless texts go."""
    kept = langid.predict(docs.select(row_of(docs), "text"), langid.fit(docs), keep=("row",))
    return kept.where(~F.col("rejected")).select("row.*")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model, fitted on the labels, predicts to be good; null texts count as empty."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.predict(docs.select(row_of(docs), "text"), model, keep=("row",)).where("predicted = 1").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id (null the last) of each group of near-duplicate texts (from 0.8 on).

    Rows are compared by a hash of id and text, as an id may be null or stand for several texts; texts without words
    (null ones too) are like no other, but rows equal in id and text stay once.
    """
    hashed = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull()).alias("hash")
    rows = docs.select(row_of(docs), "doc_id", "text", hashed)
    found = minhash.components(rows.select(F.col("hash").alias("doc_id"), "text"), minhash.AT_80)
    group = found.select(F.col("doc_id").alias("hash"), F.col("component_id").alias("group")).distinct()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    first = rows.select("hash", "doc_id").distinct().join(group, "hash").groupBy("group").agg(F.min(order).alias("first"))
    keep = first.select(F.col("first.hash").alias("hash"))
    return rows.dropDuplicates(["hash", "doc_id", "text"]).join(keep, "hash", "left_semi").select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them; wordless texts go."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang and the digests of ids and decoded text; a null text has no ids."""
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id", "source", "lang"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
