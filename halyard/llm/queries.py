"""Queries of the problems on text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.query import Query
from ..session import load
from . import bpe, defects, mixing, overlap, pii, splitting


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each occurrence of personal data in the records."""
    return pii.find_personal(load(spark, d, "fewshot_bank"), "rec_id", ("emr", "handoff")).select("rec_id", "fld", "kind", "seq")


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The records with placeholders."""
    return pii.redacted(load(spark, d, "fewshot_bank"), "rec_id", ("emr", "handoff"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records across splits that are one case or near-same."""
    pairs = overlap.cross_split(load(spark, d, "fewshot_bank"))
    return pairs.select(F.least("train_id", "eval_id").alias("rec_id_a"), F.greatest("train_id", "eval_id").alias("rec_id_b"))


def p2_overlap_counts(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps per evaluation split and source."""
    bank = load(spark, d, "fewshot_bank")
    pairs = overlap.cross_split(bank)
    labels = bank.select(F.col("rec_id").alias("eval_id"), "split", "source")
    return pairs.join(labels, "eval_id").groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("pairs"), F.countDistinct("eval_id").alias("eval_records"), F.count_if("same_sid").alias("same_sid"), F.count_if("near_emr").alias("near_emr")
    )


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    """Each record with the class of its text and how many records across the splits it is linked to."""
    return overlap.link_counts(load(spark, d, "fewshot_bank"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Each defective record with its defect."""
    return defects.find_defects(load(spark, d, "inference_records")).select("gen_id", "defect")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Every text in ids of byte_bpe_50k."""
    return bpe.encode(load(spark, d, "documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix, each with the number of times it is used."""
    return mixing.mix(load(spark, d, "documents"), load(spark, d, "mix_target"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of tokens reached beside the targets."""
    return mixing.mix(load(spark, d, "documents"), load(spark, d, "mix_target"))[1]


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all documents."""
    return splitting.split_oversized(load(spark, d, "documents"), load(spark, d, "piece_limit"))


def registry() -> dict[str, Query]:
    return {
        "p1_found": Query(p1_found),
        "p1_redacted": Query(p1_redacted),
        "p2_found": Query(p2_found),
        "p2_overlap_counts": Query(p2_overlap_counts),
        "p2_links": Query(p2_links),
        "p3_found": Query(p3_found),
        "p6_ids": Query(p6_ids),
        "p7_mix": Query(p7_mix),
        "p7_shares": Query(p7_shares),
        "p8_pieces": Query(p8_pieces),
    }
