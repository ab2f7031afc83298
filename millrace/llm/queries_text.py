"""Queries of the text problems of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.ticks import table
from millrace.llm.encoding import find_garbled
from millrace.llm.leaks import find_leaks
from millrace.llm.mixture import mix_sources

#: Most that a source's share of the mixture may be off: a record at the end of a shard is taken whole or not at all.
SHARE_ERROR = 0.01


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that reproduce at least 25 words in a row of a test item."""
    return p6_passages(spark, sf_dir).select("item_id", "doc_id")


def p6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the place, length and errors of the longest passage."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the mixture and how often each is used."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p7_shares_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every source, whether what a mixture promises holds: its share within ``SHARE_ERROR``, its repeats, and shares that add up to 1."""
    mixed, report = mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    most = mixed.groupBy("source").agg(F.max("copies").alias("most"))
    targets = table(spark, sf_dir, "mix_targets").select("source", "max_repeats")
    total = F.sum("actual_share").over(Window.partitionBy())  # over one row per source of the targets
    return (
        report.withColumn("total", total)
        .join(targets, "source")
        .join(most, "source", "left")
        .select(
            "source",
            (F.abs(F.col("actual_share") - F.col("target_share")) <= SHARE_ERROR).alias("share_held"),
            (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("repeats_held"),
            (F.abs(F.col("total") - 1) < 1e-9).alias("adds_up"),
        )
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a character that came out of the wrong encoding."""
    return p8_restored(spark, sf_dir).select("doc_id")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the number of wrong characters and the text put right."""
    return find_garbled(table(spark, sf_dir, "documents"))


QUERIES = {"p7_mixture": p7_mixture, "p7_shares": p7_shares, "p7_shares_held": p7_shares_held, "p8_found": p8_found, "p8_restored": p8_restored, "p6_found": p6_found, "p6_passages": p6_passages}
SQL = {"p7_shares_held": "select source, true as share_held, true as repeats_held, true as adds_up from mix_targets"}
