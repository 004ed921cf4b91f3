"""From raw documents to training pieces: quality rules, line dedup, near duplicates, decontamination, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontamination, line_dedup, near_dup, piece_sampling, quality_rules
from ledgerlens.llm.common import drop_cut, scratch, table, write_apart


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the quality rules rejects go; null and empty texts are among them."""
    return quality_rules.apply_policy(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share leave the texts; every document stays, n_chars follows the new text."""
    out = line_dedup.line_dedup(docs, counts=False)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the least doc_id."""
    return near_dup.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document that is left: doc_id, n_pieces, piece_ids, lossless."""
    return piece_sampling.encoded_rows(docs.select("doc_id", "text"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", benchmark), ("sentencepiece", pieces)]

#: SQL expresses neither the similarity classes nor the sampling; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents. Each stage is written, then what it and the stage before left in the shared folder goes."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch():
            out = stage(spark, docs, sf_dir)
            kept = write_apart(out)
        if last is not None:
            drop_cut(last)
        docs = last = kept
    return STAGES[-1][1](spark, docs, sf_dir)
