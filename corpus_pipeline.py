"""A training corpus from documents: quality rules, near-duplicates, mixing, packing. Each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import mixing, near_dedup, packing, quality_rules
from tickloom.llm.common import AT, Scratch, file_row, saved, table

#: Learned rules, verified MinHash links, seeded draws and tokenizer ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned list keep.

    Null, empty and blank texts fail the base rule; repeated rows and ids are judged each
    by its own text; an empty table gives no rows.
    """
    return quality_rules.judged(docs, table(spark, sf_dir, "labels"), docs.columns, into=AT).where(F.col(f"{AT}.kept")).select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id, null ids last, and one of those if that id repeats.

    The decision is by row, so an exact copy goes even if its id is that of another
    text that stays. Texts without words are no copies of each other and stay; an empty
    table gives no rows.
    """
    return near_dedup.one_of_each(docs, file_row(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, 0 to 3 times.

    A null source is a source of its own; a text without words is never taken; repeated
    rows are drawn each on its own; an empty table gives no rows.
    """
    return mixing.take(docs, row=file_row(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of at most 2048 ids.

    A null or empty text is its end id alone; repeated rows are packed each on its own;
    an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("minhash near-dedup", near_dedup_stage), ("mixing to target weights", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        return saved(STAGES[-1][1](spark, docs, sf_dir), "pipeline")
