"""Training-data pipeline over ``documents``: each stage calls one operator and is written before the next reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendwise.llm.common import fresh, table, written
from lendwise.llm.language_id import keep_identified
from lendwise.llm.line_dedup import remove_boilerplate_lines
from lendwise.llm.mixing import repeat_to_mix
from lendwise.llm.packing import pack_documents
from lendwise.llm.queries import tokenizer_path
from lendwise.llm.simhash_golay import keep_one_per_group


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with that language; texts without a letter go."""
    return keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate stays only where it stands first; documents that held nothing else go."""
    had = fresh(docs, "had")
    marked = docs.withColumn(had, F.trim("text") != "")
    cleaned = remove_boilerplate_lines(marked)
    emptied = (F.col("lines_removed") > 0) & F.col(had) & (F.btrim("text", F.lit(" \t\r\n")) == "")
    return cleaned.where(~F.coalesce(emptied, F.lit(False))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one of smallest doc_id."""
    return keep_one_per_group(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return repeat_to_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in training sequences."""
    return pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("source_mixing", mixture),
    ("packing", packed),
]

#: Language models, token ids and random group places are not expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
