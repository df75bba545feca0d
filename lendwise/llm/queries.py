"""Registered queries of the operators: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendwise.llm.byte_bpe import round_trip_digests
from lendwise.llm.common import table
from lendwise.llm.conversation_repair import conversation_digests, damaged, repair_conversations
from lendwise.llm.hard_negatives import mine_hard_negatives
from lendwise.llm.language_id import identify_languages
from lendwise.llm.license_scan import scan_licenses
from lendwise.llm.line_dedup import remove_boilerplate_lines
from lendwise.llm.maxscore import exact_top_k
from lendwise.llm.mixing import mix_sources
from lendwise.llm.packing import pack_documents
from lendwise.llm.page_text import extract_main_text
from lendwise.llm.simhash_golay import simhash_near_duplicates
from lendwise.llm.spherical_filters import near_duplicate_vectors
from lendwise.llm.toxicity_crf import score_toxicity


def tokenizer_path() -> str:
    """The vocabulary that the packing query names; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return remove_boilerplate_lines(docs).select("doc_id", "text", "lines_removed")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify_languages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


def op5_spherical_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op6_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.withColumn("ids_crc32", F.crc32("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op9_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return mine_hard_negatives(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    audits, messages = repair_conversations(damaged(conversations))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = audits.join(conversation_digests(messages).withColumnRenamed("conv_id", "repaired_id"),
                        F.col("conv_id").eqNullSafe(F.col("repaired_id")), "left").withColumnRenamed("conv_id", "audited_id")
    every = conversations.select("conv_id").distinct()
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("audited_id")), "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_language_id,
        op3_license_scan,
        op4_page_text,
        op5_spherical_filters,
        op6_maxscore,
        op7_packing,
        op8_source_mixing,
        op9_simhash_golay,
        op10_toxicity_crf,
        op11_hard_negatives,
        op12_conversation_repair,
        op13_byte_bpe,
    )
}
