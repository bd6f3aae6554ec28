"""The queries of this subpackage: each operator, with production settings, over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm import (
    chat,
    decontam,
    jaccard,
    licences,
    lines,
    merkle,
    mixing,
    quality,
    resample,
    secrets,
    substrings,
    tokens,
    warc,
)
from flowsieve.llm.common import table
from flowsieve.session import small_table


def op1_template_decontamination(spark: SparkSession, d: str) -> DataFrame:
    found = decontam.leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))
    return found.select(
        found.doc.alias("doc_id"), found.item.alias("item_id"), "n_windows", "coverage", "exact"
    )


def op2_ngram_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    joined = jaccard.jaccard_join(table(spark, d, "documents").select("doc_id", "text"))
    return joined.select(joined.doc.alias("doc_id"), "class_id", "n_links")


def op3_licence_sentences(spark: SparkSession, d: str) -> DataFrame:
    return licences.find_licences(table(spark, d, "documents"))


def op4_chat_format(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    probe = small_table(spark, chat.PROBE, "conv_id bigint, turn bigint, role string, text string")
    back = chat.read_back(chat.format_conversations(turns.unionByName(probe)))
    return back.select(back.conv.cast("bigint").alias("conv_id"), *back.columns[1:])


def op5_secret_ownership(spark: SparkSession, d: str) -> DataFrame:
    """A source is an owner; its texts of one language are a repository."""
    return secrets.find_secrets(table(spark, d, "documents"), owner="source", repo=("lang",))


def op6_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    cleaned = lines.dedup_lines(table(spark, d, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "text")


def op7_token_counts(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    trusted = table(spark, d, "labels").where("quality = 1 and toxic = 0")
    judged = quality.quality_rules(table(spark, d, "documents").select("doc_id", "text"), trusted)
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "log_ratio",
    )


def op9_source_mix(spark: SparkSession, d: str) -> DataFrame:
    mixed = mixing.mix(table(spark, d, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_warc_transactions(spark: SparkSession, d: str) -> DataFrame:
    return warc.round_trip(table(spark, d, "pages"))


def op11_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    return merkle.manifest(table(spark, d, "documents"))


def op12_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    kept = substrings.dedup_substrings(table(spark, d, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit("")).cast("binary")
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(text, 256).alias("kept_sha256"))


def op13_importance_resampling(spark: SparkSession, d: str) -> DataFrame:
    return resample.resample(table(spark, d, "documents"), table(spark, d, "benchmark"))


QUERIES = {
    "op1_template_decontamination": op1_template_decontamination,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_licence_sentences": op3_licence_sentences,
    "op4_chat_format": op4_chat_format,
    "op5_secret_ownership": op5_secret_ownership,
    "op6_line_dedup": op6_line_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_quality_rules": op8_quality_rules,
    "op9_source_mix": op9_source_mix,
    "op10_warc_transactions": op10_warc_transactions,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_importance_resampling": op13_importance_resampling,
}

#: SQL twins, where SQL can express the operator.
ORACLES: dict[str, str] = {
    "op3_licence_sentences": licences.sql(),
    "op4_chat_format": chat.SQL,
    "op6_line_dedup": lines.SQL,
    "op10_warc_transactions": warc.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op12_substring_dedup": substrings.SQL,
    "op13_importance_resampling": resample.SQL,
}
