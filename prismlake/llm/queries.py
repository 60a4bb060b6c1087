"""The operators of this subpackage as queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prismlake.llm import chat, metric_join
from prismlake.runtime import table


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismlake.llm.token_records import token_records

    return token_records(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from prismlake.llm.byte_bpe import byte_bpe

    return byte_bpe(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismlake.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_telephony_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismlake.llm.telephony import text_media_digest

    return text_media_digest(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismlake.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismlake.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismlake.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"), secret_forest(spark))


def secret_forest(spark: SparkSession):
    """The forest that the query and the pipeline use."""
    from prismlake.llm.secrets import dictionary, labelled_findings, train

    return train(labelled_findings(spark), dictionary(vocabulary("word_bpe_49k.json")))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismlake.llm.chat import chat_digest, with_marked

    return chat_digest(with_marked(table(spark, sf_dir, "conversations")))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismlake.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_token_records": op2_token_records,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_telephony_media": op5_telephony_media,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLES: dict[str, str] = {"op1_embedding_near_dedup": metric_join.ORACLE, "op8_chat_formatting": chat.oracle()}
