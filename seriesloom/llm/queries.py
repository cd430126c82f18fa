"""The queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, jaccard_join, language_id, line_dedup, media, mixing, sql, substring_dedup, suffix_dedup, token_output


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), window=50))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), window=50))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.media_table(table(spark, sf_dir, "documents")))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql("SELECT -1L conv_id, 0L turn, 'user' role, '</s>[INST] ok [/INST]' text UNION ALL SELECT -1L, 1L, 'assistant', '</s>[INST] ok [/INST]'")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    return chat.digest(chat.format_chat(chat.events_of_rows(rows)))


def op5_token_output(spark: SparkSession, sf_dir: str, tokenizer: str = "") -> DataFrame:
    """tokenizer: path of a tokenizer file; the public byte-level BPE of 50k pieces if not given."""
    return token_output.token_table(table(spark, sf_dir, "documents"), tokenizer or default_tokenizer())


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op7_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.tree(), mixing.DOMAIN_WEIGHTS, share=0.8, epochs=3, seed=7)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.line_dedup(table(spark, sf_dir, "documents"), edits=2, shortest=20))


def op9_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_dedup, op2_substring_dedup, op3_media_columns, op4_chat_format, op5_token_output, op6_jaccard_join, op7_weighted_mix, op8_line_dedup, op9_fm_decontaminate, op10_language_id)
}
SQL: dict[str, str] = {"op1_suffix_dedup": sql.OP2, "op2_substring_dedup": sql.OP2, "op4_chat_format": sql.OP4, "op6_jaccard_join": sql.OP6, "op7_weighted_mix": sql.op7(mixing.DOMAIN_WEIGHTS, share=0.8, epochs=3, seed=7), "op8_line_dedup": sql.OP8, "op9_fm_decontaminate": sql.OP9}
