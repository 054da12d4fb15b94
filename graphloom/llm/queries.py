"""The operators as queries over whole tables, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm import bpe, language, lm_score, mixing, pii, piecewise, quality, secrets, simhash, suffix_dedup
from graphloom.llm.common import documents
from graphloom.llm.sql import ORACLE_SQL as ORACLE_SQL


def tokenizer_path() -> str:
    """The public vocabulary file; its place is the library's to know."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir)).drop("kept")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir), with_text=False)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe.encode(documents(spark, sf_dir), tokenizer_path())
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(documents(spark, sf_dir))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language.identify(docs, docs.where(~language.is_held_out()))
    return found.select("doc_id", language.is_held_out().alias("held_out"), "lang_pred", "score")


def op8_piecewise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.piecewise(documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(documents(spark, sf_dir), pii.stored_key(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_dedup, op2_quality_rules, op3_bpe, op4_lm_score, op5_secrets, op6_mixing, op7_language, op8_piecewise, op9_simhash, op10_pii)
}
