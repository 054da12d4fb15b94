"""The corpus pipeline: raw documents in, token ids out; each stage works on all that the one before it kept.

doc_id names a document: rows that repeat one count as the same document where a stage must choose among documents.
Every stage reads the columns of documents by name, whatever others there are, and gives these alone; an empty table
gives an empty one. Texts are worked on whole, however long. Reruns agree, as long as the key of the surrogates does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm import bpe, mixing, pii, quality, simhash
from graphloom.llm.queries import tokenizer_path
from graphloom.plans.staging import stage_table


def _documents(df: DataFrame, text: str) -> DataFrame:
    """The columns of documents, with ``text`` as the new text."""
    return df.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, with the lines that passed. Null, empty and blank texts are rejected;
    repeated rows fare alike, and null ids stay."""
    return _documents(quality.quality_rules(docs, carry=("lang", "source")).where("kept"), "clean_text")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id.

    Of different rows with that doc_id in the group the one of the least checksum stays, equal rows as one. Rows
    without an id can't be told apart, so all stay.
    """
    row = F.xxhash64("text", "lang", "source")
    marked = docs.where("doc_id is not null").select("doc_id", "text", "lang", "source", row.alias("row"))
    found = simhash.simhash_components(marked, ("row",)).where("doc_id = component_id").groupBy("doc_id").agg(F.min("row").alias("row"))
    kept = marked.join(found, ["doc_id", "row"]).dropDuplicates(["doc_id", "row"])
    return _documents(kept, "text").union(_documents(docs.where("doc_id is null"), "text"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced under the session's key. Null texts, repeated rows and null ids stay."""
    return _documents(pii.replace_pii(docs, pii.stored_key(spark), carry=("lang", "source")), "redacted")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole number, at most three times.

    Documents without words go, as the mix takes none. Rows that repeat a doc_id, or have none, share their copies
    evenly. A null source is one of its own.
    """
    takes = mixing.mix(docs).groupBy("doc_id").agg(F.round(F.try_divide(F.sum("taken"), F.sum("size"))).cast("int").alias("copies")).where("copies > 0")
    takes = takes.select(F.col("doc_id").alias("taken_id"), "copies")
    mixed = docs.select("doc_id", "text", "lang", "source").join(takes, F.col("doc_id").eqNullSafe(F.col("taken_id"))).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return _documents(mixed, "text")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as little-endian unsigned 32-bit integers, and the text that they decode to; copies
    that the mix made stay."""
    return bpe.encode(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_stage),
    ("simhash near-dedup", dedup_stage),
    ("pii surrogates", pii_stage),
    ("source mixing", mixing_stage),
    ("bpe encoding", bpe_stage),
]

#: The near-duplicate stage links by XXH64 shingle hashes and the last one needs the tokenizer: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage_table(docs, f"pipeline{i}")
    return docs
