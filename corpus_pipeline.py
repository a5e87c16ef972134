"""A training corpus from `documents`: quality rules, line dedup, near-dedup, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quireframe.llm import bpe, common, line_dedup, minhash, mixing, quality
from quireframe.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of at least 50 words, not too many of them repeated, that compress as good ones of their length do (by the labels of
    sf_dir, where it has any). Null and empty texts go; repeated rows are judged apart; all columns stay."""
    return quality.keep_good(docs, quality.fitted(spark, sf_dir))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without lines that a fifth of their source's documents hold, five at least. Null texts and blank lines stay; a
    null source is one of its own; a text may end up empty."""
    return line_dedup.drop_boilerplate(docs, host_col="source")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents that share three quarters of their shingles of five words, that with the smallest doc_id. Texts
    without words, and rows with a null doc_id, stay."""
    return minhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, three times at most and maybe never; a source without words takes nothing."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's ids go into a table of their own in the shared folder, which stays there as the corpus; what is returned is read from it:
    number of ids, digests of the ids and of the text that they decode to. A null text has no ids."""
    path = common.fresh_path(spark, "corpus-tokens")
    tokens = bpe.encode_ids(docs, tokenizer(), packed=True)
    tokens.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)  # small row groups, as a writer holds one
    return bpe.decoded(spark.read.schema(tokens.schema).parquet(path), tokenizer())


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup), ("mixing", mix), ("bpe", encode)]

#: Compression ratios and the cube method have no SQL form; a test holds the whole run against plain Python stages, row by row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
