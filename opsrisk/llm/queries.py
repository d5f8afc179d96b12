"""The registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from opsrisk.llm import (
    byte_bpe,
    decontamination,
    line_dedup,
    near_dedup,
    negatives,
    neighbours,
    packing,
    passages,
    quality,
    sharding,
    spelling,
    token_files,
    toxicity,
)
from opsrisk.llm.common import table
from opsrisk.session import scratch_path

#: Bytes of text in a shard.
SHARD_BYTES = 8 << 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.selectExpr("doc_id", "held_out", "score", "predicted", "size(sentences) AS n_sentences")


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


@query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"), size=2, percent=80)


@query
def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(table(spark, sf_dir, "documents"))


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.write_shards(table(spark, sf_dir, "documents"), scratch_path(spark, "shards"), SHARD_BYTES)
    return shards.selectExpr(
        "doc_id",
        "CAST(coalesce(octet_length(CAST(text AS binary)), 0) AS bigint) AS n_bytes",
        "shard",
        "shard_bytes",
        "shard_docs",
    )


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = token_files.write_token_files(
        table(spark, sf_dir, "documents"),
        scratch_path(spark, "token-files"),
        public_tokenizers.path("byte_bpe_50k.json"),
        end_id=2,
        added=True,
    )
    return token_files.read_token_files(index)


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return packing.digests(packing.packed(table(spark, sf_dir, "documents"), tokenizer, end_id=0, size=2048))


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.words(table(spark, sf_dir, "documents")))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(table(spark, sf_dir, "embeddings"))
