"""The corpus pipeline: quality filter, line dedup, near-dedup, benchmark decontamination, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a table; all but the last
return the columns of documents. Each result is written and read again as the
next stage's documents. Null ids, null and empty texts, repeated rows and further
columns are treated as the operators say; empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar, copy_context
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsrisk.llm import byte_bpe, decontamination, line_dedup, near_dedup, quality
from opsrisk.llm.common import noted, released, stored, table
from opsrisk.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: No SQL: the first stage is a trained classifier.
ORACLE_SQL = None


#: What the stage before wrote for itself, in this thread. Its result is a table of its own by the time the next stage begins.
_left: ContextVar[list[str] | None] = ContextVar("left", default=None)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(run: Stage) -> Stage:
    """A stage that first removes what the one before it left, and notes what it leaves."""

    @wraps(run)
    def cleaned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        released(spark, _left.get() or [])
        left: list[str] = []
        _left.set(left)
        with noted(left):
            return run(spark, docs, sf_dir)

    return cleaned


@stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant finds good; learned from the labels of those that are not held out."""
    return quality.kept(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


@stage
def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that five documents share, one holder excepted; ``n_chars`` follows."""
    return line_dedup.drop_shared_lines(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


@stage
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each class of documents that are alike in five-word shingles."""
    return near_dedup.kept(docs, size=5, percent=80).select(*COLUMNS)


@stage
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


@stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, ``n_tokens``, the ids, and whether they decode to the text."""
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    # written between: encoding and decoding in one task would hold two Python workers for each core
    ids = stored(byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, pattern), "pipeline-ids")
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return byte_bpe.decode(ids, ranks, pattern).select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("line dedup", without_shared_lines),
    ("MinHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE encoding and decoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder before the next begins.

    Runs don't see each other's folders, also not within one session.
    """
    return copy_context().run(_run, spark, sf_dir)


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    _left.set(None)
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        path, found = scratch_path(spark, name.replace(" ", "-")), function(spark, docs, sf_dir)
        found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
