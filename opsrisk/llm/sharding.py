"""Shards of bounded size by extendible hashing, in DataFrame operations alone."""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsrisk.llm.common import stored, without

#: Bits of the hash: the first 48 of an MD5.
DEPTH = 48
#: Bits that a further pass over too large buckets decides.
STEP = 8

OWN = ["shard", "shard_bytes", "shard_docs"]


def _hashed(key: Column) -> Column:
    """The first 48 bits of the key's MD5, as a number."""
    text = F.coalesce(key.cast("string"), F.lit("")).cast("binary")
    return F.conv(F.substring(F.md5(text), 1, DEPTH // 4), 16, 10).cast("bigint")


def _bytes() -> Column:
    return F.coalesce(F.octet_length(F.col("text").cast("binary")), F.lit(0)).cast("bigint")


def _buckets(rows: DataFrame, done: int, last: int, limit: int) -> DataFrame:
    """The buckets of ``rows`` (``_hash``, ``_bytes``) at ``done`` to ``last`` bits: ``depth``, ``prefix``, ``bytes``, ``n_docs``.

    Sizes are summed per prefix of ``last`` bits and from there for each shorter
    one. A bucket stays if it fits and the one that it was split from doesn't;
    those of ``last`` bits stay whatever their size.
    """
    fine = rows.groupBy(F.shiftright("_hash", DEPTH - last).alias("_fine")).agg(
        F.sum("_bytes").alias("_sum"), F.count(F.lit(1)).alias("_n")
    )
    levels = F.explode(F.array(*(
        F.struct(F.lit(d).alias("depth"), F.shiftright("_fine", last - d).alias("prefix")) for d in range(done, last + 1)
    )))
    every = (
        fine.select("_sum", "_n", levels.alias("_at"))
        .groupBy(F.col("_at.depth").alias("depth"), F.col("_at.prefix").alias("prefix"))
        .agg(F.sum("_sum").alias("bytes"), F.sum("_n").alias("n_docs"))
    )
    above = every.select(
        (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_parent"), F.col("bytes").alias("_above")
    )
    reached = (F.col("depth") == done) | (F.col("_above") > limit)
    return (
        every.withColumn("_parent", F.shiftright("prefix", 1))
        .join(above, ["depth", "_parent"], "left")
        .where(reached & ((F.col("bytes") <= limit) | (F.col("depth") == last)))
        .select("depth", "prefix", "bytes", "n_docs")
    )


def _placed(docs: DataFrame, sizes: DataFrame, limit: int, name: Column) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``_name`` and size of their buckets, in two parts: those in place, and those no bit tells apart.

    Each pass builds a directory of 2^depth entries below the buckets that are
    left, several entries naming one bucket, and rows meet it by one equal join.
    The first pass has a few bits more than shards are needed, so that it
    normally is the last; later ones concern buckets that came out too large.
    """
    total = sizes.agg(F.sum("_bytes").alias("n")).first().n or 0
    done, last = 0, min(DEPTH, max(4, ceil(log2(max(1, total / limit))) + 4))
    parts, rows = [], docs
    while True:
        found = stored(_buckets(sizes, done, last, limit), "shard-buckets")
        deepest = found.agg(F.max("depth").alias("n")).first().n or done
        large = F.col("_bytes_of") > limit
        directory = found.select(
            "depth",
            F.explode(
                F.expr(f"sequence(shiftleft(prefix, {deepest} - depth), shiftleft(prefix + 1, {deepest} - depth) - 1)")
            ).alias("_entry"),
            F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), "0")).alias("_bits"),
            F.col("bytes").alias("_bytes_of"),
            F.col("n_docs").alias("_docs_of"),
        )
        met = rows.withColumn("_entry", F.shiftright("_hash", DEPTH - deepest)).join(directory, "_entry").drop("_entry")
        met = met.withColumn("_name", F.concat(name, F.col("_bits")))
        too_large = found.where((F.col("depth") == last) & (F.col("bytes") > limit)).select(F.col("prefix").alias("_large"))
        if last == DEPTH or too_large.limit(1).count() == 0:
            stuck = (F.col("depth") == DEPTH) & large & (F.col("_docs_of") > 1)
            parts.append(met.where(~stuck))
            return reduce(DataFrame.unionByName, parts), met.where(stuck)
        parts.append(met.where((F.col("depth") < last) | ~large))
        at_last = lambda df: df.join(too_large, F.shiftright("_hash", DEPTH - last) == F.col("_large"), "left_semi")  # noqa: E731, B023
        rows, sizes = at_last(rows), at_last(sizes)
        done, last = last, min(DEPTH, last + STEP)


def assigned(docs: DataFrame, limit: int) -> DataFrame:
    """``docs`` with ``shard``, ``shard_bytes`` and ``shard_docs``, which replace columns of these names.

    All rows start in one bucket. A bucket of more than ``limit`` bytes of text
    splits on the next bit of the hash of ``doc_id``, buckets that fit stay as
    they are. ``shard`` is "r" and the bits of the bucket.

    Rows that all 48 bits leave together, as many rows of one doc_id or without
    one, are numbered and go on splitting by the hash of their numbers, with "."
    before the further bits. A single text over the limit has a shard of its own,
    which exceeds it: texts are never cut. Null texts have no bytes. An empty
    table gives an empty one.
    """
    own = without(docs, OWN)
    hashed = own.select("*", _hashed(F.col("doc_id")).alias("_hash"))
    columns = [F.col(f"`{c}`") for c in own.columns]
    shard = [F.col("_name").alias("shard"), F.col("_bytes_of").alias("shard_bytes"), F.col("_docs_of").alias("shard_docs")]
    sizes = stored(hashed.select("_hash", _bytes().alias("_bytes")), "shard-sizes")
    placed, stuck = _placed(hashed, sizes, limit, F.lit("r"))
    result = placed.select(*columns, *shard)
    if sizes.groupBy("_hash").agg(F.sum("_bytes").alias("n"), F.count(F.lit(1)).alias("k")).where(
        (F.col("n") > limit) & (F.col("k") > 1)
    ).limit(1).count():
        # numbers given once and written, so that every reading finds them again
        same = stored(
            stuck.select(*columns, F.col("_name").alias("_before"), F.monotonically_increasing_id().alias("_row"))
            .withColumn("_hash", _hashed(F.col("_row"))),
            "shard-same",
        )
        again, alone = _placed(
            same, same.select("_hash", _bytes().alias("_bytes")), limit, F.concat("_before", F.lit("."))
        )
        # buckets of several doc_ids were split as one: each has its own part of a bucket
        parts = again.unionByName(alone)
        of_part = parts.groupBy("_name").agg(F.sum(_bytes()).alias("_bytes_of"), F.count(F.lit(1)).alias("_docs_of"))
        result = result.unionByName(parts.drop("_bytes_of", "_docs_of").join(of_part, "_name").select(*columns, *shard))
    return result


def write_shards(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """Write ``docs`` as Parquet with a folder ``shard=...`` per shard, and return the written table.

    A shard is written by one task, which its limit bounds. All columns stay, as
    ``assigned`` says.
    """
    rows = assigned(docs, limit)
    rows.repartition("shard").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)
