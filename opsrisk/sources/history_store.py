"""The append-only prediction history as a table of files, and from a database."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsrisk.schemas import HISTORY_SCHEMA
from opsrisk.session import checkpointed, path_exists

# monotonically_increasing_id keeps the row number of a partition in its lower bits
_ROW_BITS = 33

# Spark's readers pass over folders whose name starts like this
_NOTES = "_last_ids"


def read_history(spark: SparkSession, path: str, batches: bool = False) -> DataFrame:
    """The history, with the ``batch`` that each row came in if asked for; empty when nothing was written yet."""
    schema = T.StructType([*HISTORY_SCHEMA, *([T.StructField("batch", T.StringType())] if batches else [])])
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def with_ids(rows: DataFrame, after: int) -> tuple[DataFrame, int]:
    """Consecutive ids from ``after`` + 1, and the last one given.

    There is no sort and no pass in a single task. The rows are stored first, so
    that their partitions no longer change. Then each partition's rows are
    counted, and an id is the number of rows in the partitions before plus the
    row's place in its own. The table of counts has as many rows as there are
    partitions.
    """
    placed = checkpointed(rows.drop("id")).withColumns(
        {"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}
    )
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    starts, last = [], after
    for part in sorted(counts):
        starts.append((part, last + 1))
        last += counts[part]
    start_of = placed.sparkSession.createDataFrame(starts, "_part int, _start bigint")
    row = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    numbered = (
        placed.join(F.broadcast(start_of), "_part")
        .withColumn("id", F.col("_start") + row)
        .drop("_part", "_row", "_start")
    )
    return numbered, last


def append_history(predictions: DataFrame, path: str, batch: str | None = None) -> DataFrame:
    """Give new predictions ids and a creation time and add them to the table at ``path``.

    Each append is one folder named by ``batch``. Writing a batch again replaces
    it, so a job or micro-batch repeated after a failure leaves no duplicates.
    The first and last id of each batch are noted before its rows are written:
    the next append reads these notes and not the history. A batch that is
    repeated, whatever came after it, gets the ids noted for it; if its number
    of rows is another one, it is refused. An append of no rows writes nothing.
    There is one writer per table.
    """
    spark = predictions.sparkSession
    batch = batch or uuid4().hex
    rows = predictions
    if "created_at" not in rows.columns:
        rows = rows.withColumn("created_at", F.current_timestamp())
    after, noted = _noted(spark, path, batch)
    numbered, last = with_ids(rows, after)
    if noted is not None and last != noted:
        raise ValueError(f"batch {batch!r} had {noted - after} rows and now has {last - after}")
    if last == after:
        return spark.createDataFrame([], HISTORY_SCHEMA)
    complete = numbered.select(
        *(F.col(f.name).cast(f.dataType).alias(f.name) for f in HISTORY_SCHEMA)
    )
    missing = " OR ".join(f"{name} IS NULL" for name in HISTORY_SCHEMA.names)
    checked = complete.withColumn(
        "status", F.expr(f"IF({missing}, raise_error('history columns must not be null'), status)")
    )
    if noted is None:
        note = spark.createDataFrame([(after + 1, last)], "first_id bigint, last_id bigint")
        note.write.mode("overwrite").parquet(f"{path}/{_NOTES}/batch={batch}")
    checked.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return spark.read.schema(HISTORY_SCHEMA).parquet(f"{path}/batch={batch}")


def _noted(spark: SparkSession, path: str, batch: str) -> tuple[int, int | None]:
    """The id after which a batch's ids begin, and the last one noted for it, if it was written before."""
    notes = f"{path}/{_NOTES}"
    if not path_exists(spark, notes):
        return 0, None
    own = F.col("batch") == batch
    row = (
        spark.read.schema("first_id bigint, last_id bigint, batch string")
        .parquet(notes)
        .agg(
            F.max(F.when(own, F.col("first_id"))).alias("own_first"),
            F.max(F.when(own, F.col("last_id"))).alias("own_last"),
            F.coalesce(F.max("last_id"), F.lit(0)).alias("last_of_all"),
        )
        .first()
    )
    return (row.last_of_all, None) if row.own_first is None else (row.own_first - 1, row.own_last)


def read_history_jdbc(
    spark: SparkSession,
    url: str,
    lower: int,
    upper: int,
    partitions: int,
    table: str = "prediction_history",
    **options: str,
) -> DataFrame:
    """The history from a relational database, in parallel ranges of its id."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=table,
            partitionColumn="id",
            lowerBound=str(lower),
            upperBound=str(upper),
            numPartitions=str(partitions),
            **options,
        )
        .load()
        .select(*HISTORY_SCHEMA.names)
    )
