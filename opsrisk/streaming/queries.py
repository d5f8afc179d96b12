"""Standing queries: the operators of the batch jobs on unbounded input.

All sinks survive a restart: files are committed once per micro-batch, and
batches written by hand replace themselves when they are repeated.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from opsrisk.constants import HIGH_RISK_PROBABILITY
from opsrisk.operators import alerts, history
from opsrisk.plans.scoring import read_refused, scored_requests, store_refused, to_history
from opsrisk.session import path_exists
from opsrisk.sources.history_store import append_history, read_history
from opsrisk.sources.published import VersionedTable, publish, published

WATERMARK = "1 hour"
SUMMARY_TRIGGER = "5 minutes"


def timed(predictions: DataFrame, lateness: str | None = WATERMARK) -> DataFrame:
    """Creation time as a timestamp, which windows of streams ask for, with the lateness allowed, if it is limited."""
    rows = predictions.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return rows if lateness is None else rows.withWatermark("created_at", lateness)


def scoring_writer(requests: DataFrame, model: PipelineModel, history_path: str) -> DataStreamWriter:
    """Score every arriving request and add it to the history; refused ones go beside it.

    A micro-batch writes a folder in either table and then moves a pointer past
    its number. Both folders replace themselves when the batch is repeated, and
    ``read_scored`` shows batches up to the pointer only. So each request is in
    one of the two tables, once, whenever the job dies.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark, own = batch.sparkSession, f"{number:012d}"
        done = published(spark, _commits(history_path))
        if done is not None and done >= own:
            return
        store_refused(batch, history_path, own)
        append_history(to_history(scored_requests(batch, model)), history_path, own)
        publish(spark, _commits(history_path), own)

    return requests.writeStream.foreachBatch(store)


def _commits(history_path: str) -> str:
    return f"{history_path.rstrip('/')}-commits"


def read_scored(spark: SparkSession, history_path: str) -> tuple[DataFrame, DataFrame]:
    """The predictions and the refused requests of all micro-batches that are complete; fails before the first is."""
    done = published(spark, _commits(history_path))
    if done is None:
        raise FileNotFoundError(f"no micro-batch is complete at {history_path}")
    complete = F.lpad(F.col("batch").cast("string"), len(done), "0") <= done
    scored = read_history(spark, history_path, batches=True).filter(complete)
    return scored.drop("batch"), read_refused(spark, history_path).filter(complete).drop("batch")


def risk_window_stream(
    predictions: DataFrame,
    length: str = "24 hours",
    slide: str = "24 hours",
    start: str = "6 hours 5 minutes",
    probability: float = HIGH_RISK_PROBABILITY,
    lateness: str | None = WATERMARK,
) -> DataFrame:
    """Risk counts of every window.

    ``table_writer`` adds a window to its table once the watermark has closed it;
    ``keyed_writer`` keeps open windows up to date as well. Without a limit of
    ``lateness`` no prediction is ever too late to count; the state then keeps
    two numbers for each window there has been.
    """
    return alerts.risk_windows(timed(predictions, lateness), length, slide, start, probability)


def keyed_writer(counts: DataFrame, path: str, keys: list[str]) -> DataStreamWriter:
    """A running aggregate as a table with one row per key, its newest; read by ``read_keyed``.

    Each micro-batch brings the rows that it changed and merges them into the
    live version of the table, which is small: one row per key of the aggregate.
    """

    def store(changed: DataFrame, number: int) -> None:
        VersionedTable(changed.sparkSession, path, counts.schema).merge(changed, keys, f"{number:012d}")

    return counts.writeStream.outputMode("update").foreachBatch(store)


def read_keyed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The live version of a table of ``keyed_writer``."""
    return VersionedTable(spark, path, schema).read()


def alert_writer(predictions: DataFrame, path: str, probability: float = HIGH_RISK_PROBABILITY) -> DataStreamWriter:
    """One alert per prediction at or above the probability, however often and however late it arrives.

    Alerts are kept by day. A micro-batch looks for its ids only in the days it
    touches, adds the new ones as a folder of its own, and replaces that folder
    when it is repeated, so neither a watermark nor stream state is needed.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark, own = batch.sparkSession, f"{number:012d}"
        raised = alerts.monitoring_alerts(batch, probability).dropDuplicates(["ref_id"])
        raised = raised.withColumn("day", F.to_date("event_time"))
        if path_exists(spark, path):
            earlier = _alert_table(spark, path, raised.schema).filter(F.col("batch") != own)
            earlier = earlier.join(raised.select("day").distinct(), "day", "left_semi")
            raised = raised.join(earlier.select("day", "ref_id"), ["day", "ref_id"], "left_anti")
        raised.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={own}")

    return predictions.writeStream.foreachBatch(store)


def _alert_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema, T.StructField("batch", T.StringType())])).parquet(path)


def read_alerts(spark: SparkSession, path: str, predictions: DataFrame) -> DataFrame:
    """The alerts that ``alert_writer`` has stored of ``predictions``."""
    kind = alerts.monitoring_alerts(predictions).schema
    return _alert_table(spark, path, kind).select(*kind.names)


def table_writer(stream: DataFrame, path: str) -> DataStreamWriter:
    """Append finished rows to a table of files."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path)


def status_count_writer(predictions: DataFrame, path: str) -> DataStreamWriter:
    """Running counts by status."""
    return keyed_writer(history.status_counts(predictions), path, ["status"])


def latest_status_counts(spark: SparkSession, path: str) -> DataFrame:
    """The running counts as they are now."""
    return read_keyed(spark, path, T.StructType.fromDDL("status string, n bigint"))


def run_available(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Process all input that is there, in as many micro-batches as it takes, and stop."""
    running = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    return running


def run_standing(writer: DataStreamWriter, checkpoint: str, every: str = SUMMARY_TRIGGER) -> StreamingQuery:
    """Keep processing input as it arrives."""
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
