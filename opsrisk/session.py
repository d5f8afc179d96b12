"""Session helpers: the shared folder and reliable lineage cuts."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "opsrisk", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings every job here relies on.

    Adaptive execution does the run-time work: it merges small shuffle
    partitions, splits skewed join partitions and re-plans joins on measured
    sizes. Stream state is kept in RocksDB, outside the heap. On a cluster pass
    no ``master`` and let spark-submit decide.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{key: str(value) for key, value in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it.

    ``spark.checkpoint.dir`` decides. Only a local session without that setting
    gets a temporary folder; on a cluster its absence is an error, because a
    machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="opsrisk-")
        context.setCheckpointDir(named)
    return str(context.getCheckpointDir())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system Spark reads."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage, on storage that outlives executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
