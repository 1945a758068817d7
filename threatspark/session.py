"""Session settings used by the tests and the bench, and the place for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", app: str = "threatspark", shuffle_partitions: int = 8) -> SparkSession:
    """A session for one machine. On a cluster the submit configuration decides; AQE sizes the shuffles."""
    builder = SparkSession.builder
    if not SparkConf().get("spark.checkpoint.dir"):
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="threatspark-"))  # one machine: its own folder
    spark = (
        builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # text scoring is costly per row, so small shuffles are worth more than one task
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # call sites are not recorded for every column: expressions here are built from many small parts
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        # a flow with much traffic then arrives at its session as few rows
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        # a micro-batch checkpoints what it changed, not the whole state
        .config("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own: list[str] = []
_made: list[str] = []


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables and stream checkpoints, below the shared folder ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder; a cluster session without it is refused, as its executors
    could not see each other's files.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="threatspark-"))
        shared = _own[0]
    _made.append(f"{shared.rstrip('/')}/threatspark/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear_work(spark: SparkSession) -> None:
    """Delete the intermediate tables and stream folders made so far. Frames that read them are of no use afterwards, so write
    or collect results first."""
    while _made:
        remove(spark, _made.pop())


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and its size is known to the optimizer."""
    spark, path = df.sparkSession, work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
