"""Session, table and checkpoint helpers that every operator shares."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "karwan", cpus: int = 8, memory: str = "8g", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings that the operators expect; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for intermediate data, which all executors share.

    It is the one the session names (spark.checkpoint.dir); only a local session without
    one gets a temporary folder, a cluster without one is refused.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="karwan-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the checkpoint folder and reads it back: a lineage cut that survives lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df marked for a broadcast if it has at most so many (narrow) rows, else as it is. It is counted, so it should be cheap or cut."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
