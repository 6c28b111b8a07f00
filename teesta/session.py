"""Session defaults and lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "teesta", cores: int | str = "*", shuffle_partitions: int = 8, checkpoints: str | None = None) -> SparkSession:
    """A local session with the settings the engine is tested under; `checkpoints` is the folder for lineage cuts."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TEESTA_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if checkpoints:
        builder = builder.config("spark.checkpoint.dir", checkpoints)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Where that is unset, a local session (one machine, tests) uses a folder of its own; a cluster has to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), f"teesta-{spark.sparkContext.applicationId}")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))
    return df.checkpoint(eager=True)
