"""Intermediate tables written to the cluster's shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from teesta.session import checkpoint_folder


class Shelf:
    """Tables of one query under a folder of their own in the shared folder; `clear` removes those no longer needed."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{checkpoint_folder(spark).rstrip('/')}/teesta-{uuid.uuid4().hex}"
        self.made = 0

    def put(self, df: DataFrame) -> DataFrame:
        """`df` as a written parquet table: computed once, its size known to the planner, safe from lost executors."""
        path = f"{self.folder}/{self.made}"
        self.made += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, *tables: DataFrame) -> None:
        """Delete the files of tables that nothing lazy reads any more."""
        jvm = self.spark._jvm
        for t in tables:
            for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """`df` in at least as many partitions as there are cores: Python work on few large files would leave most idle.

    A table in more files than that, as every large one is, passes unchanged; a small one is dealt out once.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(3 * cores) if df.rdd.getNumPartitions() < cores else df
