"""Cutting lineage in the shared folder of the cluster.

A frame that several jobs read, or whose partition layout must stay fixed
between jobs, is written with a reliable checkpoint, so that a lost executor
re-reads files and nothing is recomputed in another order.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder set by ``spark.checkpoint.dir``, which all executors share.

    Only where it is unset and driver and executors are one process, as in tests,
    a folder of this machine takes its place.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="slotwise-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize_spread(df: DataFrame, key: str) -> DataFrame:
    """``materialize`` for a frame read many times: on at least as many partitions as cores.

    Only a table small enough to have landed in fewer partitions is shuffled.
    """
    kept = materialize(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return kept if kept.rdd.getNumPartitions() >= cores else materialize(kept.repartition(cores, key))


def written(df: DataFrame, name: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Without a name the table gets a new one.

    Unlike a checkpoint the result is a normal scan: columns are pruned and
    filters reach the files.
    """
    path = f"{shared_folder(df.sparkSession)}/{name or uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
