"""Written tables, free column names and sizes shared by the operators."""

from __future__ import annotations

import math
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from slotwise.plans.materialize import shared_folder

CHUNK_BYTES = 2_000_000
BUCKET_BYTES = 3_000_000


def write_out(df: DataFrame) -> DataFrame:
    """Write to a new folder below ``spark.checkpoint.dir`` and read it back.

    What follows reads files, so a lost executor changes neither the rows nor
    their numbers.
    """
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Plans made and run inside send workers at most ``rows`` rows at once; whole texts make batches large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Rows written with a number each that is unique and stays as written."""
    return write_out(df.withColumn(name, F.monotonically_increasing_id()))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns whose name (in any case) an output column takes."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def chunk_of(n: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("long")


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts; a counter that follows the input, never a limit."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def shares(total: int, each: int) -> int:
    """Number of chunks or buckets of about ``each`` bytes."""
    return max(1, math.ceil(total / each))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
