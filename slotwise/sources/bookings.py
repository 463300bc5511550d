"""Reading and writing bookings, scoring requests and scored batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from slotwise import schema

CORRUPT = "_corrupt_record"


def read_bookings(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Bookings with the fixed schema; CSV lines that do not fit it keep their text in
    ``_corrupt_record`` with null fields instead of failing the job."""
    if fmt == "csv":
        with_bad = T.StructType([*schema.BOOKINGS.fields, T.StructField(CORRUPT, T.StringType())])
        return (
            spark.read.schema(with_bad)
            .option("header", True)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
            .csv(path)
        )
    return spark.read.schema(schema.BOOKINGS).format(fmt).load(path)


def write_bookings(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    writer = df.select(schema.BOOKINGS.names).write.mode(mode).format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def read_requests(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """JSON batches ``{"bookings": [request, ...]}``, one request per row.

    One batch per line, so that large files are split over tasks; set
    ``multi_line`` for files that hold one indented document each.
    """
    reader = spark.read.schema(schema.REQUEST_BATCH).option("multiLine", multi_line)
    return reader.json(path).select(F.explode("bookings").alias("request")).select("request.*")


def write_scores(
    scored: DataFrame, path: str, by_tier: bool = False, mode: str = "error"
) -> None:
    writer = scored.write.mode(mode)
    (writer.partitionBy("risk_tier") if by_tier else writer).parquet(path)
