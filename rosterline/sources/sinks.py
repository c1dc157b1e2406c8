"""Roster, metrics and provenance writers, and the check of a written roster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import column_names, to_output


def read_template(spark: SparkSession, path: str) -> list[str] | None:
    """Column order of a header-only CSV template, None when unreadable."""
    try:
        return spark.read.option("header", True).csv(path).columns or None
    except Exception:  # no template: the default order applies
        return None


def write_roster(records: DataFrame, path: str, template: list[str] | None = None, fmt: str = "csv") -> None:
    """Records under their published headings; one output file per partition."""
    writer = to_output(records, template).write.mode("overwrite")
    if fmt == "csv":
        writer.options(header=True, escape='"').csv(path)
    else:
        writer.parquet(path)


def read_roster(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A written roster; values may hold quotes and line breaks."""
    if fmt == "csv":
        return spark.read.options(header=True, escape='"', multiLine=True).csv(path)
    return spark.read.parquet(path)


def validate_output(spark: SparkSession, path: str, expected: list[str] | None = None, fmt: str = "csv") -> bool:
    """All expected columns there and at least one row."""
    out = read_roster(spark, path, fmt)
    missing = set(expected or column_names()) - set(out.columns)
    return not missing and not out.isEmpty()


def write_json(report: DataFrame, path: str) -> None:
    """Metrics report as JSON lines."""
    report.write.mode("overwrite").json(path)


#: rows of a written trace
TRACE = (
    "msg_id string, thread_trimmed boolean, blocks_detected int, "
    "field_traces array<struct<field:string,value:string,confidence:double,extractor_id:string,passed:boolean>>"
)


def write_traces(traces: DataFrame, path: str, buckets: int = 16, records_per_file: int = 10_000) -> None:
    """Per-message traces as JSON lines, in folders by a hash of the message and files of bounded length.

    Nothing is shuffled: every task writes its own files, at most ``buckets`` at a time.
    """
    bucket = F.pmod(F.xxhash64(F.col("msg_id").cast("string")), F.lit(buckets)).cast("int")
    traces.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").option("maxRecordsPerFile", records_per_file).json(path)


def read_traces(spark: SparkSession, path: str, msg_id=None, buckets: int = 16) -> DataFrame:
    """Written traces; those of one message come from its folder alone (``buckets`` as on writing)."""
    found = spark.read.schema(f"{TRACE}, bucket int").json(path)
    if msg_id is None:
        return found.drop("bucket")
    bucket = F.pmod(F.xxhash64(F.lit(str(msg_id))), F.lit(buckets)).cast("int")
    return found.filter((F.col("bucket") == bucket) & (F.col("msg_id") == str(msg_id))).drop("bucket")


def trace_count(spark: SparkSession, path: str) -> DataFrame:
    return read_traces(spark, path).agg(F.count("*").alias("total_traces"))
