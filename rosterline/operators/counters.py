"""Counters that live across runs: mergeable sums per batch, and the reports over all of them.

A batch leaves a small table of counters (fields, extractors, files, stages).
Tables of any batches add up, so that reports over many runs read counters,
never the messages again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..vocab.business import TRACKED_FIELDS
from . import quality

SCHEMA = "section string, key string, success long, total long, seconds decimal(38,6), least double, most double"
_NO_TIMES = {"seconds": "decimal(38,6)", "least": "double", "most": "double"}


def counted(records: DataFrame | None = None, candidates: DataFrame | None = None, files: DataFrame | None = None,
            stages: DataFrame | None = None) -> DataFrame:
    """Counters of one batch in the rows of :data:`SCHEMA`; any of the inputs may be left out.

    ``records`` hold the output columns, ``candidates`` those of
    :func:`fusion.candidates`, ``files`` the columns ``success`` and ``seconds``,
    ``stages`` the columns ``stage`` and ``seconds``.  Table cells count as one
    extractor.
    """
    def untimed(df, section, key):
        return df.select(F.lit(section).alias("section"), F.col(key).alias("key"), "success", "total",
                         *[F.lit(None).cast(t).alias(c) for c, t in _NO_TIMES.items()])

    seconds = F.col("seconds").cast("decimal(18,6)")
    times = [F.sum(seconds).cast("decimal(38,6)").alias("seconds"), F.min(seconds).cast("double").alias("least"), F.max(seconds).cast("double").alias("most")]
    parts = []
    if records is not None:
        parts.append(untimed(quality.field_success(records), "field", "field"))
    if candidates is not None:
        family = candidates.withColumn("extractor_id", F.regexp_replace("extractor_id", "^table_row_.*$", "table"))
        by = family.groupBy("extractor_id").agg(F.count_if(F.col("confidence") > 0.5).alias("success"), F.count("*").alias("total"))
        parts.append(untimed(by, "extractor", "extractor_id"))
    if files is not None:
        done = files.withColumn("seconds", F.when(F.col("success"), seconds))
        parts.append(done.agg(F.count_if("success").alias("success"), F.count("*").alias("total"), *times).select(
            F.lit("run").alias("section"), F.lit("files").alias("key"), "success", "total", "seconds", "least", "most"))
    if stages is not None:
        parts.append(stages.groupBy(F.col("stage").alias("key")).agg(F.count("*").alias("success"), F.count("*").alias("total"), *times).select(
            F.lit("stage").alias("section"), "key", "success", "total", "seconds", "least", "most"))
    return reduce(DataFrame.unionByName, parts)


def record_batch(counters: DataFrame, state: str, run: str, batch: int) -> None:
    """Write the counters of one batch of a run.

    The batch has a folder of its own, which a replay of the batch overwrites:
    a batch that a restarted stream runs again still counts once.
    """
    counters.coalesce(1).write.mode("overwrite").parquet(f"{state.rstrip('/')}/run={run}/batch={batch}")


def merged(spark: SparkSession, state: str, runs: list[str] | None = None) -> DataFrame:
    """Counters over all batches of all runs, or of the runs named; rows of :data:`SCHEMA`."""
    found = spark.read.schema(f"{SCHEMA}, run string, batch long").option("basePath", state).parquet(f"{state.rstrip('/')}/run=*/batch=*")
    if runs is not None:
        found = found.filter(F.col("run").isin(runs))
    return add(found)


def add(counters: DataFrame) -> DataFrame:
    """Sum of counter tables that were put one below the other."""
    return counters.groupBy("section", "key").agg(
        F.sum("success").alias("success"), F.sum("total").alias("total"), F.sum("seconds").cast("decimal(38,6)").alias("seconds"),
        F.min("least").alias("least"), F.max("most").alias("most"))


def field_analysis(counters: DataFrame, fields: list[str] = TRACKED_FIELDS) -> DataFrame:
    """:func:`quality.field_analysis` over merged counters."""
    place = F.array_position(F.array(*[F.lit(f) for f in fields]), F.col("key")).cast("int") - 1
    return quality.field_analysis(counters.filter("section = 'field'").select(F.col("key").alias("field"), place.alias("field_ord"), "success", "total"))


def extractor_analysis(counters: DataFrame) -> DataFrame:
    """:func:`quality.extractor_analysis` over merged counters."""
    return quality.judged(counters.filter("section = 'extractor'").select(F.col("key").alias("extractor_id"), "success", "total"))


def run_analysis(counters: DataFrame) -> DataFrame:
    """Files, successes, failures, success rate, seconds and speed class over merged counters."""
    run = counters.filter("section = 'run'")
    mean = F.coalesce(F.col("seconds").cast("double") / F.nullif("success", F.lit(0)), F.lit(0.0))
    return run.select(
        F.col("success").alias("success_count"), (F.col("total") - F.col("success")).alias("failure_count"),
        (F.col("success") / F.greatest("total", F.lit(1))).alias("success_rate"), F.coalesce(F.col("seconds").cast("double"), F.lit(0.0)).alias("total_seconds"),
        mean.alias("mean_seconds"), quality.speed_class(mean).alias("speed"))


def stage_analysis(counters: DataFrame) -> DataFrame:
    """Mean, least and greatest seconds and calls per stage over merged counters."""
    return counters.filter("section = 'stage'").select(
        F.col("key").alias("stage"), (F.col("seconds").cast("double") / F.col("total")).alias("mean_seconds"), F.col("least").alias("min_seconds"),
        F.col("most").alias("max_seconds"), F.col("total").alias("calls"))
