"""One batch of mails from bytes to roster, with its log: times, records, attachments, warnings and the overall outcome."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources import mail, sinks
from . import counters, fusion, quality, records


@dataclass
class BatchRun:
    """What a batch left behind; the tables are read from files."""

    log: DataFrame  #: one row per message: outcome, records, attachments, warnings, seconds
    stages: DataFrame  #: stage, seconds, rows
    files: int
    failed: int
    roster: str  #: folder of the finished records

    @property
    def ok(self) -> bool:
        """Every message of a batch that had any was read."""
        return self.files > 0 and self.failed == 0


def run_batch(mails: DataFrame, folder: str, gap: int = 2, state: str | None = None, run: str = "batch", number: int = 0) -> BatchRun:
    """Decode, extract and write a batch below ``folder``; a bad message is logged and never ends the batch.

    ``mails`` has the columns of :func:`rosterline.sources.mail.read_mail_files`.
    Decoding is timed per message where it happens, in the Python worker; the
    stages are timed as a whole, with the rows that Spark observed in them.
    Each stage reads what the one before has written, so a lost executor costs
    its own tasks only.  With ``state`` the counters of the batch are recorded
    there (:mod:`counters`), under ``run`` and ``number``.
    """
    spark, folder = mails.sparkSession, folder.rstrip("/")
    timed = []

    def stage(name, df, path, *counted):
        seen, started = Observation(name), time.perf_counter()
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *counted).write.mode("overwrite").parquet(path)
        timed.append((name, time.perf_counter() - started, seen.get["rows"]))
        return spark.read.schema(df.schema).parquet(path), seen.get

    decoded, seen = stage("decode", mail.decode(mails), f"{folder}/decoded", F.count("parse_error").alias("failed"))
    log, _ = stage("log", quality.file_runs(decoded, gap), f"{folder}/log")
    found = mail.messages(decoded.filter("parse_error IS NULL")).transform(fusion.extract, gap)
    raw, _ = stage("extract", found, f"{folder}/records")
    started = time.perf_counter()
    finished = records.process(raw)
    sinks.write_roster(finished, f"{folder}/roster", fmt="parquet")
    timed.append(("write", time.perf_counter() - started, timed[-1][2]))
    stages = spark.createDataFrame([(n, s, int(r)) for n, s, r in timed], "stage string, seconds double, rows long")
    if state:
        counters.record_batch(counters.counted(records=raw, files=log, stages=stages), state, run, number)
    return BatchRun(log, stages, int(seen["rows"]), int(seen["failed"]), f"{folder}/roster")
