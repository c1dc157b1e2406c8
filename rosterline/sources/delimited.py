"""Large delimited texts: one file or payload of any size cut into records by many tasks.

A line break ends a record unless it stands between quotes, which only the
number of quotes before it tells.  Lines are therefore held in blocks; the
quotes of a block are summed by the task that holds it, a running sum over the
blocks (one small row each) gives the state at the start of every block, and a
running sum inside the block the state of every line.  The same two levels
number the records.  Only records of several lines move a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import explode_rows
from ..session import shared_folder
from .attachments import map_attachment_header, record_cells

#: lines of a block of a payload; a block of a file is what a task reads of it
BLOCK_LINES = 65_536


def file_lines(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Lines of the delimited files of a folder: ``file`` (``source_file, path``), ``block``, ``pos``, ``value``.

    Spark cuts a file by byte ranges, at most ``spark.sql.files.maxPartitionBytes``
    each; compressed files are one block.  The offset of a range orders the
    blocks, the order of reading its lines.
    """
    read = spark.read.format("text").option("pathGlobFilter", pattern).load(folder)
    path = F.col("_metadata.file_path")
    return read.select(
        F.struct(F.element_at(F.split(path, "/"), -1).alias("source_file"), path.alias("path")).alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), "value")


def payload_lines(attachments: DataFrame, payload: str = "payload", block: int = BLOCK_LINES) -> DataFrame:
    """The same lines for attachments with a text payload; ``file`` holds their other columns.

    The lines are written to the shared folder once and read back: equal rows
    are told apart by a number (``file.row``) that must not change when lines
    are read again, and later steps then read blocks instead of whole payloads.
    A null payload has no lines.
    """
    keys = [c for c in attachments.columns if c != payload]
    tagged = attachments.select(F.struct(*keys, F.monotonically_increasing_id().alias("row")).alias("file"), payload)
    lines = tagged.transform(explode_rows, ["file"], F.split(payload, r"\r\n?|\n", -1), "pos", "value")
    lines = lines.select("file", F.floor(F.col("pos") / block).alias("block"), F.col("pos").cast("long").alias("pos"), "value")
    path = shared_folder(attachments.sparkSession, "payload-lines")
    lines.write.parquet(path)
    return attachments.sparkSession.read.schema(lines.schema).parquet(path)


def records(lines: DataFrame) -> DataFrame:
    """``file``, ``block``, ``record`` (from 0) and ``text`` of every record; blank lines between records are none.

    ``block`` is where the record starts.  A quote that is never closed makes
    the rest of its file one record, as in ``attachments.csv_records``.
    """
    at = Window.partitionBy("file", "block").orderBy("pos")
    so_far = at.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spread = lines.repartition("file", "block").withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    placed = spread.withColumn("inside", F.pmod(F.sum("quotes").over(so_far) - F.col("quotes"), F.lit(2)))

    def starts(state: int) -> Column:
        """1 for a line that starts a record if the block starts outside (0) or inside (1) of quotes."""
        return ((F.col("inside") == state) & (F.col("value") != "")).cast("long")

    placed = placed.withColumn("nth0", F.sum(starts(0)).over(so_far)).withColumn("nth1", F.sum(starts(1)).over(so_far))
    blocks = placed.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.max("nth0").alias("n0"), F.max("nth1").alias("n1"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        blocks.withColumn("state", F.pmod(F.coalesce(F.sum("quotes").over(before), F.lit(0)), F.lit(2)))
        .withColumn("n", F.when(F.col("state") == 0, F.col("n0")).otherwise(F.col("n1")))
        .select("file", "block", "state", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    outside = F.col("inside") == F.col("state")
    nth = F.col("first") + F.when(F.col("state") == 0, F.col("nth0")).otherwise(F.col("nth1")) - 1
    numbered = (
        placed.join(blocks, ["file", "block"]).filter(~outside | (F.col("value") != ""))
        .select("file", "block", nth.alias("record"), "pos", "value", (outside & (F.col("quotes") % 2 == 0)).alias("whole"))
    )
    several = (
        numbered.filter("not whole").groupBy("file", "record")
        .agg(F.min("block").alias("block"), F.sort_array(F.collect_list(F.struct("block", "pos", "value"))).alias("parts"))
    )
    return numbered.filter("whole").select("file", "block", "record", F.col("value").alias("text")).unionByName(
        several.select("file", "block", "record", F.array_join(F.col("parts.value"), "\n").alias("text")))


def cells(lines: DataFrame) -> DataFrame:
    """Long table of the mapped cells, as ``attachments.csv_cells`` gives it: the columns of ``file``, ``row_idx``,
    ``col_idx``, ``header``, ``field``, ``value``.

    Every distinct header line is mapped once.  Headers go to the records of
    their file block by block, so that a file of any size is no hot key.
    """
    found = records(lines)
    heads = found.filter("record = 0").select("file", F.col("text").alias("head"))
    mapped = heads.select("head").distinct().select("head", F.expr(record_cells("head")).alias("headers")).select(
        "head", "headers", F.expr(f"transform(headers, h -> {map_attachment_header('h')})").alias("fields"))
    blocks = lines.select("file", "block").distinct()
    headed = blocks.join(heads.join(mapped, "head"), "file").select("file", "block", "headers", "fields")
    data = found.filter("record > 0").join(headed, ["file", "block"]).select(
        "file", (F.col("record") - 1).cast("int").alias("row_idx"), "headers", "fields", F.expr(record_cells("text")).alias("cells"))
    names = [f"file.{c}" for c in lines.schema["file"].dataType.names if c != "row"]
    out = data.transform(explode_rows, [*names, "row_idx", "headers", "cells"], F.col("fields"), "col_idx", "field")
    return out.filter("field IS NOT NULL").select(
        *[n.removeprefix("file.") for n in names], "row_idx", "col_idx", F.expr("get(headers, col_idx)").alias("header"), "field",
        F.expr("coalesce(get(cells, col_idx), '')").alias("value"))
