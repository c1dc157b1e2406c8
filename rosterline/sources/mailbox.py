"""Mailbox archives (mbox): many mails in one file, cut into mails by many tasks.

A mail starts at a line that begins with ``From ``.  Spark's text source splits
files by byte range at any separator, so one archive of any size is read in
parallel from any file system, in batches and streams, without Python.  The
bytes of a mail stay as they are: the reader does not decode them, and the
rewriting here maps bytes one to one to characters and back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ends a mail and starts the next one's first line
SEPARATOR = "\nFrom "


def read_mailboxes(spark: SparkSession, folder: str, pattern: str = "*.mbox", unquote: bool = True) -> DataFrame:
    """Mails of the archives of a folder, in the form of :func:`mail.read_mail_files`: ``msg_id, source_file, content``.

    ``msg_id`` is the archive's path and a digest of the mail, so it does not
    depend on how the file was split; equal mails of one archive share it.
    ``unquote`` takes one ``>`` off lines such as ``>From``.  Blank lines at the
    end of a mail are dropped, a mail of nothing but its first line is empty,
    an empty file gives no row.  An archive starts with a ``From`` line; text
    before the first one is read as a mail of its own.  Compressed archives are
    read by one task each.
    """
    return _mails(spark.read.format("text").option("lineSep", SEPARATOR).option("pathGlobFilter", pattern).load(folder), unquote)


def read_mailbox_stream(spark: SparkSession, folder: str, pattern: str = "*.mbox", unquote: bool = True, files_per_trigger: int = 100) -> DataFrame:
    """The same over arriving archives; an archive is read once, so finished ones belong into the folder."""
    found = (
        spark.readStream.format("text").option("lineSep", SEPARATOR).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger).load(folder)
    )
    return _mails(found, unquote)


def _mails(records: DataFrame, unquote: bool) -> DataFrame:
    raw = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    body = F.regexp_replace(raw, r"\A[^\n]*+(?:\n|\z)", "")
    if unquote:
        body = F.regexp_replace(body, r"(?md)^>(>*+From )", "$1")
    content = F.encode(_ended(body), "ISO-8859-1")
    return (
        records.filter(F.trim(F.col("value"), F.lit("\r\n")) != "")
        .select(F.col("_metadata.file_path").alias("path"), content.alias("content"))
        .select(F.concat_ws("#", "path", F.sha1("content")).alias("msg_id"), F.element_at(F.split("path", "/"), -1).alias("source_file"), "content")
    )


def _ended(body: Column) -> Column:
    """Text that ends with one line feed, or nothing."""
    cut = F.rtrim(body, F.lit("\r\n"))
    return F.when(cut == "", F.lit("")).otherwise(F.concat(cut, F.lit("\n")))


def write_mailboxes(mails: DataFrame, folder: str, sender: str = "MAILER-DAEMON", mails_per_file: int = 0) -> None:
    """Write the column ``content`` (binary; null: empty) as archives; body lines such as ``From`` are quoted by ``>``.

    One archive a task, or several of ``mails_per_file``.  Spark names them ``part-*.txt``.
    """
    raw = F.decode(F.coalesce("content", F.lit(b"")), "ISO-8859-1")
    quoted = F.regexp_replace(raw, r"(?md)^(>*+From )", ">$1")
    framed = F.concat(F.lit(f"From {sender} Thu Jan  1 00:00:00 1970\n"), _ended(quoted))
    bytes_ = F.encode(framed, "ISO-8859-1").cast("string")
    mails.select(bytes_.alias("value")).write.option("maxRecordsPerFile", mails_per_file).text(folder)
