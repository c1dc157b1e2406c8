"""Mail files to messages.

Python runs in two places only: :func:`decode` takes the bytes of a message apart,
and :func:`write_mail_files` puts files into a local or mounted folder.
Everything else is Spark expressions over the decoded columns.
"""

from __future__ import annotations

import os
import re
import shutil
import sys
import time
import uuid
from collections.abc import Iterator
from email import message_from_bytes, policy
from email.header import decode_header, make_header

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors get the decoder by value; they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEADERS = ["From", "To", "Subject", "Date", "Message-ID"]

MESSAGE_SCHEMA = (
    "msg_id string, source_file string, headers map<string,string>, "
    "parts array<struct<idx:int,content_type:string,disposition:string,filename:string,text:string,payload:binary>>, "
    "parse_error string, seconds double"
)


def read_mail_files(
    spark: SparkSession, folder: str, pattern: str = "*.eml", tasks: int | None = None, subfolders: bool = False) -> DataFrame:
    """Mail files of one folder, not its subfolders unless told so: ``msg_id, source_file, content``.

    Spark gives a task some 32 small files, whose start costs more than their
    mails; ``tasks`` bounds the number of tasks, without a shuffle.  Many
    subfolders are listed by tasks, one large folder by the driver alone.
    """
    files = spark.read.format("binaryFile").options(pathGlobFilter=pattern, recursiveFileLookup=subfolders).load(folder)
    return _as_mail(files.coalesce(tasks) if tasks else files)


def write_mail_files(mails: DataFrame, folder: str) -> None:
    """Write the column ``value`` (text; null: empty) as one file a mail, ended by a line feed, to a new folder.

    Each task fills a subfolder of its own, to be read with ``subfolders=True``.
    Spark's writer starts processes for each file of a local or mounted folder,
    to set the rights of it and of its checksum; there the tasks write the
    files themselves, without checksums.  A subfolder gets its name, once, when it is whole,
    so that repeated or lost attempts of a task leave nothing to be read.
    """
    spark = mails.sparkSession
    local = local_path(folder, spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS"))
    if local is None:
        # so many files are put in place by the tasks that wrote them, not one after the other by the driver
        mails.select("value").write.option("mapreduce.fileoutputcommitter.algorithm.version", 2).option("maxRecordsPerFile", 1).text(f"{folder}/mails")
        return
    os.makedirs(local := os.path.abspath(local))
    written = mails.selectExpr("cast(value as binary) AS value").mapInArrow(_file_writer(local), "mails long")
    written.agg(F.sum("mails")).collect()


def local_path(folder: str, default: str) -> str | None:
    """Path of a folder of the local file system (mounted ones included), None for any other; ``default`` is that of paths without a scheme."""
    scheme, path = re.fullmatch(r"(?s)(?:([A-Za-z][A-Za-z0-9+.-]*):(?://[^/]*)?)?(.*)", folder).groups()
    return path if (scheme or default.partition(":")[0]).lower() == "file" else None


def _file_writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, count = os.path.join(folder, f"_{uuid.uuid4().hex}"), 0
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, _BATCH_ROWS):
                    for value in batch.column(0).slice(start, _BATCH_ROWS).to_pylist():
                        if not count:
                            os.mkdir(attempt)
                        with open(os.path.join(attempt, f"mail-{count:08d}.txt"), "wb") as f:
                            f.write((value or b"") + b"\n")
                        count += 1
            if count:
                _put(attempt, os.path.join(folder, f"part-{TaskContext.get().partitionId():05d}"))
        finally:
            shutil.rmtree(attempt, ignore_errors=True)
        yield pa.RecordBatch.from_pydict({"mails": pa.array([count], pa.int64())})

    return write


def _put(attempt: str, place: str) -> None:
    """Name a whole folder; where an earlier attempt already has the name, its equal files stay."""
    try:
        os.rename(attempt, place)
    except OSError:
        if not os.path.isdir(place):
            raise


def read_mail_stream(spark: SparkSession, folder: str, pattern: str = "*.eml", files_per_trigger: int = 10_000) -> DataFrame:
    """The same folder as a file stream, so many files a batch; run it with ``trigger(availableNow=True)``."""
    files = (
        spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger)
        .schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    )
    return _as_mail(files)


def _as_mail(files: DataFrame) -> DataFrame:
    return files.select(
        F.col("path").alias("msg_id"), F.element_at(F.split("path", "/"), -1).alias("source_file"), "content")


_PART = pa.struct([
    ("idx", pa.int32()), ("content_type", pa.string()), ("disposition", pa.string()), ("filename", pa.string()),
    ("text", pa.string()), ("payload", pa.binary()),
])
_ROW = pa.schema([
    ("msg_id", pa.string()), ("source_file", pa.string()), ("headers", pa.map_(pa.string(), pa.string())),
    ("parts", pa.list_(_PART)), ("parse_error", pa.string()), ("seconds", pa.float64()),
])
#: decoded messages per output batch; bounds the memory of a Python worker
_BATCH_ROWS = 256


def _text(part) -> str | None:
    """Text of a part; None for an unknown charset or broken encoding."""
    try:
        return part.get_payload(decode=True).decode(part.get_param("charset", "ascii"), errors="replace")
    except (LookupError, ValueError, AttributeError, TypeError):
        return None


def _decode_one(content: bytes) -> tuple[list, list]:
    # The light policy reads the structure; only the wanted headers are decoded in full.
    message = message_from_bytes(content, policy=policy.compat32)
    raw = {}
    for name, value in message.raw_items():
        raw.setdefault(name.lower(), value)
    headers = [
        (key, str(policy.default.header_fetch_parse(key, raw[key.lower()]))) for key in HEADERS if key.lower() in raw
    ]
    parts = []
    for idx, part in enumerate(message.walk() if message.is_multipart() else [message]):
        kind, disposition, filename = part.get_content_type(), part.get_content_disposition(), part.get_filename()
        if filename and "=?" in filename:
            filename = str(make_header(decode_header(filename)))
        attached = disposition == "attachment" and filename
        parts.append({
            "idx": idx, "content_type": kind, "disposition": disposition, "filename": filename,
            "text": _text(part) if kind in ("text/plain", "text/html") else None,
            "payload": part.get_payload(decode=True) if attached else None,
        })
    return headers, parts


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, _BATCH_ROWS):
            rows = []
            for row in batch.slice(start, _BATCH_ROWS).to_pylist():
                started = time.perf_counter()
                try:
                    if row["content"] is None:
                        raise ValueError("no content")
                    headers, parts = _decode_one(row["content"])
                    error = None
                except Exception as failure:  # one bad message must not fail the batch
                    headers, parts, error = [], [], str(failure)
                rows.append({"msg_id": row["msg_id"], "source_file": row["source_file"], "headers": headers,
                             "parts": parts, "parse_error": error, "seconds": time.perf_counter() - started})
            yield pa.RecordBatch.from_pylist(rows, schema=_ROW)


def decode(mail: DataFrame) -> DataFrame:
    """Bytes to headers and parts; a message that fails keeps a row with ``parse_error``.  ``seconds``: time it took."""
    return mail.selectExpr("cast(msg_id as string) AS msg_id", "source_file", "content").mapInArrow(
        _decode_batches, MESSAGE_SCHEMA)


def messages(decoded: DataFrame) -> DataFrame:
    """Message table: all text parts joined, all HTML parts joined, in walk order."""
    def joined(kind):
        return f"array_join(transform(filter(parts, p -> p.content_type = '{kind}'), p -> coalesce(p.text, '')), '')"

    text = f"CASE WHEN parse_error IS NULL THEN {joined('text/plain')} ELSE concat('Error reading email: ', parse_error) END"
    return decoded.select(
        "msg_id", "source_file", "headers", F.expr(text).alias("text_content"),
        F.expr(joined("text/html")).alias("html_content"), "parse_error", "parts", "seconds")


def compact(messages_: DataFrame, path: str) -> None:
    """Write the message table once; later jobs scan Parquet instead of many small files."""
    messages_.write.mode("overwrite").parquet(path)
