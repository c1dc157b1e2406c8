"""WARC archives: writing, reading, and revisit resolution by payload digest."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, shared_folder, ship

ship(__name__)

#: payloads of fewer bytes are always stored
SMALLEST = 1000
#: records of one archive file at most
RECORDS = 20_000
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

HEADER_SCHEMA = ("page_id long, url string, record_type string, record_id string, refers_to_id string, refers_to long, "
                 "payload_bytes long, payload_digest string, stored_bytes long, sound boolean")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Records to archive: ``page_id``, ``url``, ``payload`` (null: empty), ``payload_bytes``, ``payload_digest`` (SHA-1, hex)."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    return pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest"))


def resolve(recs: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """The records with ``record_type`` and ``refers_to``.

    Headers alone are grouped by digest, map-side first; payloads of a digest
    that occurs more than once refer to its largest page id.  Only those
    digests are joined back, so a payload that a third of all pages share is
    one row of the smaller side, and adaptive execution splits the larger.
    """
    originals = settle(
        recs.filter(F.col("payload_bytes") >= smallest).groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1 and original is not null").drop("n"),
        "warc-originals")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return recs.join(originals, ["payload_digest", "payload_bytes"], "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("original")).alias("refers_to"))


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("/", *[p.cast("string") for p in parts]))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut]), F.lit(">"))


def lines(resolved: DataFrame) -> DataFrame:
    """One WARC/1.1 record per row as text, without the closing line breaks.

    A response holds an HTTP header and the payload, a revisit the HTTP header
    only, with the digest and length of the payload it stands for.  Headers
    are new.  Control characters and blanks of an address are percent-encoded.
    """
    n = F.col("payload_bytes").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n, F.lit(END))
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    url = F.transform(F.regexp_extract_all(F.col("url"), F.lit(r"[\x00-\x20\x7f]|[^\x00-\x20\x7f]+"), F.lit(0)),
                      lambda s: F.when(s.rlike(r"^[\x00-\x20\x7f]$"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(s)), 2, "0"))).otherwise(s))

    def header(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    return resolved.select(F.concat(
        F.lit("WARC/1.1\r\n"), header("WARC-Type", F.col("record_type")), header("WARC-Record-ID", _uuid(F.col("page_id"), F.col("payload_digest"))),
        header("WARC-Date", F.lit(DATE)), header("WARC-Target-URI", F.array_join(url, "")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        header("WARC-Refers-To", F.when(revisit, _uuid(F.col("refers_to"), F.col("payload_digest")))),
        header("X-Page-ID", F.col("page_id").cast("string")), header("X-Refers-To-Page-ID", F.col("refers_to").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
    ).alias("value"))


def write_archives(resolved: DataFrame, path: str) -> str:
    """Write gzip archives through Spark's own writer, which works on any store and survives lost executors."""
    lines(resolved).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)
    return path


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Headers of every record of a folder of archives, with ``payload`` on request.

    A file is inflated piece by piece, one record at a time.  ``sound`` tells
    whether a stored payload has the length and digest of its header; for
    revisits ``payload_bytes`` is null until they are joined to their originals.
    """
    schema = HEADER_SCHEMA + (", payload string" if payloads else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                rows = []
                held = 0
                for head, body in split_records(inflate(memoryview(content.as_buffer()))):
                    rows.append(describe(head, body, payloads))
                    held += len(body) if payloads else 200
                    if len(rows) >= 2000 or held > 1 << 24:
                        yield _batch(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "stored_bytes": pa.int64(), "sound": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for c, n in zip(zip(*rows), names)], names)


def inflate(content: memoryview, step: int = 1 << 20) -> Iterator[bytes]:
    """Pieces of a gzip stream of one or more members; plain content passes through."""
    if bytes(content[:2]) != b"\x1f\x8b":
        yield from (bytes(content[k:k + step]) for k in range(0, len(content), step))
        return
    member = zlib.decompressobj(31)
    for k in range(0, len(content), step):
        piece = bytes(content[k:k + step])
        while piece:
            yield member.decompress(piece)
            piece = member.unused_data
            if member.eof:
                member = zlib.decompressobj(31)


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record, by Content-Length."""
    data = bytearray()
    at = 0

    def more() -> bool:
        nonlocal at
        piece = next(pieces, None)
        if piece is None:
            return False
        del data[:at]
        at = 0
        data.extend(piece)
        return True

    while True:
        while data.startswith(b"\r\n", at):
            at += 2
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or end - at < 2:
            if more():
                continue
            return
        fields = {}
        for line in bytes(data[at:end]).decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        at = end + 4
        while len(data) - at < size:
            if not more():
                raise ValueError("an archive ends inside a record")
        yield fields, bytes(data[at:at + size])
        at += size


def describe(head: dict[str, str], block: bytes, payloads: bool) -> tuple:
    """Row of a record; the payload is what follows the HTTP header."""
    kind = head.get("warc-type")
    payload = block.partition(b"\r\n\r\n")[2]
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    stored = kind != "revisit"
    sound = not stored or hashlib.sha1(payload).hexdigest() == digest
    number = lambda name: int(head[name]) if name in head else None
    row = (number("x-page-id"), head.get("warc-target-uri"), kind, head.get("warc-record-id"), head.get("warc-refers-to"),
           number("x-refers-to-page-id"), len(payload) if stored else None, digest, len(payload), sound)
    return (*row, payload.decode("utf-8", "replace") if stored else None) if payloads else row


def expand(headers: DataFrame) -> DataFrame:
    """Headers with ``payload_bytes`` (and ``payload``, where read) of revisits taken from their originals.

    Revisits are joined to the response of the same digest and page id; a
    revisit without one keeps null.
    """
    taken = [c for c in ("payload_bytes", "payload") if c in headers.columns]
    originals = (
        headers.filter("record_type = 'response'").groupBy("payload_digest", F.col("page_id").alias("refers_to"))
        .agg(*[F.max(c).alias(f"original_{c}") for c in taken])
    )
    revisits = headers.filter("record_type = 'revisit'").join(originals, ["payload_digest", "refers_to"], "left")
    revisits = revisits.select(*[F.col(f"original_{c}").alias(c) if c in taken else F.col(c) for c in headers.columns])
    return headers.filter("record_type <> 'revisit'").unionByName(revisits)


def archive_pages(pages: DataFrame, path: str | None = None, smallest: int = SMALLEST) -> DataFrame:
    """Write the pages as deduplicated archives, read them back, and resolve the revisits.

    Of records with equal payloads of at least ``smallest`` bytes, that with
    the largest page id is the response; rows that repeat it are responses
    too.  Smaller payloads are all responses.  Null payloads are empty, null
    addresses have no header; a null page id is a response.  An empty table
    gives an empty result.  Other columns are ignored.
    """
    spark = pages.sparkSession
    path = write_archives(resolve(records(pages), smallest), path or shared_folder(spark, "archives"))
    return expand(settle(read_archives(spark, path), "warc-headers"))
