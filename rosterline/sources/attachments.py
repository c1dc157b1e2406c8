"""Attachments: routing by extension, delimited payloads, header mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import explode_rows

from ..functions.sql import let, q, rows, strip
from ..vocab.headers import attachment_rows

# Extensions and their readers.
ROUTES = {
    "spreadsheet": ["xlsx", "xls", "csv"],
    "document": ["docx"],
    "pdf": ["pdf"],
    "image": ["png", "jpg", "jpeg", "tiff", "bmp"],
}
# Fixed value: share of a variant's words that must occur in a header.
WORD_SHARE = 0.8


def route(filename: str) -> str:
    """Reader of a file by its lower-cased extension, NULL when unsupported."""
    ext = f"lower(regexp_extract({filename}, {q(r'\.([^.]+)$')}, 1))"
    cases = " ".join(
        f"WHEN {ext} IN ({', '.join(q(e) for e in exts)}) THEN '{kind}'" for kind, exts in ROUTES.items())
    return f"CASE {cases} END"


def manifest(decoded: DataFrame) -> DataFrame:
    """Attachment parts with a filename and a non-empty payload that some reader supports."""
    parts = decoded.transform(explode_rows, ["msg_id"], F.col("parts"), "p")
    kept = parts.filter("p.disposition = 'attachment' AND p.filename <> '' AND length(p.payload) > 0")
    return kept.select(
        "msg_id", "p.idx", "p.filename", "p.content_type", F.expr(route("p.filename")).alias("reader"),
        F.col("p.payload").alias("payload")).filter("reader IS NOT NULL")


def map_attachment_header(header: str) -> str:
    """Field of a column: an exact variant first, else the first field with a match.

    A variant matches when the header contains it or at least 80 % of its words.
    """
    table = rows("field:string,ord:int,variant:string", [(f, i * 1000 + v, t) for f, i, t, v in attachment_rows()])
    exact = "get(filter(vs, e -> e.variant = hd), 0).field"
    share = "size(array_intersect(split(e.variant, ' '), ws)) / cast(size(array_distinct(split(e.variant, ' '))) as double)"
    near = f"get(filter(vs, e -> contains(hd, e.variant) OR {share} >= {WORD_SHARE}D), 0).field"
    return let(strip(f"lower({header})"), "hd", let(
        "regexp_extract_all(hd, '\\\\S+', 0)", "ws", let(table, "vs", f"coalesce({exact}, {near})")))


def record_cells(record: str) -> str:
    """Cells of one record, quotes undone."""
    cell = q(r'("(?:[^"]|"")*+"|[^,]*+),')
    undo = "if(startswith(c, '\"'), replace(substr(c, 2, length(c) - 2), '\"\"', '\"'), c)"
    return f"transform(regexp_extract_all(concat({record}, ','), {cell}, 1), c -> {undo})"


def csv_records(payload: str) -> str:
    """Records of a comma-separated text: array of arrays of cells, quotes undone."""
    record = q(r'(?:[^"\n]|"(?:[^"]|"")*+"?)++')
    unix = f"regexp_replace({payload}, {q(chr(92) + 'r' + chr(92) + 'n?')}, '\\n')"
    return f"transform(regexp_extract_all({unix}, {record}, 0), r -> {record_cells('r')})"


def csv_cells(attachments: DataFrame, payload: str = "payload") -> DataFrame:
    """Long table of the mapped cells of delimited attachments.

    Input: ``msg_id, filename`` and a text payload column.  The first record
    holds the headers; columns without a field are dropped, missing cells are ''.
    """
    keys = [c for c in attachments.columns if c != payload]
    parsed = attachments.select(*keys, F.expr(csv_records(payload)).alias("recs"))
    headed = parsed.select(*keys, "recs", F.expr(f"transform(get(recs, 0), h -> {map_attachment_header('h')})").alias("fields"))
    data = headed.transform(explode_rows, [*keys, "fields", F.expr("get(recs, 0)").alias("headers")], "slice(recs, 2, size(recs))", "row_idx", "cells")
    cells = data.transform(explode_rows, [*keys, "row_idx", "headers", "cells"], F.col("fields"), "col_idx", "field")
    return cells.filter("field IS NOT NULL").select(
        *keys, "row_idx", "col_idx", F.expr("get(headers, col_idx)").alias("header"), "field",
        F.expr("coalesce(get(cells, col_idx), '')").alias("value"))
