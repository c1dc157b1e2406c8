"""Quality, timing and provenance reports.

Reports over a batch are single aggregations with map-side combine.  Reports
per message stay inside the message row and do not shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import explode_rows

from ..functions import text as tx
from ..functions.sql import context_at, fold, let, pieces, q, stab
from ..vocab.business import SENTINEL, TRACKED_FIELDS
from ..sources import mail
from . import entities, fusion, patterns, sections, tables

# Report thresholds.
PROBLEM_RATE, TOP_RATE, TOP_N = 0.5, 0.8, 5
BEST_RATE, WEAK_RATE, LEAST_USES = 0.7, 0.3, 5
SPEED_CLASSES = [
    (0.5, "Fast (< 0.5s/file)"), (1.5, "Medium (0.5-1.5s/file)"), (5.0, "Slow (1.5-5s/file)"), (None, "Very Slow (> 5s/file)"),
]


def plausible(field: str) -> Column:
    """Present and of the right shape for its field."""
    v = F.col(field)
    digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
    ok = F.trim(v) != ""
    if field.endswith("npi"):
        ok &= digits == 10
    elif field == "tin":
        ok &= digits == 9
    elif field in ("phone_number", "fax_number"):
        ok &= digits >= 10
    elif field.endswith("date"):
        ok &= v.contains("/") | v.contains("-")
    return F.coalesce(ok & (v != SENTINEL), F.lit(False))


def field_success(records: DataFrame, fields: list[str] = TRACKED_FIELDS) -> DataFrame:
    """Successes and total per tracked field.

    One pass with one counter per field; only the one-row result is unpivoted.
    """
    counts = records.agg(F.count("*").alias("total"), *[F.count_if(plausible(f)).alias(f) for f in fields])
    listed = ", ".join(f"named_struct('field', '{f}', 'field_ord', {i}, 'success', `{f}`)" for i, f in enumerate(fields))
    return counts.transform(explode_rows, ["total"], f"array({listed})", "f").select(
        "f.field", "f.field_ord", "f.success", "total")


def field_analysis(success: DataFrame) -> DataFrame:
    """Rate per field, problem and top flags, and the mean rate.  Input has one row per tracked field."""
    rated = success.filter("total > 0").withColumn("rate", F.col("success") / F.col("total"))
    rank = F.row_number().over(Window.orderBy(F.col("rate").desc(), "field_ord"))
    return rated.select(
        "field", "success", "total", "rate", (F.col("rate") < PROBLEM_RATE).alias("problem"),
        ((rank <= TOP_N) & (F.col("rate") > TOP_RATE)).alias("top"),
        F.avg("rate").over(Window.partitionBy()).alias("overall_rate"))


def extractor_analysis(candidates: DataFrame) -> DataFrame:
    """Success rate per extractor; success is a confidence over 0.5."""
    return judged(candidates.groupBy("extractor_id").agg(
        F.count_if(F.col("confidence") > 0.5).alias("success"), F.count("*").alias("total")))


def judged(by: DataFrame) -> DataFrame:
    """Rate and verdict of extractors with ``success`` and ``total``."""
    rate = F.col("success") / F.col("total")
    used = F.col("total") >= LEAST_USES
    verdict = F.when(used & (rate > BEST_RATE), "best").when(used & (rate < WEAK_RATE), "weak").otherwise("")
    return by.select("extractor_id", "success", "total", rate.alias("rate"), verdict.alias("verdict"))


def stage_timing(stages: DataFrame) -> DataFrame:
    """Mean, least and greatest seconds and calls per stage.  Exact: sums are decimal."""
    seconds = F.col("seconds").cast("decimal(18,6)")
    by = stages.groupBy("stage").agg(
        F.sum(seconds).alias("s"), F.count("*").alias("calls"), F.min("seconds").alias("min_seconds"), F.max("seconds").alias("max_seconds"))
    return by.select("stage", (F.col("s").cast("double") / F.col("calls")).alias("mean_seconds"), "min_seconds", "max_seconds", "calls")


def speed_class(mean_seconds: Column) -> Column:
    out = F.lit(SPEED_CLASSES[-1][1])
    for limit, label in reversed(SPEED_CLASSES[:-1]):
        out = F.when(mean_seconds < limit, label).otherwise(out)
    return out


def turn_around(files: DataFrame) -> DataFrame:
    """Files, total and mean seconds, files per minute, speed class over successful files."""
    done = files.filter("success").agg(
        F.count("*").alias("total_files"), F.sum(F.col("seconds").cast("decimal(18,6)")).cast("double").alias("total_seconds"))
    mean = F.coalesce(F.col("total_seconds") / F.col("total_files"), F.lit(0.0))
    return done.select(
        "total_files", F.coalesce("total_seconds", F.lit(0.0)).alias("total_seconds"), mean.alias("mean_seconds"),
        F.when(mean > 0, 60 / mean).otherwise(0.0).alias("files_per_minute"), speed_class(mean).alias("speed"))


def run_success(files: DataFrame) -> DataFrame:
    """Successes, failures and success over files."""
    n = files.agg(F.count_if("success").alias("success_count"), F.count_if(~F.col("success")).alias("failure_count"))
    total = F.greatest(F.col("success_count") + F.col("failure_count"), F.lit(1))
    return n.select("success_count", "failure_count", (F.col("success_count") / total).alias("success_rate"))


def field_provenance(prepared: DataFrame, field: str, checksum: str = "standard") -> DataFrame:
    """Every candidate of one field with place and context, most confident first per message."""
    ranked = (
        "transform(array_sort(transform(cs, (c, i) -> named_struct('rank', -c.confidence, 'ord', i, 'c', c))), s -> s.c)"
    )
    found = prepared.transform(explode_rows, ["msg_id"], let(patterns.scan_with_positions("text", field, checksum), "cs", ranked), "rank", "c")
    return found.select("msg_id", "rank", "c.field", "c.value", "c.extractor_id", "c.confidence", "c.position",
                        "c.context", "c.validation_passed")


def provenance(prepared: DataFrame, gap: int = 2, checksum: str = "standard", compat: bool = False, known=None) -> DataFrame:
    """Every candidate of every field of the message text: where it stands, what is around it, which block holds it.

    Columns: msg_id, field, rank (per message and field, most confident first),
    value, extractor_id, confidence, position, context, block_id,
    validation_passed.  Pattern and word date matches have their own position;
    other values are looked up in the text without regard to case, and have none
    where they are not written there (canonical names, combined ids).  Positions
    meet the spans of the blocks in one sweep; a message without blocks is its
    own block 0, and a place outside all blocks has no block.
    """
    own = " ".join(f"WHEN {q(f)} THEN get(get(st.{f}, c.pattern_ord), c.match_ord)" for f in patterns.FIELDS)
    words = f"array({', '.join(patterns.match_places('text', p) for p, _ in entities.WORD_DATES)})"
    position = (
        f"CASE WHEN startswith(c.extractor_id, concat(c.field, '_pattern_')) THEN CASE c.field {own} END "
        "WHEN startswith(c.extractor_id, 'date_fallback_') THEN get(get(wd, c.pattern_ord), c.match_ord) "
        "ELSE nullif(instr(lt, lower(c.value)), 0) - 1 END"
    )
    line_starts = fold(tx.lines("text"), "0", lambda s, x: f"named_struct('s', {s} + length({x}) + 1, 'e', array({s}))", "int")
    span = "named_struct('first', get(ls, b.start_line), 'past', coalesce(get(ls, b.end_line + 1), length(text) + 1))"
    spans = f"if(size(blocks) = 0, array(named_struct('first', 0, 'past', length(text) + 1)), transform(blocks, b -> {span}))"
    reach = "CASE c.c.field " + " ".join(f"WHEN {q(f)} THEN {n}" for f, n in patterns.CONTEXT.items()) + " ELSE 20 END"
    ranked = fold(
        "array_sort(transform(cs, (c, i) -> named_struct('field', c.field, 'confidence', -c.confidence, 'ord', i, 'c', named_struct('c', c, 'at', get(at, i), 'block', get(stabbed, i)))))",
        "named_struct('field', '', 'n', 0)",
        lambda s, x: let(f"if({s}.field = {x}.field, {s}.n + 1, 0)", "rk", f"named_struct('s', named_struct('field', {x}.field, 'n', rk), 'e', array(named_struct('rank', rk, 'of', {x}.c)))"),
        f"struct<rank:int,of:struct<c:{patterns.CANDIDATE},at:int,block:int>>")
    rows = (
        prepared.select("msg_id", "text", F.expr(sections.blocks("text", gap)).alias("blocks"),
                        F.expr(fusion.all_scans("text", compat, checksum, known=known)).alias("cs"), F.expr(patterns.places("text")).alias("st"), F.expr(words).alias("wd"),
                        F.expr(line_starts).alias("ls"))
        .select("msg_id", "text", "cs", F.expr(spans).alias("spans"), F.expr(let("lower(text)", "lt", f"transform(cs, c -> cast({position} as int))")).alias("at"))
        .select("msg_id", "cs", "at", F.expr(stab("at", "spans")).alias("stabbed"), F.expr(pieces("text")).alias("pcs"))
    )
    context = f"if(c.at IS NULL, cast(null as string), {context_at('pcs', 'c.at', reach)})"
    made = f"named_struct('rank', r.rank, 'c', c, 'context', {context})"
    built = f"transform({ranked}, r -> {let('r.of', 'c', made)})"
    return rows.transform(explode_rows, ["msg_id"], built, "p").select(
        "msg_id", "p.c.c.field", "p.rank", "p.c.c.value", "p.c.c.extractor_id", "p.c.c.confidence", F.col("p.c.at").alias("position"), "p.context",
        F.col("p.c.block").alias("block_id"), "p.c.c.validation_passed")


def _message_candidates(compat: bool = False, checksum: str = "standard", known=None) -> str:
    fields = "named_struct('field', c.field, 'value', c.value, 'confidence', c.confidence, 'extractor_id', c.extractor_id, 'passed', c.validation_passed)"
    full = fusion.all_scans("text", compat, checksum, known=known)
    cells = tables.message_table_candidates("text", "html_content")
    return f"concat(transform({full}, c -> {fields}), transform({cells}, c -> {fields}))"


def candidate_report(prepared: DataFrame, known=None) -> DataFrame:
    """Message-wide and table candidates grouped by field, most confident first."""
    one = (
        "named_struct('field', f, 'candidates', transform(array_sort(transform(filter(cs, c -> c.field = f), (c, i) -> "
        "named_struct('rank', -c.confidence, 'ord', i, 'c', c))), s -> s.c))"
    )
    grouped = let(_message_candidates(known=known), "cs", f"transform(array_distinct(transform(cs, c -> c.field)), f -> {one})")
    return prepared.transform(explode_rows, ["msg_id"], grouped, "g").select(
        "msg_id", "g.field", F.size("g.candidates").alias("n"),
        F.expr("array_join(transform(g.candidates, c -> concat(c.value, ' (', c.extractor_id, ')')), '; ')").alias("candidates"))


def message_summary(prepared: DataFrame, gap: int = 2, known=None) -> DataFrame:
    """Totals per message: candidates, successes, rate, blocks, tables."""
    totals = let(
        _message_candidates(known=known), "cs",
        "named_struct('total', size(cs), 'good', size(filter(cs, c -> c.passed AND c.confidence > 0.5D)))",
    )
    html = f"coalesce(html_content, {q(' ')})"
    rows = prepared.select(
        "msg_id", F.expr(totals).alias("t"), F.expr(f"size({sections.blocks('text', gap)})").alias("blocks"),
        F.expr(f"size({tables.html_tables(html)}) + size({tables.text_tables('text')})").alias("tables"))
    return rows.select(
        "msg_id", F.col("t.total").alias("candidates"), F.col("t.good").alias("successful"),
        (F.col("t.good") / F.greatest(F.col("t.total"), F.lit(1))).alias("success_rate"), "blocks", "tables")


def processing_summary(decoded: DataFrame, gap: int = 2, known=None) -> DataFrame:
    """Summary of every message of :func:`rosterline.sources.mail.decode`.

    The totals of :func:`message_summary`, with attachments, errors, warnings
    (text parts that could not be read) and the seconds of its decoding.  A
    message that could not be decoded is summed up over its error text.
    """
    normal = tx.normalize_message("text_content", "html_content")
    found = mail.messages(decoded).select("msg_id", "source_file", "html_content", "parse_error", "parts", "seconds", F.expr(f"{normal}.text").alias("text"))
    totals = let(
        _message_candidates(known=known), "cs",
        "named_struct('total', size(cs), 'good', size(filter(cs, c -> c.passed AND c.confidence > 0.5D)))")
    html = f"coalesce(html_content, {q(' ')})"
    unread = "p.content_type IN ('text/plain', 'text/html') AND p.text IS NULL"
    rows = found.select(
        "msg_id", "source_file", F.expr(totals).alias("t"), F.expr(f"size({sections.blocks('text', gap)})").alias("blocks"),
        F.expr(f"size({tables.html_tables(html)}) + size({tables.text_tables('text')})").alias("tables"),
        F.expr("size(filter(parts, p -> p.payload IS NOT NULL))").alias("attachments"), F.col("parse_error").isNotNull().cast("int").alias("errors"),
        F.expr(f"size(filter(parts, p -> {unread}))").alias("warnings"), "seconds")
    return rows.select(
        "msg_id", "source_file", F.col("t.total").alias("candidates"), F.col("t.good").alias("successful"),
        (F.col("t.good") / F.greatest(F.col("t.total"), F.lit(1))).alias("success_rate"), "blocks", "tables", "attachments", "errors", "warnings", "seconds")


def metrics_report(records: DataFrame, files: DataFrame, candidates: DataFrame) -> DataFrame:
    """Full report as rows ``(section, entry)``; ``entry`` is JSON.

    Sections: session, turn_around (one row each), field (one row per tracked
    field), extractor (one row per extractor family).
    """
    def section(name, df):
        return df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("entry"))

    # tables give one extractor per cell place; one family keeps the report small
    family = candidates.withColumn("extractor_id", F.regexp_replace("extractor_id", "^table_row_.*$", "table"))
    parts = [
        section("session", run_success(files)),
        section("turn_around", turn_around(files)),
        section("field", field_analysis(field_success(records))),
        section("extractor", extractor_analysis(family)),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def traces(prepared: DataFrame, gap: int = 2, known=None) -> DataFrame:
    """One trace per message: all its candidates as an array, block count, trim flag."""
    return prepared.select(
        "msg_id", "thread_trimmed", F.expr(f"size({sections.blocks('text', gap)})").alias("blocks_detected"),
        F.expr(_message_candidates(known=known)).alias("field_traces"))


def file_runs(decoded: DataFrame, gap: int = 2) -> DataFrame:
    """Log of a batch, one row per message of :func:`rosterline.sources.mail.decode`.

    Success, number of records, attachments, warnings (text parts that could not
    be read), error, and the seconds that decoding took.
    """
    found = mail.messages(decoded).withColumn("text", F.expr(f"{tx.normalize_message('text_content', 'html_content')}.text"))
    readable = "p.content_type IN ('text/plain', 'text/html')"
    return found.select(
        "msg_id", "source_file", F.col("parse_error").isNull().alias("success"),
        F.expr(f"size({sections.blocks_or_default('text', gap)})").alias("records"), F.col("parse_error").alias("error"),
        F.expr("size(filter(parts, p -> p.payload IS NOT NULL))").alias("attachments"),
        F.expr(f"size(filter(parts, p -> {readable} AND p.text IS NULL))").alias("warnings"), "seconds")
