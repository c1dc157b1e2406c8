"""Queries over quality reports, attachments, decoding and streaming."""

from __future__ import annotations

import os
import re
from functools import partial

from pyspark.sql import functions as F

from ..functions.frames import explode_rows, made_rows, spread
from ..operators import batch, counters, entities, fusion, patterns, quality, records
from ..session import shared_folder
from ..sources import attachments, delimited, fixture as fx, mail as mail_source
from ..sources import mailbox, sinks
from ..streaming import metrics_stream, roster_stream
from ..vocab.business import EXTRACTOR_PRIORITY, OUTPUT_COLUMNS, TRACKED_FIELDS
from ..vocab.headers import attachment_rows
from .record_queries import _COLS, DMG, FINAL_CTE, REC, RID, S, _damaged, final_records, raw_records, cells_cte, readable_cte, records_cte
from .registry import MAIL_CTE, MIXED_CTE, RENDERED_CTE, lit, query
from .scan_queries import hits_sql, luhn, ppg_cte, re2, scan_sql
from .section_queries import blocks_cte, candidates_cte, cue_text_cte, cues_cte, header_map_cte, lines_cte, tables_cte
from .entity_queries import context_sql, lob_cte, names_sql, organization_cte, specialties_cte, type_cte, word_dates_sql
from .text_queries import TRIM_CTE, WS, clean_sql, punct_sql

# --- fields ----------------------------------------------------------------


def plausible_sql(c: str) -> str:
    d = f"length(regexp_replace({c}, '[^0-9]', '', 'g'))"
    more = "true"
    if c.endswith("npi"):
        more = f"{d} = 10"
    elif c == "tin":
        more = f"{d} = 9"
    elif c in ("phone_number", "fax_number"):
        more = f"{d} >= 10"
    elif c.endswith("date"):
        more = f"(contains({c}, '/') OR contains({c}, '-'))"
    return f"({c} <> {S} AND trim({c}) <> '' AND {more})"


def success_cte(src: str, out: str) -> str:
    return f"{out} AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS field, {i} AS field_ord, count(*) FILTER (WHERE {plausible_sql(c)}) AS success, count(*) AS total FROM {src}"
        for i, c in enumerate(TRACKED_FIELDS)) + ")"


ANALYSIS_SQL = """SELECT field, success, total, success / total::DOUBLE AS rate, success / total::DOUBLE < 0.5 AS problem,
    row_number() OVER (ORDER BY success / total::DOUBLE DESC, field_ord) <= 5 AND success / total::DOUBLE > 0.8 AS top,
    avg(success / total::DOUBLE) OVER () AS overall_rate FROM fs WHERE total > 0"""


@query("field_success", f"{REC}, {success_cte('rec', 'fs')} SELECT field, field_ord, success, total FROM fs")
def field_success(spark, sf):
    return quality.field_success(raw_records(spark, sf))


@query("field_success_damaged", f"{DMG}, {success_cte('dmg', 'fs')} SELECT field, field_ord, success, total FROM fs")
def field_success_damaged(spark, sf):
    return quality.field_success(_damaged(spark, sf))


@query("value_plausibility", f"{DMG} SELECT msg_id, {', '.join(f'{plausible_sql(c)} AS {c}' for c in TRACKED_FIELDS)} FROM dmg")
def value_plausibility(spark, sf):
    return _damaged(spark, sf).select("msg_id", *[quality.plausible(c).alias(c) for c in TRACKED_FIELDS])


@query("field_analysis", f"{REC}, {success_cte('rec', 'fs')} {ANALYSIS_SQL}")
def field_analysis(spark, sf):
    return quality.field_analysis(quality.field_success(raw_records(spark, sf)))


# --- candidates ------------------------------------------------------------

def _scope_sql(scope: str, src: str, key: str, p: str) -> str:
    """All scan candidates of one scope."""
    parts = []
    for f in patterns.FIELDS:
        rows = f"(SELECT * FROM {p}ppg)" if f == "ppg" else f"({scan_sql(f, src, key, 'text')})"
        parts.append(f"SELECT {key}, '{f}' AS field, value, confidence, extractor_id, i AS pattern_ord, match_ord, validation_passed FROM {rows}")
    parts.append(f"SELECT {key}, 'provider_name', value, confidence, extractor_id, i, match_ord, true FROM ({names_sql(src, key, 'text')})")
    parts.append(f"SELECT {key}, 'date', value, confidence, extractor_id, i, match_ord, true FROM ({word_dates_sql(src, key, 'text')})")
    parts.append(f"SELECT {key}, 'line_of_business', value, 0.9::DOUBLE, 'lob_gazetteer', 0, (row_number() OVER (PARTITION BY {key} ORDER BY ord) - 1)::INT, true FROM {p}lob")
    bars = f"SELECT * FROM {p}pc c WHERE NOT EXISTS (SELECT 1 FROM {p}oc o WHERE o.{key} = c.{key})"
    parts.append(f"SELECT {key}, 'organization', value, confidence, 'pattern_org_extended', 0, (row_number() OVER (PARTITION BY {key} ORDER BY rk) - 1)::INT, true FROM (SELECT * FROM {p}oc UNION ALL {bars})")
    parts.append(f"SELECT {key}, 'specialty', value, confidence, extractor_id, 0, (row_number() OVER (PARTITION BY {key} ORDER BY rank) - 1)::INT, true FROM {p}sp")
    parts.append(f"SELECT {key}, 'transaction_type', value, confidence, extractor_id, 0, 0, true FROM {p}ty WHERE value IS NOT NULL")
    return (
        f"{ppg_cte(src, key, 'text', p + 'ppg')}, {lob_cte(src, key, 'text', p + 'lob')}, {organization_cte(src, key, 'text', p)}, "
        f"{specialties_cte(src, key, 'text', p)}, {type_cte(src, key, 'text', p + 'ty')}, {p}all AS ({' UNION ALL '.join(parts)})"
    )


PREP_CTE = f"""
    raw AS (SELECT msg_id, body AS text_content, {punct_sql(clean_sql('body'))} AS body FROM mail),
    {TRIM_CTE.replace('FROM mail)', 'FROM raw)', 1)}, msg AS (SELECT msg_id, text, thread_trimmed FROM trimmed)"""
CAND_CTE = f"""
    {PREP_CTE}, {lines_cte('msg', 'text')}, {cues_cte()}, {cue_text_cte()}, {blocks_cte('msg', 'text', 2)},
    blk AS (SELECT {RID} AS rid, * FROM blocks),
    {tables_cte('msg', 'text')}, {header_map_cte('t_cells', 'header')}, {candidates_cte('t_cells', 'text', 'tc')},
    {_scope_sql('full', 'msg', 'msg_id', 'f_')}, {_scope_sql('block', 'blk', 'rid', 'b_')},
    cand AS (SELECT msg_id, NULL::INT AS block_id, 'full' AS scope, field, value, confidence, extractor_id, pattern_ord, match_ord, validation_passed FROM f_all
        UNION ALL SELECT msg_id, NULL, 'table', field, value, confidence, concat('table_row_', row_idx, '_col_', col_idx), table_id, row_idx, true FROM tc
        UNION ALL SELECT rid // 4294967296, (rid % 4294967296)::INT, 'block', field, value, confidence, extractor_id, pattern_ord, match_ord, validation_passed FROM b_all)"""
CAND = f"WITH RECURSIVE {MAIL_CTE}, {CAND_CTE}"
_CAND_COLS = "msg_id, block_id, scope, field, value, confidence, extractor_id, pattern_ord, match_ord, validation_passed"


def _prepared(spark, sf):
    return fusion.prepare(fx.messages(spark, sf))


def _with_known(build):
    """A report over the candidates, the specialty phrases of the batch scored once."""
    def run(spark, sf):
        prepared = _prepared(spark, sf)
        return build(prepared, known=fusion.known_phrases(prepared))

    return run


_candidates = _with_known(fusion.candidates)


@query("candidates", f"{CAND} SELECT {_CAND_COLS} FROM cand")
def candidates(spark, sf):
    return _candidates(spark, sf)


_PRIORITY = "CASE " + " ".join(f"WHEN starts_with(extractor_id, '{p}') THEN {n}" for p, n in EXTRACTOR_PRIORITY.items()) + " ELSE 0 END"


def _ranking_sql(first: str) -> str:
    return f"""
    {CAND}, k AS (SELECT *, {_PRIORITY} AS p, row_number() OVER (PARTITION BY msg_id, field ORDER BY {first},
        CASE scope WHEN 'table' THEN 0 WHEN 'full' THEN 1 ELSE 2 END, coalesce(block_id, -1), pattern_ord, match_ord, extractor_id DESC, value DESC) AS rn FROM cand)
    SELECT msg_id, field, value, p::INT AS priority, confidence, extractor_id FROM k WHERE rn = 1"""


@query("priority_ranking", _ranking_sql(f"{_PRIORITY} DESC, confidence DESC"))
def priority_ranking(spark, sf):
    return _with_known(fusion.ranked_candidates)(spark, sf)


@query("confidence_ranking", _ranking_sql(f"confidence DESC, {_PRIORITY} DESC"))
def confidence_ranking(spark, sf):
    """Best candidates by confidence first, by the priority of their extractors only among equals."""
    return _with_known(partial(fusion.ranked_candidates, rank_by="confidence"))(spark, sf)


@query("extractor_analysis", f"""
    {CAND}, per AS (SELECT extractor_id, count(*) FILTER (WHERE confidence > 0.5) AS success, count(*) AS total FROM cand GROUP BY 1)
    SELECT extractor_id, success, total, success / total::DOUBLE AS rate, CASE WHEN total >= 5 AND success / total::DOUBLE > 0.7 THEN 'best'
        WHEN total >= 5 AND success / total::DOUBLE < 0.3 THEN 'weak' ELSE '' END AS verdict FROM per""")
def extractor_analysis(spark, sf):
    return quality.extractor_analysis(_candidates(spark, sf))


@query("field_provenance", f"""
    WITH {MAIL_CTE}, {PREP_CTE}, h AS ({hits_sql('msg', 'msg_id', 'text', patterns.NPI)}), f AS (SELECT msg_id, i, o, m, (SELECT text FROM msg WHERE msg.msg_id = h.msg_id) AS text FROM h),
    q AS (SELECT *, regexp_extract_all(text, '(?i)NPI[:\\s#]*(\\d{{10}})', 0) AS hs, string_split_regex(text, '(?i)NPI[:\\s#]*\\d{{10}}') AS gs FROM f),
    p AS (SELECT *, (list_sum(list_transform(gs[1:o+1], lambda g: length(g))) + coalesce(list_sum(list_transform(hs[1:o], lambda g: length(g))), 0))::INT AS position FROM q WHERE i = 0)
    SELECT msg_id, (row_number() OVER (PARTITION BY msg_id ORDER BY CASE WHEN {luhn('m')} THEN 0 ELSE 1 END, o) - 1)::INT AS rank, 'npi' AS field, m AS value, 'npi_pattern_0' AS extractor_id,
        CASE WHEN {luhn('m')} THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence, position, {context_sql('text', 'position', 20, 20, '0')} AS context, {luhn('m')} AS validation_passed FROM p""")
def field_provenance(spark, sf):
    return quality.field_provenance(_prepared(spark, sf), "npi")


def _places_sql(field: str, shapes: list[str], src: str = "msg", text: str = "text") -> str:
    """Match starts of the patterns of one field: ``msg_id, field, i, o, position``."""
    parts = []
    for i, p in enumerate(shapes):
        full = lit("(?i)" + re.sub(r"(?<!\\)\((?!\?)", "(?:", re2(p)))
        parts.append(f"""SELECT msg_id, '{field}' AS field, {i} AS i, o, (list_sum(list_transform(gs[1:o + 1], lambda g: length(g))) + coalesce(list_sum(list_transform(hs[1:o], lambda g: length(g))), 0))::INT AS position
            FROM (SELECT msg_id, gs, hs, unnest(range(0, len(hs)))::INT AS o FROM (SELECT msg_id, string_split_regex({text}, {full}) AS gs, regexp_extract_all({text}, {full}, 0) AS hs FROM {src}))""")
    return " UNION ALL ".join(parts)


@query("match_context", f"""
    WITH {MAIL_CTE}, p AS ({_places_sql('npi', patterns.NPI, 'mail', 'body')})
    SELECT msg_id, i AS pattern_ord, o AS match_ord, position, {context_sql('body', 'position', 20, 20, '0')} AS context FROM p JOIN mail USING (msg_id)""")
def match_context(spark, sf):
    """Context of every match of every identifier pattern."""
    found = fx.mail(spark, sf).transform(explode_rows, ["msg_id"], patterns.scan_with_positions("body", "npi"), "c")
    return found.select("msg_id", "c.pattern_ord", "c.match_ord", "c.position", "c.context")


_REACH = "CASE field " + " ".join(f"WHEN '{f}' THEN {n}" for f, n in patterns.CONTEXT.items()) + " ELSE 20 END"
_WHERE = "substr(text, 1, position)"


@query("provenance", f"""
    WITH RECURSIVE {MAIL_CTE}, {PREP_CTE}, {lines_cte('msg', 'text')}, {cues_cte()}, {cue_text_cte()}, {blocks_cte('msg', 'text', 2)}, {_scope_sql('full', 'msg', 'msg_id', 'f_')},
    places AS MATERIALIZED ({" UNION ALL ".join(_places_sql(f, patterns._FIELDS[f][0]) for f in patterns.FIELDS)} UNION ALL {_places_sql('word', [p for p, _ in entities.WORD_DATES])}),
    c AS (SELECT a.*, m.text, CASE WHEN starts_with(extractor_id, concat(field, '_pattern_')) THEN field WHEN starts_with(extractor_id, 'date_fallback_') THEN 'word' END AS kind FROM f_all a JOIN msg m USING (msg_id)),
    d AS (SELECT c.*, CASE WHEN kind IS NULL THEN nullif(strpos(lower(text), lower(value)), 0) - 1 ELSE p.position END::INT AS position FROM c
        LEFT JOIN places p ON p.msg_id = c.msg_id AND p.field = c.kind AND p.i = c.pattern_ord AND p.o = c.match_ord),
    e AS (SELECT *, length({_WHERE}) - length(replace({_WHERE}, chr(10), '')) AS line FROM d)
    SELECT e.msg_id, field, (row_number() OVER (PARTITION BY e.msg_id, field ORDER BY e.confidence DESC, coalesce(kind = 'word', false), pattern_ord, match_ord) - 1)::INT AS rank, value, extractor_id, e.confidence,
        position, CASE WHEN position IS NOT NULL THEN trim(replace(substr(e.text, greatest(position - {_REACH}, 0) + 1, position + {_REACH} - greatest(position - {_REACH}, 0)), chr(10), ' '), {WS}) END AS context,
        b.block_id, validation_passed FROM e LEFT JOIN blocks b ON b.msg_id = e.msg_id AND e.position IS NOT NULL AND e.line BETWEEN b.start_line AND b.end_line""")
def provenance(spark, sf):
    """All candidates of all fields of the messages, with place, context and block."""
    return _with_known(quality.provenance)(spark, sf)


@query("candidate_report", f"""
    {CAND}, u AS (SELECT *, CASE scope WHEN 'full' THEN 0 ELSE 1 END AS so,
        CASE WHEN scope = 'table' THEN 0 WHEN starts_with(extractor_id, 'date_fallback') THEN 1 ELSE 0 END AS src, try_cast(regexp_extract(extractor_id, '_col_(\\d+)$', 1) AS INT) AS col
        FROM cand WHERE scope <> 'block')
    SELECT msg_id, field, count(*)::INT AS n, string_agg(concat(value, ' (', extractor_id, ')'), '; ' ORDER BY confidence DESC, so, src, pattern_ord, match_ord, col) AS candidates FROM u GROUP BY 1, 2""")
def candidate_report(spark, sf):
    return _with_known(quality.candidate_report)(spark, sf)


@query("message_summary", f"""
    {CAND}, c AS (SELECT msg_id, count(*)::INT AS n, (count(*) FILTER (WHERE validation_passed AND confidence > 0.5))::INT AS good FROM cand WHERE scope <> 'block' GROUP BY 1),
    b AS (SELECT msg_id, count(*)::INT AS n FROM blk WHERE indicators <> '' GROUP BY 1), t AS (SELECT msg_id, count(*)::INT AS n FROM t_tab GROUP BY 1)
    SELECT m.msg_id, coalesce(c.n, 0) AS candidates, coalesce(c.good, 0) AS successful, coalesce(c.good, 0) / greatest(coalesce(c.n, 0), 1)::DOUBLE AS success_rate,
        coalesce(b.n, 0) AS blocks, coalesce(t.n, 0) AS tables FROM msg m LEFT JOIN c USING (msg_id) LEFT JOIN b USING (msg_id) LEFT JOIN t USING (msg_id)""")
def message_summary(spark, sf):
    return _with_known(quality.message_summary)(spark, sf)


@query("candidate_quality", f"""
    WITH c AS ({scan_sql('phone', 'documents', 'doc_id', 'text')}), n AS (SELECT doc_id, count(*) AS k FROM c GROUP BY 1)
    SELECT l.quality, l.toxic, count(*) AS documents, coalesce(sum(n.k), 0)::BIGINT AS candidates FROM labels l LEFT JOIN n USING (doc_id) GROUP BY 1, 2""")
def candidate_quality(spark, sf):
    """Phone candidates of labelled documents.  Counts are made in the document row before the join."""
    docs = fx.table(spark, sf, "documents").select("doc_id", F.expr(f"size({patterns.scan('text', 'phone')})").alias("k")).filter("k > 0")
    return fx.table(spark, sf, "labels").join(docs, "doc_id", "left").groupBy("quality", "toxic").agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("k"), F.lit(0)).cast("bigint").alias("candidates"))


# --- timing ----------------------------------------------------------------

_STAGES = [("mime_parsing", 1), ("extraction", 2), ("export", 3)]


def runs_sql(table: str = "customer") -> str:
    return " UNION ALL ".join(
        f"SELECT c_custkey AS msg_id, '{s}' AS stage, ((c_custkey * 37 + {n} * 11) % 400)::INT AS cs, c_custkey % 17 <> 0 AS success FROM {table}" for s, n in _STAGES)


def _runs(spark, sf):
    stages = ", ".join(f"named_struct('stage', '{s}', 'cs', cast((c_custkey * 37 + {n} * 11) % 400 as int))" for s, n in _STAGES)
    rows = fx.table(spark, sf, "customer").selectExpr("c_custkey AS msg_id", "c_custkey % 17 <> 0 AS success", f"array({stages}) AS st")
    return rows.select("msg_id", "success", F.explode("st").alias("s")).select(
        "msg_id", "success", "s.stage", (F.col("s.cs") / 100.0).alias("seconds"))


def _files(spark, sf):
    cs = " + ".join(f"(c_custkey * 37 + {n} * 11) % 400" for _, n in _STAGES)
    return fx.table(spark, sf, "customer").selectExpr(
        "c_custkey AS msg_id", "c_custkey % 17 <> 0 AS success", f"cast(({cs}) / 100.0D as decimal(18,6)) AS seconds")


_TIMING_SQL = "SELECT stage, sum(seconds::DECIMAL(18,6))::DOUBLE / count(*) AS mean_seconds, min(seconds) AS min_seconds, max(seconds) AS max_seconds, count(*) AS calls FROM {} GROUP BY 1"


@query("stage_timing", f"WITH r AS (SELECT stage, cs / 100.0::DOUBLE AS seconds FROM ({runs_sql()}) WHERE success) {_TIMING_SQL.format('r')}")
def stage_timing(spark, sf):
    return quality.stage_timing(_runs(spark, sf).filter("success"))


@query("event_timing", f"WITH r AS (SELECT event_type AS stage, value / 1000.0::DOUBLE AS seconds FROM events) {_TIMING_SQL.format('r')}")
def event_timing(spark, sf):
    return quality.stage_timing(fx.table(spark, sf, "events").selectExpr("event_type AS stage", "value / 1000.0D AS seconds"))


_SPEED_SQL = "CASE WHEN {0} < 0.5 THEN 'Fast (< 0.5s/file)' WHEN {0} < 1.5 THEN 'Medium (0.5-1.5s/file)' WHEN {0} < 5 THEN 'Slow (1.5-5s/file)' ELSE 'Very Slow (> 5s/file)' END"


@query("speed_class", f"SELECT event_id, {_SPEED_SQL.format('value / 10')} AS speed FROM events")
def speed_class(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", quality.speed_class(F.col("value") / 10).alias("speed"))


@query("turn_around", f"""
    WITH f AS (SELECT msg_id, sum(cs) AS cs, any_value(success) AS success FROM ({runs_sql()}) GROUP BY 1), t AS (SELECT count(*) AS n, sum(cs) AS cs FROM f WHERE success)
    SELECT n AS total_files, cs / 100.0::DOUBLE AS total_seconds, cs / 100.0::DOUBLE / n AS mean_seconds, 60 / (cs / 100.0::DOUBLE / n) AS files_per_minute, {_SPEED_SQL.format('(cs / 100.0::DOUBLE / n)')} AS speed FROM t""")
def turn_around(spark, sf):
    return quality.turn_around(_files(spark, sf))


@query("run_success", """
    WITH n AS (SELECT count(*) FILTER (WHERE c_custkey % 17 <> 0) AS s, count(*) FILTER (WHERE c_custkey % 17 = 0) AS f FROM customer)
    SELECT s AS success_count, f AS failure_count, s / greatest(s + f, 1)::DOUBLE AS success_rate FROM n""")
def run_success(spark, sf):
    return quality.run_success(_files(spark, sf))


# --- attachments -----------------------------------------------------------

_FILES_SQL = "CASE c_custkey % 9 WHEN 0 THEN 'Roster.XLSX' WHEN 1 THEN 'a.b.csv' WHEN 2 THEN 'x.docx' WHEN 3 THEN 'scan.PDF' WHEN 4 THEN 'img.jpeg' WHEN 5 THEN 'run.exe' WHEN 6 THEN '' WHEN 7 THEN 'noext' ELSE concat(c_name, '.xls') END"
_ROUTE_SQL = (
    "CASE WHEN e IN ('xlsx', 'xls', 'csv') THEN 'spreadsheet' WHEN e = 'docx' THEN 'document' WHEN e = 'pdf' THEN 'pdf' "
    "WHEN e IN ('png', 'jpg', 'jpeg', 'tiff', 'bmp') THEN 'image' END"
)


@query("attachment_manifest", f"""
    WITH f AS (SELECT c_custkey AS msg_id, {_FILES_SQL} AS filename, c_custkey % 4 AS d FROM customer),
    r AS (SELECT msg_id, filename, lower(regexp_extract(filename, '\\.([^.]+)$', 1)) AS e FROM f WHERE d <> 0 AND filename <> '' AND d <> 3)
    SELECT msg_id, filename, {_ROUTE_SQL} AS reader FROM r WHERE {_ROUTE_SQL} IS NOT NULL""")
def attachment_manifest(spark, sf):
    parts = fx.table(spark, sf, "customer").selectExpr(
        "c_custkey AS msg_id", f"{_FILES_SQL} AS filename", "if(c_custkey % 4 = 0, 'inline', 'attachment') AS disposition",
        "if(c_custkey % 4 = 3, cast('' as binary), cast(c_name as binary)) AS payload")
    decoded = parts.selectExpr(
        "msg_id", "array(named_struct('idx', 0, 'content_type', 'application/octet-stream', 'disposition', disposition, "
        "'filename', filename, 'text', cast(null as string), 'payload', payload)) AS parts")
    return attachments.manifest(decoded).select("msg_id", "filename", "reader")


def attachment_field_cte(src: str, col: str, out: str) -> str:
    values = ", ".join(f"({i * 1000 + v}, '{f}', {lit(t)})" for f, i, t, v in attachment_rows())
    return f"""
    {out}_v AS (SELECT * FROM (VALUES {values}) AS v(ord, field, variant)),
    {out}_h AS (SELECT DISTINCT lower(trim({col}, {WS})) AS hd FROM {src}),
    {out} AS (SELECT hd, arg_min(field, (CASE WHEN hd = variant THEN 0 ELSE 1 END, ord)) AS field FROM {out}_h, {out}_v
        WHERE contains(hd, variant) OR len(list_filter(list_distinct(string_split(variant, ' ')), lambda w: list_contains(regexp_extract_all(hd, '\\S+'), w)))
            / len(list_distinct(string_split(variant, ' ')))::DOUBLE >= 0.8 GROUP BY 1)"""


_HEADER_TEXTS = (
    "SELECT concat(p_name, ' id') AS h FROM part UNION ALL SELECT concat('Group ', p_type, ' NPI') FROM part "
    "UNION ALL SELECT concat('of business line ', p_brand) FROM part UNION ALL SELECT concat('State  ', p_type, ' license ', p_size) FROM part"
)


@query("attachment_header_map", f"WITH hs AS ({_HEADER_TEXTS}), {attachment_field_cte('hs', 'h', 'am')} SELECT hd AS header, field FROM am")
def attachment_header_map(spark, sf):
    part = fx.table(spark, sf, "part")
    texts = part.select(F.explode(F.array(
        F.concat("p_name", F.lit(" id")), F.concat(F.lit("Group "), "p_type", F.lit(" NPI")),
        F.concat(F.lit("of business line "), "p_brand"), F.concat(F.lit("State  "), "p_type", F.lit(" license "), "p_size"))).alias("h"))
    headers = texts.select(F.lower(F.trim("h")).alias("header")).distinct()
    return headers.transform(made_rows, ["header"], attachments.map_attachment_header("header"), "field")


_CSV = (
    "concat('Provider Name,', CASE WHEN k % 2 = 0 THEN 'NPI #' ELSE 'Notes' END, ',\"Office, Phone\",License', chr(13), chr(10), "
    "'\"', person, ', \"\"MD\"\"\",', npi, ',', phone, ',', lic, chr(10), person, ',,', fax)"
)
_CSV_ROWS = """
    SELECT msg_id, 0 AS row_idx, 0 AS col_idx, 'Provider Name' AS header, 'provider_name' AS field, concat(person, ', "MD"') AS value FROM rendered UNION ALL
    SELECT msg_id, 0, 1, 'NPI #', 'npi', npi FROM rendered WHERE k % 2 = 0 UNION ALL SELECT msg_id, 0, 2, 'Office, Phone', 'phone', phone FROM rendered UNION ALL
    SELECT msg_id, 0, 3, 'License', 'license', lic FROM rendered UNION ALL SELECT msg_id, 1, 0, 'Provider Name', 'provider_name', person FROM rendered UNION ALL
    SELECT msg_id, 1, 1, 'NPI #', 'npi', '' FROM rendered WHERE k % 2 = 0 UNION ALL SELECT msg_id, 1, 2, 'Office, Phone', 'phone', fax FROM rendered UNION ALL
    SELECT msg_id, 1, 3, 'License', 'license', '' FROM rendered"""


@query("csv_attachment_rows", f"WITH {RENDERED_CTE} {_CSV_ROWS}")
def csv_attachment_rows(spark, sf):
    files = fx.rendered(spark, sf).selectExpr("msg_id", f"{_CSV} AS payload")
    return attachments.csv_cells(files)


_BLOCKS = "concat('\"', person, ', \"\"MD\"\"', chr(10), chr(10), 'second line\",', npi, ',\"', chr(10), ',\"\"x\"\"\",', phone)"


@query("csv_attachment_blocks", f"""
    WITH {RENDERED_CTE}, r AS (SELECT *, (c // 500)::BIGINT AS msg, row_number() OVER (PARTITION BY c // 500 ORDER BY c)::INT - 1 AS i FROM (SELECT *, msg_id::BIGINT AS c FROM rendered))
    SELECT msg AS msg_id, i AS row_idx, 0 AS col_idx, 'Provider Name' AS header, 'provider_name' AS field, concat(person, ', "MD"', chr(10), chr(10), 'second line') AS value FROM r
    UNION ALL SELECT msg, i, 1, 'NPI #', 'npi', npi FROM r UNION ALL SELECT msg, i, 3, 'Office, Phone', 'phone', phone FROM r""")
def csv_attachment_blocks(spark, sf):
    """Rosters of up to 500 providers, each one payload, read in blocks of 64 lines with records across them."""
    rows = fx.rendered(spark, sf).selectExpr("cast(msg_id as long) AS c", f"{_BLOCKS} AS line")
    files = rows.groupBy(F.expr("c div 500").alias("msg_id")).agg(F.sort_array(F.collect_list(F.struct("c", "line"))).alias("found"))
    head = "'Provider Name,NPI #,Notes,\"Office, Phone\"'"
    payload = F.expr(f"concat({head}, chr(10), array_join(found.line, chr(10)))").alias("payload")
    return delimited.cells(delimited.payload_lines(files.select("msg_id", payload), block=64))


# --- decoding --------------------------------------------------------------

#: raw mails: plain and HTML alternative (quoted text in base64 for some), a CSV attachment; some unreadable
_EML = (
    "concat('From: ops@example.com', chr(10), 'To: network@example.com', chr(10), 'Subject: Mail ', cast(msg_id as string), ' of ', person, chr(10), "
    "'Message-ID: <', cast(msg_id as string), '@example.com>', chr(10), 'MIME-Version: 1.0', chr(10), "
    "'Content-Type: multipart/mixed; boundary=\"outer\"', chr(10), chr(10), '--outer', chr(10), "
    "'Content-Type: text/plain; charset=\"', if(k % 7 = 3, 'x-none', 'utf-8'), '\"', chr(10), "
    "if(k % 2 = 0, concat('Content-Transfer-Encoding: base64', chr(10), chr(10), base64(encode(concat(body, ' – end'), 'UTF-8'))), "
    "concat('Content-Transfer-Encoding: 8bit', chr(10), chr(10), body, ' – end')), chr(10), '--outer', chr(10), "
    "'Content-Type: text/html; charset=utf-8', chr(10), chr(10), html, chr(10), '--outer', chr(10), "
    "'Content-Type: text/csv', chr(10), 'Content-Disposition: attachment; filename=\"roster ', cast(msg_id as string), '.csv\"', chr(10), chr(10), 'NPI,TIN', chr(10), "
    "npi, ',', tin, chr(10), '--outer--', chr(10))"
)


def _raw_mails(spark, sf):
    return fx.rendered(spark, sf).selectExpr("*", f"{fx.HTML_SQL} AS html").selectExpr(
        "msg_id", "concat('mail_', msg_id, '.eml') AS source_file", f"if(k % 17 = 0, null, encode({_EML}, 'UTF-8')) AS content")


@query("mail_decode", f"""
    WITH {RENDERED_CTE}, h AS (SELECT *, {fx.HTML_SQL} AS html FROM rendered)
    SELECT msg_id::VARCHAR AS msg_id, concat('mail_', msg_id, '.eml') AS source_file,
        CASE WHEN k % 17 = 0 THEN NULL ELSE concat('Mail ', msg_id, ' of ', person) END AS subject,
        CASE WHEN k % 17 = 0 THEN 'Error reading email: no content' WHEN k % 7 = 3 THEN '' ELSE concat(body, ' – end') END AS text_content,
        CASE WHEN k % 17 = 0 THEN '' ELSE html END AS html_content, CASE WHEN k % 17 = 0 THEN 'no content' END AS parse_error FROM h""")
def mail_decode(spark, sf):
    decoded = mail_source.decode(_raw_mails(spark, sf))
    return mail_source.messages(decoded).select(
        "msg_id", "source_file", F.col("headers")["Subject"].alias("subject"), "text_content", "html_content", "parse_error")


@query("mail_attachments", f"""
    WITH {RENDERED_CTE} SELECT msg_id::VARCHAR AS msg_id, concat('roster ', msg_id, '.csv') AS filename, 0 AS row_idx, 0 AS col_idx, 'NPI' AS header, 'npi' AS field, npi AS value FROM rendered WHERE k % 17 <> 0
    UNION ALL SELECT msg_id::VARCHAR, concat('roster ', msg_id, '.csv'), 0, 1, 'TIN', 'tin', tin FROM rendered WHERE k % 17 <> 0""")
def mail_attachments(spark, sf):
    """Raw mails to the mapped cells of their CSV attachments."""
    found = attachments.manifest(mail_source.decode(_raw_mails(spark, sf))).filter("lower(filename) LIKE '%.csv'")
    return attachments.csv_cells(found.selectExpr("msg_id", "filename", "cast(payload as string) AS payload"))


#: decoded fixture mails as they leave the reader
DECODED_CTE = f"""{RENDERED_CTE}, h AS (SELECT *, {fx.HTML_SQL} AS html0 FROM rendered),
    mail AS (SELECT msg_id, CASE WHEN k % 17 = 0 THEN 'Error reading email: no content' WHEN k % 7 = 3 THEN '' ELSE concat(body, ' – end') END AS body,
        CASE WHEN k % 17 = 0 THEN '' ELSE html0 END AS html FROM h)"""


@query("batch_run_log", f"""
    WITH RECURSIVE {DECODED_CTE}, {readable_cte(True)}, {TRIM_CTE.replace('FROM mail)', 'FROM raw)', 1)}, msg AS (SELECT msg_id, text FROM trimmed),
    {lines_cte('msg', 'text')}, {cues_cte()}, {cue_text_cte()}, {blocks_cte('msg', 'text', 2)}, n AS (SELECT msg_id, count(*)::INT AS records FROM blocks GROUP BY 1)
    SELECT r.msg_id::VARCHAR AS msg_id, concat('mail_', r.msg_id, '.eml') AS source_file, k % 17 <> 0 AS success, records, CASE WHEN k % 17 = 0 THEN 'no content' END AS error,
        (k % 17 <> 0)::INT AS attachments, (k % 17 <> 0 AND k % 7 = 3)::INT AS warnings, true AS timed, count(*) OVER () AS files, count(*) FILTER (WHERE k % 17 = 0) OVER () AS failed,
        count(*) FILTER (WHERE k % 17 = 0) OVER () = 0 AS ok, 'decode,extract,log,write' AS stages FROM rendered r JOIN n USING (msg_id)""")
def batch_run_log(spark, sf):
    """Log of the fixture mails run as one batch; seconds differ from run to run and are only told to be there."""
    run = batch.run_batch(_raw_mails(spark, sf), shared_folder(spark, "batch"))
    stages = sorted(r["stage"] for r in run.stages.filter("seconds > 0").collect())
    return run.log.select(
        "msg_id", "source_file", "success", "records", "error", "attachments", "warnings", (F.col("seconds") > 0).alias("timed"),
        F.lit(run.files).cast("long").alias("files"), F.lit(run.failed).cast("long").alias("failed"), F.lit(run.ok).alias("ok"), F.lit(",".join(stages)).alias("stages"))


def _html_candidates_cte(mails: str) -> str:
    """Like :data:`CAND` for mails with HTML parts."""
    return f"""WITH RECURSIVE {mails}, {readable_cte(True)}, {TRIM_CTE.replace('FROM mail)', 'FROM raw)', 1)}, msg AS (SELECT msg_id, text FROM trimmed),
    {lines_cte('msg', 'text')}, {cues_cte()}, {cue_text_cte()}, {blocks_cte('msg', 'text', 2)}, blk AS (SELECT {RID} AS rid, * FROM blocks), {cells_cte(True)},
    {_scope_sql('full', 'msg', 'msg_id', 'f_')}, {_scope_sql('block', 'blk', 'rid', 'b_')},
    cand AS (SELECT msg_id, NULL::INT AS block_id, 'full' AS scope, field, value, confidence, extractor_id, pattern_ord, match_ord, validation_passed FROM f_all
        UNION ALL SELECT msg_id, NULL, 'table', field, value, confidence, concat('table_row_', row_idx, '_col_', col_idx), table_id, row_idx, true FROM tc
        UNION ALL SELECT rid // 4294967296, (rid % 4294967296)::INT, 'block', field, value, confidence, extractor_id, pattern_ord, match_ord, validation_passed FROM b_all)"""


@query("candidates_html", f"{_html_candidates_cte(MIXED_CTE)} SELECT {_CAND_COLS} FROM cand")
def candidates_html(spark, sf):
    """All candidates of mails of which some have HTML parts with tables."""
    prepared = fusion.prepare(fx.messages(spark, sf, True))
    return fusion.candidates(prepared, known=fusion.known_phrases(prepared))


@query("extractor_analysis_html", f"""
    {_html_candidates_cte(MIXED_CTE)}, per AS (SELECT extractor_id, count(*) FILTER (WHERE confidence > 0.5) AS success, count(*) AS total FROM cand GROUP BY 1)
    SELECT extractor_id, success, total, success / total::DOUBLE AS rate, CASE WHEN total >= 5 AND success / total::DOUBLE > 0.7 THEN 'best'
        WHEN total >= 5 AND success / total::DOUBLE < 0.3 THEN 'weak' ELSE '' END AS verdict FROM per""")
def extractor_analysis_html(spark, sf):
    return quality.extractor_analysis(candidates_html(spark, sf))


@query("processing_summary", f"""
    {_html_candidates_cte(DECODED_CTE)}, c AS (SELECT msg_id, count(*)::INT AS n, (count(*) FILTER (WHERE validation_passed AND confidence > 0.5))::INT AS good FROM cand WHERE scope <> 'block' GROUP BY 1),
    b AS (SELECT msg_id, count(*)::INT AS n FROM blk WHERE indicators <> '' GROUP BY 1), t AS (SELECT msg_id, count(*)::INT AS n FROM t_tab GROUP BY 1), x AS (SELECT msg_id, count(*)::INT AS n FROM h1 GROUP BY 1)
    SELECT r.msg_id::VARCHAR AS msg_id, concat('mail_', r.msg_id, '.eml') AS source_file, coalesce(c.n, 0) AS candidates, coalesce(c.good, 0) AS successful, coalesce(c.good, 0) / greatest(coalesce(c.n, 0), 1)::DOUBLE AS success_rate,
        coalesce(b.n, 0) AS blocks, coalesce(t.n, 0) + coalesce(x.n, 0) AS tables, (k % 17 <> 0)::INT AS attachments, (k % 17 = 0)::INT AS errors, (k % 17 <> 0 AND k % 7 = 3)::INT AS warnings, true AS timed
    FROM rendered r LEFT JOIN c USING (msg_id) LEFT JOIN b USING (msg_id) LEFT JOIN t USING (msg_id) LEFT JOIN x USING (msg_id)""")
def processing_summary(spark, sf):
    """Summary of every decoded fixture mail; seconds differ from run to run and are only told to be there."""
    found = quality.processing_summary(mail_source.decode(_raw_mails(spark, sf)))
    return found.withColumn("timed", F.col("seconds") > 0).drop("seconds")


@query("metrics_over_runs", f"""
    WITH fs AS ({REC}, {success_cte('rec', 'fs')} SELECT * FROM fs), an AS ({ANALYSIS_SQL}), cand AS ({CAND} SELECT * FROM cand)
    SELECT 'field' AS section, field AS key, success, total, rate, CASE WHEN problem THEN 'problem' WHEN top THEN 'top' ELSE '' END AS verdict FROM an
    UNION ALL SELECT 'extractor', e, success, total, success / total::DOUBLE, CASE WHEN total >= 5 AND success / total::DOUBLE > 0.7 THEN 'best' WHEN total >= 5 AND success / total::DOUBLE < 0.3 THEN 'weak' ELSE '' END
    FROM (SELECT CASE WHEN starts_with(extractor_id, 'table_row_') THEN 'table' ELSE extractor_id END AS e, count(*) FILTER (WHERE confidence > 0.5) AS success, count(*) AS total FROM cand GROUP BY 1)""")
def metrics_over_runs(spark, sf):
    """Rates over two runs of a stream, the second one over the mails that arrived after the first."""
    base = shared_folder(spark, "metrics")
    mails = fx.messages(spark, sf)
    for part in (0, 1):
        mails.filter(f"msg_id % 2 = {part}").write.mode("append").parquet(f"{base}/mails")
        arriving = spark.readStream.schema(mails.schema).parquet(f"{base}/mails")
        metrics_stream(arriving, f"{base}/state", f"{base}/checkpoint", "mails").awaitTermination()
    sums = counters.merged(spark, f"{base}/state")
    fields = counters.field_analysis(sums).select(
        F.lit("field").alias("section"), F.col("field").alias("key"), "success", "total", "rate", F.expr("CASE WHEN problem THEN 'problem' WHEN top THEN 'top' ELSE '' END AS verdict"))
    used = counters.extractor_analysis(sums).select(F.lit("extractor").alias("section"), F.col("extractor_id").alias("key"), "success", "total", "rate", "verdict")
    return fields.unionByName(used)


_TRACED = f"""{CAND}, n AS (SELECT msg_id, count(*) FILTER (WHERE indicators <> '')::INT AS blocks_detected FROM blk GROUP BY 1)"""


@query("trace_export", f"""
    {_TRACED} SELECT m.msg_id::VARCHAR AS msg_id, m.thread_trimmed, blocks_detected, field, value, confidence, extractor_id, validation_passed AS passed, (SELECT count(*) FROM msg) AS total_traces
    FROM msg m JOIN n USING (msg_id) JOIN cand c ON c.msg_id = m.msg_id AND scope <> 'block'""")
def trace_export(spark, sf):
    """Traces of all messages written as JSON, read back and counted."""
    path = shared_folder(spark, "traces")
    sinks.write_traces(_with_known(quality.traces)(spark, sf), path)
    rows = sinks.read_traces(spark, path).transform(explode_rows, ["msg_id", "thread_trimmed", "blocks_detected"], "field_traces", "t")
    total = sinks.trace_count(spark, path).first()["total_traces"]
    return rows.select("msg_id", "thread_trimmed", "blocks_detected", "t.*", F.lit(total).cast("long").alias("total_traces"))


FILES_CTE = f"""{RENDERED_CTE}, h AS (SELECT *, {fx.HTML_SQL} AS html0 FROM rendered),
    mail AS (SELECT msg_id, CASE WHEN k % 7 = 3 THEN '' ELSE concat(body, ' – end') END AS body, html0 AS html FROM h)"""


_FILES_ROSTER = f"WITH RECURSIVE {FILES_CTE}, {records_cte(html=True)}, {FINAL_CTE} SELECT msg_id, block_id, {_COLS} FROM fin"


@query("mail_files_roster", _FILES_ROSTER)
def mail_files_roster(spark, sf):
    """The fixture mails written as one file each to the shared folder, read back as a mail folder, and their roster."""
    folder = os.path.join(shared_folder(spark, "mail-files"), "mails")
    mails = fx.rendered(spark, sf).selectExpr("*", f"{fx.HTML_SQL} AS html").selectExpr(f"{_EML} AS value")
    mail_source.write_mail_files(mails, folder)
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _roster_of(mail_source.read_mail_files(spark, folder, "*.txt", tasks=tasks, subfolders=True))


def _roster_of(files):
    """Roster of fixture mails, which carry their number in the header."""
    found = mail_source.messages(mail_source.decode(files)).withColumn(
        "msg_id", F.regexp_extract(F.col("headers")["Message-ID"], "<([0-9]+)@", 1).cast("bigint"))
    return found.transform(fusion.extract).transform(records.process).select("msg_id", "block_id", *OUTPUT_COLUMNS)


@query("mailbox_roster", _FILES_ROSTER)
def mailbox_roster(spark, sf):
    """The fixture mails written as mailbox archives to the shared folder, cut into mails again, and their roster."""
    folder = os.path.join(shared_folder(spark, "mailboxes"), "boxes")
    mails = fx.rendered(spark, sf).selectExpr("*", f"{fx.HTML_SQL} AS html").selectExpr(f"encode({_EML}, 'UTF-8') AS content")
    mailbox.write_mailboxes(mails, folder, mails_per_file=100_000)
    # a task reads some 50,000 mails of an archive; decoding and extraction want smaller shares, and even ones
    return _roster_of(mailbox.read_mailboxes(spark, folder, "*.txt").transform(spread, "msg_id"))


_SHORT = ["TIN", "Provider Name", "Provider NPI", "Roster Note", "Term Date"]


@query("output_contract", f"""
    {REC}, {FINAL_CTE}, n AS (SELECT count(*) AS n_rows FROM fin)
    SELECT 'csv' AS written, 0 AS missing_columns, n_rows, n_rows > 0 AS ok FROM n UNION ALL SELECT 'parquet', 0, n_rows, n_rows > 0 FROM n
    UNION ALL SELECT 'template', {len(OUTPUT_COLUMNS) - len(_SHORT) + 1}, n_rows, false FROM n UNION ALL SELECT 'empty', 0, 0, false""")
def output_contract(spark, sf):
    """Rosters written, read back and checked: CSV, Parquet, a template that lacks columns, and an empty one."""
    base = shared_folder(spark, "output-contract")
    whole = os.path.join(base, "records")
    final_records(spark, sf).write.parquet(whole)
    found = spark.read.parquet(whole)
    checks = None
    for name, rows, template, fmt in (
        ("csv", found, None, "csv"), ("parquet", found, None, "parquet"), ("template", found, _SHORT, "csv"), ("empty", found.limit(0), None, "parquet"),
    ):
        path = os.path.join(base, name)
        sinks.write_roster(rows, path, template, fmt)
        out = sinks.read_roster(spark, path, fmt)
        missing = len(set(records.column_names()) - set(out.columns))
        one = out.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("written"), F.lit(missing).alias("missing_columns"), "n_rows",
            F.lit(sinks.validate_output(spark, path, fmt=fmt)).alias("ok"))
        checks = one if checks is None else checks.unionByName(one)
    return checks


@query("mail_stream", f"{REC}, {FINAL_CTE} SELECT msg_id, block_id, {_COLS} FROM fin")
def mail_stream(spark, sf):
    """The roster of the fixture by a one-shot file stream over the customer table."""
    schema = fx.table(spark, sf, "customer").schema
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 256).parquet(os.path.join(sf, "customer.parquet*"))
    messages = arriving.transform(fx.dealt).transform(fx.mail_of).selectExpr("msg_id", "body AS text_content", "cast(null as string) AS html_content")
    base = shared_folder(spark, "mail-stream")
    path = os.path.join(base, "roster")
    roster_stream(messages, path, os.path.join(base, "checkpoint")).awaitTermination()
    return spark.read.parquet(path).select("msg_id", "block_id", *OUTPUT_COLUMNS)


# --- reports ---------------------------------------------------------------

_FAMILY_SQL = "CASE WHEN starts_with(extractor_id, 'table_row_') THEN 'table' ELSE extractor_id END"
METRICS_SQL = f"""
    WITH fs AS ({REC}, {success_cte('rec', 'fs')} SELECT * FROM fs), an AS ({ANALYSIS_SQL}), cand AS ({CAND} SELECT * FROM cand),
    per AS (SELECT {_FAMILY_SQL} AS extractor_id, count(*) FILTER (WHERE confidence > 0.5) AS success, count(*) AS total FROM cand GROUP BY 1),
    runs AS (SELECT msg_id, sum(cs)::BIGINT AS cs, any_value(success) AS success FROM ({runs_sql()}) GROUP BY 1),
    n AS (SELECT count(*) FILTER (WHERE success) AS s, count(*) FILTER (WHERE NOT success) AS f FROM runs),
    t AS (SELECT count(*) AS n, sum(cs)::BIGINT / 100.0::DOUBLE AS s FROM runs WHERE success)
    SELECT 'session' AS section, to_json({{success_count: s, failure_count: f, success_rate: s / greatest(s + f, 1)::DOUBLE}})::VARCHAR AS entry FROM n
    UNION ALL SELECT 'turn_around', to_json({{total_files: n, total_seconds: s, mean_seconds: s / n, files_per_minute: 60 / (s / n), speed: {_SPEED_SQL.format('(s / n)')}}})::VARCHAR FROM t
    UNION ALL SELECT 'field', to_json({{field: field, success: success, total: total, rate: rate, problem: problem, top: top, overall_rate: overall_rate}})::VARCHAR FROM an
    UNION ALL SELECT 'extractor', to_json({{extractor_id: extractor_id, success: success, total: total, rate: success / total::DOUBLE,
        verdict: CASE WHEN total >= 5 AND success / total::DOUBLE > 0.7 THEN 'best' WHEN total >= 5 AND success / total::DOUBLE < 0.3 THEN 'weak' ELSE '' END}})::VARCHAR FROM per"""


@query("metrics_json", METRICS_SQL)
def metrics_json(spark, sf):
    """Full metrics report, one JSON text per section."""
    return quality.metrics_report(raw_records(spark, sf), _files(spark, sf), _candidates(spark, sf))


@query("trace_json")
def trace_json(spark, sf):
    """One JSON trace per message."""
    return _with_known(quality.traces)(spark, sf).select("msg_id", F.to_json(F.struct("*")).alias("trace"))

