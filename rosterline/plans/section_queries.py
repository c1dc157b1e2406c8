"""Queries over sectioning and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import explode_rows, made_rows

from ..functions import text as tx
from ..functions.sql import let
from ..operators import sections, tables
from ..sources import fixture as fx
from ..vocab.headers import BLOCK_FIELDS, LABEL_WORDS, LABEL_WORDS_TEXT, TABLE_HEADER_WORDS, header_rows
from ..vocab.transactions import SCOPE_WORDS
from .registry import HTML_CTE, MAIL_CTE, lit, query, str_list
from .text_queries import WS


def lines_cte(src: str = "mail", text: str = "body", out: str = "ln") -> str:
    """Numbered lines with cue flags."""
    marks = " ".join(f"WHEN regexp_matches(l, '\\b(?:{w})\\b', 'i') THEN '{k}'" for k, w in SCOPE_WORDS.items())

    def has(p):
        return f"regexp_matches(t, {lit(p)})"

    return f"""
    {out}_r AS (SELECT msg_id, unnest(string_split({text}, chr(10))) AS l, (generate_subscripts(string_split({text}, chr(10)), 1) - 1)::INT AS n FROM {src}),
    {out}_t AS (SELECT *, trim(l, {WS}) AS t FROM {out}_r),
    {out} AS (SELECT *, t = '' AS blank, coalesce(lead(t) OVER w, '') = '' AS nextblank, {has(sections.HARD_CUE)} AS hard, {has(sections.SOFT_NPI)} AS npi,
        {has(sections.SOFT_NPI)}::INT + {has(sections.SOFT_LICENSE)}::INT + {has(sections.SOFT_TIN)}::INT AS hits,
        regexp_matches(l, {lit(sections.TABLE_HEADER)}) AS head, {has(sections.ROW_SEPARATOR)} AND {has(sections.ROW_IDENTIFIER)} AS cells,
        CASE {marks} END AS mark FROM {out}_t WINDOW w AS (PARTITION BY msg_id ORDER BY n))"""


def ends_cte(starts: str, reach: int, out: str, ln: str = "ln") -> str:
    """Block ends for rows ``(msg_id, s)``."""
    return f"""
    {out}_p AS (SELECT a.msg_id, a.s, min(b.n) FILTER (WHERE b.hard OR (b.blank AND b.nextblank)) AS past
        FROM {starts} a LEFT JOIN {ln} b ON b.msg_id = a.msg_id AND b.n > a.s AND b.n <= a.s + {reach} GROUP BY 1, 2),
    {out} AS (SELECT p.msg_id, p.s, coalesce(max(b.n), p.s) AS e FROM {out}_p p LEFT JOIN {ln} b
        ON b.msg_id = p.msg_id AND b.n > p.s AND b.n <= p.s + {reach} AND b.n < coalesce(p.past, 2000000000) AND NOT b.blank GROUP BY 1, 2)"""


def cues_cte(ln: str = "ln", p: str = "") -> str:
    """All unmerged blocks: ``{p}cue(msg_id, s, e, kind, conf)``."""
    return f"""
    {p}hs AS (SELECT msg_id, n AS s FROM {ln} WHERE hard), {ends_cte(p + 'hs', 10, p + 'hard_b', ln)},
    {p}table_b AS (SELECT r.msg_id, r.n AS s, r.n AS e, h.n AS h FROM {ln} h JOIN {ln} r ON r.msg_id = h.msg_id AND r.n > h.n AND r.n <= h.n + 19 AND r.cells WHERE h.head),
    {p}ev AS (SELECT a.msg_id, a.n AS s, sum(b.hits)::INT AS score FROM {ln} a JOIN {ln} b ON b.msg_id = a.msg_id AND b.n BETWEEN a.n - 3 AND a.n + 3 WHERE a.npi GROUP BY 1, 2),
    {p}ss AS (SELECT msg_id, s, score FROM {p}ev WHERE score >= 2), {ends_cte(p + 'ss', 5, p + 'soft_e', ln)},
    {p}sc AS (SELECT e.*, score FROM {p}soft_e e JOIN {p}ss USING (msg_id, s)),
    {p}soft_b AS (SELECT msg_id, s, e, score FROM {p}sc c WHERE s = (SELECT min(s) FROM {p}sc d WHERE d.msg_id = c.msg_id)
        UNION ALL SELECT c.msg_id, c.s, c.e, c.score FROM {p}soft_b b JOIN {p}sc c ON c.msg_id = b.msg_id AND c.s = (SELECT min(d.s) FROM {p}sc d WHERE d.msg_id = b.msg_id AND d.s > b.e)),
    {p}cue AS (SELECT msg_id, s, e, 1 AS kind, 0.9::DOUBLE AS conf FROM {p}hard_b UNION ALL SELECT msg_id, s, e, 2, 0.8::DOUBLE FROM {p}table_b
        UNION ALL SELECT msg_id, s, e, 3, least(score * 0.2::DOUBLE, 0.7::DOUBLE) FROM {p}soft_b)"""


KIND_SQL = "['hard_cue', 'table_row', 'soft_cue'][kind]"


def cue_text_cte(ln: str = "ln", p: str = "") -> str:
    return f"""
    {p}cue_t AS (SELECT c.*, (SELECT CASE WHEN c.kind = 2 THEN any_value(x.t) ELSE string_agg(x.l, chr(10) ORDER BY x.n) END FROM {ln} x
        WHERE x.msg_id = c.msg_id AND x.n BETWEEN c.s AND c.e) AS text FROM {p}cue c)"""


def blocks_cte(src: str, text: str, gap: int, out: str = "blocks", ln: str = "ln", p: str = "") -> str:
    """Merged blocks, or the whole text: ``{out}(msg_id, block_id, start_line, end_line, text, transaction_type, indicators, confidence)``."""
    return f"""
    {p}o AS (SELECT *, row_number() OVER w AS rn, max(e) OVER (PARTITION BY msg_id ORDER BY s, kind, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
        FROM {p}cue_t WINDOW w AS (PARTITION BY msg_id ORDER BY s, kind, e)),
    {p}i AS (SELECT *, sum(CASE WHEN top IS NULL OR s > top + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY msg_id ORDER BY rn) AS isl FROM {p}o),
    {p}g AS (SELECT msg_id, (isl - 1)::INT AS block_id, min(s) AS start_line, max(e) AS end_line, string_agg(text, chr(10) ORDER BY rn) AS text,
        string_agg({KIND_SQL}, ',' ORDER BY rn) AS indicators, max(conf) AS confidence FROM {p}i GROUP BY 1, 2),
    {p}mk AS (SELECT msg_id, n, mark FROM {ln} WHERE mark IS NOT NULL),
    {p}scoped AS (SELECT g.*, m.mark AS transaction_type FROM {p}g g ASOF LEFT JOIN {p}mk m ON g.msg_id = m.msg_id AND g.start_line >= m.n),
    {out} AS (SELECT msg_id, block_id, start_line, end_line, text, transaction_type, indicators, confidence FROM {p}scoped
        UNION ALL SELECT msg_id, 0, 0, len(string_split({text}, chr(10)))::INT, {text}, NULL, '', 0.5::DOUBLE FROM {src} m WHERE NOT EXISTS (SELECT 1 FROM {p}g g WHERE g.msg_id = m.msg_id))"""


LN = f"WITH RECURSIVE {MAIL_CTE}, {lines_cte()}"
CUES = f"{LN}, {cues_cte()}, {cue_text_cte()}"


@query("message_lines", f"{LN} SELECT msg_id, n AS line_no, l AS line FROM ln")
def message_lines(spark, sf):
    return fx.mail(spark, sf).transform(explode_rows, ["msg_id"], tx.lines("body"), "line_no", "line")


@query("shared_fields", f"""
    WITH {MAIL_CTE} SELECT msg_id, nullif(regexp_extract(body, {lit(sections.SHARED_TIN)}, 1), '') AS tin,
        nullif(regexp_extract(body, {lit(sections.SHARED_PPG)}, 1), '') AS ppg,
        nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(body, {lit(sections.SHARED_LOB)}, 0))), ', '), '') AS lob,
        nullif(regexp_extract(body, {lit(sections.SHARED_ORGANIZATION)}, 0), '') AS organization FROM mail""")
def shared_fields(spark, sf):
    return fx.mail(spark, sf).select(
        "msg_id", *[F.expr(e).alias(n) for n, e in sections.shared_fields("body").items()])


def _cue_query(kind):
    def run(spark, sf):
        found = fx.mail(spark, sf).transform(explode_rows, ["msg_id"], sections.cue_blocks("body", kind), "b")
        return found.select("msg_id", "b.start_line", "b.end_line", "b.text", "b.confidence")

    return run


for _name, _kind, _no in (("hard_blocks", "hard", 1), ("table_row_blocks", "table", 2), ("soft_blocks", "soft", 3)):
    query(_name, f"{CUES} SELECT msg_id, s AS start_line, e AS end_line, text, conf AS confidence FROM cue_t WHERE kind = {_no}")(
        _cue_query(_kind))


@query("soft_evidence", f"{LN}, {cues_cte()} SELECT msg_id, s AS line_no, score FROM ev")
def soft_evidence(spark, sf):
    return fx.mail(spark, sf).transform(explode_rows, ["msg_id"], sections.soft_evidence("body"), "e").select(
        "msg_id", "e.line_no", "e.score")


@query("block_union", f"{CUES} SELECT msg_id, s AS start_line, e AS end_line, {KIND_SQL} AS indicator FROM cue_t")
def block_union(spark, sf):
    mail = fx.mail(spark, sf)
    parts = [
        mail.transform(explode_rows, ["msg_id"], sections.cue_blocks("body", k), "b").select(
            "msg_id", "b.start_line", "b.end_line", "b.indicator")
        for k in ("hard", "table", "soft")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_BLOCK_COLS = ["start_line", "end_line", "text", "transaction_type", "confidence"]


def _blocks(gap, default):
    build = sections.blocks_or_default if default else sections.blocks

    def run(spark, sf):
        found = fx.mail(spark, sf).transform(explode_rows, ["msg_id"], build("body", gap), "block_id", "b")
        return found.select("msg_id", "block_id", *[f"b.{c}" for c in _BLOCK_COLS],
                            F.array_join("b.indicators", ",").alias("indicators"))

    return run


for _name, _gap, _default in (("merged_blocks", 2, False), ("merged_blocks_gap0", 0, False), ("default_blocks", 2, True)):
    query(_name, f"{CUES}, {blocks_cte('mail', 'body', _gap)} SELECT * FROM {'blocks' if _default else '(SELECT * FROM blocks WHERE indicators <> ' + lit('') + ')'}")(
        _blocks(_gap, _default))


@query("transaction_scope_asof", f"{CUES}, {blocks_cte('mail', 'body', 0)} SELECT msg_id, block_id, start_line, transaction_type FROM blocks WHERE indicators <> ''")
def transaction_scope_asof(spark, sf):
    return _blocks(0, False)(spark, sf).select("msg_id", "block_id", "start_line", "transaction_type")


# --- text tables -----------------------------------------------------------

def split_sql(t: str, sep: str) -> str:
    return (
        f"list_filter(list_transform(CASE {sep} WHEN 'bar' THEN string_split({t}, '|') WHEN 'tab' THEN string_split({t}, chr(9)) "
        f"ELSE string_split_regex({t}, '\\s{{2,}}') END, lambda c: trim(c, {WS})), lambda c: c <> '')"
    )


SEP_SQL = "CASE WHEN contains({0}, '|') THEN 'bar' WHEN contains({0}, chr(9)) THEN 'tab' WHEN regexp_matches({0}, '\\s{{2,}}') THEN 'spaces' END"
HEADER_SQL = (
    "(" + " + ".join(f"contains(lower({{0}}), '{w}')::INT" for w in TABLE_HEADER_WORDS)
    + ") >= 2 AND regexp_matches({0}, '\\||\\t|  ')"
)


def tables_cte(src: str, text: str, p: str = "t_") -> str:
    """Text tables by a scan over per-line decisions: ``{p}cells(msg_id, table_id, kind, row_idx, col_idx, header, value, width)``."""
    labels = "|".join(LABEL_WORDS_TEXT)
    return f"""
    {p}l AS (SELECT msg_id, trim(unnest(string_split({text}, chr(10))), {WS}) AS t, (generate_subscripts(string_split({text}, chr(10)), 1) - 1)::INT AS n FROM {src}),
    {p}f0 AS (SELECT *, trim(split_part(t, ':', 1), {WS}) AS raw, trim(substr(t, strpos(t, ':') + 1), {WS}) AS v, {SEP_SQL.format('t')} AS sep, {HEADER_SQL.format('t')} AS head FROM {p}l),
    {p}f1 AS (SELECT *, CASE WHEN starts_with(raw, '-') THEN trim(substr(raw, 2), {WS}) ELSE raw END AS fd FROM {p}f0),
    {p}f2 AS (SELECT *, contains(t, ':') AND regexp_matches(lower(fd), '{labels}') AS known FROM {p}f1),
    {p}f AS (SELECT *, known AND fd <> '' AND v <> '' AS pair, t <> '' AND (NOT contains(t, ':') OR (fd <> '' AND v <> '' AND NOT known)) AS halt,
        t <> '' AND NOT contains(t, ':') AS plain, max(n) OVER (PARTITION BY msg_id) + 1 AS total FROM {p}f2),
    {p}hstop AS (SELECT a.msg_id, a.n, coalesce(min(b.n), any_value(a.total)) AS stop FROM {p}f a LEFT JOIN {p}f b ON b.msg_id = a.msg_id AND b.n > a.n
        AND NOT CASE a.sep WHEN 'bar' THEN contains(b.t, '|') WHEN 'tab' THEN contains(b.t, chr(9)) ELSE regexp_matches(b.t, '\\s{{2,}}') END WHERE a.head GROUP BY 1, 2),
    {p}hrow AS (SELECT a.msg_id, a.n, s.stop, b.n AS rn, {split_sql('a.t', 'a.sep')} AS hs, {split_sql('b.t', 'a.sep')} AS cs
        FROM {p}hstop s JOIN {p}f a USING (msg_id, n) JOIN {p}f b ON b.msg_id = a.msg_id AND b.n > a.n AND b.n < s.stop),
    {p}hkept AS (SELECT *, row_number() OVER (PARTITION BY msg_id, n ORDER BY rn) - 1 AS row_idx FROM {p}hrow WHERE len(cs) BETWEEN 1 AND len(hs)),
    {p}vstop AS (SELECT a.msg_id, a.n, coalesce(min(b.n), any_value(a.total)) AS stop FROM {p}f a LEFT JOIN {p}f b ON b.msg_id = a.msg_id AND b.n > a.n AND b.halt
        WHERE a.known AND NOT a.head GROUP BY 1, 2),
    {p}vnear AS (SELECT a.msg_id, a.n FROM {p}f a JOIN {p}f b ON b.msg_id = a.msg_id AND b.n BETWEEN a.n + 1 AND a.n + 7 AND b.known
        WHERE a.known AND NOT EXISTS (SELECT 1 FROM {p}f c WHERE c.msg_id = a.msg_id AND c.plain AND c.n > a.n AND c.n < b.n) GROUP BY 1, 2),
    {p}vpairs AS (SELECT s.msg_id, s.n, s.stop, count(*) AS pairs FROM {p}vstop s JOIN {p}vnear USING (msg_id, n)
        JOIN {p}f b ON b.msg_id = s.msg_id AND b.n >= s.n AND b.n < s.stop AND b.pair GROUP BY 1, 2, 3),
    {p}dec AS (SELECT msg_id, n, 'horizontal' AS kind, n + count(*)::INT + 2 AS nxt, any_value(stop) AS stop FROM {p}hkept GROUP BY 1, 2
        UNION ALL SELECT msg_id, n, 'vertical', stop, stop FROM {p}vpairs WHERE pairs >= 2),
    {p}step AS (SELECT f.msg_id, f.n, d.kind, coalesce(d.nxt, f.n + 1) AS nxt, d.stop FROM {p}f f LEFT JOIN {p}dec d USING (msg_id, n)),
    {p}walk AS (SELECT msg_id, n, kind, nxt, stop FROM {p}step WHERE n = 0
        UNION ALL SELECT s.msg_id, s.n, s.kind, s.nxt, s.stop FROM {p}walk w JOIN {p}step s ON s.msg_id = w.msg_id AND s.n = w.nxt),
    {p}tab AS (SELECT *, (row_number() OVER (PARTITION BY msg_id ORDER BY n) - 1)::INT AS table_id FROM {p}walk WHERE kind IS NOT NULL),
    {p}vp AS (SELECT t.msg_id, t.table_id, b.fd, b.v, (row_number() OVER (PARTITION BY t.msg_id, t.table_id ORDER BY b.n) - 1)::INT AS col_idx
        FROM {p}tab t JOIN {p}f b ON b.msg_id = t.msg_id AND b.n >= t.n AND b.n < t.stop AND b.pair WHERE t.kind = 'vertical'),
    {p}hc AS (SELECT t.msg_id, t.table_id, k.row_idx::INT AS row_idx, k.hs, k.cs, unnest(range(0, len(k.hs))) AS c FROM {p}tab t JOIN {p}hkept k USING (msg_id, n) WHERE t.kind = 'horizontal'),
    {p}cells AS (SELECT msg_id, table_id, 'horizontal' AS kind, row_idx, c::INT AS col_idx, hs[c + 1] AS header, coalesce(cs[c + 1], '') AS value, len(hs)::INT AS width FROM {p}hc
        UNION ALL SELECT msg_id, table_id, 'vertical', 0, col_idx, fd, v, (count(*) OVER (PARTITION BY msg_id, table_id))::INT FROM {p}vp)"""


def lcs_sql(a: str, b: str) -> str:
    """LCS length by the textbook row recurrence."""
    return (
        f"list_reduce(list_transform(string_split({a}, ''), lambda ch: [ascii(ch)]), lambda prv, ch: "
        f"list_reduce(list_transform(range(1, length({b}) + 1), lambda z: [z::INT]), lambda rw, jx: list_append(rw, "
        f"CASE WHEN ascii(substr({b}, jx[1], 1)) = ch[1] THEN prv[jx[1]] + 1 ELSE greatest(prv[jx[1] + 1], rw[jx[1]]) END), [0]), "
        f"list_transform(range(0, length({b}) + 1), lambda z: 0))[-1]"
    )


def header_map_cte(src: str, col: str, out: str = "hmap") -> str:
    """Distinct headers to fields: ``{out}(hd, field, score)``."""
    values = ", ".join(f"({i}, '{f}', {lit(v)})" for i, (f, _, v, _) in enumerate(header_rows()))
    return f"""
    {out}_v AS (SELECT * FROM (VALUES {values}) AS v(ord, field, variant)),
    {out}_h AS (SELECT DISTINCT lower(trim({col}, {WS})) AS hd FROM {src}),
    {out}_s AS (SELECT hd, ord, field, CASE WHEN hd = variant THEN 100 ELSE 200.0::DOUBLE * ({lcs_sql('hd', 'variant')}) / (length(hd) + length(variant)) END::DOUBLE AS score
        FROM {out}_h, {out}_v WHERE hd <> ''),
    {out} AS (SELECT hd, arg_max(field, (score, -ord)) AS field, max(score) AS score FROM {out}_s WHERE score >= 60 GROUP BY 1)"""


def candidates_cte(cells: str, origin: str, out: str) -> str:
    """Cells of mapped columns: ``{out}(msg_id, origin, table_id, row_idx, col_idx, field, value, confidence)``."""
    return f"""
    {out}_m AS (SELECT c.*, h.field FROM {cells} c LEFT JOIN hmap h ON h.hd = lower(trim(c.header, {WS}))),
    {out}_w AS (SELECT msg_id, table_id, count(DISTINCT col_idx) FILTER (WHERE field IS NOT NULL) / any_value(width)::DOUBLE AS share FROM {out}_m GROUP BY 1, 2),
    {out} AS (SELECT m.msg_id, '{origin}' AS origin, m.table_id, m.row_idx, m.col_idx, m.field, trim(m.value, {WS}) AS value,
        CASE WHEN m.kind = 'vertical' THEN least(w.share + 0.2::DOUBLE, 1) ELSE w.share END::DOUBLE AS confidence
        FROM {out}_m m JOIN {out}_w w USING (msg_id, table_id) WHERE m.field IS NOT NULL AND trim(m.value, {WS}) <> '')"""


TT = f"WITH RECURSIVE {MAIL_CTE}, {tables_cte('mail', 'body')}"


def _explode_tables(df, built):
    t = df.transform(explode_rows, ["msg_id"], built, "table_id", "t")
    r = t.select("msg_id", "table_id", "t.kind", "t.headers", F.posexplode("t.rows").alias("row_idx", "cells"))
    return r.select("msg_id", "table_id", "kind", "row_idx", "headers", F.posexplode("cells").alias("col_idx", "value")).select(
        "msg_id", "table_id", "kind", "row_idx", "col_idx", F.expr("get(headers, col_idx)").alias("header"), "value")


_CELL_SQL = "SELECT msg_id, table_id, kind, row_idx, col_idx, header, value FROM {}"


@query("text_table_header", f"""
    {LN} SELECT msg_id, n AS line_no, {HEADER_SQL.format('t')} AS is_header, {SEP_SQL.format('t')} AS separator,
    coalesce(array_to_string({split_sql('t', SEP_SQL.format('t'))}, '/'), '') AS cells FROM ln""")
def text_table_header(spark, sf):
    lines = fx.mail(spark, sf).transform(explode_rows, ["msg_id"], tx.lines("body"), "line_no", "l").selectExpr(
        "msg_id", "line_no", f"{tx.strip('l')} AS t")
    sep = tables.separator("t")
    return lines.select(
        "msg_id", "line_no", F.expr(tables.looks_like_header("t")).alias("is_header"), F.expr(sep).alias("separator"),
        F.expr(f"array_join({tables.split_row('t', f'coalesce({sep}, {chr(39)}spaces{chr(39)})')}, '/')").alias("cells"))


@query("text_table_rows", f"{TT} {_CELL_SQL.format('t_cells')} WHERE kind = 'horizontal'")
def text_table_rows(spark, sf):
    return _explode_tables(fx.mail(spark, sf), tables.text_tables("body")).filter("kind = 'horizontal'")


@query("vertical_pairs", f"{TT} {_CELL_SQL.format('t_cells')} WHERE kind = 'vertical'")
def vertical_pairs(spark, sf):
    return _explode_tables(fx.mail(spark, sf), tables.text_tables("body")).filter("kind = 'vertical'")


_HEADERS = (
    "SELECT lower(p_name) AS h FROM part UNION SELECT lower(p_type) FROM part UNION SELECT concat('provider ', p_brand) FROM part "
    "UNION SELECT concat('npi ', p_size) FROM part UNION SELECT concat(p_type, ' date') FROM part"
)


@query("header_field_map", f"WITH hs AS ({_HEADERS}), {header_map_cte('hs', 'h')} SELECT hd AS header, field, score FROM hmap")
def header_field_map(spark, sf):
    part = fx.table(spark, sf, "part")
    texts = part.select(F.explode(F.array(
        F.lower("p_name"), F.lower("p_type"), F.concat(F.lit("provider "), "p_brand"),
        F.concat(F.lit("npi "), "p_size"), F.concat("p_type", F.lit(" date")))).alias("h"))
    distinct = texts.select(F.expr(tx.strip("lower(h)")).alias("header")).distinct()
    return distinct.transform(made_rows, ["header"], tables.map_header("header"), "m").select(
        "header", "m.field", "m.score")


TC = f"{TT}, {header_map_cte('t_cells', 'header')}, {candidates_cte('t_cells', 'text', 'tc')}"
_TC_COLS = ["origin", "table_id", "row_idx", "col_idx", "field", "value", "confidence"]


@query("table_candidates", f"{TC} SELECT msg_id, {', '.join(_TC_COLS)} FROM tc")
def table_candidates(spark, sf):
    built = tables.table_candidates(tables.text_tables("body"), "text")
    return fx.mail(spark, sf).transform(explode_rows, ["msg_id"], built, "c").select("msg_id", *[f"c.{c}" for c in _TC_COLS])


_OWN = str_list(BLOCK_FIELDS)


@query("block_aware_candidates", f"""
    {TC}, {lines_cte()}, {cues_cte()}, {cue_text_cte()}, {blocks_cte('mail', 'body', 0)},
    bc AS (SELECT c.*, b.block_id, contains(lower(b.text), lower(c.value)) AS inside FROM tc c JOIN blocks b ON b.msg_id = c.msg_id)
    SELECT msg_id, block_id, field, value, CASE WHEN inside THEN confidence ELSE confidence * 0.6::DOUBLE END AS confidence
    FROM bc WHERE inside OR NOT list_contains({_OWN}, field)""")
def block_aware_candidates(spark, sf):
    """Usable cells per block: those found in it, and those of message-wide fields at 0.6, by the operator that records use."""
    built = tables.block_cells(tables.table_candidates(tables.text_tables("body"), "text"))
    of_block = f"transform(blocks, b -> {tables.in_block('cs', 'b.text')})"
    rows = fx.mail(spark, sf).select(
        "msg_id", F.expr(sections.blocks_or_default("body", 0)).alias("blocks"), F.expr(built).alias("cells"))
    return rows.transform(explode_rows, ["msg_id"], let("cells", "cs", of_block), "block_id", "u").transform(
        explode_rows, ["msg_id", "block_id"], F.col("u"), "c").select("msg_id", "block_id", "c.field", "c.value", "c.confidence")


# --- HTML tables -----------------------------------------------------------

def _html_rows_cte() -> str:
    """Cells of HTML tables by splitting on tags: ``hr(msg_id, table_id, row_no, cs)``."""
    from .text_queries import _ENTITY_SQL

    cell = (
        "array_to_string(list_transform(string_split_regex(string_split_regex(cell, '(?i)</t[dh]|</tr')[1], '<[^>]*>'), "
        f"lambda x: trim({_ENTITY_SQL.format('x')}, {WS})), '')"
    )
    return f"""
    h0 AS (SELECT msg_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS html FROM mail),
    h1 AS (SELECT msg_id, unnest(regexp_extract_all(html, '(?is)<table(?:\\s[^>]*)?>(.*?)</table', 1)) AS t,
        (generate_subscripts(regexp_extract_all(html, '(?is)<table(?:\\s[^>]*)?>(.*?)</table', 1), 1) - 1)::INT AS table_id FROM h0),
    h2 AS (SELECT msg_id, table_id, unnest(string_split_regex(t, '(?i)<tr(?:\\s[^>]*)?>')[2:]) AS r,
        (generate_subscripts(string_split_regex(t, '(?i)<tr(?:\\s[^>]*)?>')[2:], 1) - 1)::INT AS row_no FROM h1),
    hr AS (SELECT msg_id, table_id, row_no, list_transform(string_split_regex(r, '(?i)<t[dh](?:\\s[^>]*)?>')[2:], lambda cell: {cell}) AS cs FROM h2),
    ho AS (SELECT msg_id, table_id, count(*) >= 2 AND count(*) FILTER (WHERE row_no < 5 AND len(cs) = 2 AND regexp_matches(lower(cs[1]), '{'|'.join(LABEL_WORDS)}')) >= 2 AS vertical FROM hr GROUP BY 1, 2)"""


HT = f"WITH {HTML_CTE}, {_html_rows_cte()}"


@query("html_table_cells", f"{HT} SELECT msg_id, table_id, row_no, (c)::INT AS col_idx, cs[c + 1] AS value FROM (SELECT *, unnest(range(0, len(cs))) AS c FROM hr)")
def html_table_cells(spark, sf):
    t = fx.mail_html(spark, sf).transform(explode_rows, ["msg_id"], tables.html_cells("html"), "table_id", "rs")
    r = t.select("msg_id", "table_id", F.posexplode("rs").alias("row_no", "cs"))
    return r.select("msg_id", "table_id", "row_no", F.posexplode("cs").alias("col_idx", "value"))


@query("html_orientation", f"{HT} SELECT msg_id, table_id, vertical FROM ho")
def html_orientation(spark, sf):
    t = fx.mail_html(spark, sf).transform(explode_rows, ["msg_id"], tables.html_cells("html"), "table_id", "rs")
    return t.select("msg_id", "table_id", F.expr(tables.is_vertical("rs")).alias("vertical"))


HTML_CELLS_CTE = f"""
    hflat AS (SELECT r.msg_id, r.table_id, 'horizontal' AS kind, (r.row_no - 1)::INT AS row_idx, unnest(range(0, len(r.cs)))::INT AS c, h.cs AS hs, r.cs, len(h.cs)::INT AS width
        FROM hr r JOIN ho o USING (msg_id, table_id) JOIN hr h ON h.msg_id = r.msg_id AND h.table_id = r.table_id AND h.row_no = 0 WHERE NOT o.vertical AND r.row_no > 0),
    htall AS (SELECT r.msg_id, r.table_id, (row_number() OVER (PARTITION BY r.msg_id, r.table_id ORDER BY r.row_no) - 1)::INT AS col_idx, r.cs[1] AS header, r.cs[2] AS value,
        (count(*) OVER (PARTITION BY r.msg_id, r.table_id))::INT AS width
        FROM hr r JOIN ho o USING (msg_id, table_id) WHERE o.vertical AND len(r.cs) = 2 AND r.cs[1] <> '' AND r.cs[2] <> '' AND regexp_matches(lower(r.cs[1]), '{'|'.join(LABEL_WORDS)}')),
    hcells AS (SELECT msg_id, table_id, kind, row_idx, c AS col_idx, hs[c + 1] AS header, cs[c + 1] AS value, width FROM hflat
        UNION ALL SELECT msg_id, table_id, 'vertical', 0, col_idx, header, value, width FROM htall WHERE width >= 2)"""


@query("html_horizontal", f"{HT}, {HTML_CELLS_CTE} {_CELL_SQL.format('hcells')} WHERE kind = 'horizontal'")
def html_horizontal(spark, sf):
    return _explode_tables(fx.mail_html(spark, sf), tables.html_tables("html")).filter("kind = 'horizontal'")


@query("html_vertical", f"{HT}, {HTML_CELLS_CTE} {_CELL_SQL.format('hcells')} WHERE kind = 'vertical'")
def html_vertical(spark, sf):
    return _explode_tables(fx.mail_html(spark, sf), tables.html_tables("html")).filter("kind = 'vertical'")


@query("html_and_text_candidates", f"""
    WITH RECURSIVE {HTML_CTE}, {_html_rows_cte()}, {HTML_CELLS_CTE}, {tables_cte('mail', 'body')},
    every AS (SELECT header FROM hcells UNION ALL SELECT header FROM t_cells), {header_map_cte('every', 'header')},
    {candidates_cte('hcells', 'html', 'hc')}, {candidates_cte('t_cells', 'text', 'tc')}
    SELECT msg_id, {', '.join(_TC_COLS)} FROM hc UNION ALL SELECT msg_id, {', '.join(_TC_COLS)} FROM tc""")
def html_and_text_candidates(spark, sf):
    built = tables.message_table_candidates("body", "html")
    return fx.mail_html(spark, sf).transform(explode_rows, ["msg_id"], built, "c").select("msg_id", *[f"c.{c}" for c in _TC_COLS])
