"""Queries over text projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import explode_rows

from ..functions import text as tx
from ..sources import fixture as fx
from .registry import HTML_CTE, MAIL_CTE, lit, query

WS = "chr(32) || chr(10) || chr(9) || chr(13) || chr(12)"

#: mails with tabs, CR line ends, deep indents and runs of blank lines
MESSY = (
    "concat(replace(replace(body, chr(10), concat('  ', chr(13), chr(10), repeat(' ', cast(msg_id % 12 as int)))), "
    "': ', concat(':', chr(9), ' ')), chr(10), chr(10), chr(10), chr(10), 'end', chr(13), 'of mail  ')"
)
#: mails with typographic punctuation
CURLY = (
    "concat(replace(replace(body, '-', '–'), '. ', '… '), '— “', cast(msg_id as string), '” ‘x’')"
)
#: mails followed by boilerplate lines
LEGAL = (
    "concat(body, chr(10), 'Please click here to UNSUBSCRIBE now', chr(10), 'Legal Disclaimer: none', chr(10), "
    "'This email may be confidential in part', chr(10), 'bye')"
)


def clean_sql(t: str) -> str:
    unified = f"regexp_replace(regexp_replace({t}, '\\r\\n?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return (
        f"array_to_string(list_transform(string_split({unified}, chr(10)), lambda l: CASE WHEN trim(l, {WS}) = '' THEN '' "
        f"ELSE repeat(' ', least(8, length(l) - length(ltrim(l, {WS})))::INT) || trim(l, {WS}) END), chr(10))"
    )


def punct_sql(t: str) -> str:
    return (
        f"translate(replace(translate({t}, '–—', '--'), '…', '...'), "
        "'‘’“”', '''''\"\"')"
    )


@query("clean_whitespace", f"WITH {MAIL_CTE} SELECT msg_id, {clean_sql(MESSY)} AS text FROM mail")
def clean_whitespace(spark, sf):
    return fx.mail(spark, sf).selectExpr("msg_id", f"{MESSY} AS messy").select(
        "msg_id", F.expr(tx.clean_whitespace("messy")).alias("text"))


@query("clean_whitespace_documents",
       f"SELECT doc_id, md5({clean_sql('text')}) AS digest, length({clean_sql('text')})::INT AS n FROM documents")
def clean_whitespace_documents(spark, sf):
    return fx.columns(spark, sf, "documents", "doc_id", "text").select("doc_id", F.expr(tx.clean_whitespace("text")).alias("t")).select(
        "doc_id", F.md5("t").alias("digest"), F.length("t").alias("n"))


@query("normalize_punct", f"WITH {MAIL_CTE} SELECT msg_id, {punct_sql(CURLY)} AS text FROM mail")
def normalize_punct(spark, sf):
    return fx.mail(spark, sf).selectExpr("msg_id", f"{CURLY} AS curly").select(
        "msg_id", F.expr(tx.normalize_punctuation("curly")).alias("text"))


_ENTITY_SQL = "{}"
for _e, _c in tx.ENTITIES.items():
    _ENTITY_SQL = f"replace({_ENTITY_SQL}, {lit(_e)}, {lit(_c)})"


def html_text_sql(h: str, compat: bool = False) -> str:
    x = f"regexp_replace({h}, '(?s)<!--.*?-->', '<!>', 'g')"
    for tag in ("script", "style"):
        x = f"regexp_replace({x}, '(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>', '<!>', 'g')"
    if compat:
        # all cells of a row but the last end in a separator node
        x = f"regexp_replace({x}, '(?i)</t[dh]>(\\s*<t[dh])', ' | </td>\\1', 'g')"
    else:
        x = f"regexp_replace({x}, '(?i)</?(?:b|i|u|strong|em|span|font|a|small|sub|sup)(?:\\s[^>]*)?>', '', 'g')"
        x = f"regexp_replace({x}, '(?i)</t[dh]>\\s*<t[dh](?:\\s[^>]*)?>', ' | ', 'g')"
    x = f"regexp_replace({x}, '(?:<[^>]*>)+', chr(10), 'g')"
    x = f"regexp_replace(regexp_replace({x}, '^\\n', ''), '\\n$', '')"
    return clean_sql(_ENTITY_SQL.format(x))


@query("html_to_text", f"SELECT page_id, {html_text_sql('html')} AS text FROM pages")
def html_to_text(spark, sf):
    return fx.columns(spark, sf, "pages", "page_id", "html").select("page_id", F.expr(tx.html_to_text("html")).alias("text"))


@query("html_table_separators", f"WITH {HTML_CTE} SELECT msg_id, {html_text_sql('html')} AS text, "
       f"{html_text_sql('html', True)} AS text_by_node FROM mail")
def html_table_separators(spark, sf):
    return fx.mail_html(spark, sf).select(
        "msg_id", F.expr(tx.html_to_text("html")).alias("text"),
        F.expr(tx.html_to_text("html", compat=True)).alias("text_by_node"))


REPLY_SQL = (
    r"^(?:From:\s+\S|Sent:\s+\S|To:\s+\S|Subject:\s+\S|-----Original Message-----"
    r"|________________________________|On .* wrote:|> \s*\S)"
)
_NPI_SQL = "'NPI[:\\s]*(\\d{10})', 1, 'i'"
TRIM_CTE = f"""
    split AS (SELECT msg_id, body, string_split(body, chr(10)) AS ls FROM mail),
    cut AS (SELECT *, list_position(list_transform(ls, lambda l: regexp_matches(trim(l, {WS}), {lit(REPLY_SQL)}, 'i')), true) AS p FROM split),
    halves AS (SELECT *, array_to_string(ls[1:p-1], chr(10)) AS newer, array_to_string(ls[p:], chr(10)) AS older FROM cut),
    known AS (SELECT *, list_distinct(regexp_extract_all(older, {_NPI_SQL})) AS o, regexp_extract_all(newer, {_NPI_SQL}) AS n FROM halves),
    trimmed AS (SELECT msg_id, coalesce(p, 0) > 0 AND len(list_filter(coalesce(o, []), lambda x: NOT list_contains(n, x))) = 0 AS thread_trimmed,
        CASE WHEN coalesce(p, 0) > 0 AND len(list_filter(o, lambda x: NOT list_contains(n, x))) = 0 THEN trim(newer, {WS}) ELSE body END AS text FROM known)
"""


@query("trim_thread", f"WITH {MAIL_CTE}, {TRIM_CTE} SELECT msg_id, text, thread_trimmed FROM trimmed")
def trim_thread(spark, sf):
    return fx.mail(spark, sf).select("msg_id", F.expr(tx.trim_thread("body")).alias("t")).select(
        "msg_id", "t.text", F.col("t.trimmed").alias("thread_trimmed"))


@query("npi_set_difference", f"""
    WITH {MAIL_CTE}, halves AS (SELECT msg_id, split_part(body, '-----Original', 1) AS newer, split_part(body, '-----Original', 2) AS older
        FROM mail WHERE contains(body, '-----Original')),
    ids AS (SELECT msg_id, newer, unnest(regexp_extract_all(older, {_NPI_SQL})) AS npi FROM halves)
    SELECT DISTINCT msg_id, npi FROM ids WHERE NOT list_contains(regexp_extract_all(newer, {_NPI_SQL}), npi)""")
def npi_set_difference(spark, sf):
    halves = fx.mail(spark, sf).filter(F.col("body").contains("-----Original")).select(
        "msg_id", F.split_part("body", F.lit("-----Original"), F.lit(1)).alias("newer"),
        F.split_part("body", F.lit("-----Original"), F.lit(2)).alias("older"))
    return halves.transform(explode_rows, ["msg_id"], tx.npi_set_difference("older", "newer"), "npi")


@query("strip_boilerplate", f"""
    WITH {MAIL_CTE}, t1 AS (SELECT msg_id, regexp_replace({LEGAL}, 'unsubscribe[^\\n]*', '', 'gi') AS t FROM mail),
    t2 AS (SELECT msg_id, regexp_replace(regexp_replace(t, 'confidential[^\\n]*', '', 'gi'), 'disclaimer[^\\n]*', '', 'gi') AS t FROM t1),
    t3 AS (SELECT msg_id, regexp_replace(t, 'this email[^\\n]*?confidential[^\\n]*', '', 'gi') AS t FROM t2)
    SELECT msg_id, regexp_replace(t, 'please[^\\n]*?unsubscribe[^\\n]*', '', 'gi') AS text FROM t3""")
def strip_boilerplate(spark, sf):
    return fx.mail(spark, sf).selectExpr("msg_id", f"{LEGAL} AS body").select(
        "msg_id", F.expr(tx.strip_boilerplate("body")).alias("text"))


def body_window_cte(src: str, key: str, text: str, out: str = "windowed") -> str:
    """CTE chain with the body window of every text, by line numbers."""
    return f"""
    {out}_l AS (SELECT {key}, unnest(string_split({text}, chr(10))) AS l, generate_subscripts(string_split({text}, chr(10)), 1) AS n FROM {src}),
    {out}_f AS (SELECT *, lower(trim(l, {WS})) AS t FROM {out}_l),
    {out}_s AS (SELECT {key}, coalesce(min(n) FILTER (WHERE t <> '' AND NOT regexp_matches(t, {lit(tx.SALUTATION)})
        AND NOT regexp_matches(t, {lit(tx.HEADER_LINE)})), 1) AS st, max(n) AS total FROM {out}_f GROUP BY 1),
    {out}_e AS (SELECT f.{key}, s.st, coalesce(max(n) FILTER (WHERE n > st AND t <> '' AND regexp_matches(t, {lit(tx.CLOSING)})), any_value(total) + 1) AS en
        FROM {out}_f f JOIN {out}_s s USING ({key}) GROUP BY 1, 2),
    {out}_k AS (SELECT f.*, e.st, e.en, min(n) FILTER (WHERE t <> '' AND n >= st AND n < en) OVER w AS a, max(n) FILTER (WHERE t <> '' AND n >= st AND n < en) OVER w AS b
        FROM {out}_f f JOIN {out}_e e USING ({key}) WINDOW w AS (PARTITION BY f.{key})),
    {out} AS (SELECT {key}, coalesce(string_agg(l, chr(10) ORDER BY n) FILTER (WHERE n >= a AND n <= b), '') AS text FROM {out}_k GROUP BY 1)"""


@query("body_window", f"WITH {MAIL_CTE}, {body_window_cte('mail', 'msg_id', 'body')} SELECT msg_id, text FROM windowed")
def body_window(spark, sf):
    return fx.mail(spark, sf).select("msg_id", F.expr(tx.body_window("body")).alias("text"))


def pipe_sql(t: str) -> str:
    return (
        f"array_to_string(list_filter(string_split({t}, chr(10)), lambda l: length(l) - length(replace(l, '|', '')) >= 2 "
        "OR regexp_matches(l, '\\s+\\|\\s+') OR regexp_matches(l, '\\w+:\\s*\\w+\\s*\\|\\s*\\w+:')), chr(10))"
    )


@query("pipe_lines", f"WITH {MAIL_CTE} SELECT msg_id AS id, {pipe_sql('body')} AS text FROM mail "
       f"UNION ALL SELECT doc_id AS id, {pipe_sql('text')} AS text FROM documents")
def pipe_lines(spark, sf):
    mails = fx.mail(spark, sf).select(F.col("msg_id").alias("id"), F.expr(tx.pipe_lines("body")).alias("text"))
    docs = fx.table(spark, sf, "documents")
    return mails.unionByName(docs.select(F.col("doc_id").alias("id"), F.expr(tx.pipe_lines("text")).alias("text")))


@query("collapse_ws", f"SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), {WS}) AS text FROM documents")
def collapse_ws(spark, sf):
    return fx.columns(spark, sf, "documents", "doc_id", "text").select("doc_id", F.expr(tx.collapse_whitespace("text")).alias("text"))


PY_TITLE = "array_to_string(list_transform(regexp_extract_all({0}, '\\pL+|\\PL+'), lambda r: upper(r[1]) || lower(r[2:])), '')"


@query("py_title", f"""
    SELECT id, kind, {PY_TITLE.format('s')} AS title FROM (
        SELECT p_partkey AS id, 'part' AS kind, concat(p_name, '-', p_type, ' o''neil ', p_size, 'x') AS s FROM part
        UNION ALL SELECT s_suppkey, 'supplier', s_name FROM supplier
        UNION ALL SELECT n_nationkey::BIGINT, 'nation', concat('de ', n_name, '.') FROM nation)""")
def py_title(spark, sf):
    parts = fx.table(spark, sf, "part").selectExpr(
        "p_partkey AS id", "'part' AS kind", "concat(p_name, '-', p_type, \" o'neil \", p_size, 'x') AS s")
    supp = fx.table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "'supplier' AS kind", "s_name AS s")
    nat = fx.table(spark, sf, "nation").selectExpr("cast(n_nationkey as bigint) AS id", "'nation' AS kind", "concat('de ', n_name, '.') AS s")
    return parts.unionByName(supp).unionByName(nat).select("id", "kind", F.expr(tx.title_case("s")).alias("title"))

