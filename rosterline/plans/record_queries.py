"""Queries over fusion, resolution and the output contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import explode_rows

from ..functions import checks
from ..operators import fusion, records
from ..sources import fixture as fx
from ..vocab.business import ALLOWED_VALUES, LOB_SYNONYMS, OUTPUT_COLUMNS, SENTINEL
from ..vocab.headers import BLOCK_FIELDS
from ..vocab.specialties import SPECIALTIES
from ..vocab.transactions import (
    ADD_ATTRIBUTE_PHRASES, ATTRIBUTE_LABELS, ATTRIBUTE_OF_PHRASE, ATTRIBUTE_SUBJECTS, ATTRIBUTE_TIE_WORDS,
    ATTRIBUTE_VALUES, ATTRIBUTE_WEIGHTS, REASON_CONTEXTS, REASON_WORDS, SUBJECT_FACTOR, TERM_ATTRIBUTE_PHRASES, TERM_REASONS,
)
from .entity_queries import (
    any_sql, codes_cte, exact_cte, fuzzy_cte, lob_cte, names_sql, organization_cte, synonyms_cte, title_words_sql, type_cte,
    weighted_sql, word_dates_context_sql, word_dates_sql, DATED_CTE, dated_mails,
)
from .registry import MAIL_CTE, MIXED_CTE, lit, query, str_list
from .scan_queries import date_sql, ppg_cte, scan_sql
from .section_queries import HTML_CELLS_CTE, _html_rows_cte, blocks_cte, candidates_cte, cue_text_cte, cues_cte, header_map_cte, lines_cte, tables_cte
from .text_queries import PY_TITLE, TRIM_CTE, WS, clean_sql, html_text_sql, punct_sql

S = lit(SENTINEL)

# --- attribute and reason --------------------------------------------------


def attribute_scores_cte(src: str, key: str, text: str, out: str) -> str:
    """Scores per attribute: ``{out}({key}, low, ord, attribute, score)``."""
    def score(a):
        subjects = "".join(
            f" + CASE WHEN regexp_matches(low[1:100], {lit(p)}) THEN {w * SUBJECT_FACTOR!r}::DOUBLE ELSE 0 END" for p, w in ATTRIBUTE_SUBJECTS[a])
        return weighted_sql("low", ATTRIBUTE_WEIGHTS[a]) + subjects

    parts = " UNION ALL ".join(
        f"SELECT {key}, low, {i} AS ord, {lit(a)} AS attribute, {score(a)} AS score FROM {out}_l" for i, a in enumerate(ATTRIBUTE_WEIGHTS))
    return f"{out}_l AS (SELECT {key}, lower({text}) AS low FROM {src}), {out} AS ({parts})"


def attribute_cte(src: str, key: str, text: str, kind: str, out: str) -> str:
    """Transaction attribute: ``{out}({key}, value)``."""
    mapped = "CASE " + " ".join(f"WHEN contains(v, {lit(k)}) THEN {lit(a)}" for k, a in ATTRIBUTE_VALUES.items())
    mapped += f" WHEN length(v) < 50 THEN {PY_TITLE.format('v')} END"
    labels = ", ".join(f"nullif(trim(regexp_extract(low, {lit(p)}, 1), {WS}), '')" for p in ATTRIBUTE_LABELS)
    bonus = "CASE {0} " + " ".join(
        f"WHEN {lit(a)} THEN len(list_filter({str_list(ws)}, lambda w: contains(low, w)))" for a, ws in ATTRIBUTE_TIE_WORDS.items()) + " END * 0.5::DOUBLE"

    def listed(phrases):
        cases = " ".join(
            f"WHEN contains(low, {lit(p)}) THEN {lit(next(a for k, a in ATTRIBUTE_OF_PHRASE.items() if k in p))}" for p in phrases)
        return f"CASE {cases} ELSE 'Provider' END"

    return f"""
    {attribute_scores_cte(src, key, text, out + '_s')},
    {out}_r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, ord) AS rn FROM {out}_s_x),
    {out}_w AS (SELECT {key}, any_value(low) AS low, max(attribute) FILTER (WHERE rn = 1) AS a1, max(score) FILTER (WHERE rn = 1) AS s1,
        max(attribute) FILTER (WHERE rn = 2) AS a2, max(score) FILTER (WHERE rn = 2) AS s2 FROM {out}_r GROUP BY 1),
    {out}_c AS (SELECT *, CASE WHEN s1 <= 0 THEN 'Provider' WHEN s2 > 0 AND abs(s1 - s2) < 1 AND s1 + {bonus.format('a1')} < s2 + {bonus.format('a2')} THEN a2 ELSE a1 END AS ctx FROM {out}_w),
    {out}_v AS (SELECT w.{key}, low, ctx, coalesce({kind}, '') AS kind, list_transform([{labels}], lambda v: CASE WHEN v IS NULL THEN NULL ELSE {mapped} END) AS ex FROM {out}_c w JOIN {src} s ON s.{key} = w.{key}),
    {out} AS (SELECT {key}, coalesce(list_filter(ex, lambda x: x IS NOT NULL)[1], CASE kind WHEN 'Term' THEN {listed(TERM_ATTRIBUTE_PHRASES)} WHEN 'Add' THEN {listed(ADD_ATTRIBUTE_PHRASES)}
        WHEN 'Update' THEN ctx ELSE 'Not Applicable' END) AS value FROM {out}_v)""".replace(f"{out}_s_x", f"{out}_s")


def reason_sql(low: str) -> str:
    groups = "CASE " + " ".join(f"WHEN {any_sql(low, ws)} THEN {lit(label)}" for label, ws in TERM_REASONS.items()) + " END"
    found = " || ".join(f"regexp_extract_all({low}, {lit(p)}, 1)" for p in REASON_CONTEXTS)
    mapped = "CASE " + " ".join(f"WHEN regexp_matches(r, '{'|'.join(ws)}') THEN {lit(label)}" for label, ws in REASON_WORDS.items())
    mapped += f" WHEN length(trim(r, {WS})) > 2 THEN {PY_TITLE.format(f'trim(r, {WS})')} END"
    return f"coalesce({groups}, list_filter(list_transform({found}, lambda r: {mapped}), lambda x: x IS NOT NULL)[1])"


#: mails with labels and reasons of every kind
_NOTES = (
    "CASE k % 12 WHEN 0 THEN concat('Transaction Attribute: ', org, chr(10), body) WHEN 1 THEN concat('Update Type : telephone of ', person) "
    "WHEN 2 THEN 'terminate: phone termination. reason: moved' WHEN 3 THEN 'please add new ppg to roster, term reason: ok go' "
    "WHEN 4 THEN concat('change fax and address in suite 5, due to: ', lower(org), ' leaving') WHEN 5 THEN 'update lob, coverage and ppg; eligibility' "
    "WHEN 6 THEN 'update city, state, phone number extension' ELSE body END"
)
NOTES_CTE = f"{MAIL_CTE.rsplit(', mail AS', 1)[0]}, mail AS (SELECT msg_id, {_NOTES} AS body FROM rendered)"


def _note_mails(spark, sf):
    return fx.rendered(spark, sf).selectExpr("msg_id", f"{_NOTES} AS body")


@query("attribute_scores", f"WITH {NOTES_CTE}, {attribute_scores_cte('mail', 'msg_id', 'body', 's')} SELECT msg_id, attribute, score FROM s")
def attribute_scores(spark, sf):
    scored = _note_mails(spark, sf).select("msg_id", F.lower("body").alias("low")).transform(explode_rows, ["msg_id"], fusion.attribute_scores("low"), "s")
    return scored.select("msg_id", "s.attribute", "s.score")


@query("transaction_attribute", f"""
    WITH {NOTES_CTE}, {type_cte('mail', 'msg_id', 'body', 'ty')}, src AS (SELECT m.msg_id, m.body, t.value AS kind FROM mail m JOIN ty t USING (msg_id)),
    {attribute_cte('src', 'msg_id', 'body', 's.kind', 'attr')} SELECT msg_id, value FROM attr""")
def transaction_attribute(spark, sf):
    from ..operators import entities
    typed = _note_mails(spark, sf).select("msg_id", "body", F.expr(f"{entities.transaction_type('body')}.value").alias("kind"))
    return typed.select("msg_id", F.expr(fusion.transaction_attribute("coalesce(kind, '')", "body")).alias("value"))


@query("attribute_conflicts", f"""
    WITH {NOTES_CTE}, src AS (SELECT msg_id, body FROM mail), {attribute_cte('src', 'msg_id', 'body', lit('Update'), 'attr')} SELECT msg_id, ctx AS value FROM attr_v""")
def attribute_conflicts(spark, sf):
    return _note_mails(spark, sf).select("msg_id", F.lower("body").alias("low")).select(
        "msg_id", F.expr(fusion.context_attribute("low")).alias("value"))


@query("term_reason", f"WITH {NOTES_CTE} SELECT msg_id, {reason_sql('lower(body)')} AS reason FROM mail")
def term_reason(spark, sf):
    return _note_mails(spark, sf).select("msg_id", F.expr(fusion.term_reason("body")).alias("reason"))


# --- records ---------------------------------------------------------------

def first_sql(rows: str, key: str, n: int = 1) -> str:
    """n-th value per key in scan order."""
    return f"(SELECT {key}, list(value ORDER BY i, o)[{n}] AS value FROM (SELECT *, match_ord AS o FROM ({rows})) GROUP BY 1)"


def _first_specialty(src: str, key: str, p: str) -> str:
    """First specialty of a text: later sources only where earlier ones found nothing."""
    need = f"SELECT * FROM {src} s WHERE NOT EXISTS (SELECT 1 FROM {p}sp0 x WHERE x.{key} = s.{key}) AND NOT EXISTS (SELECT 1 FROM {p}sp1 x WHERE x.{key} = s.{key})"
    every = " UNION ALL ".join(f"SELECT {key}, value, {i} AS src, ord FROM {p}sp{i}" for i in range(4))
    return (
        f"{synonyms_cte(src, key, 'text', p + 'sp0')}, {codes_cte(src, key, 'text', p + 'sp1')}, {p}need AS MATERIALIZED ({need}), "
        f"{fuzzy_cte(p + 'need', key, 'text', p + 'sp2')}, {exact_cte(p + 'need', key, 'text', p + 'sp3')}, "
        f"{p}spf AS (SELECT {key}, arg_min(value, (src, ord)) AS value FROM ({every}) GROUP BY 1)"
    )


def _scalar(src: str, key: str, p: str) -> str:
    """First values of the text scans of one scope: tables ``{p}npi`` and so on."""
    parts = [f"{p}{f} AS {first_sql(scan_sql(f, src, key, 'text'), key)}" for f in ("tin", "phone", "fax", "license")]
    parts += [f"{p}npi AS (SELECT {key}, list(value ORDER BY i, match_ord) AS vs FROM ({scan_sql('npi', src, key, 'text')}) GROUP BY 1)"]
    parts += [ppg_cte(src, key, "text", p + "ppg_c"), f"{p}ppg AS {first_sql(f'SELECT * FROM {p}ppg_c', key)}"]
    parts += [f"{p}name AS {first_sql(names_sql(src, key, 'text'), key)}"]
    parts += [f"{p}word AS ({word_dates_sql(src, key, 'text')})"]
    parts += [lob_cte(src, key, "text", p + "lob_c"), f"{p}lob AS (SELECT {key}, string_agg(value, ', ' ORDER BY ord) AS value FROM {p}lob_c GROUP BY 1)"]
    return ", ".join(parts)


def readable_cte(html: bool) -> str:
    """Texts that scans read: ``raw(msg_id, text_content, body)``, body before the thread is trimmed."""
    body = punct_sql(clean_sql("body"))
    if html:
        body = f"CASE WHEN coalesce(html, '') <> '' THEN {html_text_sql('html')} ELSE {body} END"
    return f"raw AS (SELECT msg_id, body AS text_content, {body} AS body FROM mail)"


def cells_cte(html: bool) -> str:
    """Table candidates of the messages: ``tc``, with origin html or text."""
    if not html:
        return f"{tables_cte('msg', 'text')}, {header_map_cte('t_cells', 'header')}, {candidates_cte('t_cells', 'text', 'tc')}"
    return f"""
    {_html_rows_cte()}, {HTML_CELLS_CTE}, {tables_cte('msg', 'text')},
    every AS (SELECT header FROM hcells UNION ALL SELECT header FROM t_cells), {header_map_cte('every', 'header')},
    {candidates_cte('hcells', 'html', 'hc')}, {candidates_cte('t_cells', 'text', 'xc')}, tc AS (SELECT * FROM hc UNION ALL SELECT * FROM xc)"""


#: one key of a message and its block
RID = "msg_id * 4294967296 + block_id"


def records_cte(gap: int = 2, html: bool = False) -> str:
    """Raw records of the fixture mails: ``rec(msg_id, block_id, 17 columns)``."""
    own = str_list(BLOCK_FIELDS)

    def tab(field, n=1):
        return f"(SELECT list(c.value ORDER BY c.origin, c.table_id, c.row_idx, c.col_idx)[{n}] FROM use c WHERE c.rid = b.rid AND c.field = '{field}')"

    def blk(t, expr="value"):
        return f"(SELECT {expr} FROM b_{t} x WHERE x.rid = b.rid)"

    def msg(t, expr="value"):
        return f"(SELECT {expr} FROM m_{t} x WHERE x.msg_id = b.msg_id)"

    is_term = "coalesce(ty.value, '') = 'Term'"
    word = "(SELECT arg_min(x.value, (x.i, x.match_ord)) FROM b_word x WHERE x.rid = b.rid)"
    found = f"coalesce((SELECT value FROM m_date x WHERE x.msg_id = b.msg_id), {word})"
    known = f"coalesce({tab('term_date')}, {tab('effective_date')})"
    return f"""
    {readable_cte(html)},
    {TRIM_CTE.replace('FROM mail)', 'FROM raw)', 1)},
    msg AS (SELECT t.msg_id, t.text, concat(r.text_content, chr(10), t.text) AS both_texts, t.thread_trimmed FROM trimmed t JOIN raw r USING (msg_id)),
    {lines_cte('msg', 'text')}, {cues_cte()}, {cue_text_cte()}, {blocks_cte('msg', 'text', gap)},
    blk AS (SELECT {RID} AS rid, * FROM blocks),
    {cells_cte(html)},
    use AS (SELECT b.rid, c.* FROM blk b JOIN tc c ON c.msg_id = b.msg_id AND (NOT list_contains({own}, c.field) OR contains(lower(b.text), lower(c.value)))),
    {type_cte('msg', 'msg_id', 'text', 'ty')},
    {_scalar('msg', 'msg_id', 'm_')}, {_scalar('blk', 'rid', 'b_')},
    m_num AS ({scan_sql('date', 'msg', 'msg_id', 'text')}),
    m_date AS (SELECT msg_id, arg_max(value, (confidence, -src, -i, -match_ord)) AS value FROM (SELECT msg_id, value, confidence, 0 AS src, i, match_ord FROM m_num
        UNION ALL SELECT msg_id, value, confidence, 1, i, match_ord FROM ({word_dates_context_sql('msg', 'msg_id', 'text')})) GROUP BY 1),
    {_first_specialty('msg', 'msg_id', 'm_')}, {_first_specialty('blk', 'rid', 'b_')},
    {organization_cte('msg', 'msg_id', 'text', 'm_')}, {organization_cte('blk', 'rid', 'text', 'b_')},
    typed AS (SELECT m.msg_id, m.both_texts, t.value AS kind FROM msg m JOIN ty t USING (msg_id)),
    {attribute_cte('typed', 'msg_id', 'both_texts', 's.kind', 'attr')},
    base AS (SELECT b.msg_id, b.block_id, ty.value AS transaction_type, attr.value AS transaction_attribute,
        coalesce({tab('effective_date')}, CASE WHEN {known} IS NULL AND NOT {is_term} THEN {found} END) AS effective_date,
        coalesce({tab('term_date')}, CASE WHEN {known} IS NULL AND {is_term} THEN {found} END) AS term_date,
        CASE WHEN {is_term} THEN coalesce({reason_sql('lower(msg.text)')}, {tab('term_reason')}, {reason_sql('lower(b.text)')}) END AS term_reason,
        coalesce({tab('provider_name')}, {blk('name')}, {msg('name')}) AS provider_name,
        coalesce({tab('npi')}, {msg('npi', 'vs[1]')}, {blk('npi', 'vs[1]')}) AS provider_npi,
        coalesce({tab('specialty')}, {blk('spf')}, {msg('spf')}) AS provider_specialty,
        coalesce({blk('license')}, {msg('license')}, {tab('license')}) AS state_license,
        coalesce({msg('org')}, {blk('org')}, {tab('organization')}) AS organization_name,
        coalesce({msg('tin')}, {tab('tin')}, {blk('tin')}) AS tin,
        coalesce({tab('npi', 2)}, {msg('npi', 'vs[2]')}, {blk('npi', 'vs[2]')}) AS group_npi,
        {tab('address')} AS complete_address,
        coalesce({blk('phone')}, {msg('phone')}) AS phone_number,
        coalesce({tab('fax')}, {blk('fax')}, {msg('fax')}) AS fax_number,
        coalesce({msg('ppg')}, {tab('ppg')}, {blk('ppg')}) AS ppg_id,
        coalesce({msg('lob')}, {blk('lob')}) AS line_of_business
        FROM blk b JOIN msg ON msg.msg_id = b.msg_id JOIN ty ON ty.msg_id = b.msg_id JOIN attr ON attr.msg_id = b.msg_id),
    rec AS (SELECT msg_id, block_id, {', '.join(f'coalesce({c}, {S}) AS {c}' for c in OUTPUT_COLUMNS)} FROM base)"""


_COLS = ", ".join(OUTPUT_COLUMNS)
REC = f"WITH RECURSIVE {MAIL_CTE}, {records_cte()}"
REC0 = f"WITH RECURSIVE {MAIL_CTE}, {records_cte(0)}"


REC_HTML = f"WITH RECURSIVE {MIXED_CTE}, {records_cte(html=True)}"


def raw_records(spark, sf, gap=2, html=False):
    return fusion.extract(fx.messages(spark, sf, html), gap)


@query("records", f"{REC} SELECT msg_id, block_id, {_COLS} FROM rec")
def records_query(spark, sf):
    return raw_records(spark, sf)


@query("records_gap0", f"{REC0} SELECT msg_id, block_id, {_COLS} FROM rec")
def records_gap0(spark, sf):
    return raw_records(spark, sf, 0)


@query("records_html", f"{REC_HTML} SELECT msg_id, block_id, {_COLS} FROM rec")
def records_html(spark, sf):
    """Records of mails with text, HTML, or both: HTML tables come before text tables and scans."""
    return raw_records(spark, sf, html=True)


@query("resolved_dates", f"{REC} SELECT msg_id, block_id, transaction_type, effective_date, term_date FROM rec")
def resolved_dates(spark, sf):
    return raw_records(spark, sf).select("msg_id", "block_id", "transaction_type", "effective_date", "term_date")


@query("resolved_dates_context", f"WITH RECURSIVE {DATED_CTE}, {records_cte()} SELECT msg_id, block_id, transaction_type, effective_date, term_date FROM rec")
def resolved_dates_context(spark, sf):
    """Of several dates in words a record takes the one next to a cue."""
    messages = dated_mails(spark, sf).selectExpr("msg_id", "body AS text_content", "cast(null as string) AS html_content")
    return fusion.extract(messages).select("msg_id", "block_id", "transaction_type", "effective_date", "term_date")


@query("group_npi", f"{REC} SELECT msg_id, block_id, provider_npi, group_npi FROM rec")
def group_npi(spark, sf):
    return raw_records(spark, sf).select("msg_id", "block_id", "provider_npi", "group_npi")


@query("lob_list", f"{REC} SELECT msg_id, block_id, line_of_business FROM rec")
def lob_list(spark, sf):
    return raw_records(spark, sf).select("msg_id", "block_id", "line_of_business")


# --- normalisation ---------------------------------------------------------

def lob_sql(x: str) -> str:
    hits = ", ".join(f"CASE WHEN {any_sql(f'lower({x})', ws)} THEN '{n}' END" for n, ws in LOB_SYNONYMS.items())
    words = " ".join(f"WHEN regexp_matches(lower({x}), '\\b{w}\\b') THEN '{n}'" for w, n in
                     (("hmo", "Commercial"), ("ppo", "Commercial"), ("medicare", "Medicare"), ("medicaid", "Medicaid")))
    return f"coalesce(nullif(array_to_string(list_filter([{hits}], lambda v: v IS NOT NULL), ', '), ''), CASE {words} ELSE 'Commercial' END)"


def org_name_sql(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '\\S+'), lambda w, i: CASE WHEN i = 1 THEN {PY_TITLE.format('w')} "
        f"WHEN list_contains({str_list(records.ORG_SMALL)}, lower(w)) THEN lower(w) WHEN list_contains({str_list(records.ORG_SUFFIX)}, lower(w)) THEN upper(w) "
        f"WHEN regexp_matches(lower(w), '^[a-z]+$') AND length(w) <= 4 THEN upper(w) ELSE {PY_TITLE.format('w')} END), ' ')"
    )


def _titles_sql(x: str) -> str:
    cases = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in records.TITLES.items())
    return f"CASE lower(trim({x}, {WS})) {cases} ELSE {PY_TITLE.format(x)} END"


def provider_name_sql(x: str) -> str:
    flat = f"array_to_string(regexp_extract_all({x}, '\\S+'), ' ')"
    last = PY_TITLE.format(f"trim(split_part({flat}, ',', 1), {WS})")
    rest = f"trim(substr({flat}, strpos({flat}, ',') + 1), {WS})"
    return (
        f"CASE WHEN contains({flat}, ',') THEN concat({last}, ', ', {_titles_sql(rest)}) "
        f"ELSE array_to_string(list_transform(string_split({flat}, ' '), lambda w: {_titles_sql('w')}), ' ') END"
    )


def specialty_norm_cte(src: str, col: str, out: str) -> str:
    """Distinct specialty texts to normal forms: ``{out}(raw, value)``."""
    flat = [(i, s, c) for i, (c, s) in enumerate((c, s) for c, ss in SPECIALTIES.items() for s in ss)]
    values = ", ".join(f"({i}, {lit(s)}, {lit(c)})" for i, s, c in flat)
    return f"""
    {out}_d AS (SELECT * FROM (VALUES {values}) AS v(ord, syn, canonical)),
    {out}_r AS (SELECT DISTINCT {col} AS raw, lower(trim({col}, {WS})) AS lo FROM {src}),
    {out} AS (SELECT raw, CASE WHEN raw = '' OR raw = {S} THEN {S} ELSE coalesce((SELECT arg_min(canonical, ord) FROM {out}_d WHERE syn = lo),
        (SELECT arg_min(canonical, ord) FROM {out}_d WHERE length(syn) > 3 AND (contains(lo, syn) OR contains(syn, lo))), {title_words_sql('raw', records.SPECIALTY_SMALL, True)}) END AS value FROM {out}_r)"""


_LOB_TEXT = "CASE c_custkey % 8 WHEN 0 THEN 'Medi-Cal, PPO' WHEN 1 THEN 'Part B and CMS' WHEN 2 THEN c_mktsegment WHEN 3 THEN concat('position ', c_name) WHEN 4 THEN 'Private employer HMO' WHEN 5 THEN 'state plan' WHEN 6 THEN 'Medigap, exchange' ELSE concat('x ', c_mktsegment, ' marketplace') END"
_SPEC_TEXT = "CASE WHEN p_size % 4 = 0 THEN concat(p_name, ' surgery') WHEN p_size % 4 = 1 THEN split_part('im,obgyn,peds,207R00000X,cardio,pm&r,heart of the matter,id', ',', cast(p_partkey % 8 + 1 as int)) WHEN p_size % 4 = 2 THEN concat(p_type, ' of the ', p_name) ELSE p_name END"
_NAME_TEXT = "CASE c_custkey % 6 WHEN 0 THEN lower(c_name) WHEN 1 THEN concat('doctor ', c_mktsegment, ' o''neil iii') WHEN 2 THEN concat(c_mktsegment, ',  md') WHEN 3 THEN 'smith-jones, anna  MARIA' WHEN 4 THEN concat('dr. ', c_name, ' M.D') ELSE concat('de la ', c_mktsegment, ' jr.') END"
_ORG_TEXT = "CASE c_custkey % 5 WHEN 0 THEN concat('the ', c_mktsegment, ' of PINE inc') WHEN 1 THEN concat('ucsd  health and ', lower(c_mktsegment), ' llc') WHEN 2 THEN c_name WHEN 3 THEN 'st. mary''s at the bay' ELSE concat(c_mktsegment, ' MEDICAL for kids') END"
# one spelling of the apostrophe for both engines
_NAME_TEXT, _ORG_TEXT = (t.replace("o''neil", "o', chr(39), 'neil").replace("'st. mary''s at the bay'", "concat('st. mary', chr(39), 's at the bay')") for t in (_NAME_TEXT, _ORG_TEXT))


@query("normalize_lob", f"SELECT c_custkey, t AS raw, {lob_sql('t')} AS value FROM (SELECT c_custkey, {_LOB_TEXT} AS t FROM customer)")
def normalize_lob(spark, sf):
    rows = fx.table(spark, sf, "customer").selectExpr("c_custkey", f"{_LOB_TEXT} AS raw")
    return rows.select("c_custkey", "raw", F.expr(f"array_join({records.normalize_lob('raw')}, ', ')").alias("value"))


@query("normalize_specialty", f"WITH src AS (SELECT p_partkey, {_SPEC_TEXT} AS t FROM part), {specialty_norm_cte('src', 't', 'sn')} SELECT p_partkey, t AS raw, value FROM src JOIN sn ON sn.raw = src.t")
def normalize_specialty(spark, sf):
    rows = fx.table(spark, sf, "part").selectExpr("p_partkey", f"{_SPEC_TEXT} AS raw")
    return rows.select("p_partkey", "raw", F.expr(records.normalize_specialty("raw")).alias("value"))


@query("normalize_org_name", f"SELECT c_custkey, t AS raw, {org_name_sql('t')} AS value FROM (SELECT c_custkey, {_ORG_TEXT} AS t FROM customer)")
def normalize_org_name(spark, sf):
    rows = fx.table(spark, sf, "customer").selectExpr("c_custkey", f"{_ORG_TEXT} AS raw")
    return rows.select("c_custkey", "raw", F.expr(records.normalize_organization("raw")).alias("value"))


@query("normalize_provider_name", f"SELECT c_custkey, t AS raw, {provider_name_sql('t')} AS value FROM (SELECT c_custkey, {_NAME_TEXT} AS t FROM customer)")
def normalize_provider_name(spark, sf):
    rows = fx.table(spark, sf, "customer").selectExpr("c_custkey", f"{_NAME_TEXT} AS raw")
    return rows.select("c_custkey", "raw", F.expr(records.normalize_provider_name("raw")).alias("value"))


def normalized_cte(src: str, out: str) -> str:
    keep = [c for c in OUTPUT_COLUMNS if c not in ("line_of_business", "provider_specialty", "organization_name", "provider_name")]
    return f"""
    {specialty_norm_cte(src, 'provider_specialty', out + '_sp')},
    {out} AS (SELECT r.msg_id, r.block_id, {', '.join('r.' + c for c in keep)},
        CASE WHEN r.line_of_business IN ('', {S}) THEN r.line_of_business ELSE {lob_sql('r.line_of_business')} END AS line_of_business, s.value AS provider_specialty,
        CASE WHEN r.organization_name IN ('', {S}) THEN {S} ELSE {org_name_sql('r.organization_name')} END AS organization_name,
        CASE WHEN r.provider_name IN ('', {S}) THEN {S} ELSE {provider_name_sql('r.provider_name')} END AS provider_name
        FROM {src} r JOIN {out}_sp s ON s.raw = r.provider_specialty)"""


@query("normalized_records", f"{REC}, {normalized_cte('rec', 'nrm')} SELECT msg_id, block_id, {_COLS} FROM nrm")
def normalized_records(spark, sf):
    return raw_records(spark, sf).transform(records.normalize_all)


# --- validation ------------------------------------------------------------

_D = "regexp_replace({0}, '[^0-9]', '', 'g')"


def check_sql(field: str, x: str) -> tuple[str, str, str]:
    """is_valid, message and normal form of one field."""
    d = _D.format(x)
    if field in ("provider_npi", "group_npi"):
        return f"length({d}) = 10", f"CASE WHEN {x} = '' THEN 'NPI is empty' WHEN length({d}) = 10 THEN 'Valid NPI' ELSE concat('NPI must be 10 digits, got ', length({d})) END", d
    if field == "tin":
        return f"length({d}) = 9", f"CASE WHEN {x} = '' THEN 'TIN is empty' WHEN length({d}) = 9 THEN 'Valid TIN' ELSE concat('TIN must be 9 digits, got ', length({d})) END", f"concat({d}[1:2], '-', {d}[3:])"
    if field in ("phone_number", "fax_number"):
        k = field.split("_")[0]
        ok = f"(length({d}) = 10 OR (length({d}) = 11 AND {d}[1] = '1'))"
        r = f"right({d}, 10)"
        return ok, (
            f"CASE WHEN {x} = '' THEN '{k} number is empty' WHEN length({d}) < 10 THEN concat('{k} number too short: ', length({d}), ' digits') "
            f"WHEN length({d}) > 11 THEN concat('{k} number too long: ', length({d}), ' digits') WHEN {ok} THEN 'Valid {k} number' ELSE '11-digit {k} number must start with 1' END"
        ), f"concat({r}[1:3], '-', {r}[4:6], '-', {r}[7:])"
    if field == "state_license":
        v = f"upper(trim({x}, {WS}))"
        ok = f"regexp_matches({v}, '^[A-Z][0-9]{{5,6}}$')"
        return ok, f"CASE WHEN {x} = '' THEN 'License number is empty' WHEN {ok} THEN 'Valid license format' ELSE 'Invalid license format. Expected: Letter followed by 5-6 digits' END", v
    if field == "ppg_id":
        v = f"trim(regexp_replace({x}, '[^A-Za-z0-9, ]', '', 'g'), {WS})"
        return f"{v} <> ''", f"CASE WHEN {x} = '' THEN 'PPG ID is empty' WHEN {v} = '' THEN 'PPG ID contains no valid characters' ELSE 'Valid PPG ID' END", v
    v = date_sql(f"trim({x}, {WS})", strict=True)
    return f"({v}) IS NOT NULL", f"CASE WHEN {x} = '' THEN 'Date is empty' WHEN ({v}) IS NULL THEN concat('Could not parse date: ', {x}) ELSE 'Valid date' END", v


def results_sql(src: str) -> str:
    parts = []
    for f in checks.VALIDATORS:
        ok, message, value = check_sql(f, f)
        parts.append(
            f"SELECT msg_id, block_id, '{f}' AS field, {ok} AS is_valid, {message} AS message, CASE WHEN {ok} THEN coalesce({value}, '') ELSE '' END AS normalized FROM {src} WHERE {f} <> {S}")
    return " UNION ALL ".join(parts)


#: records with damaged values, from the raw customer rows
_DAMAGE = {
    "transaction_type": "CASE c_custkey % 5 WHEN 0 THEN 'Add' WHEN 1 THEN 'Update' WHEN 2 THEN 'Term' WHEN 3 THEN 'Information not found' ELSE 'Change' END",
    "transaction_attribute": "CASE c_custkey % 4 WHEN 0 THEN 'PPG' WHEN 1 THEN 'Fax' WHEN 2 THEN 'Information not found' ELSE 'Phone Number' END",
    "effective_date": "CASE c_custkey % 7 WHEN 0 THEN 'Information not found' WHEN 1 THEN '13/02/2025' WHEN 2 THEN '2025-3-9' WHEN 3 THEN '02/31/99' WHEN 4 THEN '1/2/1850' WHEN 5 THEN '4-5-49' ELSE 'soon' END",
    "term_date": "CASE c_custkey % 3 WHEN 0 THEN 'Information not found' WHEN 1 THEN '' ELSE ' 31/12/2024 ' END",
    "term_reason": "CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Information not found' ELSE 'Retired' END",
    "provider_name": "c_name",
    "provider_npi": "CASE c_custkey % 4 WHEN 0 THEN concat('NPI ', cast(1000000000 + c_custkey as string)) WHEN 1 THEN cast(c_custkey as string) WHEN 2 THEN '' ELSE 'Information not found' END",
    "provider_specialty": "c_mktsegment",
    "state_license": "CASE c_custkey % 3 WHEN 0 THEN ' a12345 ' WHEN 1 THEN 'AB1234' ELSE 'Information not found' END",
    "organization_name": "c_mktsegment",
    "tin": "CASE c_custkey % 3 WHEN 0 THEN cast(100000000 + c_custkey as string) WHEN 1 THEN '12-345' ELSE 'Information not found' END",
    "group_npi": "CASE c_custkey % 3 WHEN 0 THEN cast(1900000000 + c_custkey as string) WHEN 1 THEN '19-00' ELSE 'Information not found' END",
    "complete_address": "'Information not found'",
    "phone_number": "CASE c_custkey % 6 WHEN 0 THEN '1 (415) 555-9921' WHEN 1 THEN '2 415 555 9921' WHEN 2 THEN '555-9921' WHEN 3 THEN '123456789012' WHEN 4 THEN '415.555.0000' ELSE 'Information not found' END",
    "fax_number": "CASE c_custkey % 3 WHEN 0 THEN '4155559922' WHEN 1 THEN 'none' ELSE 'Information not found' END",
    "ppg_id": "CASE c_custkey % 4 WHEN 0 THEN 'P04, 1104' WHEN 1 THEN '<P-9>' WHEN 2 THEN '##' ELSE 'Information not found' END",
    "line_of_business": "CASE c_custkey % 4 WHEN 0 THEN 'Medicare, Medicaid' WHEN 1 THEN 'Medicare, HMO' WHEN 2 THEN 'Information not found' ELSE ' Commercial ,x' END",
}
DMG = f"WITH dmg AS (SELECT c_custkey AS msg_id, 0 AS block_id, {', '.join(f'{e} AS {c}' for c, e in _DAMAGE.items())} FROM customer)"


def _damaged(spark, sf):
    return fx.table(spark, sf, "customer").selectExpr("c_custkey AS msg_id", "0 AS block_id", *[f"{e} AS {c}" for c, e in _DAMAGE.items()])


@query("validate_fields", f"{DMG} {results_sql('dmg')}")
def validate_fields(spark, sf):
    return records.validation_results(_damaged(spark, sf))


def validated_cte(src: str, out: str) -> str:
    shaped = []
    for c in OUTPUT_COLUMNS:
        if c in checks.VALIDATORS:
            ok, _, value = check_sql(c, c)
            shaped.append(f"CASE WHEN {c} <> {S} AND {ok} AND coalesce({value}, '') <> '' THEN {value} ELSE {c} END AS {c}")
        else:
            shaped.append(c)
    return f"{out} AS (SELECT msg_id, block_id, {', '.join(shaped)} FROM {src})"


def rules_cte(src: str, out: str) -> str:
    term = "lower(transaction_type) = 'term'"
    swap = f"{term} AND term_date = {S} AND effective_date <> {S}"

    def phone(c):
        d = _D.format(c)
        return f"CASE WHEN {c} <> {S} AND length({d}) = 10 THEN concat({d}[1:3], '-', {d}[4:6], '-', {d}[7:]) ELSE {c} END"

    new = {
        "term_date": f"CASE WHEN {swap} THEN effective_date WHEN {term} THEN term_date ELSE {S} END",
        "effective_date": f"CASE WHEN {swap} THEN {S} ELSE effective_date END",
        "transaction_attribute": f"CASE WHEN {term} THEN 'Provider' WHEN lower(transaction_type) = 'add' THEN {S} ELSE transaction_attribute END",
        "term_reason": f"CASE WHEN {term} THEN term_reason ELSE {S} END",
        "phone_number": phone("phone_number"), "fax_number": phone("fax_number"),
        "provider_npi": f"CASE WHEN provider_npi = {S} THEN {S} ELSE {_D.format('provider_npi')} END",
        "group_npi": f"CASE WHEN group_npi = {S} THEN {S} ELSE {_D.format('group_npi')} END",
        "tin": f"CASE WHEN tin <> {S} AND length({_D.format('tin')}) = 9 THEN concat({_D.format('tin')}[1:2], '-', {_D.format('tin')}[3:]) ELSE tin END",
        "ppg_id": f"CASE WHEN ppg_id = {S} THEN {S} ELSE regexp_replace(ppg_id, '[^A-Za-z0-9, ]', '', 'g') END",
    }
    return f"{out} AS (SELECT msg_id, block_id, {', '.join(f'{new[c]} AS {c}' if c in new else c for c in OUTPUT_COLUMNS)} FROM {src})"


@query("validated_records", f"{DMG}, {validated_cte('dmg', 'val')} SELECT * FROM val")
def validated_records(spark, sf):
    return records.validate_all(_damaged(spark, sf))


@query("business_rules", f"{DMG}, {rules_cte('dmg', 'rul')} SELECT * FROM rul")
def business_rules(spark, sf):
    return records.business_rules(_damaged(spark, sf))


def contract_sql(src: str) -> str:
    parts = []
    for c in OUTPUT_COLUMNS:
        v = f"trim({c}, {WS})"
        allowed = ALLOWED_VALUES.get(c)
        if allowed:
            values = f"list_transform(string_split({v}, ','), lambda p: trim(p, {WS}))" if c == "line_of_business" else f"[{v}]"
            tail = lit("' is not an allowed value. Must be one of: " + ", ".join(allowed))
            parts.append(
                f"SELECT msg_id, block_id, '{c}' AS field, concat('''', p, {tail}) AS error FROM (SELECT msg_id, block_id, unnest({values}) AS p FROM {src} WHERE {v} <> {S}) "
                f"WHERE p <> '' AND NOT list_contains({str_list(allowed)}, p)")
        if c in ("term_date", "term_reason"):
            parts.append(f"SELECT msg_id, block_id, '{c}', 'Field is required when Transaction Type is ''Term''' FROM {src} WHERE transaction_type = 'Term' AND {v} = ''")
        n, text = {"provider_npi": (10, "NPI must be 10 digits"), "group_npi": (10, "Group NPI must be 10 digits"), "tin": (9, "TIN must be 9 digits, formatted as XX-XXXXXXX")}.get(c, (0, ""))
        if n:
            parts.append(f"SELECT msg_id, block_id, '{c}', '{text}' FROM {src} WHERE {v} NOT IN ('', {S}) AND length({_D.format(c)}) <> {n}")
    return " UNION ALL ".join(parts)


@query("column_contract", f"{DMG} {contract_sql('dmg')}")
def column_contract(spark, sf):
    return records.contract_errors(_damaged(spark, sf))


@query("contract_metadata", "WITH spec AS (SELECT * FROM (VALUES "
       + ", ".join(f"({i}, {lit(n)}, {lit(h)}, {lit(', '.join(ALLOWED_VALUES.get(n, [])))})" for i, (n, h) in enumerate(OUTPUT_COLUMNS.items()))
       + f") AS v(position, name, heading, allowed)), errs AS ({DMG} {contract_sql('dmg')}), n AS (SELECT field, count(*) AS errors FROM errs GROUP BY 1) "
       "SELECT position, name, heading, allowed, coalesce(errors, 0) AS errors FROM spec LEFT JOIN n ON n.field = spec.name")
def contract_metadata(spark, sf):
    """Column specifications with the number of violations seen in a batch."""
    errors = records.contract_errors(_damaged(spark, sf)).groupBy(F.col("field").alias("name")).agg(F.count("*").alias("errors"))
    specs = records.column_specs(spark).select("position", "name", "heading", F.coalesce(F.array_join("allowed_values", ", "), F.lit("")).alias("allowed"))
    return specs.join(errors, "name", "left").withColumn("errors", F.coalesce("errors", F.lit(0).cast("bigint")))


FINAL_CTE = f"{normalized_cte('rec', 'nrm')}, {validated_cte('nrm', 'val')}, {rules_cte('val', 'fin')}"


def final_records(spark, sf, gap=2, html=False):
    return raw_records(spark, sf, gap, html).transform(records.process)


@query("final_roster", f"{REC}, {FINAL_CTE} SELECT msg_id, block_id, {_COLS} FROM fin")
def final_roster(spark, sf):
    return final_records(spark, sf)


@query("final_roster_gap0", f"{REC0}, {FINAL_CTE} SELECT msg_id, block_id, {_COLS} FROM fin")
def final_roster_gap0(spark, sf):
    return final_records(spark, sf, 0)


@query("final_roster_html", f"{REC_HTML}, {FINAL_CTE} SELECT msg_id, block_id, {_COLS} FROM fin")
def final_roster_html(spark, sf):
    return final_records(spark, sf, html=True)


_TEMPLATE = ["TIN", "Provider Name", "Provider NPI", "Roster Note", "Term Date"]


@query("output_columns", f"""
    {REC}, {FINAL_CTE} SELECT tin AS "TIN", provider_name AS "Provider Name", provider_npi AS "Provider NPI", {S} AS "Roster Note", term_date AS "Term Date" FROM fin""")
def output_columns(spark, sf):
    """Projection to a template order; headings without a field hold the sentinel."""
    return records.to_output(final_records(spark, sf), _TEMPLATE)
