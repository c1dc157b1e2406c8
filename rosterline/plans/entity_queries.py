"""Queries over names, organisations, specialties, lines of business, dates, types."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import explode_rows, made_rows, spread

from ..functions import checks
from ..functions import text as tx
from ..operators import entities as en
from ..operators import gazetteer, phrases
from ..sources import dictionaries
from ..sources import fixture as fx
from ..vocab import specialties as sp
from ..vocab.business import LOB_GAZETTEER
from ..vocab.transactions import (
    ADD_WORDS, CHANGE_WORDS, EXISTING_PROVIDER, EXPLICIT_TYPE, FIRST_TIME_PROVIDER, TERM_WORDS,
    TYPE_SUBJECTS, TYPE_WEIGHTS, UPDATE_NEAR_ADD, UPDATE_WORDS,
)
from .registry import MAIL_CTE, lit, query, str_list, struct_list
from .scan_queries import hits_sql
from .section_queries import lcs_sql
from .text_queries import PY_TITLE, WS, body_window_cte, pipe_sql

COLLAPSE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'), " + WS + ")"


def any_sql(text: str, phrases) -> str:
    return f"len(list_filter({str_list(phrases)}, lambda w: contains({text}, w))) > 0"


# --- names -----------------------------------------------------------------

NAME_SQL = [r"Dr\.?\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]*\.?)*\s+[A-Z][a-z]+)", en.NAME_MD, en.NAME_DO]


def names_sql(src: str, key: str, text: str) -> str:
    value = f"regexp_replace({COLLAPSE.format('m')}, '(?i),\\s*(M\\.?D\\.?|D\\.?O\\.?)$', ', \\1')"
    rows = hits_sql(src, key, text, NAME_SQL).replace(", 'i'), lambda", "), lambda")
    return f"SELECT {key}, {value} AS value, 0.6::DOUBLE AS confidence, concat('name_pattern_', i) AS extractor_id, o AS match_ord, i FROM ({rows})"


#: mails that also name people with degrees and initials
PEOPLE = (
    "concat(body, chr(10), person, ', MD and ', replace(person, ' ', '  '), ' D.O. met Dr. ', split_part(person, ' ', 1), ' Q. ', "
    "split_part(person, ' ', 2), ' J. and Dr ', split_part(person, ' ', 1))"
)
PEOPLE_CTE = f"{MAIL_CTE.rsplit(', mail AS', 1)[0]}, mail AS (SELECT msg_id, {PEOPLE} AS body FROM rendered)"


def _people(spark, sf):
    return fx.rendered(spark, sf).selectExpr("msg_id", f"{PEOPLE} AS body")


@query("provider_names", f"WITH {PEOPLE_CTE}, c AS ({names_sql('mail', 'msg_id', 'body')}) SELECT msg_id, value, confidence, extractor_id, match_ord FROM c")
def provider_names(spark, sf):
    return _people(spark, sf).transform(explode_rows, ["msg_id"], en.provider_names("body"), "c").select(
        "msg_id", "c.value", "c.confidence", "c.extractor_id", "c.match_ord")


LIKELY_SQL = (
    "(NOT ({stop}) AND len(string_split(trim({0}), ' ')) >= 2 AND length(trim({0})) > 0 AND "
    "len(list_filter(regexp_extract_all({0}, '\\S+'), lambda p: length(p) <= 1)) = 0)"
)


def likely_sql(name: str) -> str:
    return LIKELY_SQL.format(name, stop=any_sql(f"lower({name})", en.NAME_STOP))


_NAMES = "CASE WHEN c_custkey % 6 = 0 THEN split_part(c_name, '#', 1) WHEN c_custkey % 6 = 1 THEN concat('Dr. ', c_name, ' x') WHEN c_custkey % 6 = 2 THEN concat('Best Regards ', c_name) ELSE concat(c_mktsegment, ' ', c_name) END"


@query("name_plausibility", f"SELECT c_custkey, n AS name, {likely_sql('n')} AS likely FROM (SELECT c_custkey, {_NAMES} AS n FROM customer)")
def name_plausibility(spark, sf):
    return fx.table(spark, sf, "customer").selectExpr("c_custkey", f"{_NAMES} AS name").select(
        "c_custkey", "name", F.expr(en.likely_name("name")).alias("likely"))


@query("title_adjacent_names", f"""
    WITH {PEOPLE_CTE}, c AS ({names_sql('mail', 'msg_id', 'body')}), j AS (SELECT c.*, m.body FROM c JOIN mail m USING (msg_id))
    SELECT msg_id, value, 0.9::DOUBLE AS confidence, count(*)::BIGINT AS n FROM j WHERE {likely_sql('value')} AND (
        regexp_matches(body, concat('(?i)\\b(?:{en.TITLES})\\b\\.?\\s+(?:\\S+\\s+){{0,5}}?', '\\Q', value, '\\E'))
        OR regexp_matches(body, concat('(?i)', '\\Q', value, '\\E', '(?:\\W+\\w+){{0,5}}?\\W+\\b(?:{en.TITLES})\\b'))) GROUP BY 1, 2""")
def title_adjacent_names(spark, sf):
    found = _people(spark, sf).transform(explode_rows, ["msg_id"], en.names_near_title("body"), "c")
    return found.groupBy("msg_id", "c.value", "c.confidence").agg(F.count("*").alias("n"))


# --- organisations ---------------------------------------------------------

def related_sql(n: str) -> str:
    low = f"lower({n})"
    return (
        f"CASE WHEN length({n}) < 3 THEN false WHEN {any_sql(low, en.NOT_HEALTHCARE)} THEN false WHEN {any_sql(low, en.HEALTHCARE_TERMS)} THEN true "
        f"WHEN length({n}) >= 8 THEN true ELSE regexp_matches({n}, '^[A-Z]+(?:\\s*&\\s*[A-Z]+)*$') END"
    )


def plan_sql(n: str) -> str:
    return f"(NOT ({any_sql(f'lower({n})', en.PROVIDER_TERMS)}) AND ({any_sql(f'lower({n})', en.PLAN_TERMS)}))"


def orgconf_sql(n: str, cx: str) -> str:
    return (
        f"least(0.7::DOUBLE + CASE WHEN {any_sql(f'lower({n})', ['medical', 'clinic', 'hospital', 'practice'])} THEN 0.1::DOUBLE ELSE 0 END "
        f"+ CASE WHEN {any_sql(f'lower({cx})', ['terminated with', 'affiliated with', 'practices at'])} THEN 0.15::DOUBLE ELSE 0 END "
        f"+ CASE WHEN {any_sql(f'lower({n})', ['group', 'associates', 'partners'])} THEN 0.05::DOUBLE ELSE 0 END, 0.95::DOUBLE)"
    )


def class_sql(cx: str, n: str) -> str:
    return (
        f"CASE WHEN {any_sql(f'lower({cx})', en.CONTEXT_PROVIDER)} OR {any_sql(f'lower({n})', en.NAME_PROVIDER)} THEN 'provider' "
        f"WHEN {any_sql(f'lower({cx})', en.CONTEXT_PLAN)} OR {any_sql(f'lower({n})', en.CONTEXT_PLAN)} THEN 'health_plan' ELSE 'unknown' END"
    )


def title_words_sql(x: str, small, first: bool) -> str:
    lead = "i = 1 OR " if first else ""
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '\\S+'), lambda w, i: CASE WHEN {lead}NOT list_contains({str_list(small)}, lower(w)) "
        f"THEN {PY_TITLE.format('w')} ELSE lower(w) END), ' ')"
    )


def context_sql(text: str, p: str, before: int, after: int, length: str) -> str:
    lo = f"greatest({p} - {before}, 0)"
    return f"trim(replace(substr({text}, ({lo})::INT + 1, ({p} + {length} + {after} - {lo})::INT), chr(10), ' '), {WS})"


def organizations_cte(src: str, key: str, text: str, out: str) -> str:
    """Accepted organisations of a prepared body: ``{out}({key}, name, value, confidence)``."""
    run = en.CAPITAL_RUN.replace("*+", "*")
    tail = rf"^((?:[^\n]*[ \t])?(?:{en.ALIAS})(?:[ \t]+&[ \t]+[A-Z]{{2,10}}\b)?)\b"
    return f"""
    {out}_n AS (SELECT {key}, {text} AS body, trim(unnest(regexp_extract_all({text}, {lit(en.ORG_LABEL)}, 1)), {WS}) AS m, 0 AS kd FROM {src}
        UNION SELECT {key}, {text}, regexp_extract(unnest(regexp_extract_all({text}, {lit(run)})), {lit(tail)}, 1), 1 FROM {src}),
    {out}_k AS (SELECT {key}, m, {context_sql('body', '(strpos(body, m) - 1)', 60, 60, 'length(m)')} AS cx, min(kd * 1000000 + strpos(body, m)) AS rk FROM {out}_n
        WHERE m <> '' AND {related_sql('m')} AND NOT {plan_sql('m')} GROUP BY 1, 2, 3),
    {out} AS (SELECT {key}, m AS name, {title_words_sql('m', en.ORG_SMALL_WORDS, False)} AS value, {orgconf_sql('m', 'cx')} AS confidence, cx, rk FROM {out}_k)"""


def best_org_cte(cands: str, key: str, out: str) -> str:
    return f"""
    {out} AS (SELECT {key}, arg_max(value, (confidence, length(value), -rk)) AS value, max(confidence) AS confidence FROM {cands} a
        WHERE NOT EXISTS (SELECT 1 FROM {cands} b WHERE b.{key} = a.{key} AND length(b.value) > length(a.value) AND contains(lower(b.value), lower(a.value))) GROUP BY 1)"""


def organization_cte(src: str, key: str, text: str, p: str) -> str:
    """Best organisation of body, else of bar lines: ``{p}org({key}, value)``."""
    return f"""
    {body_window_cte(src, key, text, p + 'bw')}, {organizations_cte(p + 'bw', key, 'text', p + 'oc')}, {best_org_cte(p + 'oc', key, p + 'ob')},
    {p}pl AS (SELECT {key}, {pipe_sql(text)} AS text FROM {src}), {organizations_cte(p + 'pl', key, 'text', p + 'pc')}, {best_org_cte(p + 'pc', key, p + 'pb')},
    {p}org AS (SELECT s.{key}, coalesce(b.value, p.value) AS value, coalesce(b.confidence, p.confidence) AS confidence FROM {src} s LEFT JOIN {p}ob b ON b.{key} = s.{key} LEFT JOIN {p}pb p ON p.{key} = s.{key}
        WHERE coalesce(b.value, p.value) IS NOT NULL)"""


#: mails that name more organisations in prose
ORGS = (
    "concat('Dear Team,', chr(10), 'Dr. ', person, ' practices at the ', org, ' & RC of North Shore Medical Group and Health Net.', chr(10), "
    "'He was affiliated with Blue Shield Insurance, Pine ', org, ' Hospital.', chr(10), 'Group: ', org, chr(10), 'Regards')"
)
ORGS_CTE = f"{MAIL_CTE.rsplit(', mail AS', 1)[0]}, mail AS (SELECT msg_id, CASE WHEN k % 3 = 0 THEN body ELSE {ORGS} END AS body FROM rendered)"


def _org_mails(spark, sf):
    return fx.rendered(spark, sf).selectExpr("msg_id", f"CASE WHEN k % 3 = 0 THEN body ELSE {ORGS} END AS body")


@query("organizations", f"""
    WITH {ORGS_CTE}, {body_window_cte('mail', 'msg_id', 'body', 'bw')}, {organizations_cte('bw', 'msg_id', 'text', 'oc')}
    SELECT msg_id, name, value, confidence, cx AS context FROM oc""")
def organizations(spark, sf):
    bodies = _org_mails(spark, sf).select("msg_id", F.expr(tx.body_window("body")).alias("bw"))
    return bodies.transform(explode_rows, ["msg_id"], en.organization_candidates("bw"), "o").select(
        "msg_id", "o.name", "o.value", "o.confidence", "o.context")


@query("org_best", f"WITH {ORGS_CTE}, {organization_cte('mail', 'msg_id', 'body', '')} SELECT msg_id, value, confidence FROM org")
def org_best(spark, sf):
    return _org_mails(spark, sf).transform(made_rows, ["msg_id"], en.organization("body"), "o").select(
        "msg_id", "o.value", "o.confidence")


_ORG_NAMES = (
    "CASE c_custkey % 9 WHEN 0 THEN concat('the ', c_mktsegment, ' Medical Group effective 01/02/2025.') WHEN 1 THEN 'Health Net' WHEN 2 THEN 'Blue Insurance Practice' "
    "WHEN 3 THEN 'ABC & DEF' WHEN 4 THEN 'Outlook Clinic' WHEN 5 THEN 'HMO' WHEN 6 THEN concat(c_mktsegment, ' of the Coast, ') WHEN 7 THEN 'March' ELSE concat(c_name, ' Partners') END"
)
_ORG_CONTEXTS = "CASE c_custkey % 4 WHEN 0 THEN concat('was terminated with ', c_name) WHEN 1 THEN 'a Medicare plan' WHEN 2 THEN c_mktsegment ELSE 'practices at a place' END"
_CLEAN_SQL = (
    "trim(regexp_replace(regexp_replace(regexp_replace(n, '(?i)^the\\s+', ''), '(?i)\\s+(?:effective|on|as\\s+of)[^\\n]*$', ''), '[.,;:\\s]+$', ''), " + WS + ")"
)


@query("org_confidence", f"""
    SELECT c_custkey, n AS name, {orgconf_sql('n', 'cx')} AS confidence, {related_sql('n')} AS healthcare, {plan_sql('n')} AS health_plan,
        {any_sql('lower(n)', en.BAD_ORG)} AS bad, {any_sql('lower(n)', en.HEALTHCARE_WORDS)} AS healthcare_org
    FROM (SELECT c_custkey, {_ORG_NAMES} AS n, {_ORG_CONTEXTS} AS cx FROM customer)""")
def org_confidence(spark, sf):
    rows = fx.table(spark, sf, "customer").selectExpr("c_custkey", f"{_ORG_NAMES} AS name", f"{_ORG_CONTEXTS} AS cx")
    return rows.select(
        "c_custkey", "name", F.expr(en.organization_confidence("name", "cx")).alias("confidence"),
        F.expr(en.is_healthcare_related("name")).alias("healthcare"), F.expr(en.is_health_plan("name")).alias("health_plan"),
        F.expr(en.is_bad_organization("name")).alias("bad"), F.expr(en.is_healthcare_organization("name")).alias("healthcare_org"))


@query("org_context_class", f"""
    SELECT c_custkey, n AS name, {class_sql('cx', 'n')} AS kind, CASE WHEN regexp_matches({_CLEAN_SQL},
        '(?i)^(?:(?:effective|on|as\\s+of|date|time)|\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}|(?:january|february|march|april|may|june|july|august|september|october|november|december)|\\w{{1,2}})$')
        THEN '' ELSE {_CLEAN_SQL} END AS clean, {title_words_sql('n', en.ORG_SMALL_WORDS, False)} AS titled
    FROM (SELECT c_custkey, {_ORG_NAMES} AS n, {_ORG_CONTEXTS} AS cx FROM customer)""")
def org_context_class(spark, sf):
    rows = fx.table(spark, sf, "customer").selectExpr("c_custkey", f"{_ORG_NAMES} AS name", f"{_ORG_CONTEXTS} AS cx")
    return rows.select(
        "c_custkey", "name", F.expr(en.organization_context_class("cx", "name")).alias("kind"),
        F.expr(en.clean_organization("name")).alias("clean"),
        F.expr(en.normalize_organization_candidate("name")).alias("titled"))


# --- specialties -----------------------------------------------------------

def synonyms_cte(src: str, key: str, text: str, out: str) -> str:
    values = ", ".join(f"({i}, {lit(s)}, {lit(c)})" for i, (s, c) in enumerate(sp.reverse_map().items()))
    # split on the plain word edges of a short synonym to find its first place
    head = "string_split_regex(lower(t), concat('\\b', s.syn, '\\b'))[1]"
    around = f"concat(right({head}, 20), substr(lower(t), length({head}) + length(s.syn) + 1, 20))"
    return f"""
    {out}_d AS (SELECT * FROM (VALUES {values}) AS v(ord, syn, canonical)),
    {out}_h AS MATERIALIZED (SELECT x.{key}, s.ord, s.syn, s.canonical FROM (SELECT {key}, {text} AS t FROM {src}) x, {out}_d s
        WHERE CASE WHEN NOT contains(lower(t), s.syn) THEN false WHEN length(s.syn) <= 2 THEN regexp_matches(t, concat('(?i)\\b\\Q', s.syn, '\\E\\b')) AND NOT regexp_matches({around}, '{en.SHORT_VETO}')
            ELSE regexp_matches(t, concat('(?i)\\b\\Q', s.syn, '\\E\\b|\\Q', s.syn, '\\E(?:[\\s,.]|$)')) END),
    {out} AS (SELECT {key}, canonical AS value, CASE WHEN length(arg_min(syn, ord)) <= 2 THEN 0.7 ELSE 0.95 END::DOUBLE AS confidence,
        'enhanced_synonym_match' AS extractor_id, min(ord) AS ord FROM {out}_h GROUP BY 1, 2)"""


def codes_cte(src: str, key: str, text: str, out: str) -> str:
    values = ", ".join(f"({i}, {lit(c)}, {lit(n)})" for i, (c, n) in enumerate(sp.taxonomy_map().items()))
    return f"""
    {out}_d AS (SELECT * FROM (VALUES {values}) AS v(ord, code, canonical)),
    {out} AS (SELECT x.{key}, d.canonical AS value, 0.9::DOUBLE AS confidence, 'taxonomy_code_match' AS extractor_id, min(d.ord) AS ord
        FROM {src} x, {out}_d d WHERE CASE WHEN contains(lower(x.{text}), d.code) THEN regexp_matches(x.{text}, concat('(?i)\\b', d.code, '\\b')) ELSE false END GROUP BY 1, 2)"""


def fuzzy_cte(src: str, key: str, text: str, out: str) -> str:
    names = ", ".join(f"({i}, {lit(n)})" for i, n in enumerate(sp.SPECIALTIES))
    pats = [rf"\w+(?:\s+\w+)*\s+{e}|\w*{e}\w*(?:\s+\w+)*" for e in en.PHRASE_ENDINGS]
    labels = [rf"{w}[:\s]+([^,.\n]+)" for w in en.PHRASE_LABELS]
    span = f"substr(p, greatest(o, 0)::INT + 1, (least(o + length(c), length(p)) - greatest(o, 0))::INT)"
    cut = f"substr(c, greatest(o, 0)::INT + 1, (least(o + length(p), length(c)) - greatest(o, 0))::INT)"

    def score(a, b):
        return (
            f"CASE WHEN levenshtein({a}, {b}) <= 0.15 * (length({a}) + length({b})) + 1e-9 "
            f"THEN 200.0::DOUBLE * ({lcs_sql(a, b)}) / (length({a}) + length({b})) ELSE 0 END"
        )

    return f"""
    {out}_g AS ({hits_sql(src, key, text, pats, 0)}), {out}_l AS ({hits_sql(src, key, text, labels, 1)}),
    {out}_a AS (SELECT {key}, trim(m, {WS}) AS ph, i * 1000000 + o AS ord FROM {out}_g UNION ALL SELECT {key}, trim(m, {WS}), (100 + i) * 1000000 + o FROM {out}_l),
    {out}_p AS (SELECT {key}, ph, min(ord) AS ord FROM {out}_a WHERE length(ph) > 3 GROUP BY 1, 2),
    {out}_n AS (SELECT ord, name, lower(name) AS c FROM (VALUES {names}) AS v(ord, name)),
    {out}_d AS (SELECT DISTINCT lower(ph) AS p FROM {out}_p),
    {out}_r AS (SELECT p, arg_max(name, (sc, -ord)) AS name, max(sc) AS sc FROM (SELECT p, name, ord, 200.0::DOUBLE * ({lcs_sql('p', 'c')}) / (length(p) + length(c)) AS sc
        FROM {out}_d, {out}_n WHERE length(p) <= 1.5 * length(c) + 1 AND length(c) <= 1.5 * length(p) + 1) WHERE sc >= 80 GROUP BY 1),
    {out}_q AS (SELECT p, c, name, ord, unnest(range(1 - length(c), length(p))) AS o, true AS tall FROM {out}_d, {out}_n WHERE length(p) >= length(c) AND p NOT IN (SELECT p FROM {out}_r)
        UNION ALL SELECT p, c, name, ord, unnest(range(1 - length(p), length(c))), false FROM {out}_d, {out}_n WHERE length(p) <= length(c) AND p NOT IN (SELECT p FROM {out}_r)),
    {out}_w AS (SELECT p, c, name, ord, CASE WHEN tall THEN {span} ELSE p END AS a, CASE WHEN tall THEN c ELSE {cut} END AS b FROM {out}_q),
    {out}_x AS (SELECT p, arg_max(name, (sc, -ord)) AS name, max(sc) AS sc FROM (SELECT p, name, ord, {score('a', 'b')} AS sc FROM {out}_w) WHERE sc >= 85 GROUP BY 1),
    {out}_b AS (SELECT * FROM {out}_r UNION ALL SELECT * FROM {out}_x),
    {out} AS (SELECT {key}, b.name AS value, arg_min(CASE WHEN sc >= 90 THEN 0.8 WHEN sc >= 85 THEN 0.7 ELSE 0.6 END::DOUBLE, p.ord) AS confidence,
        'fuzzy_match' AS extractor_id, min(p.ord) AS ord FROM {out}_p p JOIN {out}_b b ON b.p = lower(p.ph) GROUP BY 1, 2)"""


def exact_cte(src: str, key: str, text: str, out: str) -> str:
    names = ", ".join(f"({i}, {lit(n)})" for i, n in enumerate(sp.SPECIALTIES))
    return f"""
    {out}_d AS (SELECT * FROM (VALUES {names}) AS v(ord, name)),
    {out} AS (SELECT x.{key}, d.name AS value, 0.8::DOUBLE AS confidence, 'canonical_exact_match' AS extractor_id, d.ord
        FROM {src} x, {out}_d d WHERE CASE WHEN contains(lower(x.{text}), lower(d.name)) THEN regexp_matches(x.{text}, concat('(?i)\\b\\Q', d.name, '\\E\\b')) ELSE false END)"""


def specialties_cte(src: str, key: str, text: str, p: str) -> str:
    """All specialty sources: ``{p}sp({key}, value, confidence, extractor_id, src, ord)``, first per canonical."""
    every = " UNION ALL ".join(
        f"SELECT {key}, value, confidence, extractor_id, {i} AS src, ord FROM {p}sp{i}" for i in range(4))
    return f"""
    {synonyms_cte(src, key, text, p + 'sp0')}, {codes_cte(src, key, text, p + 'sp1')}, {fuzzy_cte(src, key, text, p + 'sp2')}, {exact_cte(src, key, text, p + 'sp3')},
    {p}sp AS (SELECT {key}, value, arg_min(confidence, (src, ord)) AS confidence, arg_min(extractor_id, (src, ord)) AS extractor_id, min((src, ord)) AS rank FROM ({every}) GROUP BY 1, 2)"""


#: mails with taxonomy codes and misspelt specialties
_CODES = ",".join(sp.taxonomy_map())
SPECIAL = (
    f"concat(body, chr(10), 'Code ', upper(split_part('{_CODES}', ',', cast(k % 35 + 1 as int))), ', ', "
    f"split_part('{_CODES}', ',', cast(k % 7 + 1 as int)), chr(10), 'area: ', "
    "split_part('Rheumatologi,Neurosurgry of adults,critical car,a general surgry clinic list,sport medicine field,plain words', ',', cast(k % 6 + 1 as int)), "
    "chr(10), 'Pediatric Emergency Medicine er')"
)
SPECIAL_CTE = f"{MAIL_CTE.rsplit(', mail AS', 1)[0]}, mail AS (SELECT msg_id, CASE WHEN k % 2 = 0 THEN body ELSE {SPECIAL} END AS body FROM rendered)"


def _special_mails(spark, sf):
    return fx.rendered(spark, sf).selectExpr("msg_id", f"CASE WHEN k % 2 = 0 THEN body ELSE {SPECIAL} END AS body")


def _specialty_query(build):
    def run(spark, sf):
        return _special_mails(spark, sf).transform(explode_rows, ["msg_id"], build("body"), "c").select(
            "msg_id", "c.value", "c.confidence", "c.extractor_id")

    return run


def _batch_query(build):
    return lambda spark, sf: build(_special_mails(spark, sf), ["msg_id"], text="body").select("msg_id", "value", "confidence", "extractor_id")


_SP = "SELECT msg_id, value, confidence, extractor_id FROM"
query("specialty_synonym", f"WITH {SPECIAL_CTE}, {synonyms_cte('mail', 'msg_id', 'body', 's')} {_SP} s")(_specialty_query(en.specialty_synonyms))
query("specialty_fuzzy", f"WITH {SPECIAL_CTE}, {fuzzy_cte('mail', 'msg_id', 'body', 's')} {_SP} s")(_batch_query(phrases.fuzzy_specialties))
query("specialty_exact", f"WITH {SPECIAL_CTE}, {exact_cte('mail', 'msg_id', 'body', 's')} {_SP} s")(_specialty_query(en.specialty_exact))
query("specialty_union", f"WITH {SPECIAL_CTE}, {specialties_cte('mail', 'msg_id', 'body', '')} {_SP} sp")(_batch_query(phrases.specialties_of))


query("specialty_taxonomy", f"WITH {SPECIAL_CTE}, {codes_cte('mail', 'msg_id', 'body', 's')} {_SP} s")(_specialty_query(en.specialty_codes))


@query("specialty_reverse_map", "WITH r AS (SELECT * FROM (VALUES "
       + ", ".join(f"({o}, {lit(s)}, {lit(c)})" for o, s, c in sp.synonym_rows())
       + ") AS v(ord, synonym, canonical)) SELECT r.synonym, arg_max(canonical, ord) AS canonical, min(ord)::INT AS first_ord, count(*) AS owners, (SELECT count(*) FROM part WHERE contains(lower(p_name), r.synonym)) AS parts FROM r GROUP BY 1")
def specialty_reverse_map(spark, sf):
    """Reverse dictionary with the number of part names that hold each synonym."""
    dim = spark.createDataFrame(sp.synonym_rows(), "ord int, synonym string, canonical string")
    reverse = dim.groupBy("synonym").agg(
        F.max_by("canonical", "ord").alias("canonical"), F.min("ord").alias("first_ord"), F.count("*").alias("owners"))
    # names are counted first, so the scan of the dictionary meets each distinct name once
    names = fx.table(spark, sf, "part").groupBy(F.lower("p_name").alias("name")).agg(F.count("*").alias("n"))
    synonyms = ", ".join("'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'" for s in sp.reverse_map())
    hits = names.transform(explode_rows, ["n"], f"filter(array({synonyms}), s -> contains(name, s))", "synonym")
    used = hits.groupBy("synonym").agg(F.sum("n").alias("parts"))
    return reverse.join(F.broadcast(used), "synonym", "left").withColumn("parts", F.coalesce("parts", F.lit(0).cast("bigint")))


# --- lines of business, dates ----------------------------------------------

def lob_cte(src: str, key: str, text: str, out: str) -> str:
    values = ", ".join(f"({i}, {lit(v)}, {lit(n[0])})" for i, (v, n) in enumerate(LOB_GAZETTEER.items()))
    return f"""
    {out}_d AS (SELECT * FROM (VALUES {values}) AS v(ord, variant, canonical)),
    {out} AS (SELECT x.{key}, canonical AS value, min(ord) AS ord FROM {src} x, {out}_d d
        WHERE regexp_matches(x.{text}, concat('(?i)\\b', variant, '\\b')) GROUP BY 1, 2)"""


@query("lob_gazetteer", f"WITH {MAIL_CTE}, {lob_cte('mail', 'msg_id', 'body', 's')} SELECT msg_id, value, (row_number() OVER (PARTITION BY msg_id ORDER BY ord) - 1)::INT AS ord FROM s")
def lob_gazetteer(spark, sf):
    return fx.mail(spark, sf).transform(explode_rows, ["msg_id"], en.lines_of_business("body"), "ord", "value")


_MONTH_LIST = "'January,February,March,April,May,June,July,August,September,October,November,December'"
_MON = "split_part(" + _MONTH_LIST + ", ',', cast(month(o_orderdate) as int))"
DATE_TEXT = (
    f"concat('Effective ', day(o_orderdate), CASE o_orderkey % 4 WHEN 0 THEN 'th' WHEN 1 THEN '' WHEN 2 THEN 'ND' ELSE 'st' END, ' ', "
    f"CASE WHEN o_orderkey % 3 = 0 THEN substr({_MON}, 1, 3) ELSE {_MON} END, ' ', year(o_orderdate), ' until ', {_MON}, ' ', day(o_orderdate), ', ', year(o_orderdate), ' or ', upper({_MON}), ' ', year(o_orderdate))"
)


def word_dates_sql(src: str, key: str, text: str) -> str:
    months = "MAP {" + ", ".join(f"'{m}': '{n:02d}'" for m, n in en.MONTHS.items()) + "}"
    mon = f"{months}[regexp_extract(lower(m), '({'|'.join(en.MONTHS)})\\s', 1)]"
    day = "lpad(regexp_extract(m, CASE WHEN i = 1 THEN '^[A-Za-z]+\\s+(\\d+)' ELSE '^(\\d+)' END, 1), 2, '0')"
    value = f"concat({mon}, '/', CASE WHEN i = 3 THEN '01' ELSE {day} END, '/', right(m, 4))"
    pats = [p for p, _ in en.WORD_DATES]
    return f"SELECT {key}, {value} AS value, 0.7::DOUBLE AS confidence, concat('date_fallback_', i) AS extractor_id, o AS match_ord, i FROM ({hits_sql(src, key, text, pats, 0)})"


def word_dates_context_sql(src: str, key: str, text: str) -> str:
    """Word dates with the confidence of their context: ten words on either side, cut from the text before and after each match."""
    parts = []
    for i, (p, _) in enumerate(en.WORD_DATES):
        full = lit("(?i)" + p)
        parts.append(f"""SELECT {key}, {i} AS i, o, hs[o + 1] AS m, concat(coalesce(list_aggregate(list_transform(range(0, o), lambda j: concat(gs[j + 1], hs[j + 1])), 'string_agg', ''), ''), gs[o + 1]) AS lead,
            concat(gs[o + 2], coalesce(list_aggregate(list_transform(range(o + 1, len(hs)), lambda j: concat(hs[j + 1], gs[j + 2])), 'string_agg', ''), '')) AS tail
            FROM (SELECT {key}, gs, hs, unnest(range(0, len(hs)))::INT AS o FROM (SELECT {key}, string_split_regex({text}, {full}) AS gs, regexp_extract_all({text}, {full}, 0) AS hs FROM {src}))""")
    cues = "|".join(en.DATE_CUES)
    near = "concat(array_to_string(string_split_regex(lead, '\\s+')[-11:], ' '), '|', m, '|', array_to_string(string_split_regex(tail, '\\s+')[1:11], ' '))"
    return f"""SELECT w.{key}, w.value, CASE WHEN regexp_matches(lower({near}), '{cues}') THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence, concat('date_context_', w.i) AS extractor_id, w.match_ord, w.i
        FROM ({word_dates_sql(src, key, text)}) w JOIN ({' UNION ALL '.join(parts)}) c ON c.{key} = w.{key} AND c.i = w.i AND c.o = w.match_ord"""


#: mails that name several dates in words: a first one, one after a number of filler words, and one next to a cue
DATED = (
    "concat('We met on ', cast(k % 28 + 1 as string), ' March 2024', CASE k % 4 WHEN 0 THEN ', please' WHEN 1 THEN chr(10) ELSE ' and talked' END, "
    "repeat(' of this and that', cast(k % 5 as int)), CASE k % 3 WHEN 0 THEN ' Effective: ' WHEN 1 THEN ' the contract ends ' ELSE ' around ' END, "
    "CASE WHEN k % 2 = 0 THEN 'May 5, 2025' ELSE '6th June 2025' END, repeat(' noted', cast(k % 13 as int)), '. Expires January 2026', chr(10), body)"
)
DATED_CTE = f"{MAIL_CTE.rsplit(', mail AS', 1)[0]}, mail AS (SELECT msg_id, {DATED} AS body FROM rendered)"


def dated_mails(spark, sf):
    return fx.rendered(spark, sf).selectExpr("msg_id", f"{DATED} AS body")


@query("word_dates_context", f"WITH {DATED_CTE} SELECT msg_id, value, confidence, extractor_id, match_ord FROM ({word_dates_context_sql('mail', 'msg_id', 'body')})")
def word_dates_context(spark, sf):
    return dated_mails(spark, sf).transform(explode_rows, ["msg_id"], en.word_dates_in_context("body"), "c").select(
        "msg_id", "c.value", "c.confidence", "c.extractor_id", "c.match_ord")


@query("word_dates", f"WITH o AS (SELECT o_orderkey AS id, {DATE_TEXT} AS t FROM orders), c AS ({word_dates_sql('o', 'id', 't')}) SELECT id, value, confidence, extractor_id, match_ord FROM c")
def word_dates(spark, sf):
    texts = fx.columns(spark, sf, "orders", "o_orderkey", "o_orderdate").selectExpr("o_orderkey AS id", f"{DATE_TEXT} AS t")
    return texts.transform(explode_rows, ["id"], en.word_dates("t"), "c").select(
        "id", "c.value", "c.confidence", "c.extractor_id", "c.match_ord")


@query("date_context_confidence", f"""
    WITH {MAIL_CTE}, c AS (SELECT msg_id, body, regexp_extract_all(body, '\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}') AS ds FROM mail WHERE regexp_matches(body, '\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}')),
    x AS (SELECT msg_id, ds[1] AS value, {context_sql('body', '(strpos(body, ds[1]) - 1)', 30, 30, '0')} AS cx FROM c)
    SELECT msg_id, value, cx AS context, CASE WHEN regexp_matches(lower(cx), 'effective|start|begin|term|end|finish|expir') THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence FROM x""")
def date_context_confidence(spark, sf):
    mail = fx.mail(spark, sf).select(
        "msg_id", "body", F.expr(r"regexp_extract(body, '\\d{1,2}[/-]\\d{1,2}[/-]\\d{2,4}', 0)").alias("value")).filter("value <> ''")
    around = mail.select("msg_id", "value", F.expr(tx.context("body", "instr(body, value) - 1", 30)).alias("context"))
    return around.withColumn("confidence", F.expr(en.date_confidence("context")))


# --- transaction type ------------------------------------------------------

def weighted_sql(low: str, weights) -> str:
    return (
        f"list_reduce(list_transform(list_filter({struct_list('p w', weights)}, lambda e: contains({low}, e.p)), lambda e: e.w), "
        "lambda a, b: a + b, 0.0::DOUBLE)"
    )


def scores_cte(src: str, key: str, text: str, out: str) -> str:
    """Contextual scores: ``{out}({key}, low, a, u, t, type, confidence)``."""
    def score(kind):
        subjects = "".join(f" + CASE WHEN regexp_matches(low[1:50], {lit(p)}) THEN 1.5::DOUBLE ELSE 0 END" for p in TYPE_SUBJECTS[kind])
        return f"{weighted_sql('low', TYPE_WEIGHTS[kind])}{subjects}"

    return f"""
    {out}_b AS (SELECT {key}, low, {score('Add')} AS a, {score('Update')} AS u, {score('Term')} AS t FROM (SELECT {key}, lower({text}) AS low FROM {src})),
    {out}_m AS (SELECT *, a > 0 AND u > 0 AND {any_sql('low', EXISTING_PROVIDER)} AS known, a > 0 AND u > 0 AND NOT ({any_sql('low', EXISTING_PROVIDER)}) AND {any_sql('low', FIRST_TIME_PROVIDER)} AS fresh FROM {out}_b),
    {out}_f AS (SELECT {key}, low, a + CASE WHEN known THEN -0.5 WHEN fresh THEN 1 ELSE 0 END::DOUBLE AS a, u + CASE WHEN known THEN 1 WHEN fresh THEN -0.5 ELSE 0 END::DOUBLE AS u, t FROM {out}_m),
    {out} AS (SELECT *, CASE WHEN greatest(a, u, t) <= 0 THEN NULL WHEN a >= u AND a >= t THEN 'Add' WHEN u >= t THEN 'Update' ELSE 'Term' END AS type,
        CASE WHEN greatest(a, u, t) > 0 THEN least(greatest(a, u, t) / 3::DOUBLE, 0.9::DOUBLE) ELSE 0::DOUBLE END AS confidence FROM {out}_f)"""


def type_cte(src: str, key: str, text: str, out: str) -> str:
    """Transaction type: ``{out}({key}, value, confidence, extractor_id)``."""
    def around(w):
        head = f"length(string_split_regex(low, concat('\\b', {w}, '\\b'))[1])"
        return f"substr(low, (greatest({head} - 50, 0) + 1)::INT, ({head} + length({w}) + 50 - greatest({head} - 50, 0))::INT)"

    def first(ws, extra=""):
        return f"list_filter({str_list(ws)}, lambda w: regexp_matches(low, concat('\\b', w, '\\b')){extra})"

    explicit = "CASE " + " ".join(f"WHEN {any_sql('low', ps)} THEN '{k}'" for k, ps in EXPLICIT_TYPE.items()) + " END"
    fresh = first(ADD_WORDS, f" AND NOT regexp_matches({around('w')}, '{UPDATE_NEAR_ADD}')")
    return f"""
    {scores_cte(src, key, text, out + '_s')},
    {out}_e AS (SELECT *, {explicit} AS ex, regexp_matches(low, '\\b(?:{TERM_WORDS})\\b|no longer') AS ended, {first(UPDATE_WORDS)}[1] AS uw, len({fresh}) > 0 AS added FROM {out}_s),
    {out} AS (SELECT {key},
        CASE WHEN ex IS NOT NULL THEN ex WHEN type IS NOT NULL AND confidence > 0.6::DOUBLE THEN type WHEN ended THEN 'Term' WHEN uw IS NOT NULL THEN 'Update' WHEN added THEN 'Add' END AS value,
        CASE WHEN ex IS NOT NULL THEN 0.95 WHEN type IS NOT NULL AND confidence > 0.6::DOUBLE THEN confidence WHEN ended THEN 0.9
            WHEN uw IS NOT NULL THEN CASE WHEN regexp_matches({around('uw')}, '{CHANGE_WORDS}') THEN 0.85 ELSE 0.7 END WHEN added THEN 0.8 END::DOUBLE AS confidence,
        CASE WHEN ex IS NOT NULL THEN concat('transaction_explicit_', lower(ex)) WHEN type IS NOT NULL AND confidence > 0.6::DOUBLE THEN 'transaction_contextual'
            WHEN ended THEN 'transaction_ner_term' WHEN uw IS NOT NULL THEN 'transaction_ner_update' WHEN added THEN 'transaction_ner_add' END AS extractor_id FROM {out}_e)"""


#: mails of every step of the cascade
_KINDS = (
    "CASE k % 11 WHEN 0 THEN 'Please terminate provider record' WHEN 1 THEN concat('Fax change. edit the phone of ', person) "
    "WHEN 2 THEN 'We recruit staff' WHEN 3 THEN concat('final call: stop ', person) WHEN 4 THEN 'alter it' "
    "WHEN 5 THEN concat('enroll ', person, ' who is an existing provider, update it') WHEN 6 THEN 'never been here, add and modify' "
    "WHEN 7 THEN 'hire now' WHEN 8 THEN concat('an initial note on ', person) ELSE body END"
)
KINDS_CTE = f"{MAIL_CTE.rsplit(', mail AS', 1)[0]}, mail AS (SELECT msg_id, {_KINDS} AS body FROM rendered)"


def _kind_mails(spark, sf):
    return fx.rendered(spark, sf).selectExpr("msg_id", f"{_KINDS} AS body")


@query("transaction_type", f"WITH {KINDS_CTE}, {type_cte('mail', 'msg_id', 'body', 'ty')} SELECT msg_id, value, confidence, extractor_id FROM ty WHERE value IS NOT NULL")
def transaction_type(spark, sf):
    return _kind_mails(spark, sf).transform(made_rows, ["msg_id"], en.transaction_type("body"), "t").select(
        "msg_id", "t.value", "t.confidence", "t.extractor_id")


@query("transaction_context_score", f"WITH {KINDS_CTE}, {scores_cte('mail', 'msg_id', 'body', 's')} SELECT msg_id, a AS add_score, u AS update_score, t AS term_score, type, confidence FROM s")
def transaction_context_score(spark, sf):
    return _kind_mails(spark, sf).select("msg_id", F.lower("body").alias("low")).select(
        "msg_id", F.expr(en.transaction_scores("low")).alias("s")).selectExpr(
        "msg_id", "s.add AS add_score", "s.upd AS update_score", "s.term AS term_score", "s.type AS type", "s.confidence AS confidence")


@query("taxonomy_valid", f"""
    WITH c AS (SELECT p_partkey, concat(split_part('{_CODES}', ',', cast(p_partkey % 35 + 1 as int)), CASE WHEN p_size % 5 = 0 THEN ' ' WHEN p_size % 5 = 1 THEN '1' ELSE '' END) AS code FROM part)
    SELECT p_partkey, code, regexp_matches(upper(trim(code)), '^[12]\\d{{2}}[A-Z]\\d{{5}}X$') AS is_valid FROM c""")
def taxonomy_valid(spark, sf):
    codes = fx.table(spark, sf, "part").selectExpr(
        "p_partkey", f"concat(split_part('{_CODES}', ',', cast(p_partkey % 35 + 1 as int)), CASE WHEN p_size % 5 = 0 THEN ' ' WHEN p_size % 5 = 1 THEN '1' ELSE '' END) AS code")
    return codes.select("p_partkey", "code", F.expr(f"{checks.validate_taxonomy('code')}.is_valid").alias("is_valid"))


# --- dictionaries in tables ------------------------------------------------

#: five synonyms of every part, and texts of orders that name parts in whole, in other cases, and inside other words
_PART_SYNONYMS = [
    "concat(p_name, ' ', cast(p_partkey as string))", "concat(p_type, ' ', p_name, ' ', cast(p_partkey % 100 as string))",
    "concat(p_brand, '/', cast(p_partkey as string))", "concat('no. ', cast(p_partkey as string))", "concat('z', cast(p_partkey % 10 as string))",
]
_ORDER_LINE = (
    "concat(CASE l_linenumber % 3 WHEN 0 THEN 'x' WHEN 1 THEN '(' ELSE '' END, CASE WHEN l_orderkey % 2 = 0 THEN upper({s}) ELSE {s} END, "
    "CASE l_quantity % 4 WHEN 0 THEN ',' WHEN 1 THEN 's' WHEN 2 THEN ' number' ELSE '' END)"
)
_PART_OF_LINE = "CASE l_suppkey % 5 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(_PART_SYNONYMS)) + " END"
_LINE_SQL = _ORDER_LINE.format(s=f"({_PART_OF_LINE})")
_CANONICAL = "concat(p_name, ' of ', p_brand)"
_PART_ROWS = " UNION ALL ".join(f"SELECT p_partkey * 5 + {i} AS ord, {s} AS synonym, {_CANONICAL} AS canonical FROM part" for i, s in enumerate(_PART_SYNONYMS))


@query("dictionary_hits", f"""
    WITH g AS ({_PART_ROWS}), d AS (SELECT lower(synonym) AS syn, min(ord) AS ord, arg_max(canonical, ord) AS canonical FROM g GROUP BY 1),
    t AS (SELECT l_orderkey, string_agg(line, ' and ' ORDER BY l_linenumber, line) AS t FROM (SELECT l_orderkey, l_linenumber, {_LINE_SQL} AS line FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1),
    keyed AS (SELECT *, left(syn, 4) AS head FROM d),
    heads AS (SELECT DISTINCT l_orderkey, t, substr(lower(t), i::INT, 4) AS head FROM (SELECT l_orderkey, t, unnest(range(1, length(t) + 1)) AS i FROM t)),
    h AS (SELECT l_orderkey, t, ord, syn, canonical FROM heads JOIN keyed USING (head) WHERE length(syn) >= 4 AND contains(lower(t), syn)
        UNION ALL SELECT l_orderkey, t, ord, syn, canonical FROM t JOIN keyed ON length(syn) < 4 AND contains(lower(t), syn)),
    x AS (SELECT *, string_split_regex(lower(t), concat('\\b', syn, '\\b'))[1] AS lead FROM h),
    k AS (SELECT * FROM x WHERE CASE WHEN length(syn) <= 2
        THEN regexp_matches(t, concat('(?i)\\b\\Q', syn, '\\E\\b')) AND NOT regexp_matches(concat(right(lead, 20), substr(lower(t), length(lead) + length(syn) + 1, 20)), '{en.SHORT_VETO}')
        ELSE regexp_matches(t, concat('(?i)\\b\\Q', syn, '\\E\\b|\\Q', syn, '\\E(?:[\\s,.]|$)')) END)
    SELECT l_orderkey, canonical AS value, CASE WHEN length(arg_min(syn, ord)) <= 2 THEN 0.7 ELSE 0.95 END::DOUBLE AS confidence, 'enhanced_synonym_match' AS extractor_id, min(ord)::BIGINT AS ord
    FROM k GROUP BY 1, 2""")
def dictionary_hits(spark, sf):
    """Parts that the texts of orders name, by a dictionary of five synonyms a part."""
    parts = fx.table(spark, sf, "part")
    listed = ", ".join(f"named_struct('ord', p_partkey * 5 + {i}, 'synonym', {s}, 'canonical', {_CANONICAL})" for i, s in enumerate(_PART_SYNONYMS))
    dictionary = dictionaries.synonym_table(parts.transform(spread, "p_partkey").transform(explode_rows, [], f"array({listed})", "d").select("d.*"))
    lines = fx.table(spark, sf, "lineitem").join(parts, F.col("p_partkey") == F.col("l_partkey")).selectExpr("l_orderkey", "l_linenumber", f"{_LINE_SQL} AS line")
    texts = lines.groupBy("l_orderkey").agg(F.expr("array_join(transform(array_sort(collect_list(struct(l_linenumber, line))), x -> x.line), ' and ')").alias("text"))
    return gazetteer.synonym_hits(texts, ["l_orderkey"], dictionary).drop("row_id")
