"""Queries over pattern candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import explode_rows, made_rows

from ..functions import checks
from ..operators import patterns
from ..sources import fixture as fx
from ..vocab.transactions import LEXICON
from .registry import MAIL_CTE, lit, query

_CAND = ["value", "confidence", "extractor_id", "match_ord", "validation_passed"]


def _spark_scan(field, source="mail", key="msg_id", text="body"):
    def run(spark, sf):
        df = fx.mail(spark, sf) if source == "mail" else fx.columns(spark, sf, source, key, text)
        return df.transform(explode_rows, [key], patterns.scan(text, field), "c").select(
            key, *[f"c.{n}" for n in _CAND])

    return run


def re2(pattern: str) -> str:
    """The pattern without look-ahead: its tail is consumed instead."""
    return (
        pattern.replace(r"(?=\s|\z)", r"(?:\s|$)")
        .replace(r"(?=[^\n]*(?:provider|NPI|national))", r"[^\n]*(?:provider|NPI|national)")
    )


def hits_sql(src: str, key: str, text: str, pats: list[str], group: int = 1) -> str:
    """Long table of matches ``key, i, o, m`` of a pattern list."""
    return " UNION ALL ".join(
        f"SELECT {key}, {i} AS i, u.o AS o, u.m AS m FROM (SELECT {key}, unnest(list_transform("
        f"regexp_extract_all({text}, {lit(re2(p))}, {group}, 'i'), lambda m, n: {{'m': m, 'o': (n - 1)::INT}})) AS u FROM {src})"
        for i, p in enumerate(pats)
    )


DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
PHONE_SQL = f"concat({DIGITS}[1:3], '-', {DIGITS}[4:6], '-', {DIGITS}[7:])"

LUHN_SQL = """((10 - (list_sum(list_transform(range(0, 14), lambda p:
    CASE WHEN p % 2 = {odd} THEN (2 * substr(reverse('80840' || {npi}[1:9]), p + 1, 1)::INT - CASE WHEN substr(reverse('80840' || {npi}[1:9]), p + 1, 1)::INT > 4 THEN 9 ELSE 0 END)
    ELSE substr(reverse('80840' || {npi}[1:9]), p + 1, 1)::INT END)) % 10)) % 10 = {npi}[10]::INT)"""


def luhn(npi: str, mode: str = "standard") -> str:
    return LUHN_SQL.format(npi=npi, odd=0 if mode == "standard" else 1)


def date_sql(m: str, strict: bool = False) -> str:
    """Date rule as list arithmetic over the split parts."""
    end = "$" if strict else ""
    p = f"regexp_extract({m}, '^(\\d{{1,2}})[/-](\\d{{1,2}})[/-](\\d{{2,4}}){end}', ['a', 'b', 'c'])"
    y = f"regexp_extract({m}, '^(\\d{{4}})[/-](\\d{{1,2}})[/-](\\d{{1,2}}){end}', ['a', 'b', 'c'])"

    def made(mo, d, yr):
        return (
            f"CASE WHEN ({mo}) BETWEEN 1 AND 12 AND ({d}) BETWEEN 1 AND 31 AND ({yr}) BETWEEN 1900 AND 2100 THEN "
            f"printf('%02d/%02d/%d', ({mo})::INT, ({d})::INT, ({yr})::INT) END"
        )

    def n(s, k):
        return f"try_cast(({s}).{k} AS INT)"

    if strict:
        yr = f"CASE WHEN {n(p, 'c')} < 50 THEN {n(p, 'c')} + 2000 WHEN {n(p, 'c')} < 100 THEN {n(p, 'c')} + 1900 ELSE {n(p, 'c')} END"
        eu = f"CASE WHEN length(({p}).c) = 4 THEN {made(n(p, 'b'), n(p, 'a'), n(p, 'c'))} END"
        return f"coalesce({made(n(p, 'a'), n(p, 'b'), yr)}, {made(n(y, 'b'), n(y, 'c'), n(y, 'a'))}, {eu})"
    yr = f"CASE WHEN length(({p}).c) <> 2 THEN {n(p, 'c')} WHEN {n(p, 'c')} < 50 THEN {n(p, 'c')} + 2000 ELSE {n(p, 'c')} + 1900 END"
    return f"coalesce({made(n(p, 'a'), n(p, 'b'), yr)}, {made(n(y, 'b'), n(y, 'c'), n(y, 'a'))})"


#: value, confidence and flag of every field in the check SQL
SHAPES = {
    "npi": ("m", f"CASE WHEN {luhn('m')} THEN 0.9 ELSE 0.6 END", luhn("m")),
    "tin": (f"concat({DIGITS}[1:2], '-', {DIGITS}[3:])", "CASE WHEN i < 5 THEN 0.9 ELSE 0.7 END", "true"),
    "phone": (PHONE_SQL, "CASE WHEN i IN (0, 3) THEN 0.9 ELSE 0.7 END", "true"),
    "fax": (PHONE_SQL, "0.9", "true"),
    "license": ("upper(m)", "CASE WHEN i IN (0, 1, 2) THEN 0.9 ELSE 0.7 END", "true"),
    "date": (date_sql("m"), "CASE WHEN i < 4 THEN 0.9 ELSE 0.6 END", "true"),
}
PATTERNS = {
    "npi": patterns.NPI, "tin": patterns.TIN, "phone": patterns.PHONE, "fax": patterns.FAX,
    "license": patterns.LICENSE, "date": patterns.DATE,
}


def scan_sql(field: str, src: str = "mail", key: str = "msg_id", text: str = "body") -> str:
    """Candidate rows of one field: ``key, value, confidence, extractor_id, match_ord, validation_passed, i``."""
    value, conf, ok = SHAPES[field]
    return (
        f"SELECT {key}, {value} AS value, ({conf})::DOUBLE AS confidence, concat('{field}_pattern_', i) AS extractor_id, "
        f"o AS match_ord, {ok} AS validation_passed, i FROM ({hits_sql(src, key, text, PATTERNS[field])}) WHERE ({value}) IS NOT NULL"
    )


def ppg_cte(src: str = "mail", key: str = "msg_id", text: str = "body", out: str = "ppg") -> str:
    stop = ", ".join(lit(w) for w in patterns.PPG_STOP)
    return f"""
    {out}_h AS ({hits_sql(src, key, text, patterns.PPG)}),
    {out}_c AS (SELECT {key}, i, o, regexp_replace(m, '[^0-9A-Za-z]', '', 'g') AS v FROM {out}_h),
    {out}_k AS (SELECT *, CASE WHEN i < 4 THEN 0.8 ELSE 0.9 END::DOUBLE AS conf FROM {out}_c WHERE length(v) BETWEEN 2 AND 6 AND upper(v) NOT IN ({stop})),
    {out}_n AS (SELECT {key}, list_sort(list(DISTINCT v)) AS vs, max(conf) AS conf FROM {out}_k GROUP BY 1),
    {out} AS (SELECT {key}, array_to_string(vs, ', ') AS value, conf AS confidence, 'ppg_combined' AS extractor_id, 0 AS match_ord, true AS validation_passed, 0 AS i
        FROM {out}_n WHERE len(vs) > 1
        UNION ALL SELECT {key}, v, k.conf, concat('ppg_pattern_', i), o, true, i FROM {out}_k k JOIN {out}_n n USING ({key}) WHERE len(vs) = 1)"""


for _field in SHAPES:
    query(f"{_field}_candidates", f"WITH {MAIL_CTE}, c AS ({scan_sql(_field)}) SELECT msg_id, {', '.join(_CAND)} FROM c")(
        _spark_scan(_field))
query("ppg_candidates", f"WITH {MAIL_CTE}, {ppg_cte()} SELECT msg_id, {', '.join(_CAND)} FROM ppg")(_spark_scan("ppg"))
query("phone_candidates_documents",
      f"WITH c AS ({scan_sql('phone', 'documents', 'doc_id', 'text')}) SELECT doc_id, {', '.join(_CAND)} FROM c")(
    _spark_scan("phone", "documents", "doc_id", "text"))

_IDS = "cast(1000000000 + c_custkey * 7919 as string)"


def _checksum(mode):
    def run(spark, sf):
        return fx.table(spark, sf, "customer").selectExpr(f"{_IDS} AS npi").select(
            "npi", F.expr(checks.npi_checksum("npi", mode)).alias("valid"))

    return run


for _mode in ("standard", "compat"):
    query(f"npi_checksum_{_mode}",
          f"SELECT npi, {luhn('npi', _mode)} AS valid FROM (SELECT {_IDS} AS npi FROM customer)")(_checksum(_mode))

_ODATE = "concat(month(o_orderdate), CASE WHEN o_orderkey % 2 = 0 THEN '/' ELSE '-' END, day(o_orderdate) + o_orderkey % 4, '/', right(cast(year(o_orderdate) as string), cast(2 + 2 * (o_orderkey % 2) as int)))"
_ODATE2 = "concat(year(o_orderdate), '-', month(o_orderdate), '/', day(o_orderdate))"


@query("normalize_dates", f"SELECT o_orderkey, {date_sql('a')} AS mdy, {date_sql('b')} AS ymd FROM "
       f"(SELECT o_orderkey, {_ODATE} AS a, {_ODATE2} AS b FROM orders)")
def normalize_dates(spark, sf):
    return fx.columns(spark, sf, "orders", "o_orderkey", "o_orderdate").selectExpr("o_orderkey", f"{_ODATE} AS a", f"{_ODATE2} AS b").select(
        "o_orderkey", F.expr(checks.normalize_date("a")).alias("mdy"), F.expr(checks.normalize_date("b")).alias("ymd"))


def lexicon_sql(text: str) -> str:
    def n(kind):
        return " + ".join(f"len(regexp_extract_all({text}, {lit(p)}, 0, 'i'))" for p in LEXICON[kind])

    return f"{n('Term')} AS t, {n('Add')} AS a, {n('Update')} AS u"


@query("transaction_lexicon", f"""
    WITH {MAIL_CTE}, n AS (SELECT msg_id, {lexicon_sql('body')} FROM mail
        WHERE NOT regexp_matches(lower(body), 'not\\s+terminate|no\\s+changes|don''t\\s+|will\\s+not'))
    SELECT msg_id, CASE WHEN t >= a AND t >= u THEN 'Term' WHEN a >= u THEN 'Add' ELSE 'Update' END AS value,
        least(greatest(t, a, u) * 0.3::DOUBLE, 0.9::DOUBLE) AS confidence, greatest(t, a, u)::INT AS hits FROM n WHERE greatest(t, a, u) > 0""")
def transaction_lexicon(spark, sf):
    return fx.mail(spark, sf).transform(made_rows, ["msg_id"], patterns.transaction_lexicon("body"), "c").select("msg_id", "c.*")
