"""Dictionary normalisation, validation, business rules and the output contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import explode_rows
from ..functions import checks
from ..functions import text as tx
from ..functions.sql import any_of, let, mapping, q, rows, strip, word
from ..vocab.business import (
    ALLOWED_VALUES, LOB_SYNONYMS, OUTPUT_COLUMNS, REQUIRED_FOR, SENTINEL,
)
from ..vocab.specialties import SPECIALTIES

# Casing word lists and name titles.
ORG_SMALL = ["and", "the", "of", "for", "in", "on", "at", "by", "with"]
ORG_SUFFIX = ["md", "do", "llc", "inc", "corp", "pa", "pc"]
SPECIALTY_SMALL = ["and", "of", "the", "in", "on", "for"]
TITLES = {
    "dr": "Dr.", "dr.": "Dr.", "doctor": "Dr.", "md": "M.D.", "m.d.": "M.D.", "m.d": "M.D.",
    "do": "D.O.", "d.o.": "D.O.", "d.o": "D.O.", "jr": "Jr.", "jr.": "Jr.", "sr": "Sr.", "sr.": "Sr.",
    "ii": "II", "iii": "III", "iv": "IV",
}


def _missing(x: str) -> str:
    return f"({x} IS NULL OR {x} = '' OR {x} = {q(SENTINEL)})"


# --- normalisation ---------------------------------------------------------

def normalize_lob(x: str) -> str:
    """Array of canonical lines of business; unknown text counts as Commercial."""
    hits = ", ".join(f"if({any_of('lo', ws)}, '{name}', cast(null as string))" for name, ws in LOB_SYNONYMS.items())
    by_word = "CASE " + " ".join(
        f"WHEN lo rlike {q(word(w))} THEN '{name}'"
        for w, name in [("hmo", "Commercial"), ("ppo", "Commercial"), ("medicare", "Medicare"), ("medicaid", "Medicaid")]
    ) + " ELSE 'Commercial' END"
    found = f"filter(array({hits}), v -> v IS NOT NULL)"
    body = let(found, "fs", f"if(size(fs) > 0, fs, array({by_word}))")
    return f"if({_missing(x)}, cast(array() as array<string>), {let(strip(f'lower({x})'), 'lo', body)})"


def title_case_specialty(x: str) -> str:
    return tx.title_words(x, SPECIALTY_SMALL, first_title=True)


def normalize_specialty(x: str, specialties=None) -> str:
    """Exact synonym, else containment either way (synonyms over 3 characters), else title case."""
    table = specialties or SPECIALTIES
    first: dict[str, str] = {}
    ordered = []
    for canonical, synonyms in table.items():
        for synonym in synonyms:
            first.setdefault(synonym, canonical)
            if len(synonym) > 3:
                ordered.append((synonym, canonical))
    exact = f"{mapping(first)}[lo]"
    near = (
        f"get(filter({rows('s:string,c:string', ordered)}, e -> contains(lo, e.s) OR contains(e.s, lo)), 0).c"
    )
    body = f"coalesce({exact}, {near}, {title_case_specialty(x)})"
    return f"if({_missing(x)}, {q(SENTINEL)}, {let(strip(f'lower({x})'), 'lo', body)})"


def normalize_organization(x: str) -> str:
    """Small words lower, suffixes and words of up to four letters upper, the rest title."""
    small = ", ".join(q(w) for w in ORG_SMALL)
    suffix = ", ".join(q(w) for w in ORG_SUFFIX)
    cased = (
        f"CASE WHEN lower(w) IN ({small}) THEN lower(w) WHEN lower(w) IN ({suffix}) THEN upper(w) "
        f"WHEN lower(w) rlike '^[a-z]+$' AND length(w) <= 4 THEN upper(w) ELSE {tx.title_case('w')} END"
    )
    one = f"transform({tx.word_list(x)}, (w, i) -> if(i = 0, {tx.title_case('w')}, {cased}))"
    return f"if({_missing(x)}, {q(SENTINEL)}, array_join({one}, ' '))"


def _title_part(x: str) -> str:
    return f"coalesce({mapping(TITLES)}[{strip(f'lower({x})')}], {tx.title_case(x)})"


def normalize_provider_name(x: str) -> str:
    """``Last, First`` as two parts, other names word by word; titles in their set form."""
    flat = f"array_join({tx.word_list(x)}, ' ')"
    last = tx.title_case(strip("substring_index(nm, ',', 1)"))
    first = let(strip("substr(nm, instr(nm, ',') + 1)"), "fp", _title_part("fp"))
    plain = f"array_join(transform(split(nm, ' '), w -> {_title_part('w')}), ' ')"
    body = f"if(contains(nm, ','), concat({last}, ', ', {first}), {plain})"
    return f"if({_missing(x)}, {q(SENTINEL)}, {let(flat, 'nm', body)})"


def normalize_all(records: DataFrame, specialties=None) -> DataFrame:
    """The four dictionary normalisations of a record."""
    lob = f"array_join({normalize_lob('line_of_business')}, ', ')"
    return records.withColumns({
        "line_of_business": F.expr(f"if({_missing('line_of_business')}, line_of_business, {lob})"),
        "provider_specialty": F.expr(normalize_specialty("provider_specialty", specialties)),
        "organization_name": F.expr(normalize_organization("organization_name")),
        "provider_name": F.expr(normalize_provider_name("provider_name")),
    })


# --- validation ------------------------------------------------------------

def validate_all(records: DataFrame) -> DataFrame:
    """Validated fields take their normal form."""
    def normal(field, check):
        return F.expr(
            f"if({field} = {q(SENTINEL)}, {field}, "
            + let(check(field), "r", f"if(r.is_valid AND r.normalized <> '', r.normalized, {field})") + ")"
        )

    return records.withColumns({f: normal(f, check) for f, check in checks.VALIDATORS.items()})


def validation_results(records: DataFrame) -> DataFrame:
    """Long table: one row per present validated field of a record."""
    checked = ", ".join(
        f"named_struct('field', '{f}', 'raw', {f}, 'r', {check(f)})" for f, check in checks.VALIDATORS.items()
    )
    return (
        records.transform(explode_rows, ["msg_id", "block_id"], f"filter(array({checked}), e -> e.raw <> {q(SENTINEL)})", "e")
        .select("msg_id", "block_id", "e.field", "e.r.is_valid", "e.r.message", "e.r.normalized")
    )


# --- business rules --------------------------------------------------------

def business_rules(records: DataFrame) -> DataFrame:
    """Cross-field rules; every rule reads the values before the rules."""
    s = q(SENTINEL)
    term, add = "lower(transaction_type) = 'term'", "lower(transaction_type) = 'add'"
    swap = f"{term} AND term_date = {s} AND effective_date <> {s}"

    def digits_if(field, n, shaped):
        d = checks.digits(field)
        return f"if({field} <> {s} AND length({d}) = {n}, {shaped(d)}, {field})"

    rules = {
        "term_date": f"CASE WHEN {swap} THEN effective_date WHEN {term} THEN term_date ELSE {s} END",
        "effective_date": f"if({swap}, {s}, effective_date)",
        "transaction_attribute": f"CASE WHEN {term} THEN 'Provider' WHEN {add} THEN {s} ELSE transaction_attribute END",
        "term_reason": f"if({term}, term_reason, {s})",
        "phone_number": digits_if("phone_number", 10, checks.format_phone),
        "fax_number": digits_if("fax_number", 10, checks.format_phone),
        "provider_npi": f"if(provider_npi = {s}, provider_npi, {checks.digits('provider_npi')})",
        "group_npi": f"if(group_npi = {s}, group_npi, {checks.digits('group_npi')})",
        "tin": digits_if("tin", 9, lambda d: f"concat(substr({d}, 1, 2), '-', substr({d}, 3))"),
        "ppg_id": f"if(ppg_id = {s}, ppg_id, regexp_replace(ppg_id, {q('[^A-Za-z0-9, ]')}, ''))",
    }
    return records.withColumns({f: F.expr(e) for f, e in rules.items()})


def process(records: DataFrame, specialties=None) -> DataFrame:
    """Normalise, validate, fill missing columns and apply the business rules."""
    missing = [c for c in OUTPUT_COLUMNS if c not in records.columns]
    out = records.transform(normalize_all, specialties).transform(validate_all)
    if missing:
        out = out.withColumns({c: F.lit(SENTINEL) for c in missing})
    return out.transform(business_rules)


# --- contract --------------------------------------------------------------

def contract_errors(records: DataFrame) -> DataFrame:
    """Long table of contract violations: ``msg_id, block_id, field, error``."""
    def errors(field):
        out = []
        v = strip(f"coalesce({field}, '')")
        allowed = ALLOWED_VALUES.get(field)
        if allowed:
            tail = q("' is not an allowed value. Must be one of: " + ", ".join(allowed))
            listed = ", ".join(q(a) for a in allowed)
            values = f"transform(split({v}, ','), p -> {strip('p')})" if field == "line_of_business" else f"array({v})"
            out.append(
                f"transform(filter({values}, p -> p <> '' AND p NOT IN ({listed})), p -> concat('\\'', p, {tail}))"
            )
        if field in REQUIRED_FOR:
            kinds = ", ".join(q(k) for k in REQUIRED_FOR[field])
            out.append(
                f"if({strip('transaction_type')} IN ({kinds}) AND {v} = '', "
                f"array(concat('Field is required when Transaction Type is \\'', {strip('transaction_type')}, '\\'')), "
                "cast(array() as array<string>))"
            )
        for name, n, message in (
            ("provider_npi", 10, "NPI must be 10 digits"),
            ("group_npi", 10, "Group NPI must be 10 digits"),
            ("tin", 9, "TIN must be 9 digits, formatted as XX-XXXXXXX"),
        ):
            if field == name:
                out.append(
                    f"if({v} <> '' AND length({checks.digits(v)}) <> {n}, array({q(message)}), cast(array() as array<string>))"
                )
        if not out:
            return None
        found = f"concat({', '.join(out)})"
        return f"transform(if({v} = {q(SENTINEL)}, cast(array() as array<string>), {found}), e -> named_struct('field', '{field}', 'error', e))"

    parts = [e for e in map(errors, OUTPUT_COLUMNS) if e]
    return (
        records.transform(explode_rows, ["msg_id", "block_id"], f"concat({', '.join(parts)})", "e")
        .select("msg_id", "block_id", "e.field", "e.error")
    )


def column_specs(spark) -> DataFrame:
    """Contract metadata: position, name, heading, allowed values, required types."""
    data = [
        (i, name, heading, ALLOWED_VALUES.get(name), REQUIRED_FOR.get(name))
        for i, (name, heading) in enumerate(OUTPUT_COLUMNS.items())
    ]
    return spark.createDataFrame(
        data, "position int, name string, heading string, allowed_values array<string>, required_for array<string>"
    )


def column_names() -> list[str]:
    return list(OUTPUT_COLUMNS.values())


def allowed_values(name: str) -> list[str] | None:
    return ALLOWED_VALUES.get(name)


def to_output(records: DataFrame, template: list[str] | None = None) -> DataFrame:
    """Published headings in template order; columns the records lack hold the sentinel."""
    by_heading = {heading: name for name, heading in OUTPUT_COLUMNS.items()}
    cols: list[Column] = []
    for heading in template or list(by_heading):
        name = by_heading.get(heading, heading)
        value = F.coalesce(F.col(name), F.lit(SENTINEL)) if name in records.columns else F.lit(SENTINEL)
        cols.append(value.alias(heading))
    return records.select(*cols)
