"""Checksums, date forms and value validators as SQL expressions."""

from __future__ import annotations

from .sql import let, q, strip

#: luhn doubling of a digit, by position in the string
_DOUBLED = "0246813579"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def npi_checksum(npi: str, mode: str = "standard") -> str:
    """Check digit test of a ten digit number under the 80840 prefix.

    ``standard`` is the published Luhn form.  ``compat`` doubles every second
    digit of the payload starting from the one before its last.
    """
    if mode == "standard":
        return f"luhn_check(concat('80840', {npi}))"
    if mode != "compat":
        raise ValueError(f"unknown checksum mode: {mode}")

    def plain(i):
        return f"cast(substr({npi}, {i}, 1) as int)"

    def doubled(i):
        return f"cast(substr('{_DOUBLED}', {plain(i)} + 1, 1) as int)"

    # the prefix 80840 always adds 18
    total = " + ".join(["18"] + [plain(i) for i in (1, 3, 5, 7, 9)] + [doubled(i) for i in (2, 4, 6, 8)])
    return f"((10 - ({total}) % 10) % 10 = {plain(10)})"


def _assemble(month: str, day: str, year: str) -> str:
    made = (
        "CASE WHEN mn BETWEEN 1 AND 12 AND dn BETWEEN 1 AND 31 AND yn BETWEEN 1900 AND 2100 "
        "THEN concat(lpad(mn, 2, '0'), '/', lpad(dn, 2, '0'), '/', yn) END"
    )
    return let(month, "mn", let(day, "dn", let(year, "yn", made)))


def _group(x: str, pattern: str, i: int) -> str:
    return f"cast(regexp_extract({x}, {q(pattern)}, {i}) as int)"


def normalize_date(x: str) -> str:
    """``m/d/y`` or ``y/m/d`` text to ``MM/DD/YYYY``; two-digit years pivot at 50."""
    s = "date_"
    mdy = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})"
    ymd = r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})"
    y = _group(s, mdy, 3)
    year = (
        f"(CASE WHEN length(regexp_extract({s}, {q(mdy)}, 3)) <> 2 THEN {y} "
        f"WHEN {y} < 50 THEN {y} + 2000 ELSE {y} + 1900 END)"
    )
    return let(
        strip(x), s,
        f"CASE WHEN {s} rlike {q(mdy)} THEN {_assemble(_group(s, mdy, 1), _group(s, mdy, 2), year)} "
        f"WHEN {s} rlike {q(ymd)} THEN {_assemble(_group(s, ymd, 2), _group(s, ymd, 3), _group(s, ymd, 1))} END",
    )


def normalize_date_strict(x: str) -> str:
    """Whole-value form of :func:`normalize_date`; retries day/month order for 4-digit years."""
    s = "date_"
    mdy = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})$"
    ymd = r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})$"
    dmy = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"
    y = _group(s, mdy, 3)
    year = f"(CASE WHEN {y} < 50 THEN {y} + 2000 WHEN {y} < 100 THEN {y} + 1900 ELSE {y} END)"
    return let(
        strip(x), s,
        f"coalesce(CASE WHEN {s} rlike {q(mdy)} THEN {_assemble(_group(s, mdy, 1), _group(s, mdy, 2), year)} END, "
        f"CASE WHEN {s} rlike {q(ymd)} THEN {_assemble(_group(s, ymd, 2), _group(s, ymd, 3), _group(s, ymd, 1))} END, "
        f"CASE WHEN {s} rlike {q(dmy)} THEN {_assemble(_group(s, dmy, 2), _group(s, dmy, 1), _group(s, dmy, 3))} END)",
    )


def _result(valid: str, message: str, normalized: str) -> str:
    return (
        f"named_struct('is_valid', {valid}, 'message', {message}, 'normalized', "
        f"if({valid}, coalesce({normalized}, ''), ''))"
    )


def validate_npi(x: str) -> str:
    message = (
        f"CASE WHEN {x} = '' THEN 'NPI is empty' WHEN length(digits_) <> 10 THEN "
        f"concat('NPI must be 10 digits, got ', length(digits_)) ELSE 'Valid NPI' END"
    )
    return let(digits(x), "digits_", _result("(length(digits_) = 10)", message, "digits_"))


def validate_tin(x: str) -> str:
    d, n = "digits_", "length(digits_)"
    message = (
        f"CASE WHEN {x} = '' THEN 'TIN is empty' WHEN {n} <> 9 THEN "
        f"concat('TIN must be 9 digits, got ', {n}) ELSE 'Valid TIN' END"
    )
    return let(digits(x), d, _result(f"({n} = 9)", message, f"concat(substr({d}, 1, 2), '-', substr({d}, 3))"))


def validate_taxonomy(x: str) -> str:
    code = f"upper({strip(x)})"
    ok = f"({code} rlike {q('^[12][0-9]{2}[A-Z][0-9]{5}X$')})"
    message = (
        f"CASE WHEN {x} = '' THEN 'Taxonomy code is empty' WHEN {ok} THEN 'Valid taxonomy code' "
        "ELSE 'Invalid taxonomy code format. Expected: [12]DD[A-Z]DDDDDX' END"
    )
    return _result(ok, message, code)


def format_phone(d: str) -> str:
    return f"concat(substr({d}, 1, 3), '-', substr({d}, 4, 3), '-', substr({d}, 7))"


def validate_phone(x: str, kind: str) -> str:
    d, n = "digits_", "length(digits_)"
    ok = f"({n} = 10 OR ({n} = 11 AND startswith({d}, '1')))"
    message = (
        f"CASE WHEN {x} = '' THEN '{kind} number is empty' "
        f"WHEN {n} < 10 THEN concat('{kind} number too short: ', {n}, ' digits') "
        f"WHEN {n} > 11 THEN concat('{kind} number too long: ', {n}, ' digits') "
        f"WHEN {ok} THEN 'Valid {kind} number' ELSE '11-digit {kind} number must start with 1' END"
    )
    return let(digits(x), d, _result(ok, message, format_phone(f"right({d}, 10)")))


def validate_license(x: str) -> str:
    code = "code_"
    ok = f"({code} rlike {q('^[A-Z][0-9]{5,6}$')})"
    message = (
        f"CASE WHEN {x} = '' THEN 'License number is empty' WHEN {ok} THEN 'Valid license format' "
        "ELSE 'Invalid license format. Expected: Letter followed by 5-6 digits' END"
    )
    return let(f"upper({strip(x)})", code, _result(ok, message, code))


def validate_date(x: str) -> str:
    message = (
        f"CASE WHEN {x} = '' THEN 'Date is empty' WHEN date_ IS NULL THEN "
        f"concat('Could not parse date: ', {x}) ELSE 'Valid date' END"
    )
    return let(normalize_date_strict(x), "date_", _result("(date_ IS NOT NULL)", message, "date_"))


def validate_ppg(x: str) -> str:
    clean = "clean_"
    message = (
        f"CASE WHEN {x} = '' THEN 'PPG ID is empty' WHEN {clean} = '' THEN "
        "'PPG ID contains no valid characters' ELSE 'Valid PPG ID' END"
    )
    return let(strip(f"regexp_replace({x}, '[^A-Za-z0-9, ]', '')"), clean, _result(f"({clean} <> '')", message, clean))


#: validated record fields, in report order
VALIDATORS = {
    "provider_npi": validate_npi,
    "group_npi": validate_npi,
    "tin": validate_tin,
    "phone_number": lambda x: validate_phone(x, "phone"),
    "fax_number": lambda x: validate_phone(x, "fax"),
    "state_license": validate_license,
    "effective_date": validate_date,
    "term_date": validate_date,
    "ppg_id": validate_ppg,
}
