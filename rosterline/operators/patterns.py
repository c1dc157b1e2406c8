"""Identifier, contact and date candidates found by patterns.

Each scan returns an array of candidates ordered by (pattern, match); that
order decides which candidate a record takes, so it is never re-sorted.
"""

from __future__ import annotations

from collections.abc import Iterable

from ..functions import checks
from ..functions.sql import any_of, edges, let, match_starts, q, span, strip, where
from ..vocab.transactions import LEXICON, NEGATION

# Patterns per field, in scan order.
NPI = [
    r"NPI[:\s#]*(\d{10})",
    r"National Provider Identifier[:\s]*(\d{10})",
    r"Provider ID[:\s]*(\d{10})",
    r"(?:^|\s)(\d{10})(?=[^\n]*(?:provider|NPI|national))",
]
TIN = [
    r"TIN[:\s#]*(\d{2}-?\d{7})",
    r"Tax\s+ID[:\s]*(\d{2}-?\d{7})",
    r"Federal\s+ID[:\s]*(\d{2}-?\d{7})",
    r"EIN[:\s]*(\d{2}-?\d{7})",
    r"Employer\s+ID[:\s]*(\d{2}-?\d{7})",
    r"(\d{2}-\d{7})",
]
PPG = [
    r"PPG[:\s#']*([A-Za-z0-9]+)",
    r"PPG\s+ID[:\s]*([A-Za-z0-9]+)",
    r"Provider Practice Group[:\s]*([A-Za-z0-9]+)",
    r"Group\s+ID[:\s]*([A-Za-z0-9]+)",
    r"Shared\s+Risk:\s*[^\n]*?[-–]\s*([A-Za-z0-9]{2,6})(?=\s|\z)",
    r"PPG[#'s]*[^:]*?[-–]\s*([A-Za-z0-9]{2,6})(?=\s|\z)",
    r"(?:ppg|shared\s+risk)[^\n]{0,50}?[-–]\s*([A-Za-z0-9]{2,6})(?=\s|\z)",
    r"Shared\s+Risk[:\s]*<[^>]+>\s*[-–]\s*<([^>]+)>",
]
PPG_STOP = ["PPG", "ID", "TIN", "NPI", "MD", "DR", "HMO", "PPO"]
_NUMBER = r"(\d{3}[-.\s]?\d{3}[-.\s]?\d{4})"
PHONE = [
    rf"Phone[:\s]*{_NUMBER}",
    rf"Tel[:\s]*{_NUMBER}",
    rf"Contact[:\s]*{_NUMBER}",
    rf"Phone\s+Number[:\s]*{_NUMBER}",
    r"(\(\d{3}\)\s*\d{3}[-.\s]*\d{4})",
]
FAX = [
    rf"Fax[:\s]*{_NUMBER}",
    rf"Facsimile[:\s]*{_NUMBER}",
    rf"Fax\s+Number[:\s]*{_NUMBER}",
]
LICENSE = [
    r"License[:\s#]*([A-Z]\d{5,6})",
    r"State\s+License[:\s]*([A-Z]\d{5,6})",
    r"Medical\s+License[:\s]*([A-Z]\d{5,6})",
    r"Lic\s*#[:\s]*([A-Z]\d{5,6})",
    r"State\s+Lic[:\s]*([A-Z]\d{5,6})",
]
_DATE = r"(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})"
DATE = [
    rf"Effective\s+Date[:\s]*{_DATE}",
    rf"Term(?:ination)?\s+Date[:\s]*{_DATE}",
    rf"Start\s+Date[:\s]*{_DATE}",
    rf"End\s+Date[:\s]*{_DATE}",
    _DATE,
]
# Per pattern, lower-case pieces of which every match, or the text after it, holds one.
NEEDS = {
    "npi": [["npi"], ["national"], ["provider id"], ["provider", "npi", "national"]],
    "tin": [["tin"], ["tax"], ["federal"], ["ein"], ["employer"], ["-"]],
    "ppg": [["ppg"], ["ppg"], ["provider practice group"], ["group"], ["shared"], ["ppg"], ["ppg", "shared"], ["shared"]],
    "phone": [["phone"], ["tel"], ["contact"], ["phone"], ["("]],
    "fax": [["fax"], ["facsimile"], ["fax"]],
    "license": [["license"], ["state"], ["medical"], ["lic"], ["state"]],
    "date": [["effective"], ["term"], ["start"], ["end"], ["/", "-"]],
}
# Context characters kept on either side of a match.
CONTEXT = {"npi": 20, "tin": 20, "ppg": 30, "phone": 20, "fax": 20, "license": 20, "date": 30}

#: element type of every candidate array
CANDIDATE = (
    "struct<field:string,value:string,confidence:double,extractor_id:string,"
    "pattern_ord:int,match_ord:int,validation_passed:boolean>"
)


def candidate(field, value, confidence, extractor, pattern_ord, match_ord="0", passed="true") -> str:
    return (
        f"named_struct('field', '{field}', 'value', {value}, 'confidence', {confidence}, "
        f"'extractor_id', {extractor}, 'pattern_ord', {pattern_ord}, 'match_ord', {match_ord}, "
        f"'validation_passed', {passed})"
    )


def _npi(m: str, i: int, mode: str):
    ok = checks.npi_checksum(m, mode)
    return m, f"if({ok}, 0.9D, 0.6D)", ok


def _tin(m, i, mode):
    d = checks.digits(m)
    return f"concat(substr({d}, 1, 2), '-', substr({d}, 3))", "0.9D" if i < 5 else "0.7D", "true"


def _ppg(m, i, mode):
    d = f"regexp_replace({m}, '[^0-9A-Za-z]', '')"
    stop = ", ".join(q(w) for w in PPG_STOP)
    ok = f"length({d}) BETWEEN 2 AND 6 AND upper({d}) NOT IN ({stop})"
    return f"if({ok}, {d}, cast(null as string))", "0.8D" if i < 4 else "0.9D", "true"


def _phone(m, i, mode):
    return checks.format_phone(checks.digits(m)), "0.9D" if "Phone" in PHONE[i] else "0.7D", "true"


def _fax(m, i, mode):
    return checks.format_phone(checks.digits(m)), "0.9D", "true"


def _license(m, i, mode):
    return f"upper({m})", "0.9D" if "License" in LICENSE[i] else "0.7D", "true"


def _date(m, i, mode):
    return checks.normalize_date(m), "0.9D" if i < 4 else "0.6D", "true"


_FIELDS = {
    "npi": (NPI, _npi),
    "tin": (TIN, _tin),
    "ppg": (PPG, _ppg),
    "phone": (PHONE, _phone),
    "fax": (FAX, _fax),
    "license": (LICENSE, _license),
    "date": (DATE, _date),
}
FIELDS = list(_FIELDS)


def _scan(text: str, field: str, checksum: str) -> str:
    patterns, shape = _FIELDS[field]
    arrays = []
    for i, pattern in enumerate(patterns):
        value, confidence, passed = shape("m", i, checksum)
        made = candidate(field, value, confidence, f"'{field}_pattern_{i}'", i, "j", passed)
        found = f"transform(regexp_extract_all({text}, {q('(?i)' + pattern)}, 1), (m, j) -> {made})"
        arrays.append(where(any_of("lw", NEEDS[field][i]), found))
    # a text without any of the pieces is spared the rest
    pieces = dict.fromkeys(piece for needs in NEEDS[field] for piece in needs)
    found = f"filter(concat({', '.join(arrays)}), c -> c.value IS NOT NULL)"
    return let(f"lower({text})", "lw", where(any_of("lw", pieces), found))


def _values(field: str, i: int) -> str:
    """Values of one pattern of a field, in the lower-cased text ``lw`` of ``vt``."""
    value = _FIELDS[field][1]("m", i, "standard")[0]
    found = f"filter(transform(regexp_extract_all(vt, {q('(?i)' + _FIELDS[field][0][i])}, 1), m -> {value}), v -> v IS NOT NULL)"
    return where(any_of("lw", NEEDS[field][i]), found)


def first_value(text: str, field: str, which: Iterable[int] | None = None) -> str:
    """Value of the first candidate of :func:`scan`, or of its patterns ``which``; later patterns run only where earlier ones find nothing."""
    patterns = range(len(_FIELDS[field][0])) if which is None else which
    tried = ", ".join(f"get({_values(field, i)}, 0)" for i in patterns)
    if field == "ppg":
        ids = "array_sort(array_distinct(vs))"
        found = f"concat({', '.join(_values(field, i) for i in patterns)})"
        tried = let(found, "vs", f"if(size(vs) > 1 AND size(array_distinct(vs)) > 1, array_join({ids}, ', '), get(vs, 0))")
    pieces = dict.fromkeys(piece for i in patterns for piece in NEEDS[field][i])
    value = f"if({any_of('lw', pieces)}, {tried if field == 'ppg' else f'coalesce({tried})'}, cast(null as string))"
    return let(text, "vt", let("lower(vt)", "lw", value))


def first_values(text: str, field: str, n: int) -> str:
    """Values of the first ``n`` candidates of :func:`scan`, perhaps of more."""
    first, *rest = [_values(field, i) for i in range(len(_FIELDS[field][0]))]
    return let(text, "vt", let("lower(vt)", "lw", let(first, "vs", f"if(size(vs) >= {n}, vs, concat(vs, {', '.join(rest)}))")))


def scan(text: str, field: str, checksum: str = "standard") -> str:
    """Candidates of one field.  Two or more distinct PPG ids become one candidate."""
    found = _scan(text, field, checksum)
    if field != "ppg":
        return found
    ids = "array_sort(array_distinct(transform(cs, c -> c.value)))"
    combined = candidate(
        "ppg", "array_join(ids, ', ')", "array_max(transform(cs, c -> c.confidence))", "'ppg_combined'", 0
    )
    return let(found, "cs", let(ids, "ids", f"if(size(ids) > 1, array({combined}), cs)"))


def _nearby(n: int) -> str:
    """Up to ``n`` characters on both sides of the start of match ``j``.

    Put together from the neighbouring matches and the gaps between them: a cut
    by position would scan a long text from its start for every match.  No
    match is shorter than four characters, hence the number of neighbours.
    """
    k = n // 4 + 1
    before = (
        f"right(array_join(transform({span(f'greatest(j - {k}, 0)', 'j')}, "
        f"k -> concat(right(get(gaps, k), {n}), if(k < j, get(hits, k), ''))), ''), {n})"
    )
    after = (
        f"left(array_join(transform({span('j', f'least(j + {k}, size(hits) - 1)')}, "
        f"k -> concat(get(hits, k), left(get(gaps, k + 1), {n}))), ''), {n})"
    )
    return strip(f"replace(concat({before}, {after}), '\n', ' ')")


def scan_with_positions(text: str, field: str, checksum: str = "standard") -> str:
    """Like :func:`scan` without the PPG step, plus match position and context."""
    patterns, shape = _FIELDS[field]
    arrays = []
    for i, pattern in enumerate(patterns):
        value, confidence, passed = shape("m", i, checksum)
        full = q("(?i)" + pattern)
        made = (
            f"named_struct('field', '{field}', 'value', {value}, 'confidence', {confidence}, "
            f"'extractor_id', '{field}_pattern_{i}', 'pattern_ord', {i}, 'match_ord', j, "
            f"'validation_passed', {passed}, 'position', get(starts, j), 'context', {_nearby(CONTEXT[field])})"
        )
        arrays.append(
            let(
                f"split({text}, {full}, -1)", "gaps",
                let(
                    f"regexp_extract_all({text}, {full}, 0)", "hits",
                    let(
                        match_starts("gaps", "hits"), "starts",
                        f"transform(regexp_extract_all({text}, {full}, 1), (m, j) -> {made})",
                    ),
                ),
            )
        )
    return f"filter(concat({', '.join(arrays)}), c -> c.value IS NOT NULL)"


def match_places(text: str, pattern: str) -> str:
    """Array of the 0-based starts of a pattern's matches."""
    full = q("(?i)" + pattern)
    return let(f"split({text}, {full}, -1)", "gaps", let(f"regexp_extract_all({text}, {full}, 0)", "hits", match_starts("gaps", "hits")))


def places(text: str) -> str:
    """Struct with, per field, the match starts of each of its patterns."""
    return "named_struct(" + ", ".join(
        f"'{field}', array({', '.join(match_places(text, p) for p in shapes)})" for field, (shapes, _) in _FIELDS.items()) + ")"


def transaction_lexicon(text: str) -> str:
    """Type with the most lexicon hits, NULL under a negation; struct ``(value, confidence, hits)``."""
    def hits(kind):
        return " + ".join(f"regexp_count({text}, {q('(?i)' + edges(p))})" for p in LEXICON[kind])

    best = (
        "CASE WHEN n.term >= n.add AND n.term >= n.upd THEN 'Term' "
        "WHEN n.add >= n.upd THEN 'Add' ELSE 'Update' END"
    )
    top = "greatest(n.term, n.add, n.upd)"
    out = (
        f"CASE WHEN {top} > 0 THEN named_struct('value', {best}, "
        f"'confidence', least({top} * 0.3D, 0.9D), 'hits', {top}) END"
    )
    counts = f"named_struct('term', {hits('Term')}, 'add', {hits('Add')}, 'upd', {hits('Update')})"
    return f"CASE WHEN NOT lower({text}) rlike {q(NEGATION)} THEN {let(counts, 'n', out)} END"

