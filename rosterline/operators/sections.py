"""Message text to provider blocks.

A message stays one row.  Its lines become an array, cue flags are computed
once per line, and blocks come out of bounded look-ahead plus one linear scan.
Nothing is shuffled: a message is never spread over, or collected into, a task
other than the one that read it.
"""

from __future__ import annotations

from ..functions import text as tx
from ..functions.sql import any_of, emit, fold, let, part, q, span, strip, word
from ..vocab.transactions import SCOPE_WORDS

# Cue patterns.
HARD_CUE = r"(?i)^\s*(?:Provider|Provider\s+Name|Provider\s+\d+|Doctor|Physician)\s*:"
TABLE_HEADER = r"(?i)Provider.*Name.*NPI|Name.*NPI.*TIN|NPI.*Provider.*Specialty"
SOFT_NPI = r"(?i)NPI[:\s]*\d{10}"
SOFT_LICENSE = r"(?i)License[:\s]*[A-Z]\d+"
SOFT_TIN = r"(?i)TIN[:\s]*\d{2}-?\d{7}"
ROW_SEPARATOR = r"\||\t|  "
ROW_IDENTIFIER = r"\d{10}|[A-Z]\d{5}"
#: the pieces of ROW_SEPARATOR
SEPARATORS = ["|", "\t", "  "]
SHARED_TIN = r"(?i)TIN[:\s#]*(\d{2}-?\d{7})"
SHARED_PPG = r"(?i)PPG[:\s#']*([A-Za-z0-9]+)"
SHARED_LOB = r"(?i)Medicare|Medicaid|Commercial|HMO|PPO"
SHARED_ORGANIZATION = r"(?i)Medical Group|Healthcare|Clinic|Practice"

# Look-ahead of a block, rows below a header, evidence window.
HARD_LINES, SOFT_LINES, TABLE_ROWS, EVIDENCE_LINES = 10, 5, 19, 3

_EVENT = "struct<line:int,kind:int,stop:int,conf:double,mark:string>"
_RANGE = "struct<first:int,past:int,start:int,stop:int,conf:double,mark:string>"


def shared_fields(text: str) -> dict[str, str]:
    """Message-wide values that apply to all blocks."""
    def first(p, group):
        return f"nullif(regexp_extract({text}, {q(p)}, {group}), '')"

    lob = f"array_sort(array_distinct(regexp_extract_all({text}, {q(SHARED_LOB)}, 0)))"
    return {
        "tin": first(SHARED_TIN, 1),
        "ppg": first(SHARED_PPG, 1),
        "lob": f"nullif(array_join({lob}, ', '), '')",
        "organization": first(SHARED_ORGANIZATION, 0),
    }


def _flags(text: str) -> str:
    # cheap tests first: the piece that a pattern cannot do without, and all scope words at once
    def test(piece, pattern, of="t"):
        return f"(contains(lw, '{piece}') AND {of} rlike {q(pattern)})"

    hits = " + ".join(f"cast({x} as int)" for x in ("by_npi", test("license", SOFT_LICENSE), test("tin", SOFT_TIN)))
    any_mark = q("(?i)" + word("|".join(SCOPE_WORDS.values())))
    mark = f"CASE WHEN NOT l rlike {any_mark} THEN cast(null as string) " + " ".join(f"WHEN l rlike {q('(?i)' + word(w))} THEN '{kind}'" for kind, w in SCOPE_WORDS.items()) + " END"
    flags = (
        f"named_struct('l', l, 't', t, 'blank', t = '', 'hard', contains(t, ':') AND t rlike {q(HARD_CUE)}, "
        f"'npi', by_npi, 'hits', {hits}, 'head', {test('npi', TABLE_HEADER, 'l')}, "
        f"'cells', {any_of('t', SEPARATORS)} AND t rlike {q(ROW_IDENTIFIER)}, 'mark', {mark})"
    )
    return f"transform({tx.lines(text)}, l -> {let(strip('l'), 't', let('lower(t)', 'lw', let(test('npi', SOFT_NPI), 'by_npi', flags)))})"


def _end(s: str, reach: int) -> str:
    """Last non-blank line before the next cue, a double blank, or the reach."""
    stops = (
        "get(f, i).hard OR (get(f, i).blank AND coalesce(get(f, i + 1).blank, true))"
    )
    return let(
        f"least(size(f) - 1, {s} + {reach})", "hi",
        let(
            span(f"{s} + 1", "hi"), "rng",
            let(
                f"coalesce(get(filter(rng, i -> {stops}), 0), hi + 1)", "past",
                f"coalesce(array_max(filter(rng, i -> i < past AND NOT get(f, i).blank)), {s})",
            ),
        ),
    )


def _event(line: str, kind: int, stop: str, conf: str, mark: str = "cast(null as string)") -> str:
    return (
        f"named_struct('line', {line}, 'kind', {kind}, 'stop', {stop}, 'conf', {conf}, 'mark', {mark})"
    )


def _hard() -> str:
    return f"transform(filter(idx, i -> get(f, i).hard), s -> {_event('s', 1, _end('s', HARD_LINES), '0.9D')})"


def _table() -> str:
    below = span("h + 1", f"least(size(f) - 1, h + {TABLE_ROWS})")
    return (
        "flatten(transform(filter(idx, i -> get(f, i).head), h -> "
        f"transform(filter({below}, i -> get(f, i).cells), i -> {_event('i', 2, 'i', '0.8D')})))"
    )


def _evidence(s: str) -> str:
    lo = f"greatest({s} - {EVIDENCE_LINES}, 0)"
    near = span(lo, f"least({s} + {EVIDENCE_LINES}, size(f) - 1)")
    return f"aggregate({near}, 0, (a, k) -> a + get(f, k).hits)"


def _soft() -> str:
    starts = f"filter(idx, i -> get(f, i).npi AND {_evidence('i')} >= 2)"
    conf = f"least({_evidence('s')} * 0.2D, 0.7D)"
    candidates = f"transform({starts}, s -> {_event('s', 3, _end('s', SOFT_LINES), conf)})"
    return fold(
        candidates,
        "-1",
        lambda s, x: (
            f"named_struct('s', if({x}.line > {s}, {x}.stop, {s}), 'e', {emit(f'{x}.line > {s}', x, _EVENT)})"
        ),
        _EVENT,
    )


def _marks() -> str:
    marked = "filter(idx, i -> get(f, i).mark IS NOT NULL)"
    return f"transform({marked}, i -> {_event('i', 0, 'i', '0D', 'get(f, i).mark')})"


def _text(e: str) -> str:
    raw = f"array_join(transform({span(f'{e}.line', f'{e}.stop')}, k -> get(f, k).l), '\\n')"
    return f"if({e}.kind = 2, get(f, {e}.line).t, {raw})"


_KIND = "element_at(array('hard_cue', 'table_row', 'soft_cue'), {}.kind)"


def _over_lines(text: str, body: str) -> str:
    return let(_flags(text), "f", let("sequence(0, size(f) - 1)", "idx", body))


def cue_blocks(text: str, kind: str) -> str:
    """Unmerged blocks of one kind (``hard``, ``table`` or ``soft``)."""
    events = {"hard": _hard, "table": _table, "soft": _soft}[kind]()
    out = (
        f"named_struct('start_line', e.line, 'end_line', e.stop, 'text', {_text('e')}, "
        f"'indicator', {_KIND.format('e')}, 'confidence', e.conf)"
    )
    return _over_lines(text, f"transform({events}, e -> {out})")


def soft_evidence(text: str) -> str:
    """Evidence score of every line that holds a labelled NPI."""
    scored = f"transform(filter(idx, i -> get(f, i).npi), s -> named_struct('line_no', s, 'score', {_evidence('s')}))"
    return _over_lines(text, scored)


def scope_marks(text: str) -> str:
    """Lines that set a transaction scope."""
    return _over_lines(text, f"transform({_marks()}, e -> named_struct('line_no', e.line, 'mark', e.mark))")


def _merge(gap: int) -> str:
    """Linear merge of sorted cue blocks; scope marks travel in the same order."""
    def advance(s, x):
        joins = f"({s}.start >= 0 AND {x}.line <= {s}.stop + {gap})"
        moved = (
            f"CASE WHEN {x}.kind = 0 THEN named_struct('i', {s}.i + 1, 'first', {s}.first, 'start', {s}.start, "
            f"'stop', {s}.stop, 'conf', {s}.conf, 'seen', {x}.mark, 'mark', {s}.mark) "
            f"WHEN {joins} THEN named_struct('i', {s}.i + 1, 'first', {s}.first, 'start', {s}.start, "
            f"'stop', greatest({s}.stop, {x}.stop), 'conf', greatest({s}.conf, {x}.conf), 'seen', {s}.seen, 'mark', {s}.mark) "
            f"ELSE named_struct('i', {s}.i + 1, 'first', {s}.i, 'start', {x}.line, 'stop', {x}.stop, "
            f"'conf', {x}.conf, 'seen', {s}.seen, 'mark', {s}.seen) END"
        )
        closed = (
            f"named_struct('first', {s}.first, 'past', {s}.i, 'start', {s}.start, 'stop', {s}.stop, "
            f"'conf', {s}.conf, 'mark', {s}.mark)"
        )
        done = emit(f"{x}.kind > 0 AND {s}.start >= 0 AND NOT {joins}", closed, _RANGE)
        return f"named_struct('s', {moved}, 'e', {done})"

    zero = (
        "named_struct('i', 0, 'first', 0, 'start', -1, 'stop', -1, 'conf', 0D, "
        "'seen', cast(null as string), 'mark', cast(null as string))"
    )
    # a last event far below the text closes the open range
    last = _event("2000000000", 4, "2000000000", "0D")
    return fold(f"concat(ev, array({last}))", zero, advance, _RANGE)


def blocks(text: str, gap: int = 2) -> str:
    """Merged provider blocks with confidence 0.3 or more; may be empty.

    Blocks closer than ``gap`` lines merge.  ``gap=0`` keeps neighbouring
    providers apart.
    """
    events = f"array_sort(concat({_marks()}, {_hard()}, {_table()}, {_soft()}))"
    parts = f"filter({part('ev', 'r.first', 'r.past - 1')}, e -> e.kind > 0)"
    out = let(
        parts, "es",
        f"named_struct('start_line', r.start, 'end_line', r.stop, "
        f"'text', array_join(transform(es, e -> {_text('e')}), '\\n'), 'transaction_type', r.mark, "
        f"'indicators', transform(es, e -> {_KIND.format('e')}), 'confidence', r.conf)",
    )
    merged = let(events, "ev", f"filter(transform({_merge(gap)}, r -> {out}), b -> b.confidence >= 0.3D)")
    return _over_lines(text, merged)


def blocks_or_default(text: str, gap: int = 2) -> str:
    """Blocks, or the whole text as one block of confidence 0.5."""
    whole = (
        f"named_struct('start_line', 0, 'end_line', size({tx.lines(text)}), 'text', {text}, "
        "'transaction_type', cast(null as string), 'indicators', cast(array() as array<string>), 'confidence', 0.5D)"
    )
    return let(blocks(text, gap), "bs", f"if(size(bs) = 0, array({whole}), bs)")
