"""Tables in messages (HTML and text) to field candidates.

Both readers give an array of tables ``(kind, start, headers, rows)``; header
texts map to fields by similarity, and cells become candidates.
"""

from __future__ import annotations

from ..functions import similarity
from ..functions import text as tx
from ..functions.sql import any_of, emit, fold, let, mapping, part, q, span, strip
from .sections import SEPARATORS
from ..vocab.headers import (
    BLOCK_FIELDS, HEADER_THRESHOLD, LABEL_WORDS, LABEL_WORDS_TEXT, TABLE_HEADER_WORDS, header_rows,
)

_DECISION = "struct<kind:int,start:int,stop:int,sep:string,next:int>"
_LABELS = "|".join(LABEL_WORDS)
_LABELS_TEXT = "|".join(LABEL_WORDS_TEXT)
# Fixed value: lines below a first label line that must hold a second one.
LABEL_REACH = 7


# --- lines -----------------------------------------------------------------

def looks_like_header(line: str) -> str:
    """At least two header words and a separator."""
    count = " + ".join(f"cast(contains(lh, '{w}') as int)" for w in TABLE_HEADER_WORDS)
    return let(strip(f"lower({line})"), "lh", f"({any_of('lh', SEPARATORS)} AND ({count}) >= 2)")


def separator(line: str) -> str:
    """``bar``, ``tab``, ``spaces`` or NULL."""
    return (
        f"CASE WHEN contains({line}, '|') THEN 'bar' WHEN contains({line}, '\\t') THEN 'tab' "
        f"WHEN {line} rlike '\\\\s{{2,}}' THEN 'spaces' END"
    )


def split_row(line: str, sep: str) -> str:
    """Non-empty cells of a line; empty cells are dropped, later ones move left."""
    pattern = f"CASE {sep} WHEN 'bar' THEN '\\\\|' WHEN 'tab' THEN '\\t' ELSE '\\\\s{{2,}}' END"
    return f"filter(transform(split({line}, {pattern}, -1), c -> {strip('c')}), c -> c <> '')"


def _label(t: str) -> str:
    raw = strip(f"substring_index({t}, ':', 1)")
    return let(raw, "raw", f"if(startswith(raw, '-'), {strip('substr(raw, 2)')}, raw)")


def _line_facts(text: str) -> str:
    colon = "contains(t, ':')"
    value = strip("substr(t, instr(t, ':') + 1)")
    known = f"({colon} AND lower(fd) rlike {q(_LABELS_TEXT)})"
    facts = (
        f"named_struct('t', t, 'blank', t = '', 'field', fd, 'value', v, 'known', {known}, "
        f"'pair', {known} AND fd <> '' AND v <> '', "
        f"'halt', t <> '' AND (NOT {colon} OR (fd <> '' AND v <> '' AND NOT {known})), "
        f"'plain', t <> '' AND NOT {colon}, "
        f"'head', {looks_like_header('t')}, 'sep', {separator('t')}, "
        "'bar', contains(t, '|'), 'tab', contains(t, '\\t'), 'gap', t rlike '\\\\s{2,}')"
    )
    return f"transform({tx.lines(text)}, l -> {let(strip('l'), 't', let(_label('t'), 'fd', let(value, 'v', facts)))})"


def _label_start(i: str) -> str:
    """A label line with another label line within reach, before any plain line."""
    ahead = span(f"{i} + 1", f"least(size(g) - 1, {i} + {LABEL_REACH})")
    near = let(
        ahead, "rng",
        let(
            "coalesce(get(filter(rng, j -> get(g, j).plain), 0), 2000000000)", "past",
            "exists(rng, j -> j < past AND get(g, j).known)",
        ),
    )
    return f"(get(g, {i}).known AND {near})"


def _decide(i: str) -> str:
    """Table that starts at line ``i``, or NULL.  Look-ups of the next stop line are O(1)."""
    none = f"cast(null as {_DECISION})"
    stop = "CASE get(g, i).sep WHEN 'bar' THEN get(stops.bar, w.bar) WHEN 'tab' THEN get(stops.tab, w.tab) ELSE get(stops.gap, w.gap) END"
    width = f"size({split_row('get(g, i).t', 'get(g, i).sep')})"
    kept = f"size(filter({span('i + 1', 'stop - 1')}, j -> size({split_row('get(g, j).t', 'get(g, i).sep')}) BETWEEN 1 AND width))"
    flat = let(
        stop, "stop",
        let(width, "width", let(
            kept, "kept",
            f"if(kept > 0, named_struct('kind', 0, 'start', i, 'stop', stop, 'sep', get(g, i).sep, 'next', i + kept + 2), {none})",
        )),
    )
    halt = "get(stops.halt, w.halt)"
    tall = (
        f"if(coalesce(get(stops.pair, w.pair + 1) < {halt}, false), "
        f"named_struct('kind', 1, 'start', i, 'stop', {halt}, 'sep', cast(null as string), 'next', {halt}), {none})"
    )
    body = f"CASE WHEN get(g, i).head THEN {flat} WHEN {_label_start('i')} THEN {tall} ELSE {none} END"
    return let(i, "i", body)


def text_tables(text: str) -> str:
    """Tables of a text: bar/tab/space rows under a header line, or ``label: value`` lines.

    One forward scan.  The positions of lines that end a table are known
    beforehand, the scan only moves pointers along them.
    """
    def lines_where(test):
        return f"concat(filter(idx, k -> {test}), array(size(g)))"

    stops = (
        f"named_struct('bar', {lines_where('NOT get(g, k).bar')}, 'tab', {lines_where('NOT get(g, k).tab')}, "
        f"'gap', {lines_where('NOT get(g, k).gap')}, 'halt', {lines_where('get(g, k).halt')}, "
        f"'pair', filter(idx, k -> get(g, k).pair))"
    )

    def advance(s, x):
        def passed(name, test):
            return f"'{name}', {s}.{name} + cast(coalesce(get(stops.{name}, {s}.{name}) {test} {x}, false) as int)"

        moved = (
            "named_struct(" + ", ".join([passed("bar", "<="), passed("tab", "<="), passed("gap", "<="),
                                          passed("halt", "<="), passed("pair", "<")]) + ")"
        )
        state = (
            f"named_struct('next', coalesce(d.next, {s}.next), 'bar', w.bar, 'tab', w.tab, 'gap', w.gap, "
            "'halt', w.halt, 'pair', w.pair)"
        )
        out = f"named_struct('s', {state}, 'e', {emit('d IS NOT NULL', 'd', _DECISION)})"
        chosen = f"if({x} < {s}.next, cast(null as {_DECISION}), {_decide(x)})"
        return let(moved, "w", let(chosen, "d", out))

    zero = "named_struct('next', 0, 'bar', 0, 'tab', 0, 'gap', 0, 'halt', 0, 'pair', 0)"
    found = fold("idx", zero, advance, _DECISION)
    flat = let(
        split_row("get(g, d.start).t", "d.sep"), "hs",
        "named_struct('kind', 'horizontal', 'start', d.start, 'headers', hs, 'rows', "
        f"transform(filter(transform({span('d.start + 1', 'd.stop - 1')}, k -> {split_row('get(g, k).t', 'd.sep')}), "
        "c -> size(c) BETWEEN 1 AND size(hs)), c -> concat(c, array_repeat('', size(hs) - size(c)))))",
    )
    tall = let(
        f"filter({part('g', 'd.start', 'd.stop - 1')}, y -> y.pair)", "ps",
        "named_struct('kind', 'vertical', 'start', d.start, 'headers', transform(ps, y -> y.field), "
        "'rows', array(transform(ps, y -> y.value)))",
    )
    tables = f"transform({found}, d -> if(d.kind = 0, {flat}, {tall}))"
    # most messages hold no table: one test of the whole text spares them the scan
    empty = "cast(array() as array<struct<kind:string,start:int,headers:array<string>,rows:array<array<string>>>>)"
    likely = f"lower({text}) rlike {q(_LABELS_TEXT)} AND {text} rlike {q(r':|\||\t|  ')}"
    # a table starts at a header line or at the first of two label lines
    starts = "exists(g, y -> y.head) OR size(filter(g, y -> y.known)) > 1"
    placed = let("sequence(0, size(g) - 1)", "idx", let(stops, "stops", tables))
    scan = let(_line_facts(text), "g", f"if({starts}, {placed}, {empty})")
    return f"if({likely}, {scan}, {empty})"


# --- HTML ------------------------------------------------------------------

def html_cells(html: str) -> str:
    """Array of tables, each an array of rows, each an array of cell texts.

    Of nested tables the innermost is read.
    """
    def after(x, tag):
        opening = q(r"(?i)<" + tag + r"(?:\s[^>]*)?>")
        return f"split({x}, {opening}, -1)"

    def tail(x):
        return f"slice({x}, 2, size({x}))"

    pieces = let(
        after(f"regexp_replace({html}, {q(r'(?s)<!--.*?-->')}, '')", "table"), "ts",
        f"transform(filter({tail('ts')}, t -> t rlike '(?i)</table'), t -> get(split(t, '(?i)</table', 2), 0))",
    )
    text_nodes = f"transform(split(c, '<[^>]*>', -1), n -> {strip(tx.decode_entities('n'))})"
    inner = "get(split(raw, '(?i)</t[dh]|</tr', 2), 0)"
    cells = let(
        after("r", "t[dh]"), "cs",
        f"transform({tail('cs')}, raw -> {let(inner, 'c', f"array_join({text_nodes}, '')")})",
    )
    rows = let(after("t", "tr"), "rs", f"transform({tail('rs')}, r -> {cells})")
    return f"transform({pieces}, t -> {rows})"


def is_vertical(rows: str) -> str:
    """Two or more of the first five rows are label/value pairs."""
    pairs = f"filter(slice({rows}, 1, 5), r -> size(r) = 2 AND lower(get(r, 0)) rlike {q(_LABELS)})"
    return f"(size({rows}) >= 2 AND size({pairs}) >= 2)"


def html_tables(html: str) -> str:
    """Tables of an HTML text, horizontal or label/value."""
    pairs = f"filter(rs, r -> size(r) = 2 AND get(r, 0) <> '' AND get(r, 1) <> '' AND lower(get(r, 0)) rlike {q(_LABELS)})"
    tall = let(
        pairs, "ps",
        "named_struct('kind', 'vertical', 'start', cast(null as int), 'headers', transform(ps, r -> get(r, 0)), "
        "'rows', if(size(ps) < 2, cast(array() as array<array<string>>), array(transform(ps, r -> get(r, 1)))))",
    )
    flat = (
        "named_struct('kind', 'horizontal', 'start', cast(null as int), 'headers', get(rs, 0), "
        "'rows', filter(slice(rs, 2, size(rs)), r -> size(r) > 0))"
    )
    some = f"filter({html_cells(html)}, rs -> size(rs) > 0 AND size(get(rs, 0)) > 0)"
    empty = "cast(array() as array<struct<kind:string,start:int,headers:array<string>,rows:array<array<string>>>>)"
    tables = f"transform({some}, rs -> if({is_vertical('rs')}, {tall}, {flat}))"
    return f"if({html} rlike '(?i)<table', {tables}, {empty})"


# --- header similarity -----------------------------------------------------

def _header_patterns() -> str:
    return similarity.pattern_rows([(field, variant) for field, _, variant, _ in header_rows()])


def _exact_headers() -> str:
    seen: dict[str, str] = {}
    for field, _, variant, _ in header_rows():
        seen.setdefault(variant, field)
    return mapping(seen)


def map_header(header: str) -> str:
    """Struct ``(field, score)`` of the field a header text stands for, or NULL."""
    exact = f"{_exact_headers()}[hd]"
    near = let(
        similarity.best_ratio("hd", _header_patterns(), float(HEADER_THRESHOLD)), "b",
        "CASE WHEN b IS NOT NULL THEN named_struct('field', b.label, 'score', b.score) END",
    )
    body = let(exact, "ex", f"if(ex IS NOT NULL, named_struct('field', ex, 'score', 100D), {near})")
    return let(strip(f"lower({header})"), "hd", body)


# --- candidates ------------------------------------------------------------

def table_candidates(tables: str, origin: str) -> str:
    """Cells of mapped columns as candidates, in table, row, column order."""
    share = "size(filter(fs, f -> f IS NOT NULL)) / cast(size(t.headers) as double)"
    conf = f"if(t.kind = 'vertical', least({share} + 0.2D, 1D), {share})"
    cell = (
        "named_struct('field', get(fs, c), 'value', "
        f"{strip('v')}, 'confidence', conf, 'extractor_id', concat('table_row_', r, '_col_', c), "
        f"'pattern_ord', ti, 'match_ord', r, 'validation_passed', true, "
        f"'origin', '{origin}', 'table_id', ti, 'row_idx', r, 'col_idx', c)"
    )
    of_row = f"filter(transform(row, (v, c) -> {cell}), x -> x.field IS NOT NULL AND x.value <> '')"
    of_table = let(
        f"transform(t.headers, h -> {map_header('h')}.field)", "fs",
        let(conf, "conf", f"flatten(transform(t.rows, (row, r) -> {of_row}))"),
    )
    return f"flatten(transform({tables}, (t, ti) -> {of_table}))"


def message_table_candidates(text: str, html: str) -> str:
    """HTML candidates first, then those of text tables."""
    return (
        f"concat({table_candidates(html_tables(f'coalesce({html}, {q(chr(32))})'), 'html')}, "
        f"{table_candidates(text_tables(text), 'text')})"
    )


def cells_of_message(text: str, html: str) -> str:
    """Candidates of :func:`message_table_candidates` as ``(field, value, confidence, low)``, in the form :func:`in_block` reads."""
    return block_cells(message_table_candidates(text, html))


def block_cells(candidates: str) -> str:
    """Candidates with their lower-cased value, made once per message."""
    return f"transform({candidates}, c -> named_struct('field', c.field, 'value', c.value, 'confidence', c.confidence, 'low', lower(c.value)))"


def in_block(cells: str, block_text: str) -> str:
    """Cells usable for a block: those that occur in it, and others of message-wide fields at 0.6 of their confidence."""
    own = ", ".join(q(f) for f in BLOCK_FIELDS)
    usable = f"filter({cells}, c -> c.field NOT IN ({own}) OR contains(low, c.low))"
    rated = "named_struct('field', c.field, 'value', c.value, 'confidence', if(contains(low, c.low), c.confidence, c.confidence * 0.6D))"
    return let(f"lower({block_text})", "low", f"transform({usable}, c -> {rated})")
