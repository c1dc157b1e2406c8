"""Small helpers that compose Spark SQL expression text.

Array programs (lines of a message, cells of a table) are written as SQL
higher-order functions; these helpers keep them readable.  Every helper takes
and returns SQL expression text; ``F.expr`` turns the result into a Column.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

#: ASCII word edges.  Java's own word-boundary class also counts accented letters, ``\w`` does not.
EDGE_LEFT = r"(?<!\w)"
EDGE_RIGHT = r"(?!\w)"

WHITESPACE = "' \\n\\t\\r\\u000c'"

#: items per chunk of :func:`fold`
CHUNK = 256


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def constant(value, ddl: str) -> str:
    """Constant array, map or struct of a dictionary.

    Written as one JSON literal: the optimizer folds it to a single value,
    where nested constructor calls would be thousands of nodes to analyse.
    """
    return f"from_json({q(json.dumps(value, ensure_ascii=False))}, '{ddl}')"


def words(values: Iterable[str]) -> str:
    """SQL array of strings."""
    return constant(list(values), "array<string>")


def rows(ddl: str, values: Iterable[tuple]) -> str:
    """SQL array of structs; ``ddl`` lists the fields as ``name:type``."""
    names = re.findall(r"(\w+):", ddl)
    return constant([dict(zip(names, row)) for row in values], f"array<struct<{ddl}>>")


def mapping(values: dict[str, str]) -> str:
    """SQL map of strings."""
    return constant(values, "map<string,string>")


def edges(pattern: str) -> str:
    """Replace ``\\b`` at the ends of a pattern by ASCII edges."""
    if pattern.startswith(r"\b"):
        pattern = EDGE_LEFT + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + EDGE_RIGHT
    return pattern


def word(pattern: str) -> str:
    """Pattern with ASCII edges on both sides."""
    return f"{EDGE_LEFT}(?:{pattern}){EDGE_RIGHT}"


def strip(x: str) -> str:
    return f"btrim({x}, {WHITESPACE})"


def let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` inside ``body``.

    The last step of ``aggregate`` over nothing: unlike ``transform`` it does not copy the result.
    """
    return f"aggregate(array(), {value}, (kept_, none_) -> kept_, {name} -> {body})"


def when_likely(test: str, text: str, name: str, array: str) -> str:
    """``array``, made of ``text`` under ``name``, where ``test`` holds; empty elsewhere.

    The test must hold wherever the array has elements: it only spares the scan.
    """
    return f"flatten(transform(if({test}, array({text}), cast(array() as array<string>)), {name} -> {array}))"


def span(first: str, last: str) -> str:
    """Ascending integer range, empty when ``last < first``."""
    return f"if({last} >= {first}, sequence({first}, {last}), cast(array() as array<int>))"


def part(array: str, first: str, last: str) -> str:
    """Elements ``first..last`` (0-based).  Costs what it returns; ``slice`` copies the whole array."""
    return f"transform({span(first, last)}, k -> get({array}, k))"


def where(test: str, array: str) -> str:
    """``array`` where ``test`` holds, else an empty array.

    The test must hold wherever the array has elements: it only spares the scan.
    """
    return f"if({test}, {array}, array())"


def any_of(text: str, phrases: Iterable[str]) -> str:
    """True when one of the plain phrases occurs in ``text``."""
    phrases = list(phrases)
    if len(phrases) > 1 and not re.fullmatch(r"[\w.]+", text):
        return let(text, "sought", any_of("sought", phrases))
    return "(" + " OR ".join(f"contains({text}, {q(p)})" for p in phrases) + ")"


def fold(items: str, zero: str, advance: Callable[[str, str], str], element: str) -> str:
    """Left-to-right scan that carries a state and emits elements.

    ``advance(state, item)`` is a struct ``(s, e)``: the next state and an
    array with the elements to emit.  ``aggregate`` copies its accumulator at
    every step, so emitted elements are gathered per chunk of items and a
    message with very many lines still costs little more than linear time.
    """
    empty = f"cast(array() as array<{element}>)"
    # the innermost aggregate binds the result of one step to ``r``
    step = (
        f"aggregate(array({advance('cs.s', 'x')}), cs, "
        "(a, r) -> named_struct('s', r.s, 'cur', if(size(r.e) = 0, a.cur, concat(a.cur, r.e))))"
    )
    chunk = part("its", f"b * {CHUNK}", f"least(b * {CHUNK} + {CHUNK - 1}, size(its) - 1)")
    one = f"aggregate({chunk}, named_struct('s', acc.s, 'cur', {empty}), (cs, x) -> {step})"
    whole = (
        f"aggregate({span('0', f'cast(ceil(size(its) / {CHUNK}D) as int) - 1')}, "
        f"named_struct('s', {zero}, 'done', cast(array() as array<array<{element}>>)), "
        f"(acc, b) -> aggregate(array({one}), acc, (o, r) -> named_struct('s', r.s, 'done', concat(o.done, array(r.cur)))), "
        "acc -> flatten(acc.done))"
    )
    return let(items, "its", f"if(size(its) = 0, {empty}, {whole})")


def emit(condition: str, value: str, element: str) -> str:
    """One-element array under a condition, for :func:`fold`."""
    return f"if({condition}, array({value}), cast(array() as array<{element}>))"


def match_starts(gaps: str, hits: str, measure: str = "length({0})") -> str:
    """0-based starts of matches from the texts between them and the matches; ``measure`` says what is counted."""
    return fold(
        f"transform({hits}, (m, i) -> named_struct('gap', {measure.format(f'get({gaps}, i)')}, 'len', {measure.format('m')}))",
        "0",
        lambda s, x: f"named_struct('s', {s} + {x}.gap + {x}.len, 'e', array({s} + {x}.gap))",
        "int",
    )


def word_places(text: str, pattern: str, made: str) -> str:
    """``made`` for each match ``m`` of a pattern (number ``j``), with ``w``: the number of the word it starts in.

    Words are what white space parts; a match must not start or end with it.
    """
    count = "cast(regexp_count({0}, '\\\\s+') as int)"
    built = f"transform(hits, (m, j) -> {let('get(places, j)', 'w', made)})"
    placed = let(f"split({text}, {q(pattern)}, -1)", "gaps", let(match_starts("gaps", "hits", count), "places", built))
    return let(f"regexp_extract_all({text}, {q(pattern)}, 0)", "hits", where("size(hits) > 0", placed))


#: spans and places up to which :func:`nearest` compares all pairs instead of sweeping
FEW = 8


def nearest(spans: str, places: str, far: int = 1 << 30) -> str:
    """Distance of each span ``(first, last)`` to the nearest place, in span order; spans and places in any order.

    One sweep over both from the left and one from the right: linear but for
    the sorting, however many of both there are; a few of both are compared
    pair by pair.  ``far`` without places.
    """
    kind = "array<struct<at:int,kind:int,ord:int>>"

    def sweep(end, order, span_kind, distance):
        events = f"concat(cast(transform(spans, (d, i) -> struct(d.{end}, {span_kind}, i)) as {kind}), cast(transform(places, k -> struct(k, {1 - span_kind}, -1)) as {kind}))"
        found = fold(
            order.format(f"array_sort({events})"), "cast(null as int)",
            lambda s, x: f"if({x}.kind = {span_kind}, named_struct('s', {s}, 'e', array(named_struct('ord', {x}.ord, 'gap', coalesce({distance.format(s=s, x=x)}, {far})))), "
                         f"named_struct('s', {x}.at, 'e', cast(array() as array<struct<ord:int,gap:int>>)))",
            "struct<ord:int,gap:int>")
        return f"array_sort({found})"

    # at one and the same word the place comes first in either direction
    left, right = sweep("first", "{0}", 1, "{x}.at - {s}"), sweep("last", "reverse({0})", 0, "{s} - {x}.at")
    swept = let(left, "lefts", let(
        right, "rights", "transform(lefts, (l, i) -> least(greatest(l.gap, 0), greatest(get(rights, i).gap, 0)))"))
    gap = f"CASE WHEN k <= d.first THEN d.first - k WHEN k >= d.last THEN k - d.last ELSE {far} END"
    paired = f"transform(spans, d -> coalesce(array_min(transform(places, k -> {gap})), {far}))"
    return let(spans, "spans", let(places, "places", f"if(size(spans) <= {FEW} AND size(places) <= {FEW}, {paired}, {swept})"))


def stab(points: str, spans: str) -> str:
    """Number of the span ``(first, past)`` that holds each point, in point order; NULL outside all.

    Spans must not overlap.  One sweep over both in order of place.
    """
    kind = "array<struct<at:int,kind:int,ord:int,past:int>>"
    events = (
        f"array_sort(concat(cast(transform({spans}, (d, i) -> struct(d.first, 0, i, d.past)) as {kind}), "
        f"cast(transform({points}, (p, i) -> struct(p, 1, i, cast(null as int))) as {kind})))"
    )
    found = fold(
        events, "named_struct('ord', -1, 'past', -1)",
        lambda s, x: f"if({x}.kind = 0, named_struct('s', named_struct('ord', {x}.ord, 'past', {x}.past), 'e', cast(array() as array<struct<ord:int,span:int>>)), "
                     f"named_struct('s', {s}, 'e', array(named_struct('ord', {x}.ord, 'span', if({x}.at < {s}.past, {s}.ord, cast(null as int))))))",
        "struct<ord:int,span:int>")
    return f"transform(array_sort({found}), e -> e.span)"


#: characters per piece of a text that contexts are cut from
PIECE = 256


def pieces(text: str) -> str:
    """A text in pieces, for :func:`context_at`."""
    return f"regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0)"


def context_at(pieces_: str, at: str, reach: str) -> str:
    """Up to ``reach`` (at most a piece) characters on both sides of a place, line breaks as blanks, stripped.

    Costs the same wherever in the text the place is.
    """
    near = f"concat(coalesce(get({pieces_}, pn - 1), ''), coalesce(get({pieces_}, pn), ''), coalesce(get({pieces_}, pn + 1), ''))"
    here = f"{at} - (greatest(pn, 1) - 1) * {PIECE}"
    cut = let(here, "ph", f"substr({near}, greatest(ph - {reach}, 0) + 1, ph + {reach} - greatest(ph - {reach}, 0))")
    return let(f"cast({at} div {PIECE} as int)", "pn", strip(f"replace({cut}, '\\n', ' ')"))
