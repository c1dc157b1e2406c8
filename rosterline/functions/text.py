"""Text projections over one message column.  All are narrow, JVM-side expressions.

Every function takes SQL expression text (usually a column name) and returns
SQL expression text; wrap it with ``F.expr`` to get a Column.
"""

from __future__ import annotations

from .sql import WHITESPACE, let, q, strip

# Line shapes that start an older message of a thread.
REPLY_LINE = (
    r"From:[^\S\n]+\S|Sent:[^\S\n]+\S|To:[^\S\n]+\S|Subject:[^\S\n]+\S"
    r"|-----Original Message-----|________________________________|On [^\n]* wrote:|> [^\S\n]*\S"
)
# Boilerplate, each removed up to the end of its line.
BOILERPLATE = [
    r"unsubscribe[^\n]*",
    r"confidential[^\n]*",
    r"disclaimer[^\n]*",
    r"this email[^\n]*?confidential[^\n]*",
    r"please[^\n]*?unsubscribe[^\n]*",
]
# Salutation, header-like and closing lines (stripped, lower case).
SALUTATION = r"^(?:dear\s+|hi\s*,?$|hello\s*,?$|greetings\s*,?$|to\s+whom|attention|regarding)"
HEADER_LINE = r"^(?:from|to|subject|date|received):|^[a-z\s,&]+:$"
CLOSING = (
    r"^(?:best\s+(?:regards?|wishes)|sincerely|thank\s+you|regards?$|thanks?$|cheers?$"
    r"|yours?\s+|respectfully|cordially)"
)
NPI_LABELLED = r"(?i)NPI[:\s]*(\d{10})"

# Inline elements that do not break a line, and named entities.
INLINE_TAGS = r"(?i)</?(?:b|i|u|strong|em|span|font|a|small|sub|sup)(?:\s[^>]*)?>"
ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'",
    "&copy;": "\u00a9", "&reg;": "\u00ae", "&middot;": "\u00b7", "&ndash;": "\u2013",
    "&mdash;": "\u2014", "&hellip;": "\u2026", "&lsquo;": "\u2018", "&rsquo;": "\u2019",
    "&ldquo;": "\u201c", "&rdquo;": "\u201d", "&bull;": "\u2022", "&amp;": "&",
}


def lines(text: str) -> str:
    return f"split({text}, '\\n', -1)"


def clean_whitespace(text: str) -> str:
    """LF line ends, at most one blank line before stripping, right-trimmed lines,
    leading blanks capped at eight."""
    unified = f"regexp_replace(regexp_replace({text}, {q(chr(92) + 'r' + chr(92) + 'n?')}, '\\n'), '\\n{{3,}}', '\\n\\n')"
    # few lines start or end with white space
    edged = q(r"^[ \n\t\r\f]|[ \n\t\r\f]$")
    bare = f"if(sl = '', '', concat(repeat(' ', least(8, length(l) - length(ltrim({WHITESPACE}, l)))), sl))"
    one = f"if(l rlike {edged}, {let(strip('l'), 'sl', bare)}, l)"
    return f"array_join(transform({lines(unified)}, l -> {one}), '\\n')"


def normalize_punctuation(text: str, compat: bool = False) -> str:
    """Dashes and ellipsis to ASCII; curly quotes too unless ``compat``."""
    dashes = f"replace(translate({text}, '\u2013\u2014', '--'), '\u2026', '...')"
    if compat:
        return dashes
    return f"translate({dashes}, '\u2018\u2019\u201c\u201d', '\\'\\'\"\"')"


def decode_entities(text: str) -> str:
    out = text
    for entity, char in ENTITIES.items():
        out = f"replace({out}, {q(entity)}, {q(char)})"
    return out


def mark_cells(html: str) -> str:
    """Put `` | `` between the cells of a row; a row then stays on one line."""
    return f"regexp_replace({html}, {q(r'(?i)</t[dh]>\s*<t[dh](?:\s[^>]*)?>')}, ' | ')"


def mark_cells_compat(html: str) -> str:
    """Append a separator node to every cell but the last of its row."""
    return f"regexp_replace({html}, {q(r'(?i)</t[dh]>(?=\s*<t[dh])')}, ' | </td>')"


def html_to_text(html: str, compat: bool = False) -> str:
    """HTML to text: script and style dropped, tags to line breaks, entities decoded."""
    x = f"regexp_replace({html}, {q(r'(?is)<!--.*?-->')}, '<!>')"
    x = f"regexp_replace({x}, {q(r'(?is)<(script|style)(?:\s[^>]*)?>.*?</\1\s*>')}, '<!>')"
    if compat:
        x = mark_cells_compat(x)
    else:
        x = mark_cells(f"regexp_replace({x}, {q(INLINE_TAGS)}, '')")
    x = f"regexp_replace({x}, {q(r'(?:<[^>]*>)++')}, '\\n')"
    x = f"regexp_replace({x}, {q(r'^\n|\n\z')}, '')"
    return clean_whitespace(decode_entities(x))


def reply_offset(text: str) -> str:
    """1-based start of the first reply line, 0 when there is none."""
    pattern = rf"(?imd)^[^\S\n]*(?:{REPLY_LINE})"
    return f"regexp_instr({text}, {q(pattern)})"


def npi_set_difference(older: str, newer: str) -> str:
    """Labelled NPIs of ``older`` that ``newer`` does not have."""
    p = q(NPI_LABELLED)
    return f"array_except(regexp_extract_all({older}, {p}, 1), regexp_extract_all({newer}, {p}, 1))"


def trim_thread(text: str) -> str:
    """Struct ``(text, trimmed)``: the newest message unless the older part has other NPIs."""
    newer = f"substr({text}, 1, greatest(pos - 2, 0))"
    older = f"substr({text}, pos)"
    body = (
        f"CASE WHEN pos = 0 OR size({npi_set_difference(older, newer)}) > 0 "
        f"THEN named_struct('text', {text}, 'trimmed', false) "
        f"ELSE named_struct('text', {strip(newer)}, 'trimmed', true) END"
    )
    return let(reply_offset(text), "pos", body)


def strip_boilerplate(text: str) -> str:
    out = text
    for pattern in BOILERPLATE:
        out = f"regexp_replace({out}, {q('(?i)' + pattern)}, '')"
    return out


def body_window(text: str) -> str:
    """Lines between the salutation or header lines and the last closing line."""
    low = f"transform(ls, l -> lower({strip('l')}))"
    first = (
        f"greatest(array_position(transform(lo, l -> l <> '' AND NOT l rlike {q(SALUTATION)} "
        f"AND NOT l rlike {q(HEADER_LINE)}), true) - 1, 0)"
    )
    closing = f"array_position(reverse(transform(lo, l -> l <> '' AND l rlike {q(CLOSING)})), true)"
    end = "if(cl > 0 AND size(ls) - cl > st, size(ls) - cl, size(ls))"
    kept = "slice(ls, cast(st + 1 as int), cast(en - st as int))"
    body = f"regexp_replace(array_join({kept}, '\\n'), {q(r'^(?:[^\S\n]*\n)++|(?:\n[^\S\n]*)++\z')}, '')"
    blank_only = f"CASE WHEN {strip('body')} = '' THEN '' ELSE body END"
    return let(
        lines(text), "ls",
        let(low, "lo", let(first, "st", let(closing, "cl", let(end, "en", let(body, "body", blank_only))))),
    )


def pipe_lines(text: str) -> str:
    """Lines that look like rows of a bar-separated table."""
    test = (
        r"regexp_count(l, '\\|') >= 2 OR l rlike "
        + q(r"\s+\|\s+") + " OR l rlike " + q(r"\w+:\s*\w+\s*\|\s*\w+:")
    )
    return f"array_join(filter({lines(text)}, l -> contains(l, '|') AND ({test})), '\\n')"


def collapse_whitespace(text: str) -> str:
    return strip(f"regexp_replace({text}, {q(r'\s+')}, ' ')")


def context(text: str, start: str, before: int, after: int | None = None, length: str = "0") -> str:
    """Characters around a 0-based match start, line breaks as blanks, stripped."""
    after = before if after is None else after
    lo = f"greatest({start} - {before}, 0)"
    cut = f"substr({text}, {lo} + 1, {start} + {length} + {after} - {lo})"
    return strip(f"replace({cut}, '\\n', ' ')")


def title_case(text: str) -> str:
    """Capital at the start of every letter run, as in ``O'Neil-Smith``."""
    runs = f"regexp_extract_all({text}, {q(r'\p{L}+|\P{L}+')}, 0)"
    return f"array_join(transform({runs}, r -> concat(upper(substr(r, 1, 1)), lower(substr(r, 2)))), '')"


def title_words(text: str, lower_words: list[str], first_title: bool) -> str:
    """Title case word by word; listed small words stay lower."""
    small = ", ".join(q(w) for w in lower_words)
    lead = "i = 0 OR " if first_title else ""
    body = f"if({lead}lower(w) NOT IN ({small}), {title_case('w')}, lower(w))"
    return f"array_join(transform({word_list(text)}, (w, i) -> {body}), ' ')"


def word_list(text: str) -> str:
    """Words of a text, as a whitespace split without empty items."""
    return f"regexp_extract_all({text}, {q(chr(92) + 'S+')}, 0)"


def normalize_message(text: str, html: str, compat: bool = False) -> str:
    """Struct ``(text, trimmed)`` of the readable text of a message."""
    from_text = normalize_punctuation(clean_whitespace(text), compat)
    chosen = f"CASE WHEN {html} <> '' THEN {html_to_text(html, compat)} ELSE {from_text} END"
    return let(chosen, "t", trim_thread("t"))

