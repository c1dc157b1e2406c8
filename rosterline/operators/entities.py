"""Names, organisations, specialties, lines of business, word dates, transaction type."""

from __future__ import annotations

import re

from ..functions import similarity
from ..functions import text as tx
from ..functions.sql import EDGE_LEFT, EDGE_RIGHT, any_of, constant, let, mapping, nearest, q, rows, strip, when_likely, where, word, word_places, words
from ..vocab import specialties as sp
from ..vocab.business import LOB_GAZETTEER, ORGANIZATION_ALIASES
from ..vocab.transactions import (
    ADD_WORDS, CHANGE_WORDS, EXISTING_PROVIDER, EXPLICIT_TYPE, FIRST_TIME_PROVIDER, TERM_WORDS,
    TYPE_SUBJECTS, TYPE_WEIGHTS, UPDATE_NEAR_ADD, UPDATE_WORDS,
)
from .patterns import candidate

# --- provider names --------------------------------------------------------

# Name patterns.
NAME_TITLED_COMPAT = r"Dr\.?\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]*\.?\s+)*[A-Z][a-z]+)"
NAME_TITLED_RUN = r"Dr\.?\s+(?=[A-Z][a-z]+\s+[A-Z])([A-Z][a-z]+(?:\s+[A-Z][a-z]*\.?)*+)"
NAME_MD = r"([A-Z][a-z]+\s+[A-Z][a-z]+),?\s+M\.?D\.?"
NAME_DO = r"([A-Z][a-z]+\s+[A-Z][a-z]+),?\s+D\.?O\.?"
NAME_STOP = ["best regards", "thank you", "sincerely", "email", "phone"]
TITLES = "dr|doctor|physician|md|do"


def normalize_name(x: str) -> str:
    """Single blanks; one blank before a trailing degree."""
    flat = tx.collapse_whitespace(x)
    return f"regexp_replace({flat}, {q(r'(?i),\s*(M\.?D\.?|D\.?O\.?)$')}, ', $1')"


def provider_names(text: str, compat: bool = False) -> str:
    """Name candidates of the three patterns, confidence 0.6.

    A titled name is read as the longest run of capitalised words; words that
    cannot end a name (initials) are then taken off its end.
    """
    if compat:
        titled = f"regexp_extract_all({text}, {q(NAME_TITLED_COMPAT)}, 1)"
    else:
        ending = q(r"\.?(?:\s+[A-Z]\.?)*+$")
        titled = (
            f"filter(transform(regexp_extract_all({text}, {q(NAME_TITLED_RUN)}, 1), "
            f"m -> regexp_replace(m, {ending}, '')), m -> m rlike {q(r'\s')})"
        )
    found = [where(f"contains({text}, 'Dr')", titled)]
    for pattern, degrees in ((NAME_MD, ["MD", "M.D"]), (NAME_DO, ["DO", "D.O"])):
        found.append(where(any_of(text, degrees), f"regexp_extract_all({text}, {q(pattern)}, 1)"))
    made = [
        f"transform({arr}, (m, j) -> "
        + candidate("provider_name", normalize_name("m"), "0.6D", q(f"name_pattern_{i}"), i, "j")
        + ")"
        for i, arr in enumerate(found)
    ]
    return f"concat({', '.join(made)})"


def likely_name(name: str) -> str:
    """No stop phrase, two or more parts, none of a single character."""
    parts = tx.word_list(name)
    return (
        f"(NOT {any_of(f'lower({name})', NAME_STOP)} AND size({parts}) >= 2 "
        f"AND forall({parts}, p -> length(p) > 1))"
    )


def names_near_title(text: str, compat: bool = False) -> str:
    """Plausible names with a title word within five tokens, confidence 0.9."""
    name = r"concat('\\Q', c.value, '\\E')"
    left = q("(?i)" + word(TITLES) + r"\.?\s+(?:\S+\s+){0,5}?")
    right = q(r"(?:\W+\w+){0,5}?\W+" + word(TITLES))
    near = f"({text} rlike concat({left}, {name}) OR {text} rlike concat('(?i)', {name}, {right}))"
    kept = f"filter({provider_names(text, compat)}, c -> {likely_name('c.value')} AND {near})"
    return f"transform({kept}, (c, j) -> {candidate('provider_name', 'c.value', '0.9D', q('title_adjacent_name'), 0, 'j')})"


# --- organisations ---------------------------------------------------------

# Organisation patterns and word lists.
CAPITAL_RUN = r"(?:[A-Z][A-Za-z'.-]*|&)(?:[ \t]+(?:[A-Z][A-Za-z'.-]*|&))*+"
ALIAS = "|".join(ORGANIZATION_ALIASES)
ORG_LABEL = r"(?im)^[ \t-]*(?:Organization Name|Organization|Group Name|Group)[ \t]*:[ \t]*([^\n|;]+)"
HEALTHCARE_TERMS = [
    "medical", "clinic", "hospital", "practice", "physicians", "health", "healthcare", "group", "associates", "center",
]
NOT_HEALTHCARE = ["microsoft", "google", "email", "outlook", "exchange", "best regards", "thank you", "sincerely"]
PLAN_TERMS = [
    "insurance", "health plan", "hmo", "ppo", "epo", "pos", "medicare", "medicaid", "coverage",
    "benefits plan", "health net", "health care plan", "managed care",
]
PROVIDER_TERMS = [
    "medical group", "medical center", "clinic", "hospital", "practice", "physicians", "health center", "associates",
]
BAD_ORG = [
    "provider", "affiliation", "network", "best regards", "hi", "please", "terminate", "effective",
    "date", "tax id", "license", "npi",
]
HEALTHCARE_WORDS = ["medical", "health", "clinic", "hospital", "practice", "physicians", "doctors"]
CONTEXT_PROVIDER = [
    "medical group", "medical center", "clinic", "hospital", "practice", "physicians", "associates",
    "health system", "healthcare", "terminated with", "employed by", "affiliated with", "works at",
    "practices at", "joined", "leaving",
]
NAME_PROVIDER = [
    "medical", "clinic", "hospital", "practice", "physicians", "health center", "medical center", "group", "associates",
]
CONTEXT_PLAN = [
    "insurance", "health plan", "hmo", "ppo", "epo", "pos", "medicare", "medicaid", "coverage",
    "benefits", "plan", "payor", "payer", "insurer",
]
ORG_SMALL_WORDS = ["and", "the", "of", "for", "in", "on", "at"]


def is_healthcare_related(name: str) -> str:
    low = f"lower({name})"
    return (
        f"CASE WHEN length({name}) < 3 THEN false WHEN {any_of(low, NOT_HEALTHCARE)} THEN false "
        f"WHEN {any_of(low, HEALTHCARE_TERMS)} THEN true WHEN length({name}) >= 8 THEN true "
        f"ELSE {name} rlike {q(r'^[A-Z]+(?:\s*&\s*[A-Z]+)*$')} END"
    )


def is_health_plan(name: str) -> str:
    low = f"lower({name})"
    return f"(NOT {any_of(low, PROVIDER_TERMS)} AND {any_of(low, PLAN_TERMS)})"


def is_bad_organization(name: str) -> str:
    return any_of(f"lower({name})", BAD_ORG)


def is_healthcare_organization(name: str) -> str:
    return any_of(f"lower({name})", HEALTHCARE_WORDS)


def organization_confidence(name: str, context: str) -> str:
    low = f"lower({name})"
    return (
        f"least(0.7D + if({any_of(low, ['medical', 'clinic', 'hospital', 'practice'])}, 0.1D, 0D) "
        f"+ if({any_of(f'lower({context})', ['terminated with', 'affiliated with', 'practices at'])}, 0.15D, 0D) "
        f"+ if({any_of(low, ['group', 'associates', 'partners'])}, 0.05D, 0D), 0.95D)"
    )


def organization_context_class(context: str, name: str) -> str:
    ctx, low = f"lower({context})", f"lower({name})"
    return (
        f"CASE WHEN {any_of(ctx, CONTEXT_PROVIDER)} THEN 'provider' WHEN {any_of(low, NAME_PROVIDER)} THEN 'provider' "
        f"WHEN {any_of(ctx, CONTEXT_PLAN)} OR {any_of(low, CONTEXT_PLAN)} THEN 'health_plan' ELSE 'unknown' END"
    )


def clean_organization(name: str) -> str:
    """Drop a leading article, a trailing date clause and punctuation; '' for non-names."""
    x = f"regexp_replace({name}, {q(r'(?i)^the\s+')}, '')"
    x = f"regexp_replace({x}, {q(r'(?i)\s+(?:effective|on|as\s+of)[^\n]*$')}, '')"
    x = strip(f"regexp_replace({x}, {q(r'[.,;:\s]+$')}, '')")
    skip = (
        r"(?i)^(?:(?:effective|on|as\s+of|date|time)|\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}"
        r"|(?:january|february|march|april|may|june|july|august|september|october|november|december)|\w{1,2})$"
    )
    return let(x, "o", f"if(o rlike {q(skip)}, '', o)")


def normalize_organization_candidate(name: str) -> str:
    return tx.title_words(name, ORG_SMALL_WORDS, first_title=False)


def _found_organizations(body: str) -> str:
    """Labelled values, then capitalised spans that end in an organisation word."""
    labelled = f"transform(regexp_extract_all({body}, {q(ORG_LABEL)}, 1), m -> {strip('m')})"
    runs = f"regexp_extract_all({body}, {q(CAPITAL_RUN)}, 0)"
    # the longest lead of a run that ends in an organisation word, with a short "& ABC" tail
    span_ = q(rf"^((?:[^\n]*[ \t])?(?:{ALIAS})(?:[ \t]+&[ \t]+[A-Z]{{2,10}}(?![A-Za-z]))?)(?![A-Za-z])")
    spans = f"filter(transform({runs}, m -> regexp_extract(m, {span_}, 1)), m -> length(m) > 5)"
    return f"concat({labelled}, {spans})"


def _organizations_likely(text: str) -> str:
    """A label or an organisation word, of which every organisation holds one in a line of its own."""
    return f"({any_of(text, ORGANIZATION_ALIASES)} OR {any_of(f'lower({text})', ['organization', 'group'])})"


def organization_candidates(body: str) -> str:
    """Accepted organisations of a body text: array of ``(name, value, confidence, context, ord)``."""
    start = f"instr({body}, m) - 1"
    around = tx.context(body, start, 60, 60, "length(m)")
    keep = f"{is_healthcare_related('m')} AND NOT {is_health_plan('m')}"
    made = let(
        around, "cx",
        f"named_struct('name', m, 'value', {normalize_organization_candidate('m')}, "
        f"'confidence', {organization_confidence('m', 'cx')}, 'context', cx, 'ord', j)",
    )
    return f"transform(filter(array_distinct({_found_organizations(body)}), m -> {keep}), (m, j) -> {made})"


def found_organizations(text: str) -> str:
    """Accepted organisations of the body, else of the bar-separated lines."""
    bars = let(tx.pipe_lines(text), "pl", organization_candidates("pl"))
    body = let(tx.body_window(text), "bw", organization_candidates("bw"))
    return where(_organizations_likely(text), let(body, "found", f"if(size(found) > 0, found, {bars})"))


def best_organization(candidates: str) -> str:
    """Most confident candidate that no longer one contains; the longer on ties.

    Names are joined longest first; a name is contained in a longer one when
    its first occurrence in the joined text is not its own place.
    """
    order = "named_struct('rank', -length(o.value), 'ord', o.ord, 'value', o.value, 'low', lower(o.value), 'confidence', o.confidence)"
    joined = r"concat('\n', array_join(transform(sorted, o -> o.low), '\n'), '\n')"
    own = r"instr(names, concat('\n', o.low, '\n')) + 1 = instr(names, o.low)"
    top = "array_max(transform(kept, o -> named_struct('confidence', o.confidence, 'len', -o.rank, 'ord', -o.ord, 'value', o.value)))"
    return let(
        f"array_sort(transform({candidates}, o -> {order}))", "sorted",
        let(joined, "names", let(f"filter(sorted, o -> {own})", "kept", top)),
    )


def organization(text: str) -> str:
    """Best organisation of the body, else of the bar-separated lines: ``(confidence, ..., value)``."""
    body = let(tx.body_window(text), "bw", best_organization(organization_candidates("bw")))
    bars = let(tx.pipe_lines(text), "pl", best_organization(organization_candidates("pl")))
    return f"CASE WHEN {_organizations_likely(text)} THEN coalesce({body}, {bars}) END"


# --- specialties -----------------------------------------------------------

# Words near a short synonym that veto it; phrase endings; labels.
SHORT_VETO = (
    "provider|deliver|other|over|under|after|never|number|management|different|treatment|department|agreement|statement"
)
SHORT_SYNONYM, VETO_REACH = 2, 20
#: characters at the end of a word that phrases are looked up by
ENDING = 3
LONG_CONFIDENCE, SHORT_CONFIDENCE = 0.95, 0.7
PHRASE_ENDINGS = ["medicine", "surgery", "ology", "ics", "ist", "ian", "specialty", "field"]
PHRASE_LABELS = ["specialty", "field", "specialization", "area", "practice"]
FUZZY_RATIO, FUZZY_PARTIAL = 80.0, 85.0

_HIT = "struct<value:string,confidence:double,extractor_id:string,ord:int>"


def _quote(text: str) -> str:
    return "\\Q" + text + "\\E"


def by_ending(phrases: list[str]) -> dict[str, list[int]]:
    """Numbers of the phrases by their last characters, which end a word of a text that holds them as words."""
    groups: dict[str, list[int]] = {}
    for n, phrase in enumerate(phrases):
        groups.setdefault(phrase[-ENDING:], []).append(n)
    return groups


def endings_in(text: str, endings) -> str:
    """Distinct ``endings`` (lower case) that end a word of the text, in any case of ASCII letters.

    One pass: at the end of a word a pattern looks back for the listed endings only.
    """
    branches: dict[str, list[str]] = {}
    for ending in sorted(endings):
        branches.setdefault(ending[0], []).append(ending[1:])
    listed = "|".join(_quote(head) + "(?:" + "|".join(map(_quote, rest)) + ")" for head, rest in branches.items())
    found = f"regexp_extract_all(coalesce({text}, ''), {q(rf'(?s)(?!\w)(?i)(?<=({listed}))')}, 1)"
    return f"array_distinct(transform({found}, e -> lower(e)))"


def synonym_scan(text: str, entries: list[tuple[int, str, str]]) -> str:
    """Hits of ``(ord, synonym, canonical)`` entries in order, one per canonical name.

    A plain substring test on the lower-cased text goes first, so a message
    pays for regular expressions only for synonyms it holds.  A synonym ends
    where a word of the text ends, so only those whose last characters end
    a word are looked for.
    """
    listed = []
    for i, synonym, canonical in entries:
        short = len(synonym) <= SHORT_SYNONYM
        pattern = "(?i)" + word(_quote(synonym))
        if not short:
            pattern += rf"|(?i){_quote(synonym)}(?=[\s,.]|\z)"
        listed.append({"ord": i, "syn": synonym, "canonical": canonical, "pattern": pattern, "short": short})
    kind = "array<struct<ord:int,syn:string,canonical:string,pattern:string,short:boolean>>"
    shorter = [entry for entry in listed if len(entry["syn"]) < ENDING]
    longer = [entry for entry in listed if len(entry["syn"]) >= ENDING]
    groups = by_ending([entry["syn"] for entry in longer])
    table = constant([[longer[n] for n in ns] for ns in groups.values()], f"array<{kind}>")
    near = f"transform({endings_in(text, groups)}, e -> get({table}, cast(array_position({words(groups)}, e) as int) - 1))"
    if not longer:
        near = f"cast(array() as array<{kind}>)"
    if shorter:
        # these stand as words of their own
        alone = q("(?i)" + word("|".join(_quote(entry["syn"]) for entry in shorter)))
        near = f"concat({near}, {where(f'{text} rlike {alone}', f'array({constant(shorter, kind)})')})"
    around = f"concat(substr(lt, greatest(p - {VETO_REACH}, 1), least({VETO_REACH}, p - 1)), substr(lt, p + length(s.syn), {VETO_REACH}))"
    veto = let(f"regexp_instr({text}, s.pattern)", "p", f"p > 0 AND NOT {around} rlike {q(SHORT_VETO)}")
    test = f"contains(lt, s.syn) AND if(s.short, {veto}, {text} rlike s.pattern)"
    first = "filter(hits, (h, i) -> array_position(transform(hits, x -> x.canonical), h.canonical) = i + 1)"
    out = (
        f"transform({first}, h -> named_struct('value', h.canonical, 'confidence', if(h.short, {SHORT_CONFIDENCE}D, {LONG_CONFIDENCE}D), "
        "'extractor_id', 'enhanced_synonym_match', 'ord', h.ord))"
    )
    # entries start with their place in the dictionary, which sorts the hits
    hits = f"array_sort(flatten(transform({near}, g -> filter(g, s -> {test}))))"
    return let(f"lower({text})", "lt", let(hits, "hits", out))


def shared_pieces(texts: list[str], least: int = 4) -> list[tuple[str, list[int]]]:
    """Pieces with the numbers of the texts that hold them, each text under one piece.

    The piece that most of the remaining texts hold comes first, the longest of
    these; a text that shares no piece of ``least`` characters is its own.
    """
    holders: dict[str, set[int]] = {}
    for n, text in enumerate(texts):
        for start in range(len(text)):
            for end in range(start + least, len(text) + 1):
                holders.setdefault(text[start:end], set()).add(n)
    left, out = set(range(len(texts))), []
    while left:
        piece, held = max(((p, h & left) for p, h in holders.items()), key=lambda e: (len(e[1]), len(e[0]), e[0]), default=("", set()))
        if len(held) < 2:
            return out + [(texts[n], [n]) for n in sorted(left)]
        out.append((piece, sorted(held)))
        left -= held
    return out


def specialty_synonyms(text: str, specialties=None) -> str:
    """Dictionary hits in dictionary order, one per canonical name."""
    return synonym_scan(text, [(i, s, c) for i, (s, c) in enumerate(sp.reverse_map(specialties).items())])


def taxonomy_tokens(text: str) -> str:
    """Distinct lower-case tokens of the shape of a taxonomy code."""
    shape = q("(?i)" + word("[0-9]{3,4}[a-z]{0,2}[0-9]{4,5}x"))
    return f"array_distinct(transform(regexp_extract_all({text}, {shape}, 0), m -> lower(m)))"


def specialty_codes(text: str, specialties=None) -> str:
    """Specialties named by taxonomy code, in dictionary order, 0.9."""
    table = rows("code:string,canonical:string,ord:int", [(c, n, i) for i, (c, n) in enumerate(sp.taxonomy_map(specialties).items())])
    hits = f"filter({table}, t -> array_contains(tk, t.code))"
    first = "filter(hs, (h, i) -> array_position(transform(hs, x -> x.canonical), h.canonical) = i + 1)"
    out = (
        f"transform({first}, h -> named_struct('value', h.canonical, 'confidence', 0.9D, "
        "'extractor_id', 'taxonomy_code_match', 'ord', h.ord))"
    )
    return let(taxonomy_tokens(text), "tk", f"if(size(tk) = 0, cast(array() as array<{_HIT}>), {let(hits, 'hs', out)})")


def specialty_phrases(text: str) -> str:
    """Distinct phrases that may name a specialty, in scan order.

    A phrase is cut from a run of words: up to the last word that starts with
    an ending, then from the first later word that holds it.
    """
    runs = f"regexp_extract_all({text}, {q(r'\w+(?:\s+\w+)*+')}, 0)"
    cut = []
    for ending in PHRASE_ENDINGS:
        lead = q(rf"(?is)^(.+\s{ending})")
        rest = q(rf"(?is)(\w*{ending}.*)$")
        both = let(
            f"regexp_extract(r, {lead}, 1)", "a",
            f"array(a, regexp_extract(substr(r, length(a) + 1), {rest}, 1))",
        )
        cut.append(where(f"contains(lt, '{ending}')", f"flatten(transform(filter(runs, r -> contains(lower(r), '{ending}')), r -> {both}))"))
    labelled = [
        where(f"contains(lt, '{label}')", f"regexp_extract_all({text}, {q(rf'(?i){label}[:\s]+([^,.\n]+)')}, 1)") for label in PHRASE_LABELS]
    phrases = f"transform(concat({', '.join(cut + labelled)}), p -> {strip('p')})"
    found = let(runs, "runs", f"array_distinct(filter({phrases}, p -> length(p) > 3))")
    return let(f"lower({text})", "lt", where(any_of("lt", PHRASE_ENDINGS + PHRASE_LABELS), found))


def fuzzy_confidence(score: str) -> str:
    return f"CASE WHEN {score} >= 90D THEN 0.8D WHEN {score} >= 85D THEN 0.7D ELSE 0.6D END"


def specialty_fuzzy(text: str, specialties=None, known: dict[str, tuple[str, float]] | None = None) -> str:
    """Phrases close to a canonical name: ratio of 80, else partial ratio of 85.

    ``known`` holds the lower-case phrases of the batch that match, with label
    and score (:func:`phrases.known_phrases`); without it every phrase is
    scored in its row.
    """
    if known is None:
        names = list(specialties or sp.SPECIALTIES)
        table = similarity.pattern_rows([(n, n.lower()) for n in names], FUZZY_PARTIAL)
        longest = max(map(len, names))
        best = (
            f"coalesce({similarity.best_ratio('lower(p)', table, FUZZY_RATIO, longest)}, "
            f"{similarity.best_partial_ratio('lower(p)', table, FUZZY_PARTIAL, longest)})"
        )
        hits = f"filter(transform({specialty_phrases(text)}, p -> {best}), b -> b IS NOT NULL)"
    else:
        table = rows("label:string,score:double", known.values())
        matched = f"filter(transform({specialty_phrases(text)}, p -> array_position({words(known)}, lower(p))), i -> i > 0)"
        hits = f"transform({matched}, i -> get({table}, cast(i as int) - 1))"
    # a text may hold very many phrases, but never more labels than the dictionary
    first = "transform(array_distinct(transform(hs, x -> x.label)), l -> get(filter(hs, x -> x.label = l), 0))"
    out = (
        f"transform({first}, (h, i) -> named_struct('value', h.label, "
        f"'confidence', {fuzzy_confidence('h.score')}, 'extractor_id', 'fuzzy_match', 'ord', i))"
    )
    return let(hits, "hs", out)


def specialty_exact(text: str, specialties=None) -> str:
    """Canonical names that occur as words, 0.8."""
    names = list(specialties or sp.SPECIALTIES)
    groups = by_ending([n.lower() for n in names])
    kind = "array<struct<ord:int,canonical:string,low:string,pattern:string>>"
    table = constant(
        [[{"ord": i, "canonical": names[i], "low": names[i].lower(), "pattern": "(?i)" + word(_quote(names[i]))} for i in ns] for ns in groups.values()],
        f"array<{kind}>")
    test = f"contains(lt, s.low) AND {text} rlike s.pattern"
    near = f"transform({endings_in(text, groups)}, e -> filter(get({table}, cast(array_position({words(groups)}, e) as int) - 1), s -> {test}))"
    out = (
        f"transform(array_sort(flatten({near})), h -> named_struct('value', h.canonical, 'confidence', 0.8D, "
        "'extractor_id', 'canonical_exact_match', 'ord', h.ord))"
    )
    return let(f"lower({text})", "lt", out)


def specialties_union(text: str, specialties=None, known=None) -> str:
    """All sources in order, the first hit per canonical name."""
    parts = ", ".join([
        specialty_synonyms(text, specialties), specialty_codes(text, specialties), specialty_fuzzy(text, specialties, known),
        specialty_exact(text, specialties),
    ])
    first = "filter(al, (h, i) -> array_position(transform(al, x -> x.value), h.value) = i + 1)"
    return let(f"concat({parts})", "al", first)


def first_specialty(text: str, specialties=None) -> str:
    """Value a record takes: the first hit of the first source that has one."""
    return "coalesce(" + ", ".join(
        f"get({f(text, specialties)}, 0).value"
        for f in (specialty_synonyms, specialty_codes, specialty_fuzzy, specialty_exact)
    ) + ")"


# --- lines of business, dates ----------------------------------------------

# Month names and word date patterns.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7,
    "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}
_MONTH = "|".join(MONTHS)
WORD_DATES = [
    (rf"(?:\d{{1,2}})\s+(?:{_MONTH})\s+(?:\d{{4}})", "dmy"),
    (rf"(?:{_MONTH})\s+(?:\d{{1,2}}),?\s+(?:\d{{4}})", "mdy"),
    (rf"(?:\d{{1,2}})(?:st|nd|rd|th)?\s+(?:{_MONTH})\s+(?:\d{{4}})", "dmy"),
    (rf"(?:{_MONTH})\s+(?:\d{{4}})", "my"),
]


def lines_of_business(text: str) -> str:
    """Canonical lines of business in gazetteer order, first seen once."""
    hits = ", ".join(
        f"if(contains(lb, {q(variant.lower())}) AND {text} rlike {q('(?i)' + word(variant))}, {q(names[0])}, cast(null as string))"
        for variant, names in LOB_GAZETTEER.items()
    )
    return let(f"lower({text})", "lb", f"array_distinct(filter(array({hits}), v -> v IS NOT NULL))")


def normalize_word_date(x: str, shape: str) -> str:
    """Matched word date to ``MM/DD/YYYY``; a missing day becomes 01."""
    numbers = mapping({m: f"{n:02d}" for m, n in MONTHS.items()})
    month = f"{numbers}[lower(regexp_extract({x}, '[A-Za-z]{{3,}}', 0))]"
    year = f"right({x}, 4)"
    if shape == "my":
        day = "'01'"
    elif shape == "dmy":
        day = f"lpad(regexp_extract({x}, '^[0-9]+', 0), 2, '0')"
    else:
        day = f"lpad(regexp_extract({x}, '^[A-Za-z]+[^0-9]+([0-9]+)', 1), 2, '0')"
    return f"concat({month}, '/', {day}, '/', {year})"


def _word_dates_likely(text: str) -> str:
    """Three letters that end a month name before a digit, which every pattern of a date in words holds."""
    ends = f"transform(regexp_extract_all({text}, '([A-Za-z]{{3}})\\\\s+[0-9]', 1), e -> lower(e))"
    return f"arrays_overlap({ends}, {words(sorted({m[-3:] for m in MONTHS}))})"


def word_dates(text: str) -> str:
    """Dates written with a month name, 0.7; overlapping patterns give several."""
    return when_likely(_word_dates_likely(text), text, "dated", _word_dates("dated"))


def _word_dates(text: str) -> str:
    arrays = []
    for i, (pattern, shape) in enumerate(WORD_DATES):
        made = candidate("date", normalize_word_date("m", shape), "0.7D", f"'date_fallback_{i}'", i, "j")
        arrays.append(f"transform(regexp_extract_all({text}, {q('(?i)' + pattern)}, 0), (m, j) -> {made})")
    return f"concat({', '.join(arrays)})"


# Words that tell what a date is for, and how many words around a date are read.
DATE_CUES = ["effective", "start", "begin", "term", "end", "finish", "expir"]
DATE_REACH = 10


def date_confidence(context: str) -> str:
    return f"if({any_of(f'lower({context})', DATE_CUES)}, 0.9D, 0.8D)"


def word_dates_in_context(text: str, reach: int = DATE_REACH) -> str:
    """Like :func:`word_dates`, 0.9 where a cue stands in the date or in the ``reach`` words before or after, else 0.8.

    Every date meets its nearest cue in one sweep over both.
    """
    return when_likely(_word_dates_likely(text), text, "dated", _word_dates_in_context("dated", reach))


def _word_dates_in_context(text: str, reach: int) -> str:
    found = []
    for i, (pattern, shape) in enumerate(WORD_DATES):
        made = f"named_struct('value', {normalize_word_date('m', shape)}, 'i', {i}, 'j', j, 'first', w, 'last', w + cast(regexp_count(m, {q(chr(92) + 's+')}) as int))"
        found.append(word_places(text, "(?i)" + pattern, made))
    cues = word_places(text, "(?i)" + "|".join(DATE_CUES), "w")
    confident = f"if(get(gaps, n) <= {reach}, 0.9D, 0.8D)"
    made = candidate("date", "d.value", confident, "concat('date_context_', d.i)", "d.i", "d.j")
    return let(f"concat({', '.join(found)})", "dates", let(nearest("dates", cues), "gaps", f"transform(dates, (d, n) -> {made})"))


# --- transaction type ------------------------------------------------------

def _rarer(piece: str) -> str:
    """A piece without the frequent characters it starts with: a search stops at every place of the first character."""
    return re.sub(r"^[ aeinorst]+(?=.{3})", "", piece)


def weighted_hits(low: str, weights: dict[str, list[tuple[str, float]]]) -> str:
    """Phrases a lower-cased text contains as ``(ord, kind, p, w)``, in the order of the lists by kind.

    Phrases that share a piece are looked for only in texts that hold it.
    """
    listed = [(kind, p, w) for kind, phrases in weights.items() for p, w in phrases]
    groups = []
    for piece, ns in shared_pieces([p for _, p, _ in listed]):
        # a phrase that shares nothing is its own piece
        alone = len(ns) == 1
        entries = [{"ord": n, "kind": listed[n][0], "p": "" if alone else listed[n][1], "w": listed[n][2]} for n in ns]
        groups.append({"piece": listed[ns[0]][1] if alone else _rarer(piece), "es": entries})
    table = constant(groups, "array<struct<piece:string,es:array<struct<ord:int,kind:string,p:string,w:double>>>>")
    return f"array_sort(flatten(transform(filter({table}, g -> contains({low}, g.piece)), g -> filter(g.es, e -> contains({low}, e.p)))))"


def weighted_sum(hits: str, kind: str) -> str:
    """Sum of the weights of :func:`weighted_hits` of one kind, in list order."""
    return f"aggregate(filter({hits}, e -> e.kind = {q(kind)}), 0D, (a, e) -> a + e.w)"


def transaction_scores(low: str) -> str:
    """Struct ``(add, upd, term, type, confidence)`` of the contextual score."""
    def score(kind):
        subjects = "".join(f" + if(lead rlike {q(p)}, 1.5D, 0D)" for p in TYPE_SUBJECTS[kind])
        return weighted_sum("wh", kind) + subjects

    scores = f"named_struct('add', {score('Add')}, 'upd', {score('Update')}, 'term', {score('Term')})"
    base = let(weighted_hits(low, TYPE_WEIGHTS), "wh", let(f"substr({low}, 1, 50)", "lead", scores))
    both = "b.add > 0 AND b.upd > 0"
    known = f"{both} AND {any_of(low, EXISTING_PROVIDER)}"
    first = f"{both} AND NOT {any_of(low, EXISTING_PROVIDER)} AND {any_of(low, FIRST_TIME_PROVIDER)}"
    moved = (
        f"named_struct('add', b.add + CASE WHEN {known} THEN -0.5D WHEN {first} THEN 1D ELSE 0D END, "
        f"'upd', b.upd + CASE WHEN {known} THEN 1D WHEN {first} THEN -0.5D ELSE 0D END, 'term', b.term)"
    )
    top = "greatest(a.add, a.upd, a.term)"
    kind = (
        f"CASE WHEN {top} <= 0 THEN cast(null as string) WHEN a.add = {top} THEN 'Add' "
        f"WHEN a.upd = {top} THEN 'Update' ELSE 'Term' END"
    )
    out = (
        f"named_struct('add', a.add, 'upd', a.upd, 'term', a.term, 'type', {kind}, "
        f"'confidence', if({top} > 0, least({top} / 3D, 0.9D), 0D))"
    )
    return let(base, "b", let(moved, "a", out))


def _answer(kind: str, confidence: str, extractor: str) -> str:
    return f"named_struct('value', {kind}, 'confidence', {confidence}, 'extractor_id', {extractor})"


def _around(low: str, w: str, p: str) -> str:
    return f"substr({low}, greatest({p} - 50, 1), {p} + length({w}) + 50 - greatest({p} - 50, 1))"


def _word_regex(w: str) -> str:
    return f"concat({q(EDGE_LEFT)}, {w}, {q(EDGE_RIGHT)})"


def transaction_type(text: str) -> str:
    """Five-step cascade: struct ``(value, confidence, extractor_id)`` or NULL."""
    explicit = "CASE " + " ".join(
        f"WHEN {any_of('low', phrases)} THEN {_answer(q(kind), '0.95D', q('transaction_explicit_' + kind.lower()))}"
        for kind, phrases in EXPLICIT_TYPE.items()
    ) + " END"
    scored = let(
        transaction_scores("low"), "sc",
        f"CASE WHEN sc.type IS NOT NULL AND sc.confidence > 0.6D THEN {_answer('sc.type', 'sc.confidence', q('transaction_contextual'))} END",
    )
    ended = (
        f"CASE WHEN low rlike {q(word(TERM_WORDS) + '|no longer')} "
        f"THEN {_answer(q('Term'), '0.9D', q('transaction_ner_term'))} END"
    )
    near = f"if({_around('low', 'uw', 'p')} rlike {q(CHANGE_WORDS)}, 0.85D, 0.7D)"
    changed = let(
        f"get(filter({words(UPDATE_WORDS)}, w -> contains(low, w) AND low rlike {_word_regex('w')}), 0)", "uw",
        let(
            f"regexp_instr(low, {_word_regex('uw')})", "p",
            f"CASE WHEN uw IS NOT NULL THEN {_answer(q('Update'), near, q('transaction_ner_update'))} END",
        ),
    )
    fresh = (
        f"get(transform(array(regexp_instr(low, {_word_regex('w')})), "
        f"p -> p > 0 AND NOT {_around('low', 'w', 'p')} rlike {q(UPDATE_NEAR_ADD)}), 0)"
    )
    added = (
        f"CASE WHEN exists({words(ADD_WORDS)}, w -> contains(low, w) AND {fresh}) "
        f"THEN {_answer(q('Add'), '0.8D', q('transaction_ner_add'))} END"
    )
    return let(f"lower({text})", "low", f"coalesce({explicit}, {scored}, {ended}, {changed}, {added})")
