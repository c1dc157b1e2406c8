"""Candidates to one record per provider block.

Each scan runs once over the message text and its block texts, and both meet in
``coalesce`` chains inside the message row.  Records are exploded last.  No
step shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import explode_rows
from ..functions import text as tx
from ..functions.sql import any_of, constant, let, q, strip
from ..vocab.business import EXTRACTOR_PRIORITY, OUTPUT_COLUMNS, SENTINEL
from ..vocab.headers import BLOCK_FIELDS
from ..vocab.transactions import (
    ADD_ATTRIBUTE_PHRASES, ATTRIBUTE_LABELS, ATTRIBUTE_OF_PHRASE, ATTRIBUTE_SUBJECTS, ATTRIBUTE_TIE_WORDS,
    ATTRIBUTE_VALUES, ATTRIBUTE_WEIGHTS, REASON_CONTEXTS, REASON_WORDS, SUBJECT_FACTOR, TERM_ATTRIBUTE_PHRASES,
    TERM_REASONS,
)
from . import entities, patterns, phrases, sections, tables


# --- transaction attribute -------------------------------------------------

def explicit_attribute(text: str) -> str:
    """Value of an ``attribute:`` label, mapped where known."""
    mapped = "CASE " + " ".join(f"WHEN contains(v, {q(k)}) THEN {q(a)}" for k, a in ATTRIBUTE_VALUES.items())
    mapped += f" WHEN length(v) < 50 THEN {tx.title_case('v')} END"
    labels = []
    for p in ATTRIBUTE_LABELS:
        value = strip(f"regexp_extract({text}, {q(p)}, 1)")
        labels.append(f"if({text} rlike {q(p)}, {let(value, 'v', mapped)}, cast(null as string))")
    return f"coalesce({', '.join(labels)})"


def attribute_scores(low: str) -> str:
    """Array of ``(score, attribute)`` in declared order for a lower-cased text."""
    def score(attribute):
        subjects = "".join(
            f" + if(lead rlike {q(p)}, {w * SUBJECT_FACTOR!r}D, 0D)" for p, w in ATTRIBUTE_SUBJECTS[attribute]
        )
        return entities.weighted_sum("wh", attribute) + subjects

    scores = "array(" + ", ".join(
        f"named_struct('score', {score(a)}, 'rank', {-i}, 'attribute', {q(a)})"
        for i, a in enumerate(ATTRIBUTE_WEIGHTS)
    ) + ")"
    return let(entities.weighted_hits(low, ATTRIBUTE_WEIGHTS), "wh", let(f"substr({low}, 1, 100)", "lead", scores))


def _tie_bonus(low: str, attribute: str) -> str:
    table = constant(ATTRIBUTE_TIE_WORDS, "map<string,array<string>>")
    return f"size(filter({table}[{attribute}], w -> contains({low}, w))) * 0.5D"


def context_attribute(low: str) -> str:
    """Best scoring attribute; close calls are settled by indicator words."""
    first, second = "get(ss, 0)", "get(ss, 1)"
    close = f"{second}.score > 0 AND abs({first}.score - {second}.score) < 1D"
    keeps = (
        f"{first}.score + {_tie_bonus(low, f'{first}.attribute')} >= "
        f"{second}.score + {_tie_bonus(low, f'{second}.attribute')}"
    )
    body = (
        f"CASE WHEN {first}.score <= 0 THEN 'Provider' WHEN {close} AND NOT ({keeps}) "
        f"THEN {second}.attribute ELSE {first}.attribute END"
    )
    return let(f"array_sort({attribute_scores(low)}, (x, y) -> CASE WHEN x.score > y.score THEN -1 "
               "WHEN x.score < y.score THEN 1 WHEN x.rank > y.rank THEN -1 ELSE 1 END)", "ss", body)


def transaction_attribute(kind: str, text: str) -> str:
    """Explicit label, else by type: listed phrases, context score, or not applicable."""
    def by_phrase(phrases):
        cases = " ".join(
            f"WHEN contains(low, {q(p)}) THEN {q(next(a for k, a in ATTRIBUTE_OF_PHRASE.items() if k in p))}"
            for p in phrases
        )
        return f"CASE {cases} ELSE 'Provider' END"

    body = (
        f"coalesce({explicit_attribute('low')}, CASE {kind} WHEN 'Term' THEN {by_phrase(TERM_ATTRIBUTE_PHRASES)} "
        f"WHEN 'Add' THEN {by_phrase(ADD_ATTRIBUTE_PHRASES)} WHEN 'Update' THEN {context_attribute('low')} "
        "ELSE 'Not Applicable' END)"
    )
    return let(f"lower({text})", "low", body)


# --- termination reason ----------------------------------------------------

def map_reason(reason: str) -> str:
    """Free reason text to a category, else title case; NULL for two characters or less."""
    cases = " ".join(f"WHEN {any_of('rs', ws)} THEN {q(label)}" for label, ws in REASON_WORDS.items())
    body = f"CASE {cases} WHEN length(rs) > 2 THEN {tx.title_case('rs')} END"
    return let(strip(f"lower({reason})"), "rs", body)


def term_reason(text: str) -> str:
    """First keyword group with a hit, else the first usable reason phrase; NULL if none."""
    groups = "CASE " + " ".join(f"WHEN {any_of('low', ws)} THEN {q(label)}" for label, ws in TERM_REASONS.items()) + " END"
    phrases = ", ".join(f"regexp_extract_all(low, {q(p)}, 1)" for p in REASON_CONTEXTS)
    free = f"get(filter(transform(concat({phrases}), m -> {map_reason('m')}), v -> v IS NOT NULL), 0)"
    return let(f"lower({text})", "low", f"coalesce({groups}, {free})")


# --- records ---------------------------------------------------------------

def prepare(messages: DataFrame, compat: bool = False) -> DataFrame:
    """Messages with readable text: adds ``text`` and ``thread_trimmed``.

    Input columns: ``msg_id``, ``text_content``, ``html_content`` (nullable).
    """
    normal = tx.normalize_message("coalesce(text_content, '')", "coalesce(html_content, '')", compat)
    return (
        messages.withColumn("_norm", F.expr(normal))
        .select("msg_id", "text_content", "html_content", F.col("_norm.text").alias("text"),
                F.col("_norm.trimmed").alias("thread_trimmed"))
    )


def _best_date(text: str) -> str:
    """Most confident date of the numeric scan and of the word dates in their context, the first on ties.

    The confidences settle the order: a labelled numeric date, a date in words, any numeric date.
    """
    best = "array_max(transform(ds, (d, i) -> named_struct('confidence', d.confidence, 'ord', -i, 'value', d.value))).value"
    in_words = let(entities.word_dates_in_context(text), "ds", best)
    *labelled, plain = range(len(patterns.DATE))
    return f"coalesce({patterns.first_value(text, 'date', labelled)}, {in_words}, {patterns.first_value(text, 'date', [plain])})"


def _scan(field: str, text: str, compat: bool, specialties=None) -> str:
    """Value of a field scan of one text."""
    if field == "name":
        return f"get({entities.provider_names(text, compat)}, 0).value"
    if field == "npi":
        return patterns.first_values(text, "npi", 2)
    if field == "specialty":
        return entities.first_specialty(text, specialties)
    if field == "org":
        return f"{entities.organization(text)}.value"
    if field == "lob":
        return f"nullif(array_join({entities.lines_of_business(text)}, ', '), '')"
    if field == "reason":
        return term_reason(text)
    if field == "word_date":
        return f"get({entities.word_dates(text)}, 0).value"
    return patterns.first_value(text, field)


def message_values(prepared: DataFrame, gap: int = 2, compat: bool = False, specialties=None) -> DataFrame:
    """One row per message with its text, blocks, table cells and message-wide values.

    ``whole`` holds the scanned values of the message text but its specialty.
    """
    found = prepared.select("msg_id", "text", "text_content", "html_content", F.expr(sections.blocks_or_default("text", gap)).alias("blocks"))
    typed = found.select(
        "msg_id", "text", "text_content", "html_content", "blocks",
        F.expr("size(blocks) = 1 AND get(blocks, 0).text = text").alias("one_block"),
        F.expr(f"{entities.transaction_type('text')}.value").alias("m_type"),
        F.expr(_best_date("text")).alias("m_date"),
    )
    scans = {f: _scan(f, "scan_text", compat) for f in ("name", "npi", "tin", "ppg", "phone", "fax", "license", "org", "lob")}
    scans["reason"] = f"if(is_term, {_scan('reason', 'scan_text', compat)}, cast(null as string))"
    # a let keeps the struct from being taken apart and written once per use
    whole = let("text", "scan_text", let("coalesce(m_type, '') = 'Term'", "is_term", f"named_struct({', '.join(f'{q(k)}, {v}' for k, v in scans.items())})"))
    return typed.select(
        "msg_id", "text", "blocks", "one_block", "m_type", "m_date",
        F.expr(whole).alias("whole"),
        F.expr(tables.cells_of_message("text", "html_content")).alias("cells"),
        F.expr(transaction_attribute("coalesce(m_type, '')", "concat(coalesce(text_content, ''), '\\n', text)")).alias("m_attribute"),
    )


def resolve(values: DataFrame, compat: bool = False, specialties=None) -> DataFrame:
    """One record per block by source precedence; missing values are NULL.

    Records are built inside the message row and only they are exploded: no
    text, cell or message-wide value is copied to the blocks.  A block is
    scanned for a field only where no source before it has a value; the
    message text is scanned for a specialty only where a block lacks one.
    """
    def cell(field, n=0):
        source = "own" if field in BLOCK_FIELDS else "msg.wide"
        return f"get(filter({source}, c -> c.field = '{field}'), {n}).value"

    def scan(field):
        # a block that is the whole text has the scans of the message
        return f"if(msg.one_block, cast(null as string), {_scan(field, 'bt', compat, specialties)})"

    is_term = "coalesce(msg.kind, '') = 'Term'"
    # the message was scanned for dates in words already
    date_sources = f"coalesce(msg.best_date, {_scan('word_date', 'bt', compat)})"
    # a table effective date counts as a source unless compat
    table_effective = "cast(null as string)" if compat else cell("effective_date")
    known = f"coalesce({cell('term_date')}, {table_effective})"
    dated = f"if({known} IS NULL, {date_sources}, cast(null as string))"
    exprs = {
        "transaction_type": "msg.kind",
        "transaction_attribute": "msg.attribute",
        "effective_date": f"coalesce({table_effective}, if({is_term}, cast(null as string), dated))",
        "term_date": f"coalesce({cell('term_date')}, if({is_term}, dated, cast(null as string)))",
        "term_reason": f"CASE WHEN {is_term} THEN coalesce(whole.reason, {cell('term_reason')}, {scan('reason')}) END",
        "provider_name": f"coalesce({cell('provider_name')}, {scan('name')}, whole.name)",
        "provider_npi": f"coalesce({cell('npi')}, get(whole.npi, 0), get(npis, 0))",
        "provider_specialty": f"coalesce({cell('specialty')}, {_scan('specialty', 'bt', compat, specialties)})",
        "state_license": f"coalesce({scan('license')}, whole.license, {cell('license')})",
        "organization_name": f"coalesce(whole.org, {scan('org')}, {cell('organization')})",
        "tin": f"coalesce(whole.tin, {cell('tin')}, {scan('tin')})",
        "group_npi": f"coalesce({cell('npi', 1)}, get(whole.npi, 1), get(npis, 1))",
        "complete_address": cell("address"),
        "phone_number": f"coalesce({scan('phone')}, whole.phone)",
        "fax_number": f"coalesce({cell('fax')}, {scan('fax')}, whole.fax)",
        "ppg_id": f"coalesce(whole.ppg, {cell('ppg')}, {scan('ppg')})",
        "line_of_business": f"coalesce(whole.lob, {scan('lob')})",
    }
    record = "named_struct(" + ", ".join(f"'{c}', {exprs[c]}" for c in OUTPUT_COLUMNS) + ")"
    npis = f"if(msg.one_block OR size(whole.npi) >= 2, cast(array() as array<string>), {_scan('npi', 'bt', compat)})"
    of_block = let("b.text", "bt", let(tables.in_block("msg.own", "bt"), "own", let(npis, "npis", let(dated, "dated", record))))
    own = ", ".join(q(f) for f in BLOCK_FIELDS)
    message = (
        "named_struct('kind', m_type, 'attribute', m_attribute, 'best_date', m_date, 'one_block', one_block, "
        f"'own', filter(cs, c -> c.field IN ({own})), 'wide', filter(cs, c -> c.field NOT IN ({own})))"
    )
    built = let("cells", "cs", let(message, "msg", f"transform(blocks, b -> {of_block})"))
    lacking = "NOT one_block AND exists(rs, r -> r.provider_specialty IS NULL)"
    found = values.select("msg_id", "text", "one_block", F.expr(built).alias("rs")).select(
        "msg_id", "rs", F.expr(f"if({lacking}, {entities.first_specialty('text', specialties)}, cast(null as string))").alias("m_specialty"))
    specialty = F.coalesce("r.provider_specialty", "m_specialty").alias("provider_specialty")
    return found.transform(explode_rows, ["msg_id", "m_specialty"], "rs", "block_id", "r").select(
        "msg_id", "block_id", *[specialty if c == "provider_specialty" else f"r.{c}" for c in OUTPUT_COLUMNS])


def with_sentinel(records: DataFrame, sentinel: str = SENTINEL) -> DataFrame:
    """Missing output values as the sentinel text."""
    return records.withColumns({c: F.coalesce(F.col(c), F.lit(sentinel)) for c in OUTPUT_COLUMNS})


def extract(messages: DataFrame, gap: int = 2, compat: bool = False, checksum: str = "standard",
            specialties=None) -> DataFrame:
    """Messages to raw records, sentinel filled in."""
    prepared = prepare(messages, compat)
    return with_sentinel(message_values(prepared, gap, compat, specialties).transform(resolve, compat, specialties))


# --- long candidate table --------------------------------------------------

def all_scans(text: str, compat: bool, checksum: str, specialties=None, known=None) -> str:
    """Candidates of every extractor family of one text but tables."""
    parts = [patterns.scan(text, f, checksum) for f in patterns.FIELDS]
    parts.append(entities.provider_names(text, compat))
    parts.append(entities.word_dates(text))
    lob = patterns.candidate("line_of_business", "v", "0.9D", q("lob_gazetteer"), 0, "i")
    parts.append(f"transform({entities.lines_of_business(text)}, (v, i) -> {lob})")
    org = patterns.candidate("organization", "o.value", "o.confidence", q("pattern_org_extended"), 0, "j")
    parts.append(f"transform({entities.found_organizations(text)}, (o, j) -> {org})")
    named = patterns.candidate("specialty", "s.value", "s.confidence", "s.extractor_id", 0, "j")
    parts.append(f"transform({entities.specialties_union(text, specialties, known)}, (s, j) -> {named})")
    kind = patterns.candidate("transaction_type", "t.value", "t.confidence", "t.extractor_id", 0)
    parts.append(f"transform(filter(array({entities.transaction_type(text)}), t -> t IS NOT NULL), t -> {kind})")
    return f"concat({', '.join(parts)})"


def _scan_texts(prepared: DataFrame, gap: int) -> DataFrame:
    """Messages with ``blocks`` and ``scan_texts``: the text, then its block texts unless the whole text is the only block."""
    own = "if(size(blocks) = 1 AND get(blocks, 0).text = text, cast(array() as array<string>), transform(blocks, b -> b.text))"
    found = prepared.select("msg_id", "text", "html_content", F.expr(sections.blocks_or_default("text", gap)).alias("blocks"))
    return found.select("msg_id", "text", "html_content", "blocks", F.expr(f"concat(array(text), {own})").alias("scan_texts"))


def known_phrases(prepared: DataFrame, gap: int = 2, specialties=None) -> dict | None:
    """Matched specialty phrases of the messages and their blocks, each distinct phrase scored once (a job of its own).

    For ``known`` of the candidate functions, which give the same rows without it, slower.
    """
    texts = _scan_texts(prepared, gap).transform(explode_rows, [], "scan_texts", "text")
    return phrases.known_phrases(texts, specialties)


def scanned_candidates(prepared: DataFrame, gap: int = 2, compat: bool = False, checksum: str = "standard", specialties=None, known=None) -> DataFrame:
    """``msg_id`` and ``es``: candidates of the message, table and block scopes as ``(block_id, scope, c)``.

    The scans are written once, over the message text and its block texts; a
    default block, which is the whole text, takes the scan of the message.
    """
    fields = "struct(c.field, c.value, c.confidence, c.extractor_id, c.pattern_ord, c.match_ord, c.validation_passed)"

    def tagged(array, scope, block):
        return f"transform({array}, c -> named_struct('block_id', {block}, 'scope', '{scope}', 'c', {fields}))"

    scans = f"transform(scan_texts, scan_text -> {all_scans('scan_text', compat, checksum, specialties, known)})"
    full = tagged("get(scans, 0)", "full", "cast(null as int)")
    cells = tagged("cells", "table", "cast(null as int)")
    in_blocks = tagged("get(scans, if(size(scans) = 1, 0, bi + 1))", "block", "bi")
    return (
        _scan_texts(prepared, gap)
        .select("msg_id", F.expr("size(blocks)").alias("n_blocks"), F.expr(scans).alias("scans"),
                F.expr(tables.message_table_candidates("text", "html_content")).alias("cells"))
        .select("msg_id", F.expr(f"concat({full}, {cells}, flatten(transform(sequence(0, n_blocks - 1), bi -> {in_blocks})))").alias("es"))
    )


def candidates(prepared: DataFrame, gap: int = 2, compat: bool = False, checksum: str = "standard", specialties=None, known=None) -> DataFrame:
    """Provenance table: every candidate of the message, block and table scopes.

    A message without provider blocks is its own block 0.  Columns: msg_id, block_id (NULL for message and table scope), scope, field,
    value, confidence, extractor_id, pattern_ord, match_ord, validation_passed.
    """
    found = scanned_candidates(prepared, gap, compat, checksum, specialties, known)
    return found.transform(explode_rows, ["msg_id"], "es", "e").select("msg_id", "e.block_id", "e.scope", "e.c.*")


def ranked_candidates(
        prepared: DataFrame, gap: int = 2, compat: bool = False, checksum: str = "standard", known=None, rank_by: str = "priority") -> DataFrame:
    """Best candidate per message and field: declared priority of its extractor family (0 when undeclared), confidence, then scan order.

    ``rank_by="confidence"`` lets the confidence decide before the priority.
    The best is picked inside the message row, without a shuffle.
    """
    if rank_by not in ("priority", "confidence"):
        raise ValueError(f"rank_by must be 'priority' or 'confidence', not {rank_by!r}")
    priority = " ".join(f"WHEN startswith(e.c.extractor_id, {q(prefix)}) THEN {n}" for prefix, n in EXTRACTOR_PRIORITY.items())
    first = [f"'priority', CASE {priority} ELSE 0 END", "'confidence', e.c.confidence"]
    key = (
        f"named_struct({', '.join(first if rank_by == 'priority' else first[::-1])}, "
        "'scope', CASE e.scope WHEN 'table' THEN 0 WHEN 'full' THEN -1 ELSE -2 END, 'block', -coalesce(e.block_id, -1), "
        "'pattern', -e.c.pattern_ord, 'match', -e.c.match_ord, 'extractor_id', e.c.extractor_id, 'value', e.c.value)"
    )
    keyed = f"transform(es, e -> named_struct('field', e.c.field, 'k', {key}))"
    best = "transform(array_distinct(ks.field), f -> named_struct('field', f, 'k', array_max(filter(ks, x -> x.field = f).k)))"
    found = scanned_candidates(prepared, gap, compat, checksum, known=known)
    return found.transform(explode_rows, ["msg_id"], let(keyed, "ks", best), "r").select(
        "msg_id", "r.field", "r.k.value", "r.k.priority", "r.k.confidence", "r.k.extractor_id")
