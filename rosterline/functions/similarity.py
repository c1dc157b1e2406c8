"""Character similarity (0-100) from the longest common subsequence.

``ratio(a, b) = 200 * lcs(a, b) / (len(a) + len(b))``.  The pattern side is a
fixed phrase.  Up to 62 characters one BIGINT holds its matching state and a
comparison costs one step per character of the other side; longer phrases keep
an array of places instead.  Both count the same subsequence.
"""

from __future__ import annotations

from .sql import let, part, rows

#: longest phrase whose matching state is one BIGINT
WORD = 62


def _pieces(text: str, threshold: float) -> list[str]:
    """Pieces of a phrase of which one stays whole in any window at the threshold.

    A window is as long as the phrase, or shorter at the ends of the text.  At
    the threshold the characters that either side lacks are at most ``(1 - t)``
    of both lengths, so that many edits cannot touch every piece.
    """
    n = int(2 * (1 - threshold / 100) * len(text) + 1e-9) + 1
    return [text[i * len(text) // n:(i + 1) * len(text) // n] for i in range(n)]


def pattern_rows(entries: list[tuple[str, str]], partial: float = 85.0) -> str:
    """Array of ``(label, text, len, full, masks, pieces, ord)`` for fixed ``(label, phrase)`` pairs.

    ``masks`` maps a character to the bits of its places in a phrase of at most
    62 characters; ``pieces`` serve :func:`best_partial_ratio` at the threshold ``partial``.
    """
    out = []
    for ord_, (label, text) in enumerate(entries):
        masks: dict[str, int] = {}
        bits = text if len(text) <= WORD else ""
        for i, c in enumerate(bits):
            masks[c] = masks.get(c, 0) | (1 << i)
        out.append((label, text, len(text), (1 << len(bits)) - 1, masks, _pieces(text, partial), ord_))
    ddl = "label:string,text:string,len:int,full:bigint,masks:map<string,bigint>,pieces:array<string>,ord:int"
    return rows(ddl, out)


def full_bits(text: str) -> str:
    """``full`` of :func:`pattern_rows` for a text column."""
    return f"if(length({text}) <= {WORD}, shiftleft(1L, length({text})) - 1L, 0L)"


def letter_masks(text: str) -> str:
    """``masks`` of :func:`pattern_rows` for a text column."""
    bits = "aggregate(sequence(0, size(cs) - 1), 0L, (a, i) -> if(get(cs, i) = c, a | shiftleft(1L, i), a))"
    masks = let(f"split({text}, '')", "cs", f"map_from_entries(transform(array_distinct(cs), c -> struct(c, {bits})))")
    return f"if(length({text}) <= {WORD}, {masks}, cast(map() as map<string,bigint>))"


def whole_pieces(text: str, threshold: float) -> str:
    """``pieces`` of :func:`pattern_rows` for a text column."""
    n = f"cast({2 * (1 - threshold / 100)!r}D * length({text}) + 1e-9D as int) + 1"
    piece = f"substr({text}, (i * length({text}) div n) + 1, ((i + 1) * length({text}) div n) - (i * length({text}) div n))"
    return let(n, "n", f"transform(sequence(0, n - 1), i -> {piece})")


def subsequence_length(chars: str, text: str) -> str:
    """LCS length of a character array and a text of any length.

    Element k of the state is the first place of the text at which a common
    subsequence of k + 1 characters can end.
    """
    place = f"least(get(s, k), nullif(locate(c, {text}, coalesce(get(s, k - 1), 0) + 1), 0))"
    step = f"if(c = '', s, filter(transform(sequence(0, size(s)), k -> {place}), x -> x IS NOT NULL))"
    return f"size(aggregate({chars}, cast(array() as array<int>), (s, c) -> {step}))"


def lcs_length(chars: str, pattern: str, longest: int = WORD) -> str:
    """LCS length of a character array and one element of :func:`pattern_rows`.

    Clear bits of the state mark matched places of the pattern.
    """
    hit = f"(s & coalesce({pattern}.masks[c], 0L))"
    step = f"((s + {hit}) | (s - {hit})) & {pattern}.full"
    bits = f"{pattern}.len - bit_count(aggregate({chars}, {pattern}.full, (s, c) -> {step}))"
    return bits if longest <= WORD else f"if({pattern}.len <= {WORD}, {bits}, {subsequence_length(chars, f'{pattern}.text')})"


def ratio(chars: str, pattern: str, longest: int = WORD) -> str:
    """Similarity of a character array and one element of :func:`pattern_rows`."""
    return f"200D * ({lcs_length(chars, pattern, longest)}) / (size({chars}) + {pattern}.len)"


def best_ratio(text: str, patterns: str, threshold: float, longest: int = WORD) -> str:
    """Struct ``(score, label)`` of the most similar phrase, NULL below the threshold.

    ``longest`` is the length of the longest phrase, if that is over 62.
    Equal scores go to the earlier phrase.  The built-in edit distance never
    exceeds the distance behind the ratio, hence it may discard phrases first.
    """
    limit = 1 - threshold / 100
    near = (
        f"filter({patterns}, p -> abs(length(h) - p.len) <= {limit!r}D * (length(h) + p.len) + 1e-9D "
        f"AND levenshtein(h, p.text) <= {limit!r}D * (length(h) + p.len) + 1e-9D)"
    )
    scored = f"transform({near}, p -> named_struct('score', {ratio('cs', 'p', longest)}, 'rank', -p.ord, 'label', p.label))"
    best = f"array_max(filter({scored}, r -> r.score >= {threshold!r}D))"
    return let(text, "h", let("split(h, '')", "cs", best))


#: least number of window starts one chunk covers
_CHUNK = 40


def _chunks(cs: str, stride: int) -> str:
    """Overlapping pieces of a text, each two strides long: ``(first, size, text)``."""
    piece = let(
        part(cs, "b", f"least(b + {2 * stride} - 1, size({cs}) - 1)"), "pc",
        "named_struct('first', b = 0, 'size', size(pc), 'text', array_join(pc, ''))",
    )
    return f"transform(sequence(0, size({cs}) - 1, {stride}), b -> {piece})"


def _windows(pattern: str, threshold: float, stride: int, longest: int) -> str:
    """Best similarity of the whole pattern with the windows of the chunks ``ch``.

    A chunk that lacks every piece of the pattern, or is too far from it
    (built-in edit distance), cannot hold a window above the threshold.
    """
    limit = repr(1 - threshold / 100)
    window = f"substr(c.text, greatest(o, 0) + 1, least(o + {pattern}.len, c.size) - greatest(o, 0))"
    score = (
        f"if(levenshtein(w, {pattern}.text) <= {limit}D * (length(w) + {pattern}.len) + 1e-9D, "
        f"{let('split(w, ' + chr(39) * 2 + ')', 'wc', ratio('wc', pattern, longest))}, 0D)"
    )
    near = (
        f"filter(ch, c -> exists({pattern}.pieces, e -> contains(c.text, e)) "
        f"AND levenshtein(c.text, {pattern}.text) <= {_edit_bound('c.size', pattern, threshold)})"
    )
    starts = f"sequence(if(c.first, 1 - {pattern}.len, 0), least({stride}, c.size) - 1)"
    scores = f"flatten(transform({near}, c -> transform({starts}, o -> {let(window, 'w', score)})))"
    return f"coalesce(array_max({scores}), 0D)"


def _edit_bound(length: str, pattern: str, threshold: float) -> str:
    """Most edits between a text and a pattern if one window reaches the threshold.

    A window of the shorter side (length n) at the threshold has a common
    subsequence of ``t / (2 - t) * n`` or more characters, and two texts with a
    common subsequence of length c are at most ``a + b - 2c`` edits apart.
    """
    t = threshold / 100
    share = 2 * t / (2 - t)
    return f"{length} + {pattern}.len - {share!r}D * least({length}, {pattern}.len) + 1e-9D"


def _pattern_windows(cs: str, pattern: str, longest: int) -> str:
    """Best similarity of a whole short text with the windows of a longer pattern."""
    hit = f"(s & coalesce({pattern}.masks[c], 0L) & w)"
    step = f"((s + {hit}) | (s - {hit})) & w"
    bits = f"bit_count(w) - bit_count(aggregate({cs}, w, (s, c) -> {step}))"
    window = (
        f"(shiftleft(1L, least(o + size({cs}), {pattern}.len)) - 1L) & ~(shiftleft(1L, greatest(o, 0)) - 1L)"
    )
    score = let(window, "w", f"200D * ({bits}) / (size({cs}) + bit_count(w))")
    if longest > WORD:
        cut = f"substr({pattern}.text, greatest(o, 0) + 1, least(o + size({cs}), {pattern}.len) - greatest(o, 0))"
        plain = let(cut, "w", f"200D * ({subsequence_length(cs, 'w')}) / (size({cs}) + length(w))")
        score = f"if({pattern}.len <= {WORD}, {score}, {plain})"
    return f"array_max(transform(sequence(1 - size({cs}), {pattern}.len - 1), o -> {score}))"


def best_partial_ratio(text: str, patterns: str, threshold: float, longest: int = _CHUNK) -> str:
    """Like :func:`best_ratio`, for the best window of the longer side.

    Sound pre-filters keep the exact windows few: letters of the phrase that
    the text lacks, whole pieces, and the built-in edit distance.
    ``longest`` is the length of the longest phrase; ``patterns`` must come
    from :func:`pattern_rows` with this threshold or a lower one as ``partial``.
    """
    stride = max(_CHUNK, longest)
    # a window at the threshold shares t / (2 - t) of the phrase's letters or more
    lacking = 1 - threshold / (200 - threshold)
    near = f"filter({patterns}, p -> size(cs) < p.len OR length(translate(p.text, h, '')) <= {lacking!r}D * p.len + 1e-9D)"
    inner = (
        f"if(exists(hp, e -> contains(p.text, e)) AND levenshtein(h, p.text) <= {_edit_bound('size(cs)', 'p', threshold)}, "
        f"{_pattern_windows('cs', 'p', longest)}, 0D)"
    )
    score = (
        f"greatest(if(size(cs) >= p.len, {_windows('p', threshold, stride, longest)}, 0D), "
        f"if(size(cs) <= p.len, {inner}, 0D))"
    )
    scored = f"transform({near}, p -> named_struct('score', {score}, 'rank', -p.ord, 'label', p.label))"
    best = f"array_max(filter({scored}, r -> r.score >= {threshold!r}D))"
    return let(text, "h", let("split(h, '')", "cs", let(_chunks("cs", stride), "ch", let(whole_pieces("h", threshold), "hp", best))))
