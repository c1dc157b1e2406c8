"""Synonyms of a dictionary table in texts, for dictionaries of any size.

A few hundred synonyms become a constant of the plan.  More are sent as an
automaton (a trie with failure links) that reads each text once whatever the
number of synonyms.  Larger dictionaries are joined: texts are read once too,
and give the pieces that may be synonyms.  All ways give the same rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import explode_rows
from . import entities

# Executors get the scans by value; they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: synonyms that become a constant of the plan, and synonyms (of at most so many characters) of one automaton
CONSTANT, SHARD, SHARD_CHARS = 300, 200_000, 8_000_000
#: bits a synonym of the filter of a larger dictionary, at least and at most so many in all (as powers of two), and of one page of it
FILTER_BITS, FILTER_LEAST, FILTER_MOST, FILTER_PAGE = 16, 16, 29, 16
#: characters of texts that are searched at once
_CHUNK = 500_000

_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_SHORT, _REACH, _VETO = entities.SHORT_SYNONYM, entities.VETO_REACH, entities.SHORT_VETO.split("|")
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
_ENDS = frozenset(" \t\n\x0b\f\r,.")


def _lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_ASCII_LOWER)


def _vetoed(text: str, first: int, size: int) -> bool:
    """A veto word stands near a short synonym."""
    lower = text.lower()
    near = lower[max(first - _REACH, 0):first][:_REACH] + lower[first + size:first + size + _REACH]
    return any(w in near for w in _VETO)


def scan_text(text: str, automaton) -> list[int]:
    """Places in the dictionary of all synonyms that a text holds, by the rules of :func:`entities.synonym_scan`.

    A synonym counts between word edges, or before white space, a comma, a full
    stop or the end.  A short one counts by its first place between word edges,
    and only if no veto word is near.
    """
    low = _lower(text)
    found: set[int] = set()
    settled: set[int] = set()  # short synonyms whose first place was seen
    for last, (place, size) in automaton.iter(low):
        if place in found or place in settled:
            continue
        first, after = last - size + 1, last + 1
        edges = (first == 0 or low[first - 1] not in _WORD) and (after == len(low) or low[after] not in _WORD)
        if size > _SHORT:
            if edges or after == len(low) or low[after] in _ENDS:
                found.add(place)
        elif edges:
            settled.add(place)
            if not _vetoed(text, first, size):
                found.add(place)
    return sorted(found)


def _scanner(words):
    """Iterator function over batches of texts; one automaton per task."""
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for place, synonym in words.value:
            automaton.add_word(synonym, (place, len(synonym)))
        automaton.make_automaton()
        for texts in batches:
            yield texts.map(lambda t: [] if t is None else scan_text(t, automaton))

    return scan


# --- dictionaries beyond one automaton --------------------------------------

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, size: int) -> np.ndarray:
    """The first ``size`` powers of an odd number modulo 2 ** 64; kept for the next batch."""
    if base not in _POWERS or len(_POWERS[base]) < size:
        factors = np.full(max(size, 1), base, dtype=np.uint64)
        factors[0] = 1
        _POWERS[base] = np.cumprod(factors, dtype=np.uint64)
    return _POWERS[base][:size]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _hasher(codes: np.ndarray):
    """Function from starts and ends to 64-bit hashes of these pieces of a text; each costs the same, however long."""
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(codes)), out=sums[1:])
    shifts = _powers(pow(_BASE, -1, 1 << 64), len(codes) + 1)

    def hashes(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (sums[ends] - sums[starts]) * shifts[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    return hashes


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash in a filter of ``2 ** bits`` bits."""
    return hashes >> np.uint64(64 - bits), (hashes * np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - bits)


def _filter(dictionary: DataFrame, size: int):
    """Bits of the hashes of all synonyms, made page by page: two bytes a synonym, never more than 64 MB."""
    bits = min(max(FILTER_LEAST, (FILTER_BITS * size - 1).bit_length()), FILTER_MOST)
    page = 1 << FILTER_PAGE

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ends = np.cumsum(batch["synonym"].str.len().to_numpy(dtype=np.int64))
            hashes = _hasher(_codes("".join(batch["synonym"])))(np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)
            at = np.unique(np.concatenate(_places(hashes, bits))).astype(np.int64)
            yield pd.DataFrame({"page": at // page, "at": at % page})

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(page, dtype=bool)
        held[rows["at"].to_numpy()] = True
        return pd.DataFrame({"page": [key[0]], "bits": [np.packbits(held, bitorder="little").tobytes()]})

    pages = dictionary.select("synonym").mapInPandas(places, "page long, at long").groupBy("page").applyInPandas(packed, "page long, bits binary")
    whole = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in pages.toLocalIterator():
        whole[r["page"] * page // 8:(r["page"] + 1) * page // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return bits, whole


def _class(low: np.ndarray, chars: frozenset) -> np.ndarray:
    table = np.zeros(128, dtype=bool)
    table[[ord(c) for c in chars]] = True
    return table[np.minimum(low, 127)] & (low < 128)


def likely_synonyms(texts: list[str], sizes: list[int], bits: int, held: np.ndarray) -> list[list[str]]:
    """Pieces of texts that stand where a synonym may stand by the rules of :func:`scan_text` and that the filter holds.

    No synonym is missed; a piece that is none is dropped by the join with the dictionary.
    """
    lows = [_lower(t) for t in texts]
    low = "".join(lows)
    codes, lengths = _codes(low), np.array([len(t) for t in lows], dtype=np.int64)
    past = np.cumsum(lengths)
    begins = past - lengths
    last = np.zeros(len(codes) + 1, dtype=bool)
    last[past] = True
    first = np.zeros(len(codes) + 1, dtype=bool)
    first[begins] = True
    word, closing = np.append(_class(codes, _WORD), False), np.append(_class(codes, _ENDS), False)
    left = first | ~np.concatenate([[False], word[:-1]])
    # a text's end is the next one's begin: the place past a text counts as its end
    ends = np.flatnonzero(last[1:] | ~word[1:]) + 1
    owner = np.searchsorted(past, ends)
    closed = last[ends] | closing[ends]
    begin, hashes = begins[owner], _hasher(codes)
    found = []
    for size in sizes:
        start = ends - size
        fits = np.flatnonzero(start >= begin)
        fits = fits[left[start[fits]] | (closed[fits] if size > _SHORT else False)]
        one, two = _places(hashes(start[fits], ends[fits]), bits)
        kept = (held[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8)) & 1
        fits, two = fits[kept == 1], two[kept == 1]
        kept = (held[two >> np.uint64(3)] >> (two & np.uint64(7)).astype(np.uint8)) & 1
        fits = fits[kept == 1]
        found.append((owner[fits], start[fits], ends[fits]))
    out: list[dict] = [{} for _ in texts]
    # a short synonym counts by its first place: places of one size come in order
    for owners, starts, stops in found:
        for n, a, b in zip(owners.tolist(), starts.tolist(), stops.tolist()):
            out[n].setdefault(low[a:b], a)
    return [
        [s for s, a in pieces.items() if len(s) > _SHORT or not _vetoed(texts[n], a - int(begins[n]), len(s))]
        for n, pieces in enumerate(out)
    ]


def _searcher(sizes: list[int], bits: int, filter_):
    """Iterator function over batches of texts, searched some at a time."""
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = filter_.value
        for texts in batches:
            out: list[list[str]] = []
            some: list[str] = []
            chars = 0
            for text in texts:
                some.append(text or "")
                chars += len(some[-1])
                if chars >= _CHUNK:
                    out += likely_synonyms(some, sizes, bits, held)
                    some, chars = [], 0
            yield pd.Series(out + likely_synonyms(some, sizes, bits, held))

    return search


def synonym_hits(texts: DataFrame, keep: list[str], dictionary: DataFrame, text: str = "text", constant: int = CONSTANT, shard: int = SHARD) -> DataFrame:
    """The canonical names that texts hold synonyms of, one row per text and name.

    ``dictionary`` is a table of :func:`rosterline.sources.dictionaries.synonym_table`
    (each synonym once).  Columns: ``keep``, ``row_id`` (one per input row, so
    that rows of equal keys stay apart), ``value`` (canonical name),
    ``confidence``, ``extractor_id``, ``ord`` (first place of the name's
    synonyms in the dictionary).

    The dictionary is counted and decides the way: up to ``constant`` synonyms
    are folded into the plan; up to ``shard`` synonyms and eight million
    characters are broadcast as an automaton.  Beyond, every text is read once
    for pieces of the synonyms' lengths that a filter of hashes (at most 64 MB)
    lets through, and these are joined with the dictionary, which stays
    distributed.  Null and empty texts hold nothing; an empty dictionary gives
    no rows; synonyms of any length and script are allowed.
    """
    spark = texts.sparkSession
    size = dictionary.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.length("synonym")), F.lit(0)).alias("chars"), F.collect_set(F.length("synonym")).alias("sizes")).first()
    numbered = texts.withColumn("row_id", F.monotonically_increasing_id())
    if size["n"] <= constant:
        entries = [(r["ord"], r["synonym"], r["canonical"]) for r in dictionary.orderBy("ord", "synonym").collect()]
        return numbered.transform(explode_rows, [*keep, "row_id"], entities.synonym_scan(text, entries), "h").select(
            *keep, "row_id", "h.value", "h.confidence", "h.extractor_id", F.col("h.ord").cast("long").alias("ord"))
    if size["n"] <= shard and size["chars"] <= SHARD_CHARS:
        # places are running numbers: dictionaries may repeat an order
        own = [(r["ord"], r["synonym"], r["canonical"]) for r in dictionary.orderBy("ord", "synonym").select("ord", "synonym", "canonical").collect()]
        words = spark.sparkContext.broadcast([(place, synonym) for place, (_, synonym, _) in enumerate(own)])
        scan = F.pandas_udf(_scanner(words), "array<int>")
        table = spark.createDataFrame([(place, *entry) for place, entry in enumerate(own)], "place int, ord long, synonym string, canonical string")
        found = numbered.transform(explode_rows, [*keep, "row_id"], scan(text), "place").join(table, "place")
    else:
        bits, held = _filter(dictionary, size["n"])
        search = F.pandas_udf(_searcher(sorted(size["sizes"]), bits, spark.sparkContext.broadcast(held)), "array<string>")
        found = numbered.transform(explode_rows, [*keep, "row_id"], search(text), "synonym").join(dictionary.select("ord", "synonym", "canonical"), "synonym")
    confidence = F.when(F.length("f.synonym") <= entities.SHORT_SYNONYM, entities.SHORT_CONFIDENCE).otherwise(entities.LONG_CONFIDENCE)
    first = found.groupBy(*keep, "row_id", F.col("canonical").alias("value")).agg(F.min(F.struct("ord", "synonym")).alias("f"))
    return first.select(*keep, "row_id", "value", confidence.alias("confidence"), F.lit("enhanced_synonym_match").alias("extractor_id"), "f.ord")
