"""Periodic runs of words: maximal pairs, enumerated bottom-up in the tree of LCP intervals."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

ship(__name__)

#: words that are searched in one go
TOGETHER = 1 << 18
OUT = "doc_id long, kept binary, runs array<struct<start:long,length:long,period:long>>"


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Suffixes of ``x`` (numbers from 0) in order, by doubling the length that is sorted; settled suffixes are left alone."""
    n = len(x)
    wide = 3 if n < 1 << 20 else 2
    bits = 63 // wide
    key = np.zeros(n, dtype=np.int64)
    for i in range(wide):
        key <<= bits
        key[: n - i] += x[i:] + 1
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    slots, length = _open_groups(np.arange(n), new), wide
    while len(slots):
        p = order[slots]
        after = np.zeros(len(p), dtype=np.int64)
        inside = p + length < n
        after[inside] = rank[p[inside] + length] + 1
        key = rank[p] * (n + 1) + after
        moved = np.argsort(key)
        p, key = p[moved], key[moved]
        order[slots] = p
        new = np.append(True, key[1:] != key[:-1])
        rank[p] = slots[np.flatnonzero(new)[np.cumsum(new) - 1]]
        slots, length = _open_groups(slots, new), 2 * length
    return order


def _open_groups(slots: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Slots that share their group with another one."""
    alone = new & np.append(new[1:], True)
    return slots[~alone]


def lcp_array(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of each suffix in ``order`` with the one before (0 for the first).

    Compared word by word only where the left words differ; elsewhere the
    length is that of the suffix one word earlier less one, so that the
    comparisons grow with n log n.
    """
    n = len(x)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    told = (before <= 0) | (at == 0)
    told[~told] = x[at[~told] - 1] != x[before[~told] - 1]
    common = np.zeros(n, dtype=np.int64)
    left = np.flatnonzero(told & (before >= 0))
    padded, wide = np.append(x, -1), 2
    while len(left):
        reach = common[left, None] + np.arange(wide)
        same = padded[np.minimum(left[:, None] + reach, n)] == padded[np.minimum(before[left, None] + reach, n)]
        good = np.where(same.all(1), wide, same.argmin(1))
        common[left] += good
        left = left[good == wide]
        wide = min(max(8, (1 << 16) // max(len(left), 1)), 1 << 14)
    last = np.maximum.accumulate(np.where(told, at, 0))
    return (common[last] - (at - last))[order]


def near_repeats(order: np.ndarray, lcp: np.ndarray, least: int, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that may belong to a run, in order, with the common prefix of neighbours.

    Only intervals of ``least`` or more common words matter, and of these only
    suffixes whose next or last occurrence in the interval is no farther than its
    longest common prefix divided by ``factor`` - 1.
    """
    group = np.cumsum(lcp < least)
    size = np.bincount(group)
    slots = np.flatnonzero(size[group] > 1)
    if not len(slots):
        return slots, slots
    g, p = group[slots], order[slots]
    longest = np.zeros(len(size), dtype=np.int64)
    np.maximum.at(longest, g, np.where(lcp[slots] >= least, lcp[slots], 0))
    by_place = np.lexsort((p, g))
    gap = np.full(len(slots) + 1, np.iinfo(np.int64).max)
    inner = g[by_place[1:]] == g[by_place[:-1]]
    gap[1:-1][inner] = (p[by_place[1:]] - p[by_place[:-1]])[inner]
    near = np.empty(len(slots), dtype=bool)
    near[by_place] = np.minimum(gap[1:], gap[:-1]) <= longest[g[by_place]] // (factor - 1)
    slots = slots[near]
    if not len(slots):
        return slots, slots
    return order[slots], np.append(0, np.minimum.reduceat(lcp[: slots[-1] + 1], slots[:-1] + 1)) if len(slots) > 1 else np.zeros(1, "i8")


def maximal_pairs(places: list[int], common: list[int], left: list[int], least: int, factor: int, shortest: int) -> dict[tuple[int, int], int]:
    """Smallest period of each (start, end) of maximal pairs of periodic stretches.

    Intervals are closed bottom-up.  Each holds its places in word order, every
    place labelled by its class (``left``, the word before).  When a child is
    merged into its interval, places of the child meet the nearest places of
    the other children on both sides: a pair of different classes cannot be
    extended to the left, a pair of different children not to the right, so
    that it is a run as soon as its distance q satisfies length >= ``factor`` q
    and >= ``shortest``.  Nearest places suffice: an occurrence between the two
    would give the stretch a smaller period.
    """
    found: dict[tuple[int, int], int] = {}

    def pair(i: int, j: int, depth: int) -> None:
        q = j - i
        if q + depth >= max(factor * q, shortest) and left[i] != left[j]:
            key = (i, j + depth)
            if found.get(key, q + 1) > q:
                found[key] = q

    def merge(a: list[int], b: list[int], depth: int) -> list[int]:
        large, small = (a, b) if len(a) >= len(b) else (b, a)
        for x in small:
            at = bisect_left(large, x)
            if at:
                pair(large[at - 1], x, depth)
            if at < len(large):
                pair(x, large[at], depth)
        if len(small) > 8:
            large.extend(small)
            large.sort()
        else:
            for x in small:
                insort(large, x)
        return large

    open_: list[tuple[int, list[int]]] = []  # intervals: common prefix, places of the children so far
    child: list[int] = []
    for place, depth in zip([*places, -1], [*common, 0]):
        while open_ and open_[-1][0] > depth:
            own, merged = open_.pop()
            child = merge(merged, child, own)
        if depth >= least:
            if open_ and open_[-1][0] == depth:
                open_[-1] = (depth, merge(open_[-1][1], child, depth))
            else:
                open_.append((depth, child))
        child = [place]
    return found


def runs_of(x: np.ndarray, factor: int, shortest: int) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run of numbers, by start, then period."""
    if len(x) < shortest:
        return []
    least = min(max((factor - 1) * q, shortest - q) for q in range(1, shortest + 1))
    order = suffix_array(x)
    places, common = near_repeats(order, lcp_array(x, order), least, factor)
    left = dict(zip(places.tolist(), np.append(-1, x[:-1])[places].tolist()))
    found = maximal_pairs(places.tolist(), common.tolist(), left, least, factor, shortest)
    return sorted((i, end - i, q) for (i, end), q in found.items())


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words outside runs, and the first period of each run."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]


def find_runs(docs: DataFrame, rewrite: Callable[[int, list[bytes]], list[bytes]] | None = None, factor: int = 4, shortest: int = 6,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``kept``, ``runs``: the periodic runs of each text's words, and the text with each run cut to its first period.

    Words are stretches without space, tab, line feed, vertical tab, form feed
    or carriage return.  A run is a stretch of smallest period q and of
    ``factor`` q or more and ``shortest`` or more words that no neighbouring
    word extends; ``factor`` is 2 or more.  ``kept`` holds, joined by single
    spaces, the words that no run contains after its first q words.
    ``rewrite`` may change the words of a document before the search.

    A scan task searches its documents in groups of about 262,144 words, each
    word of each document a letter of its own alphabet, so that no repeat spans
    two documents; nothing is shuffled.  A longer document is a group of its
    own, and its task needs about 120 bytes a word.

    Null and empty texts have no words and no runs; rows with a null id are
    searched as they are (``rewrite`` is not called).  Repeated rows are
    searched again, an empty table gives an empty result, other columns are
    ignored.
    """

    def flush(ids, texts):
        words = [w for t in texts for w in t]
        counts = np.array([len(t) for t in texts], dtype=np.int64)
        ends = np.cumsum(counts)
        found: list[list] = [[] for _ in texts]
        if words:
            flat = np.empty(len(words), dtype=object)
            flat[:] = words
            code = pd.factorize(flat)[0].astype(np.int64)
            letters = pd.factorize(np.repeat(np.arange(len(texts)), counts) * (int(code.max()) + 1) + code)[0]
            for start, length, period in runs_of(letters, factor, shortest):
                doc = int(np.searchsorted(ends, start, side="right"))
                found[doc].append((start - int(ends[doc] - counts[doc]), length, period))
        kept = [b" ".join(kept_words(t, r)) for t, r in zip(texts, found)]
        lengths = np.array([len(r) for r in found], dtype=np.int64)
        flat_runs = np.array([r for of in found for r in of], dtype=np.int64).reshape(-1, 3)
        runs = pa.ListArray.from_arrays(
            pa.array(np.append(0, np.cumsum(lengths)), pa.int32()),
            pa.StructArray.from_arrays([pa.array(flat_runs[:, i]) for i in range(3)], ["start", "length", "period"]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kept, pa.binary()), runs], ["doc_id", "kept", "runs"])

    def run(batches):
        ids, texts, size = [], [], 0
        for b in batches:
            for i, text in zip(b.column("id").to_pylist(), b.column("text")):
                words = (text.as_py() or b"").split()
                if rewrite and i is not None:
                    words = rewrite(i, words)
                ids.append(i)
                texts.append(words)
                size += len(words)
                if size >= TOGETHER:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield flush(ids, texts)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, OUT)


def strongest(runs: Column) -> Column:
    """The run of greatest length / period; ties: smallest start, then period.  Null without runs."""
    def better(a, b):
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        ahead = F.struct(-a["start"], -a["period"]) > F.struct(-b["start"], -b["period"])
        return (x > y) | ((x == y) & ahead)

    return F.aggregate(runs, F.try_element_at(runs, F.lit(1)), lambda best, r: F.when(better(r, best), r).otherwise(best))
