"""Order-preserving packing: dynamic programming over cuts at document and sentence boundaries."""

from __future__ import annotations

import zlib
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Encoder, encoder, ship

ship(__name__)

#: tokens after which a run of whole documents is packed on its own
SEGMENT = 1 << 18
#: longest stretch without a place to cut
STRETCH = 24
#: cost, in padding tokens, of a cut at a document end, at a sentence end and inside a sentence, and of a sequence
DOCUMENT, SENTENCE, INSIDE, SEQUENCE = 0.0, 3.0, 8.0, 1.0

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_tokens long, padded_tokens long")


def sentence_tables(enc: Encoder, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per id: has a line feed, ends a sentence, starts with white space."""
    line, end, space = (np.zeros(vocabulary, dtype=bool) for _ in range(3))
    for i, token in enc.tokens().items():
        line[i] = b"\n" in token
        end[i] = token.rstrip(b"\"')]").endswith((b".", b"!", b"?"))
        space[i] = token[:1].isspace()
    return line, end, space


def places(ids: np.ndarray, doc_ends: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may stand, ascending from 0, and the cost of each."""
    line, end, space = tables
    cost = np.full(len(ids) + 1, np.inf)
    sentence = line[ids[:-1]] | (end[ids[:-1]] & space[ids[1:]])
    cost[1:-1][sentence] = SENTENCE
    cost[0] = DOCUMENT
    cost[doc_ends] = DOCUMENT
    at = np.flatnonzero(np.isfinite(cost))
    gaps = np.diff(at)
    more = (gaps - 1) // STRETCH
    if more.any():
        step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        extra = np.repeat(at[:-1], more) + (step + 1) * STRETCH
        cost[extra] = INSIDE
        at = np.flatnonzero(np.isfinite(cost))
    return at, cost[at]


def best_cuts(at: np.ndarray, cost: np.ndarray, width: int) -> np.ndarray:
    """Positions of the sequence ends that minimise padding plus cut costs.

    f(j) = cost(j) + min over i of f(i) + padding(at[j] - at[i]) with windows
    of at most ``width`` tokens.  Padding is width - length, or none for a
    power of two.  The first kind needs the smallest f(i) + at[i] of a sliding
    window, which a monotone queue gives in constant time; the second looks at
    the few i that lie exactly a power of two before j.
    """
    hits = []
    power = 1
    while power < width:
        i = np.searchsorted(at, at - power)
        j = np.flatnonzero(at[np.minimum(i, len(at) - 1)] == at - power)
        hits.append(np.stack([j, i[j]], axis=1))
        power *= 2
    pairs = np.concatenate(hits) if hits else np.empty((0, 2), dtype=int)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    hit_j, hit_i = pairs[:, 0].tolist(), pairs[:, 1].tolist()
    p, c = at.tolist(), cost.tolist()
    f, back = [0.0] * len(p), [0] * len(p)
    queue: deque[tuple[float, int]] = deque([(0.0 + p[0], 0)])
    h, hits_n = 0, len(hit_j)
    for j in range(1, len(p)):
        x = p[j]
        while p[queue[0][1]] < x - width:
            queue.popleft()
        key, i = queue[0]
        best = key + width - x
        while h < hits_n and hit_j[h] == j:
            if f[hit_i[h]] < best:
                best, i = f[hit_i[h]], hit_i[h]
            h += 1
        best += c[j] + SEQUENCE
        f[j], back[j] = best, i
        key = best + x
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], len(p) - 1
    while j:
        cuts.append(p[j])
        j = back[j]
    return np.array(cuts[::-1], dtype=np.int64)


def pack_segment(doc_ids: list, texts_ids: list[array], width: int, first: int, tables) -> tuple[pa.RecordBatch, int]:
    """Pieces of a run of documents, and the number of sequences."""
    lengths = np.array([len(a) for a in texts_ids], dtype=np.int64)
    ids = np.concatenate([np.frombuffer(a, dtype="<u4") for a in texts_ids])
    doc_ends = np.cumsum(lengths)
    cuts = best_cuts(*places(ids, doc_ends, tables), width)
    ends = np.union1d(cuts, doc_ends)
    starts = np.append(0, ends[:-1])
    doc = np.searchsorted(doc_ends, starts, side="right")
    seq = np.searchsorted(cuts, starts, side="right")
    seq_starts = np.append(0, cuts[:-1])
    raw = memoryview(ids.tobytes())
    crc = [zlib.crc32(raw[4 * s:4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
    tokens = cuts - seq_starts
    padded = np.where(tokens & (tokens - 1) == 0, tokens, width)
    columns = [
        pa.array(doc_ids, pa.int64()).take(pa.array(doc)), starts - (doc_ends - lengths)[doc], ends - starts, crc, lengths[doc],
        first + seq, starts - seq_starts[seq], tokens[seq], padded[seq],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if not isinstance(c, pa.Array) else c for c in columns],
                                      [c.split()[0] for c in SCHEMA.split(", ")]), len(cuts)


def pack(docs: DataFrame, width: int = 1024, vocabulary: str | None = None) -> DataFrame:
    """One row per piece of a document.

    A document is the ids of its text (null: empty) and a closing id 0.  Each
    scan task packs its documents in the order in which it reads them, without
    a shuffle, in runs of whole documents of about 262,144 tokens: a run's
    token stream is cut into sequences of at most ``width`` tokens, at document
    ends, sentence ends or, in stretches of over 24 tokens without either, in
    between, so that padding plus the costs of cuts is smallest.  A sequence
    of a power of two of tokens is not padded.

    ``sequence_id`` is unique: task number << 33, plus a running number.
    Repeated rows are packed again, null ids are kept, an empty table gives an
    empty result, and other columns are ignored.  A long document is held as
    ids only and never cut before it is encoded.
    """

    def run(batches):
        enc, tables = None, None
        first = TaskContext.get().partitionId() << 33
        names, runs, size = [], [], 0
        for b in batches:
            if enc is None:
                enc = encoder(vocabulary)
                tables = sentence_tables(enc, enc.size)
            for name, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = array("I", enc.ids(text.as_py() or ""))
                ids.append(0)
                names.append(name)
                runs.append(ids)
                size += len(ids)
                if size >= SEGMENT:
                    out, n = pack_segment(names, runs, width, first, tables)
                    yield out
                    first, names, runs, size = first + n, [], [], 0
        if runs:
            yield pack_segment(names, runs, width, first, tables)[0]

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
