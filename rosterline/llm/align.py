"""Cross-tokenizer alignment: each distinct text is tokenised and aligned once, measures go back to the documents."""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import encoder, settle, ship

ship(__name__)

#: bytes of text that are aligned in one go, links that are held at once, pairs of a row
TOGETHER, LINKS, ROW = 1 << 20, 1 << 22, 1 << 16
#: most frequent pairs whose counts are sent to every task; a text that holds a larger share of all rows is salted
HEAD, SHARE = 1 << 20, 400
ALIGNED = ("key binary, copies long, first boolean, n_a long, n_b long, n_groups long, n_links long, groups string, "
           "codes array<long>, times array<long>")


class Tokenizers:
    """Ids and bytes of tokens of a byte-level vocabulary (A) and a sentence-piece model (B)."""

    def __init__(self, byte_level: str | None, pieces: str | None):
        import public_tokenizers
        import sentencepiece

        self._a = encoder(byte_level)
        self._b = sentencepiece.SentencePieceProcessor(model_file=pieces or public_tokenizers.path("piece_bpe_32k.model"))
        known = self._a.tokens()
        self.a_bytes = [known.get(i, b"") for i in range(self._a.size)]
        self.b_bytes = []
        for i in range(self._b.get_piece_size()):
            piece = self._b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self._b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_length = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        self.b_length = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        self.a_digits, self.b_digits = digits(len(self.a_bytes)), digits(len(self.b_bytes))

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides; None for texts that B does not give back byte for byte (byte-level ids always do)."""
        out = []
        for text, b in zip(texts, self._b.encode(texts, num_threads=1)):
            same = text and b"".join(map(self.b_bytes.__getitem__, b)) == b" " + text.encode()
            out.append((self._a.array(" " + text).astype(np.int64), np.frombuffer(array("q", b), dtype=np.int64)) if same else None)
        return out


def digits(n: int) -> np.ndarray:
    """Decimal digits of the numbers below n, one row each, right-aligned after zero bytes."""
    width = len(str(n))
    return np.frombuffer(b"".join(str(i).encode().rjust(width, b"\0") for i in range(n)), dtype=np.uint8).reshape(n, width)


def groups_of(a: np.ndarray, b: np.ndarray, a_length: np.ndarray, b_length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group of each A and each B token, and end offset of each group: groups end where tokens of both sides end."""
    a_end, b_end = np.cumsum(a_length[a]), np.cumsum(b_length[b])
    both = np.zeros(int(a_end[-1]) + 1, dtype=np.int8)
    both[a_end] = 1
    both[b_end] += 1
    ended = np.cumsum(both == 2, dtype=np.int32).astype(np.int64)
    return ended[a_end - 1], ended[b_end - 1], np.flatnonzero(both == 2)


def pair_counts(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, n_b: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(codes, times) of the linked id pairs of one text, in slices of different pairs.

    The code of a pair is ``a * n_b + b``.  Where a text has very many links,
    each slice takes only the pairs of some A ids, so that memory stays bounded.
    """
    # within a group equal ids are one entry with a count
    groups = int(max(a_group[-1], b_group[-1])) + 1
    size_b = np.bincount(b_group, minlength=groups)
    a_key, a_times = np.unique(a * groups + a_group, return_counts=True)
    a_id, a_at = a_key // groups, a_key % groups
    ends = np.cumsum(size_b[a_at])
    starts_b = np.cumsum(size_b) - size_b
    out, low = [], 0
    while low < len(a_id):
        high = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + LINKS, side="right"))
        high = max(high, low + 1)
        # an A id is never cut: its pairs must be counted once a text
        last = a_id[min(high, len(a_id)) - 1]
        start_of_last = int(np.searchsorted(a_id, last))
        high = start_of_last if high < len(a_id) and a_id[high] == last and start_of_last > low else int(np.searchsorted(a_id, last, side="right"))
        codes, times = links(a_id[low:high], a_at[low:high], a_times[low:high], b, size_b, starts_b, n_b)
        out.append((codes, times))
        low = high
    return out


def links(a_id, a_at, a_times, b, size_b, starts_b, n_b):
    """Distinct codes and times of the pairs of A entries with the B tokens of their groups."""
    reps = size_b[a_at]
    inside = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
    code = np.repeat(a_id, reps) * n_b + b[np.repeat(starts_b[a_at], reps) + inside]
    codes, place = np.unique(code, return_inverse=True)
    return codes, np.bincount(place, weights=np.repeat(a_times, reps)).astype(np.int64)


def alignments(texts: list[str], tok: Tokenizers, digest: bool) -> list[tuple]:
    """Per text: n_a, n_b, n_groups, n_links, groups and slices of pairs."""
    ids = tok.ids(texts)
    used = [i for i, x in enumerate(ids) if x]
    out = [(0, 0, 0, 0, "", [])] * len(texts)
    if not used:
        return out
    a, b = (np.concatenate([ids[i][side] for i in used]) for side in (0, 1))
    n_a, n_b = (np.array([len(ids[i][side]) for i in used]) for side in (0, 1))
    a_from, b_from = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    # every text ends a group, so that the texts can be cut in one go
    a_group, b_group, ends = groups_of(a, b, tok.a_length, tok.b_length)
    size_a, size_b = np.bincount(a_group), np.bincount(b_group)
    first_group = a_group[a_from]
    n_groups = np.diff(np.append(first_group, len(ends)))
    n_links = np.add.reduceat(size_a * size_b, first_group)
    told, told_ends = told_groups(a, b, a_group, b_group, size_a, size_b, n_a, n_b, tok)
    pairs = batch_pairs(a, b, a_group, b_group, size_b, n_a, n_links, len(tok.a_bytes), len(tok.b_bytes))
    start = 0
    for at, i in enumerate(used):
        groups = told[start:told_ends[at] - 1]
        start = told_ends[at]
        if n_links[at] > LINKS:
            a_at, b_at = slice(a_from[at], a_from[at] + n_a[at]), slice(b_from[at], b_from[at] + n_b[at])
            pairs[at] = pair_counts(a[a_at], b[b_at], a_group[a_at] - first_group[at], b_group[b_at] - first_group[at], len(tok.b_bytes))
        out[i] = (int(n_a[at]), int(n_b[at]), int(n_groups[at]), int(n_links[at]),
                  hashlib.sha256(groups).hexdigest() if digest else groups.decode(), pairs[at])
    return out


def told_groups(a, b, a_group, b_group, size_a, size_b, n_a, n_b, tok: Tokenizers) -> tuple[bytes, list[int]]:
    """``a1,a2|b1;`` for each group of all texts, and where each text ends."""
    width = max(tok.a_digits.shape[1], tok.b_digits.shape[1])
    told = np.zeros((len(a) + len(b), width + 1), dtype=np.uint8)
    a_at = np.arange(len(a)) + (np.cumsum(size_b) - size_b)[a_group]
    b_at = np.arange(len(b)) + np.cumsum(size_a)[b_group]
    for at, ids, group, table, end in ((a_at, a, a_group, tok.a_digits, "|"), (b_at, b, b_group, tok.b_digits, ";")):
        told[at, width - table.shape[1]:width] = table[ids]
        told[at, width] = np.where(np.append(group[1:] != group[:-1], True), ord(end), ord(","))
    written = told != 0
    tokens = np.cumsum(n_a + n_b)
    return told[written].tobytes(), np.add.reduceat(written.sum(1), np.append(0, tokens[:-1])).cumsum().tolist()


def batch_pairs(a, b, a_group, b_group, size_b, n_a, n_links, of_a: int, of_b: int) -> list[list]:
    """One slice of pairs per text, for all texts of at most ``LINKS`` links; others stay empty."""
    out: list[list] = [[] for _ in n_a]
    starts_b = np.cumsum(size_b) - size_b
    a_from = np.cumsum(n_a) - n_a
    run = 0
    while run < len(n_a):
        # texts of about LINKS links in all
        stop = run + 1
        held = n_links[run]
        while stop < len(n_a) and held + n_links[stop] <= LINKS:
            held += n_links[stop]
            stop += 1
        if held <= LINKS:
            at = slice(a_from[run], a_from[stop - 1] + n_a[stop - 1])
            reps = size_b[a_group[at]]
            inside = np.arange(int(held)) - np.repeat(np.cumsum(reps) - reps, reps)
            key = np.repeat(np.repeat(np.arange(stop - run), n_a[run:stop]) * (of_a * of_b) + a[at] * of_b, reps)
            key += b[np.repeat(starts_b[a_group[at]], reps) + inside]
            key.sort()
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key, times = key[new], np.diff(np.append(new, len(key)))
            bounds = np.searchsorted(key, np.arange(stop - run + 1) * (of_a * of_b))
            key %= of_a * of_b
            for i in range(run, stop):
                s = slice(bounds[i - run], bounds[i - run + 1])
                out[i] = [(key[s], times[s])]
        run = stop
    return out


def align(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None, digest: bool = True,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: sizes of its alignment, and how usual its links are in the corpus.

    A encodes space + text by a byte-level vocabulary, B the text by a
    sentence-piece model that adds the space; neither adds special tokens, and
    their names in a text are plain text.  Byte offsets where tokens of both
    end cut a text into groups; all A-B token pairs of a group are links.  The
    count of an id pair is the number of document rows that hold it linked.

    ``n_a``, ``n_b``, ``n_groups``, ``n_links``; ``n_best``: links whose count is
    the highest of their A id, ties included; ``count_sum``: counts summed over
    links; ``groups``: ``a1,a2|b1;a3|b2,b3``, or its SHA-256 (``digest``).

    Rows are grouped by their full text first, with partial counts, so that
    each distinct text is tokenised once and a text that a third of all rows
    hold is one row.  Pair counts are weighted by the rows of a text.  The
    counts of the 2^20 most frequent pairs at most are broadcast; the other
    pairs are joined by shuffles.  Measures go back to documents over the SHA-256
    of the text; texts of more than a 400th of all rows are salted there.

    Null and empty texts, and texts that either side does not give back byte
    for byte, have no tokens: zeros and an empty ``groups``.  Null ids are kept,
    repeated rows count as documents of their own, an empty table gives an
    empty result, other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = rows.filter("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))

    def tokenise(batches):
        tok = None
        for b in batches:
            tok = tok or Tokenizers(byte_level, pieces)
            held, copies, size = [], [], 0
            for text, n in zip(b.column("text"), b.column("copies").to_pylist()):
                held.append(text.as_py())
                copies.append(n)
                size += len(held[-1])
                if size >= TOGETHER:
                    yield from aligned_rows(held, copies, tok, digest)
                    held, copies, size = [], [], 0
            yield from aligned_rows(held, copies, tok, digest)

    aligned = settle(texts.mapInArrow(tokenise, ALIGNED), "align-texts")
    n_b = pieces_of(pieces)
    counts = aligned.select(F.explode("codes").alias("code"), "copies").groupBy("code").agg(F.sum("copies").alias("n"))
    of_a = Window.partitionBy(F.expr(f"code div {n_b}"))
    counts = settle(counts.withColumn("best", F.col("n") == F.max("n").over(of_a)), "align-counts")
    head = _head(counts)
    sent = spark.sparkContext.broadcast(head)

    def score(batches):
        known, n, best = sent.value
        for b in batches:
            codes, times = b.column("codes"), b.column("times")
            # a row without pairs is a row of none, never null
            value = codes.flatten().to_numpy(zero_copy_only=False)
            weight = times.flatten().to_numpy(zero_copy_only=False)
            lengths = np.diff(codes.offsets.to_numpy())
            of = np.repeat(np.arange(b.num_rows), lengths)
            at = np.minimum(np.searchsorted(known, value), max(len(known) - 1, 0))
            hit = known[at] == value if len(known) else np.zeros(len(value), dtype=bool)
            sums = np.zeros(b.num_rows, dtype=np.int64)
            bests = np.zeros(b.num_rows, dtype=np.int64)
            np.add.at(sums, of[hit], weight[hit] * n[at[hit]])
            np.add.at(bests, of[hit], weight[hit] * best[at[hit]])
            ends = pa.array(np.append(0, np.cumsum(np.bincount(of[~hit], minlength=b.num_rows))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("key", "copies", "first", "n_a", "n_b", "n_groups", "n_links", "groups")] + [
                    pa.array(bests), pa.array(sums), pa.ListArray.from_arrays(ends, pa.array(value[~hit])), pa.ListArray.from_arrays(ends, pa.array(weight[~hit]))],
                [c.split()[0] for c in scored_schema.split(", ")])

    scored_schema = ("key binary, copies long, first boolean, n_a long, n_b long, n_groups long, n_links long, groups string, "
                     "n_best long, count_sum long, codes array<long>, times array<long>")
    scored = settle(aligned.mapInArrow(score, scored_schema), "align-scored")
    rare = (
        scored.select("key", F.explode(F.arrays_zip("codes", "times")).alias("p")).select("key", F.col("p.codes").alias("code"), F.col("p.times").alias("times"))
        .join(counts, "code").groupBy("key").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    )
    sizes = ["n_a", "n_b", "n_groups", "n_links"]
    measures = (
        scored.select("key", "copies", *sizes, "groups", "n_best", "count_sum")
        .unionByName(rare, allowMissingColumns=True)
        .groupBy("key").agg(F.max("copies").alias("copies"), *[F.sum(c).alias(c) for c in [*sizes, "n_best", "count_sum"]], F.max("groups").alias("groups"))
    )
    # texts of very many rows: their measures are repeated per salt, their documents dealt over the salts
    total = aligned.filter("first").agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = F.broadcast(settle(aligned.filter(F.col("first") & (F.col("copies") * SHARE > total))
                             .select("key", F.ceil(F.col("copies") * SHARE / F.lit(max(total, 1))).cast("int").alias("salts")), "align-hot"))
    dealt = rows.select("doc_id", _key(F.col("text")).alias("key")).join(hot, "key", "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
    repeated = measures.join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts", "copies")
    return dealt.join(repeated, ["key", "salt"], "left").select(
        "doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in [*sizes, "n_best", "count_sum"]], F.coalesce("groups", F.lit("")).alias("groups"))


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def pieces_of(path: str | None) -> int:
    """Size of the sentence-piece vocabulary."""
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model")).get_piece_size()


def aligned_rows(texts: list[str], copies: list[int], tok: Tokenizers, digest: bool):
    """Rows of texts; a text with very many pairs has several, of which the first holds its sizes."""
    rows, held = [], 0
    for text, n, (n_a, n_b, n_groups, n_links, groups, slices) in zip(texts, copies, alignments(texts, tok, digest)):
        key = hashlib.sha256(text.encode()).digest()
        first = True
        for codes, times in slices or [(np.zeros(0, "i8"), np.zeros(0, "i8"))]:
            for s in range(0, max(len(codes), 1), ROW):
                sizes = (n_a, n_b, n_groups, n_links, groups) if first else (0, 0, 0, 0, None)
                rows.append((key, n, first, *sizes, codes[s:s + ROW], times[s:s + ROW]))
                first, held = False, held + len(codes[s:s + ROW])
        if held > LINKS:
            yield batch_of(rows)
            rows, held = [], 0
    if rows:
        yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    ends = pa.array(np.cumsum([0, *map(len, columns[8])]), pa.int32())
    kinds = [pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)] + [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c))) for c in columns[8:]],
        [c.split()[0] for c in ALIGNED.split(", ")])


def _head(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent pairs, 2^20 at most: codes in order, counts, and whether they are the best of their A id."""
    # counts in steps of an eighth of their logarithm; a step is taken whole or not at all
    step = F.floor(F.log2("n") * 8).cast("int")
    levels = sorted(((r["step"], r["pairs"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs")).collect()), reverse=True)
    least, held = None, 0
    for level, pairs in levels:
        if held + pairs > HEAD:
            break
        least, held = level, held + pairs
    if least is None:
        return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "i8")
    found = counts.filter(step >= least).toArrow()
    code = found.column("code").to_numpy()
    order = np.argsort(code)
    return code[order], found.column("n").to_numpy()[order], found.column("best").to_numpy().astype(np.int64)[order]
