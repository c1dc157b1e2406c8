"""Exact top-k by inner product: MaxScore over terms, one term per component, merged over shards."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, ship

ship(__name__)

#: rows of a shard, queries searched in one go, rows that give the first score to beat
SHARD, TOGETHER, PILOT = 8192, 64, 4096
#: bytes of the queries that are sent to every task at once
BLOCK_BYTES = 32 << 20
#: whole numbers up to here are exact as doubles
EXACT = 2.0**53
LONG = 2**63
#: larger sums count as this one
LARGEST = 10**38 - 1


def whole_parts(column: pa.Array, scale: int) -> list[bytes | None]:
    """floor(scale * x) of each component, as doubles; None for vectors that are null or hold null or non-finite parts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    width = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        parts = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype("<f8") * scale)
    bad = np.append(0, np.cumsum(~np.isfinite(parts)))
    end = np.cumsum(width)
    start = end - width
    usable = (bad[end] == bad[start]) & ~column.is_null().to_numpy(zero_copy_only=False)
    return [parts[a:b].tobytes() if ok else None for a, b, ok in zip(start.tolist(), end.tolist(), usable.tolist())]


def by_width(raw: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of each vector length; vectors too large for sums in doubles are apart, as Python's whole numbers."""
    lengths = np.array([len(r) >> 3 for r in raw])
    out = []
    for width in np.unique(lengths):
        at = np.flatnonzero(lengths == width)
        x = np.frombuffer(b"".join(raw[i] for i in at), dtype="<f8").reshape(len(at), width)
        large = np.abs(x).max(1, initial=0) > math.isqrt(int(EXACT) // max(int(width), 1))
        if not large.all():
            out.append((at[~large], x[~large]))
        if large.any():
            out.append((at[large], whole(x[large])))
    return out


def whole(x: np.ndarray) -> np.ndarray:
    """Vectors in Python's whole numbers, for sums that doubles do not hold."""
    return x if x.dtype == object else np.array([int(v) for v in x.ravel()] + [None], dtype=object)[:-1].reshape(x.shape)


def competitive(x: np.ndarray, q: np.ndarray, beat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, query, score) of all pairs that reach the score to beat, by MaxScore.

    A term is a component, its postings are the rows' values.  What a term can
    add to a score is bounded by the query's value times the largest or
    smallest posting of the shard (0 for rows without the term).  The terms of
    smallest bound that cannot reach ``beat`` even together are non-essential.
    Postings of essential terms are traversed for all rows at once; the other
    terms are probed, largest bound first, only for rows that can still reach
    ``beat``.  Terms beyond the shorter of two vectors add nothing.
    """
    width = min(x.shape[1], q.shape[1])
    if object in (x.dtype, q.dtype):
        x, q = whole(x), whole(q)
    x, q = x[:, :width], q[:, :width]
    beat = beat.astype("f8") if x.dtype != object else beat.astype(object)
    none = np.zeros((len(q), 1), dtype=q.dtype)
    bound = np.maximum(np.maximum(q * x.max(0), q * x.min(0)), 0) if width else np.zeros((len(q), 0), dtype=q.dtype)
    order = np.argsort(bound, axis=1, kind="stable")
    total = np.concatenate([none, np.cumsum(np.take_along_axis(bound, order, 1), axis=1)], axis=1)
    others = (total[:, 1:] < beat[:, None]).sum(1)  # number of non-essential terms
    essential = np.ones(q.shape, dtype=bool)
    np.put_along_axis(essential, order, np.arange(width) >= others[:, None], 1)
    score = x @ np.where(essential, q, 0).T if width else np.zeros((len(x), len(q)), dtype=x.dtype)
    row, k = np.nonzero(score + total[np.arange(len(q)), others] >= beat)
    value, probed = score[row, k], 0
    while (open_ := others[k] > probed).any():
        at = np.flatnonzero(open_)
        left = others[k[at]] - 1 - probed
        term = order[k[at], left]
        value[at] += x[row[at], term] * q[k[at], term]
        keep = np.ones(len(k), dtype=bool)
        keep[at] = value[at] + total[k[at], left] >= beat[k[at]]
        row, k, value = row[keep], k[keep], value[keep]
        probed += 1
    return row, k, value


def exact(scores: np.ndarray) -> np.ndarray:
    """Scores as Python's whole numbers of 38 digits at most (minus infinity stays)."""
    return np.array([s if s == -math.inf else min(max(int(s), -LARGEST), LARGEST) for s in scores] + [None], dtype=object)[:-1]


class Best:
    """The best (score, id) of each query so far, and the score to beat."""

    def __init__(self, ids: np.ndarray, beat: np.ndarray, k: int):
        self.own, self.beat, self.k = ids, beat.copy(), k
        self.last = np.full(len(ids), LONG - 1)  # at the score to beat, only smaller ids are of use
        self.at, self.ids, self.scores = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, dtype=beat.dtype)

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        beat = self.beat[at]
        scores = exact(scores) if scores.dtype == object else scores
        use = ((ids != self.own[at]) & ((scores > beat) | ((scores == beat) & (ids <= self.last[at])))).astype(bool)
        if not use.any():
            return
        at, ids, scores = at[use], ids[use], scores[use]
        if object in (scores.dtype, self.beat.dtype):
            self.beat, self.scores, scores = exact(self.beat), exact(self.scores), exact(scores)
        at, ids, scores = np.append(self.at, at), np.append(self.ids, ids), np.append(self.scores, scores)
        if scores.dtype == object:
            place = {s: i for i, s in enumerate(sorted(set(scores)))}
            order = np.lexsort((ids, [-place[s] for s in scores], at))
        else:
            order = np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        # an id with several vectors counts once, with its best score
        by_id = np.lexsort((np.arange(len(at)), ids, at))
        first = np.ones(len(at), dtype=bool)
        first[by_id[1:]] = (at[by_id[1:]] != at[by_id[:-1]]) | (ids[by_id[1:]] != ids[by_id[:-1]])
        at, ids, scores = at[first], ids[first], scores[first]
        start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        rank = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
        keep, full = rank < self.k, rank == self.k - 1
        self.at, self.ids, self.scores = at[keep], ids[keep], scores[keep]
        full &= scores > -LARGEST  # anything may equal the smallest number
        self.beat[at[full]], self.last[at[full]] = scores[full], ids[full]


def search(raw: list[bytes], ids: np.ndarray, queries: list[tuple[np.ndarray, np.ndarray]], best: Best) -> None:
    """Adds the competitive rows of a shard to the best of each query."""
    for rows, x in by_width(raw):
        for at, q in queries:
            for s in range(0, len(at), TOGETHER):
                part = at[s:s + TOGETHER]
                row, k, score = competitive(x, q[s:s + TOGETHER], best.beat[part])
                best.add(part[k], ids[rows[row]], score)


def top(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k largest inner products of every row whose id is divisible by ``every``.

    Components are floor(``scale`` * x), x as double; scores are exact.  Ties
    go to the smaller id.  A row is no candidate of its own id.

    A sample of at most 8,192 rows gives every query a first score to beat.
    Queries are then sent to all tasks in blocks of 32 MB; each task searches
    the shards it reads one after the other, with the best of the earlier ones
    as score to beat, and gives at most k rows a query.  Vectors are not
    shuffled and no group meets in one task but the results of one query.

    Vectors that are null or hold null or non-finite parts (also after scaling),
    and rows without an id, take no part.  Empty vectors score 0.  Of vectors
    of different lengths the longer one's further components count as products
    of 0.  Rows of one id count once, with their best score, also as queries.
    Sums beyond a long are compared exactly, up to 38 digits, and given as the
    nearest long.
    Fewer than k candidates give fewer rows, an empty table none; other columns
    are ignored.
    """
    spark = vectors.sparkSession

    def clean(batches):
        for b in batches:
            raw = whole_parts(b.column("vec"), scale)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(raw, pa.binary())], ["id", "vec"])

    rows = settle(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
                  .filter("id is not null").mapInArrow(clean, "id long, vec binary").filter("vec is not null"), "maxscore-rows")
    sizes = rows.agg(F.count("*").alias("n"), F.sum(F.when(F.col("id") % every == 0, F.length("vec") + 8)).alias("b")).first()
    share = PILOT / max(sizes["n"], 1)
    drawn = rows.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(2**40)) < F.lit(share * 2**40)).limit(2 * PILOT).dropDuplicates(["id"]).toArrow()
    pilot = (drawn.column("vec").to_pylist(), drawn.column("id").to_numpy())

    def first_score(batches):
        for b in batches:
            raw, ids = b.column("vec").to_pylist(), b.column("id").to_numpy()
            best = Best(ids, np.full(len(ids), -math.inf), k)
            for s in range(0, len(pilot[0]), 512):
                search(pilot[0][s:s + 512], pilot[1][s:s + 512], by_width(raw), best)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("vec"), pa.array([None if s == -math.inf else str(int(s)) for s in best.beat], pa.string())], ["id", "vec", "beat"])

    blocks = max(1, math.ceil((sizes["b"] or 0) / BLOCK_BYTES))
    asked = settle(rows.filter(F.col("id") % every == 0).mapInArrow(first_score, "id long, vec binary, beat string")
                   .withColumn("block", F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)).cast("int")), "maxscore-queries")
    found = [settle(_visit(spark, rows, asked.filter(F.col("block") == i), k), "maxscore-found") for i in range(blocks)]
    merged = found[0]
    for f in found[1:]:
        merged = merged.unionByName(f)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = merged.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", F.least(F.greatest("score", F.lit(-LONG)), F.lit(LONG - 1)).cast("long").alias("score"))


def _visit(spark, rows: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """The best of each query of a block in the rows of each task."""
    local = block.select("id", "vec", "beat").toArrow()
    sent = spark.sparkContext.broadcast((local.column("id").to_numpy(), local.column("vec").to_pylist(), local.column("beat").to_pylist()))

    def run(batches):
        ids, raw, beat = sent.value
        known = [-math.inf if s is None else int(s) for s in beat]
        best = Best(ids, np.array(known, dtype="f8" if all(abs(s) < EXACT for s in known if s != -math.inf) else object), k)
        queries = by_width(raw)
        for b in batches:
            for s in range(0, b.num_rows, SHARD):
                part = b.slice(s, SHARD)
                search(part.column("vec").to_pylist(), part.column("id").to_numpy(), queries, best)
        yield pa.RecordBatch.from_arrays([pa.array(ids[best.at], pa.int64()), pa.array(best.ids, pa.int64()), pa.array([str(int(s)) for s in best.scores], pa.string())],
                                         ["query_id", "vec_id", "score"])

    found = rows.mapInArrow(run, "query_id long, vec_id long, score string")
    return found.withColumn("score", F.col("score").cast("decimal(38,0)"))
