"""Nearest neighbours: low-dimensional stable projections in kd-trees, verified until a chi-square test stops."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, ship
from .embed_dedup import valid_bytes

ship(__name__)

#: vectors of a shard, points of a leaf, queries of a block
SHARD, LEAF, QUERIES = 8192, 64, 2048
#: rows on which the split planes of the shards are fitted
SAMPLE = 20_000


def doubles(raw, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype("f8")


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def projection(dim: int, low: int, seed: int) -> np.ndarray:
    """2-stable (Gaussian) projection: projected squared distances are the true ones times chi-square of ``low`` degrees."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, low))


def chi_square_quantile(degrees: int, share: float) -> float:
    """Point below which ``share`` of a chi-square distribution lies (even degrees: a closed sum, solved by halving)."""
    half = degrees // 2
    cdf = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(half))
    low, high = 0.0, 1.0
    while cdf(high) < share:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < share else (low, middle)
    return high


class Tree:
    """kd-tree over projected points; ``boxes`` bound the points of each leaf."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.members: list[np.ndarray] = []
        self.nodes: list[tuple] = []  # (axis, value, left, right), or (-1, leaf number, 0, 0)
        self._grow(points, np.arange(len(points)), leaf)

    def _grow(self, points, rows, leaf) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        spread = points[rows].max(0) - points[rows].min(0) if len(rows) else np.zeros(1)
        if len(rows) <= leaf or not spread.any():
            self.nodes[at] = (-1, len(self.members), 0, 0)
            self.members.append(rows)
            return at
        axis = int(spread.argmax())
        value = float(np.median(points[rows, axis]))
        below = points[rows, axis] < value
        if not below.any():
            below = points[rows, axis] <= value
        self.nodes[at] = (axis, value, self._grow(points, rows[below], leaf), self._grow(points, rows[~below], leaf))
        return at

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """Leaf in whose cell each point lies."""
        out = np.empty(len(points), dtype=np.int32)
        todo = [(0, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            axis, value, left, right = self.nodes[at]
            if axis < 0:
                out[rows] = value
            elif len(rows):
                below = points[rows, axis] < value
                todo += [(left, rows[below]), (right, rows[~below])]
        return out

    def nearest_first(self, q: np.ndarray):
        """(squared projected distance, leaf) in growing distance of the leaves' cells."""
        heap = [(0.0, 0, (0.0,) * len(q))]
        while heap:
            gap, at, offsets = heapq.heappop(heap)
            axis, value, left, right = self.nodes[at]
            if axis < 0:
                yield gap, value
                continue
            d = q[axis] - value
            near, far = (left, right) if d < 0 else (right, left)
            heapq.heappush(heap, (gap, near, offsets))
            far_gap = gap - offsets[axis] ** 2 + d * d if abs(d) > offsets[axis] else gap
            heapq.heappush(heap, (far_gap, far, (*offsets[:axis], max(offsets[axis], abs(d)), *offsets[axis + 1:])))


def search_shard(tree, x, x_norm, ids, low_q, q, query_id, k, bound, reach):
    """Best (score, id) of one query in a shard.

    Leaves come in growing projected distance.  The search stops when the
    smallest projected distance of all that is left exceeds ``reach`` (the
    chi-square quantile) times the squared distance of the k-th best: a point
    that is nearer in truth would be projected beyond it with probability
    1 - confidence at most.
    """
    best = []  # heap of (score, -id): the worst on top
    limit, q_norm = bound, math.sqrt((q * q).sum())
    for gap, leaf in tree.nearest_first(low_q):
        if gap > reach * limit:
            break
        rows = tree.members[leaf]
        # row sums, not a matrix product: a score must not depend on a row's place
        scores = (x[rows] * q).sum(1) / (x_norm[rows] * q_norm)
        if len(best) == k:
            near = scores >= best[0][0]
            rows, scores = rows[near], scores[near]
        for s, row in zip(scores.tolist(), rows.tolist()):
            for i in ids[row]:
                if i == query_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
        if len(best) == k:
            limit = min(bound, max(0.0, 2 - 2 * best[0][0]) + 1e-12)
    return best


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, low: int = 8, confidence: float = 0.97, seed: int = 17,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k largest cosines of every row whose id is divisible by ``every``.

    Unit vectors are projected to ``low`` dimensions.  A kd-tree over a sample
    of at most 20,000 projected rows divides space into shards of about 8,192
    rows; every row is indexed, in the tree of its shard.  A query first
    searches its own shard.  The distance of its k-th best there bounds the
    shards that the chi-square test cannot rule out; it is sent to those in
    blocks of 2,048 queries, and the results are merged.  Candidates are always
    scored on the original vectors in double precision.

    Equal vectors are one point with their k + 1 smallest ids, which is all a
    query can need (ties go to smaller ids).  Vectors that are null, zero,
    empty or hold null or non-finite parts, and rows without an id, take no
    part; vectors of different lengths are not compared.  Repeated rows count
    once.  Fewer than k candidates give fewer rows; an empty table none.
    """
    spark = vectors.sparkSession
    kind = "<f4" if dict(vectors.dtypes)[vec_col] == "array<float>" else "<f8"
    reach = chi_square_quantile(low, confidence)
    width = np.dtype(kind).itemsize

    def clean(batches):
        for b in batches:
            raw = valid_bytes(b.column("vec").to_pylist(), kind)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([r and len(r) // width for r in raw], pa.int32()), pa.array(raw, pa.binary())],
                                             ["id", "dim", "vec"])

    rows = settle(
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
        .mapInArrow(clean, "id long, dim int, vec binary").filter("vec is not null and id is not null").distinct(), "ann-rows")
    first = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    points = settle(
        rows.withColumn("r", first).filter(F.col("r") <= k + 1).groupBy("vec", "dim").agg(F.array_sort(F.collect_list("id")).alias("ids")),
        "ann-points")
    routes = _routes(points, low, seed, kind)

    def place(batches):
        for b in batches:
            for dim, part in b.groupby("dim"):
                tree, base = routes[int(dim)]
                low_x = unit(doubles(part["vec"], kind)) @ projection(int(dim), low, seed)
                yield part.assign(shard=base + tree.leaves(low_x))

    indexed = settle(points.mapInPandas(place, "vec binary, dim int, ids array<long>, shard int"), "ann-index")
    asked = rows.filter(F.col("id") % every == 0)
    queries = asked.select("id", "dim", "vec").mapInPandas(place_queries(routes, low, seed, kind, None, 0.0), "id long, vec binary, shard int, block int, bound double")
    blocks = max(1, math.ceil(asked.count() / QUERIES))
    out = "query_id long, vec_id long, score double"
    found = settle(_visit(queries, indexed, blocks, k, low, seed, kind, reach, out), "ann-own")
    bounds = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s"))
    again = (
        asked.join(bounds.withColumnRenamed("query_id", "id"), "id", "left")
        .withColumn("bound", F.when(F.col("n") == k, F.greatest(F.lit(0.0), 2 - 2 * F.col("s")) + 1e-12).otherwise(F.lit(4.0)))
        .select("id", "dim", "vec", "bound")
        .mapInPandas(place_queries(routes, low, seed, kind, True, reach), "id long, vec binary, shard int, block int, bound double")
    )
    all_found = found.unionByName(_visit(again, indexed, blocks, k, low, seed, kind, reach, out))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return all_found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _routes(points: DataFrame, low: int, seed: int, kind: str) -> dict[int, tuple[Tree, int]]:
    """Split planes of the shards, per vector length, fitted on a bounded sample; shards are numbered through."""
    counts = {r["dim"]: r["n"] for r in points.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = min(1.0, SAMPLE / max(1, total))
    # the rows of smallest hash: the same sample on every run
    picked = points.filter(F.pmod(F.xxhash64("vec", F.lit(1)), F.lit(1_000_000)) < int(1_000_000 * share)).select("dim", "vec").limit(2 * SAMPLE).toPandas()
    routes, base = {}, 0
    for dim in sorted(counts):
        part = picked[picked["dim"] == dim]
        low_x = unit(doubles(part["vec"], kind)) @ projection(dim, low, seed) if len(part) else np.zeros((0, low))
        shards = max(1, math.ceil(counts[dim] / SHARD))
        tree = Tree(low_x, max(1, math.ceil(len(part) / shards)))
        tree.members = [m[:0] for m in tree.members]
        routes[dim] = (tree, base)
        base += len(tree.members)
    return routes


def place_queries(routes, low, seed, kind, others, reach):
    """Queries with the shards they go to: their own, or all others that the bound does not rule out."""

    def run(batches):
        for b in batches:
            out = []
            for dim, part in b.groupby("dim"):
                tree, base = routes[int(dim)]
                low_q = unit(doubles(part["vec"], kind)) @ projection(int(dim), low, seed)
                own = tree.leaves(low_q)
                for n, (i, v) in enumerate(zip(part["id"], part["vec"])):
                    if others is None:
                        out.append((i, v, base + int(own[n]), 0, 4.0))
                        continue
                    bound = float(part["bound"].iat[n])
                    for gap, leaf in tree.nearest_first(low_q[n]):
                        if gap > reach * bound:
                            break
                        if leaf != own[n]:
                            out.append((i, v, base + int(leaf), 0, bound))
                    if len(out) > 4096:
                        yield pd.DataFrame(out, columns=["id", "vec", "shard", "block", "bound"])
                        out = []
            if out:
                yield pd.DataFrame(out, columns=["id", "vec", "shard", "block", "bound"])

    return run


def _visit(queries: DataFrame, indexed: DataFrame, blocks: int, k: int, low: int, seed: int, kind: str, reach: float, out: str) -> DataFrame:
    """Search of query blocks in the shards they are sent to; a block and a shard meet in one task."""
    q = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    x = indexed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(qs) and len(xs):
            vec = doubles(xs["vec"], kind)
            plane = projection(vec.shape[1], low, seed)
            tree, ids, x_norm = Tree(unit(vec) @ plane, LEAF), [list(i) for i in xs["ids"]], norms(vec)
            asked = doubles(qs["vec"], kind)
            low_q = unit(asked) @ plane
            for n, (i, bound) in enumerate(zip(qs["id"].tolist(), qs["bound"].tolist())):
                for s, other in search_shard(tree, vec, x_norm, ids, low_q[n], asked[n], i, k, bound, reach):
                    rows.append((i, -other, s))
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    return q.groupBy("shard", "block").cogroup(x.groupBy("shard", "block")).applyInPandas(run, out)
