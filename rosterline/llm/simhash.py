"""SimHash near-duplicates: fingerprints, BK-trees per shard searched within a radius, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cells, group_starts, settle, ship, whole_groups
from .graph import components

ship(__name__)

#: unrelated fingerprints in a shard
SHARD = 1024
#: most fingerprints of one tree, and queries sent to it at a time
BLOCK = 2 * SHARD
#: the same as BLOCK where pairs are compared in rows
WIDE_BLOCK = 4096
#: radius from which a tree rules out next to nothing and pairs are compared in rows
WIDE = 5
#: documents of a block in which texts are compared
TEXTS = 256
#: shingles that are expanded to bits at a time
CHUNK = 1 << 16


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included; A-Z lower-cased, words split at ASCII white space.

    A text of fewer words is one shingle; null and blank texts have none.
    """
    w = (text or "").encode("utf-8").lower().split()
    if not w:
        return np.empty(0, dtype="<u8")
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) > words else [b" ".join(w)]
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), shingles), dtype="<u8")


def fingerprint(text: str | None, words: int = 3) -> int:
    """Signed 64-bit SimHash: a bit is 1 if more than half of the shingle hashes have it; 0 for no shingles."""
    h = shingle_hashes(text, words)
    ones = np.zeros(64, dtype=np.int64)
    for s in range(0, len(h), CHUNK):
        part = h[s:s + CHUNK]
        ones += np.unpackbits(part.view(np.uint8)).reshape(len(part), 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view("<i8")[0])


#: odd multipliers of the 64 hash functions of a sketch
MULTIPLIERS = np.random.default_rng(5).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(hashes: np.ndarray) -> int:
    """Signed 64 bits, one of the smallest hash under each of 64 functions; a bit differs with half the Jaccard distance of two sets; 0 for none."""
    if not len(hashes):
        return 0
    low = np.full(64, np.iinfo(np.uint64).max, dtype=np.uint64)
    for s in range(0, len(hashes), 1024):
        low = np.minimum(low, (hashes[s:s + 1024, None] * MULTIPLIERS).min(0))
    bits = ((low ^ low >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(63)).astype(bool)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def sketch_limit(similarity: float) -> int:
    """Differing sketch bits of pairs of the similarity: their mean and four standard deviations."""
    p = (1 - similarity) / 2
    return math.ceil(64 * p + 4 * math.sqrt(64 * p * (1 - p)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, sized: int | None = None) -> DataFrame:
    """``id``, ``fp`` (signed 64-bit) of every row, over whole texts; ``n`` counts its different ``sized``-word shingles, ``set`` is a hash and ``sketch`` a sketch of them (all 0 without ``sized``)."""

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            fp = pa.array([fingerprint(t, words) for t in texts], pa.int64())
            sets = [shingle_set(t, sized) if sized else None for t in texts]
            n = pa.array([0 if x is None else len(x) for x in sets], pa.int64())
            key = pa.array([0 if x is None else set_hash(x) for x in sets], pa.int64())
            drawn = pa.array([0 if x is None else sketch(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), fp, n, key, drawn], ["id", "fp", "n", "set", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long, n long, set long, sketch long")


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def set_hash(hashes: np.ndarray) -> int:
    h = xxhash.xxh64_intdigest(hashes.tobytes())
    return h - (1 << 64) if h >> 63 else h


class Node:
    """Node of a BK-tree; ``children`` are keyed by their Hamming distance to this node."""

    __slots__ = ("value", "row", "children")

    def __init__(self, value: int, row: int):
        self.value, self.row, self.children = value, row, {}


def insert(root: Node, value: int, row: int) -> None:
    node = root
    while True:
        d = (node.value ^ value).bit_count()
        child = node.children.get(d)
        if child is None:
            node.children[d] = Node(value, row)
            return
        node = child


def visits(root: Node, value: int, radius: int) -> Iterator[tuple[int, int]]:
    """(distance, row) of the nodes that a search compares.

    A node at distance d of the query has its matches only below edges of
    d - radius to d + radius (triangle inequality); other edges are skipped.
    """
    todo = [root]
    while todo:
        node = todo.pop()
        d = (node.value ^ value).bit_count()
        yield d, node.row
        for edge, child in node.children.items():
            if d - radius <= edge <= d + radius:
                todo.append(child)


def search(root: Node, value: int, radius: int) -> list[tuple[int, int]]:
    """(distance, row) of the nodes within the radius."""
    return [(d, row) for d, row in visits(root, value, radius) if d <= radius]


def forest(values: list[int], own: np.ndarray, i: int, j: int, radius: int, accept=None) -> list[tuple[int, int, int]]:
    """(row, row, distance) of a spanning forest of a cell's links that ``accept(row, row)`` holds for (all by default).

    Within a block every value searches the tree of those before it; of two
    blocks, block j searches the tree of block i.  Nearest links come first.
    A link is left out only if accepted ones already join its two ends.
    """
    links, root = [], None
    for row, value in enumerate(values):
        if i != j and own[row] != i:
            continue
        if i == j and root is not None:
            links += [(d, other, row) for d, other in search(root, value, radius)]
        if root is None:
            root = Node(value, row)
        else:
            insert(root, value, row)
    if i != j and root is not None:
        for row, value in enumerate(values):
            if own[row] == j:
                links += [(d, other, row) for d, other in search(root, value, radius)]
    parent = list(range(len(values)))

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for d, a, b in sorted(links):
        x, y = top(a), top(b)
        if x != y and (accept is None or accept(a, b)):
            parent[max(x, y)] = min(x, y)
            out.append((a, b, d))
    return out


def scan(values: np.ndarray, own: np.ndarray, i: int, j: int, radius: int, few: np.ndarray, most: np.ndarray, ratio: float,
         drawn: np.ndarray, limit: int, loose: np.ndarray) -> list[tuple[int, int, int]]:
    """A forest as ``forest`` gives, nearest not first: every pair is compared, 256 rows at a time.

    Counts may differ by ``ratio``, sketches by ``limit`` bits; ``loose`` rows have several sketches.
    """
    rows = np.flatnonzero(own == i) if i != j else np.arange(len(values))
    cols = np.flatnonzero(own == j) if i != j else rows
    top, out = np.arange(len(values)), []
    for s in range(0, len(rows), 256):
        part = rows[s:s + 256]
        d = np.bitwise_count(values[part][:, None] ^ values[cols][None, :])
        near = (d <= radius) & (most[part][:, None] >= ratio * few[cols][None, :]) & (most[cols][None, :] >= ratio * few[part][:, None])
        if limit < 64:
            apart = np.bitwise_count(drawn[part][:, None] ^ drawn[cols][None, :]) > limit
            near &= ~apart | loose[part][:, None] | loose[cols][None, :]
        if i == j:
            near &= cols[None, :] > part[:, None]
        for x in np.flatnonzero(near.any(1)):
            row, at = part[x], np.flatnonzero(near[x])
            roots, first = np.unique(top[cols[at]], return_index=True)
            fresh = roots != top[row]
            if fresh.any():
                out += [(int(row), int(cols[y]), int(d[x, y])) for y in at[first[fresh]]]
                joined = np.append(roots, top[row])
                top[np.isin(top, joined)] = joined.min()
    return out


def exact_masks(n: int, radius: int) -> list[int]:
    """Shard keys that miss no pair within the radius.

    radius + 1 masks of different bits: ``radius`` differing bits spoil at
    most as many masks, so two values agree under one of them at least.  The
    masks are as wide as it takes that about ``SHARD`` of n unrelated values
    share a key, so that every tree is large enough to prune and a value is
    copied radius + 1 times at every n.
    """
    bits = min(64 // (radius + 1), max(0, math.ceil(math.log2(max(n, 1) / SHARD))))
    return [((1 << bits) - 1) << k * bits for k in range(radius + 1)] if bits else [0]


def sampled_masks(n: int, radius: int, miss: float, seed: int = 3) -> list[int]:
    """Shard keys of randomly drawn bit positions, for radii at which whole blocks would be too short.

    A sample of b of the 64 bits misses d differing bits with the probability
    C(64 - d, b) / C(64, b).  b keeps about ``SHARD`` unrelated values in a
    shard, and there are as many samples as it takes that all of them miss a
    pair at the radius with a probability of ``miss`` at most, at every n.
    """
    bits = min(48, max(8, math.ceil(math.log2(max(n, 2) / SHARD))))
    hit = math.comb(64 - radius, bits) / math.comb(64, bits)
    keys = max(1, math.ceil(math.log(miss) / math.log1p(-hit))) if hit < 1 else 1
    rng = np.random.default_rng(seed)
    return [sum(1 << int(p) for p in rng.choice(64, bits, replace=False)) for _ in range(keys)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(classes: DataFrame, radius: int, masks: list[int], size_ratio: float = 0.0, limit: int = 64) -> DataFrame:
    """``a``, ``b``, ``d``: links of distinct fingerprints (``rep``, ``fp``, ``n``) that connect all that are within the radius.

    Links need counts of which the smaller is ``size_ratio`` of the larger at
    least; a fingerprint of several sets has counts from ``n`` to ``most``.
    With ``limit``, sketches of single sets differ in at most so many bits.

    A shard holds the fingerprints that agree under one mask.  Its tree is
    sent to the query blocks of that shard only; a shard of many fingerprints
    is cut into trees and query blocks of bounded size, and every tree meets
    every block.
    """
    most = F.col("most" if "most" in classes.columns else "n").alias("most")
    drawn = (F.col("sketch") if limit < 64 else F.lit(0).cast("long")).alias("sketch")
    loose = (F.col("loose") if limit < 64 else F.lit(True)).alias("loose")
    sharded = classes.filter("rep is not null").select("rep", "fp", "n", most, drawn, loose, F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("m", "key"))
    at = ["m", "key", "i", "j"]

    def run(batches):
        for b in whole_groups(batches, at):
            starts = group_starts(b, at)
            ends = np.append(starts[1:], len(b))
            many = ends - starts > 1
            rep, fp, few, most = b["rep"].to_numpy(), b["fp"].to_numpy().view("u8"), b["n"].to_numpy(), b["most"].to_numpy()
            own, i, j = (b[c].to_numpy() for c in ("own", "i", "j"))
            drawn, loose = b["sketch"].to_numpy().view("u8"), b["loose"].to_numpy()
            out = []
            for s, e in zip(starts[many], ends[many]):
                if radius >= WIDE:
                    near = scan(fp[s:e], own[s:e], i[s], j[s], radius, few[s:e], most[s:e], size_ratio, drawn[s:e], limit, loose[s:e])
                    out += [(rep[s + x], rep[s + y], d) for x, y, d in near]
                    continue
                low, high = few[s:e].tolist(), most[s:e].tolist()
                near = forest(fp[s:e].tolist(), own[s:e], i[s], j[s], radius,
                              lambda x, y: high[x] >= size_ratio * low[y] and high[y] >= size_ratio * low[x])
                out += [(rep[s + x], rep[s + y], d) for x, y, d in near]
            if out:
                yield pd.DataFrame(out, columns=["a", "b", "d"])

    return cells(sharded, ["m", "key"], "rep", WIDE_BLOCK if radius >= WIDE else BLOCK).mapInPandas(run, "a long, b long, d int").distinct()


def similar_links(found: DataFrame, spots: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, radius: int, words: int,
                  similarity: float) -> DataFrame:
    """``a``, ``b``: links that join all texts of a candidate group which are within the radius and similar.

    A candidate group is a component of ``found``, or a fingerprint that
    several shingle sets share.  Its members are the classes, each with the
    different hashes of its whole text's ``words``-word shingles; they meet in cells
    of two blocks of 256.  In a cell every pair of fingerprints within the
    radius is compared by the exact Jaccard similarity, nearest first, unless
    links found there already join the two; no pair of texts leaves its task.
    """
    parts = components(found.select("a", "b")).withColumnRenamed("node", "rep")
    groups = (
        spots.join(parts, "rep", "left").filter("component is not null or sets > 1")
        .select("fp", F.coalesce("component", "rep").alias("component"))
    )
    wanted = classes.filter("rep is not null").select("rep", "fp", "set").join(groups, "fp")
    texts = (
        docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
        .join(wanted.hint("merge"), "rep").withColumn("same", F.xxhash64("text")).dropDuplicates(["rep", "fp", "set", "same"])
    )

    def hashes(batches):
        for b in batches:
            sets = [shingle_set(t.as_py(), words) for t in b.column("text")]
            # rows that repeat an id may hold other texts than the class
            own = pa.array([set_hash(x) == k for x, k in zip(sets, b.column("set").to_pylist())], pa.bool_())
            sets = pa.array([x.tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("fp"), b.column("component"), sets], ["rep", "fp", "component", "sets"]).filter(own)

    members = settle(
        texts.select("rep", "fp", "component", "set", "text").mapInArrow(hashes, "rep long, fp long, component long, sets binary"), "near-texts")
    at = ["component", "i", "j"]

    def compare(batches):
        for b in whole_groups(batches, at):
            starts = group_starts(b, at)
            rep, fp = b["rep"].to_numpy(), b["fp"].to_numpy().view("u8")
            own, i, j = (b[c].to_numpy() for c in ("own", "i", "j"))
            out = []
            for s, e in zip(starts, np.append(starts[1:], len(b))):
                sets = [np.frombuffer(x, dtype="<u8") for x in b["sets"].iloc[s:e]]

                def alike(x, y):
                    p, q = sets[x], sets[y]
                    if min(len(p), len(q)) < similarity * max(len(p), len(q)):
                        return False
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    return both >= similarity * (len(p) + len(q) - both)

                out += [(rep[s + x], rep[s + y]) for x, y, _ in forest(fp[s:e].tolist(), own[s:e], i[s], j[s], radius, alike)]
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    return cells(members, ["component"], "rep", TEXTS).mapInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2,
                    miss: float | None = None, similarity: float | None = None, check_words: int = 5) -> DataFrame:
    """``id``, ``fp`` and ``component_id`` (smallest id reachable over links) of every row.

    Without ``similarity`` equal fingerprints are one class.  Fingerprints
    within ``radius`` bits link: without ``miss`` exactly, by shards that
    miss none; with ``miss`` by random bit samples that miss a pair at the
    radius with that probability at most, whatever the size, for large radii.
    With ``similarity`` a class is a fingerprint and a set of ``check_words``-word
    shingles, and links between different sets, of one fingerprint too, must
    also reach that Jaccard similarity.

    Null and blank texts have fingerprint 0, linked like any other.  Rows that
    repeat an id are one document; their component is the smallest of theirs.
    An empty table gives an empty result.  Other columns are ignored.
    """
    fps = settle(fingerprints(docs, id_col, text_col, words, check_words if similarity is not None else None), "fingerprints")
    classes = settle(fps.groupBy("fp", "set").agg(F.min("id").alias("rep"), F.min_by("n", "id").alias("n"), F.min_by("sketch", "id").alias("sketch")), "fingerprint-classes")
    spots = classes
    if similarity is not None:
        spots = settle(classes.groupBy("fp").agg(
            F.min("rep").alias("rep"), F.min("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("sets"),
            F.min("sketch").alias("sketch"), (F.count("*") > 1).alias("loose")), "fingerprint-spots")
    masks = sampled_masks(spots.count(), radius, miss) if miss else exact_masks(spots.count(), radius)
    found = links(spots, radius, masks, similarity or 0.0, sketch_limit(similarity) if miss and similarity is not None else 64)
    if similarity is not None:
        found = similar_links(found, spots, classes, docs, id_col, text_col, radius, check_words, similarity)
    parts = components(found.select("a", "b"))
    named = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "set", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, ["fp", "set"], "left").select("id", "fp", "component_id")


def deduplicated(docs: DataFrame, radius: int = 14, miss: float = 0.05, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """The documents without those that are a near copy of one with a smaller ``doc_id``; columns as they came.

    Candidates are fingerprints (three-word shingles) within ``radius`` bits,
    of which at most ``miss`` go unfound at the radius, whatever the size;
    copies are texts whose five-word shingles have a Jaccard similarity of 0.8
    or more, whether or not their fingerprints are equal.  Rows without a
    doc_id stay.
    """
    near = near_duplicates(docs.filter("doc_id is not null"), words=3, radius=radius, miss=miss, similarity=similarity, check_words=words)
    gone = settle(near.filter("component_id <> id").select(F.col("id").alias("doc_id")).distinct(), "near-copies")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
