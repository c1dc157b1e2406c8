"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosine check, connected components."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cells, group_starts, local_roots, settle, ship, whole_groups
from .graph import components

ship(__name__)

#: rows of a bucket that stand against each other in one go
BLOCK = 1024


def valid_bytes(vectors: list, dtype: str = "<f8") -> list[bytes | None]:
    """Bytes of each vector; None for vectors that are null, empty, zero or hold null or non-finite parts."""
    out = []
    for v in vectors:
        x = None if v is None else np.array(v, dtype="<f8")
        out.append(x.astype(dtype).tobytes() if x is not None and x.size and np.isfinite(x).all() and x.any() else None)
    return out


def unit(raw: pd.Series, dtype: str = "<f4") -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=dtype).reshape(len(raw), -1).astype("f8")
    x /= np.abs(x).max(1, keepdims=True)  # keeps squares of very small and very large parts in range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def tables_for(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a table, and number of tables, for n vectors.

    About 32 unrelated vectors share a bucket; a pair exactly at the threshold
    is found in some table with probability ``recall`` at least, closer pairs
    with a higher one.
    """
    bits = max(8, math.ceil(math.log2(max(n, 1) / 32))) if n > 32 else 8
    agree = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits))


def hyperplanes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((tables, dim, bits))


def signatures(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Signature of each row in each table (rows x tables)."""
    weight = 1 << np.arange(planes.shape[2], dtype=np.int64)
    return np.stack([(x @ p > 0) @ weight for p in planes], axis=1)


def link_cell(ids, copies, own, x, t, planes, threshold, i, j):
    """Links of one cell that no earlier table has: rows, weighted counts and local roots."""
    n = len(ids)
    hits = []
    for start in range(0, n, 256):
        stop = min(n, start + 256)
        found = x[start:stop] @ x.T >= threshold
        a, b = np.nonzero(found)
        hits.append((a + start, b))
    a = np.concatenate([h[0] for h in hits])
    b = np.concatenate([h[1] for h in hits])
    keep = (a < b) & ((own[a] != own[b]) if i != j else True)
    a, b = a[keep], b[keep]
    if len(a) and t:
        rows, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        earlier = signatures(x[rows], planes[:t])
        pa, pb = place[: len(a)], place[len(a):]
        new = np.empty(len(a), dtype=bool)
        for s in range(0, len(a), 65536):
            new[s:s + 65536] = ~(earlier[pa[s:s + 65536]] == earlier[pb[s:s + 65536]]).any(1)
        a, b = a[new], b[new]
    if not len(a):
        return None
    links = np.zeros(n, dtype=np.int64)
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    root = ids[order][local_roots(n, rank[a], rank[b])][rank]
    touched = links > 0
    return ids[touched], links[touched], root[touched]


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9,
                 recall: float = 0.995, seed: int = 11) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id`` and ``kept``.

    Links are pairs of cosine >= ``threshold`` (double precision, original
    vectors).  Equal vectors become one class first, counted map-side, so a
    vector that holds a third of all rows is one element.  Large buckets are
    split into cells of two blocks; a cell returns counts and a spanning star,
    never its pairs.  A pair that several tables find is counted in the first.

    Null, zero, empty or non-finite vectors link with nothing (0 links, own
    component, kept).  Vectors of different lengths never link.  Equal rows
    count as vectors of their own; different vectors of one id are one node.
    Rows without an id link with nothing but equal vectors.  An empty table
    gives an empty result.  Other columns are ignored.
    """
    kind = "<f4" if dict(vectors.dtypes)[vec_col] == "array<float>" else "<f8"

    def clean(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(valid_bytes(b.column("vec").to_pylist(), kind), pa.binary())], ["id", "vec"])

    rows = settle(
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).mapInArrow(clean, "id long, vec binary"),
        "vectors")
    classes = settle(
        rows.filter("vec is not null").groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "vector-classes")
    bits, tables = tables_for(classes.count(), threshold, recall)

    def sign(batches):
        for b in batches:
            for _, part in b.groupby(b["vec"].map(len)):
                x = unit(part["vec"], kind)
                sig = signatures(x, hyperplanes(x.shape[1], tables, bits, seed))
                for t in range(tables):
                    yield pd.DataFrame({"t": t, "dim": x.shape[1], "sig": sig[:, t], "rep": part["rep"].to_numpy(),
                                        "copies": part["copies"].to_numpy(), "vec": part["vec"].to_numpy()})

    signed = classes.filter("rep is not null").mapInPandas(sign, "t int, dim int, sig long, rep long, copies long, vec binary")
    keys = ["t", "dim", "sig"]

    def compare(batches):
        at = [*keys, "i", "j"]
        planes = {}
        for b in whole_groups(batches, at):
            starts = group_starts(b, at)
            out = []
            for s, e in zip(starts, [*starts[1:], len(b)]):
                if e - s < 2:
                    continue
                g = b.iloc[s:e]
                t, dim, i, j = (int(g[c].iat[0]) for c in ("t", "dim", "i", "j"))
                if dim not in planes:
                    planes[dim] = hyperplanes(dim, tables, bits, seed)
                found = link_cell(g["rep"].to_numpy(), g["copies"].to_numpy(), g["own"].to_numpy(), unit(g["vec"], kind), t,
                                  planes[dim], threshold, i, j)
                if found:
                    out.append(pd.DataFrame(dict(zip(("rep", "links", "root"), found))))
            if out:
                yield pd.concat(out, ignore_index=True)

    found = settle(
        cells(signed, keys, "rep", BLOCK).mapInPandas(compare, "rep long, links long, root long")
        .groupBy("rep", "root").agg(F.sum("links").alias("links")), "vector-links")
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    linked = (
        classes.join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
        .join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .select("vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "rep").alias("component_id"))
    )
    return rows.join(linked, "vec", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    ).withColumn("kept", F.col(id_col) == F.col("component_id"))
