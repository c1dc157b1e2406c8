"""Sharding by minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, ship

ship(__name__)

#: atomic groups that the driver sees at most; equal keys never fall into two of them
ATOMS = 1 << 16
#: parts in which the rows of an atom are numbered
PARTS = 64


def feasible(sizes: list[int], capacity: int, shards: int) -> bool:
    """Whether a greedy walk fills at most ``shards`` shards of the capacity."""
    used, room = 1, capacity
    for s in sizes:
        if s > capacity:
            return False
        if s > room:
            used, room = used + 1, capacity
        room -= s
    return used <= shards


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Smallest capacity at which the ordered sizes fit into ``shards`` contiguous shards."""
    low, high = max([0, *sizes, -(-sum(sizes) // shards)]), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(sizes, middle, shards) else (middle + 1, high)
    return low


def cut(sizes: list[int], shards: int) -> list[int]:
    """Shard of each group: shards are closed where the smallest capacity demands it or, sooner, where the rest's even share is reached.

    No shard exceeds the smallest capacity.  Closing at the share of what is
    left (as long as the rest still fits) keeps the last shards from staying
    empty.
    """
    capacity = smallest_capacity(sizes, shards)
    need = [0] * (len(sizes) + 1)  # shards that the greedy walk needs from each group on
    ahead = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))])
    for k in range(len(sizes) - 1, -1, -1):
        need[k] = 1 + need[int(np.searchsorted(ahead, ahead[k] + capacity, side="right")) - 1]
    out, shard, filled = [], 0, 0
    for k, s in enumerate(sizes):
        share = (ahead[-1] - ahead[k] + filled) / (shards - shard)
        early = filled and filled + s / 2 > share and need[k] <= shards - shard - 1
        if filled + s > capacity or early:
            shard, filled = shard + 1, 0
        out.append(shard)
        filled += s
    return out


def shard(rows: DataFrame, key: Column, size: Column, shards: int = 24, atoms: int = ATOMS, order: str = "doc_id") -> DataFrame:
    """The rows with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Rows of equal ``key`` are never parted.  Keys are ordered by a 64-bit
    hash, and each 65,536th of the hash range is an atomic group; their sizes,
    added up map-side, are all the driver sees.  It searches the smallest
    capacity that fits and cuts there.  Sizes are therefore equal up to a few
    65,536ths, or up to the largest group of one key.

    Rows are numbered by ``order`` in 64 parts of each group, so that a key
    that holds a third of all rows is no single task.  Null keys are one
    group.  Repeated rows get slots of their own.
    """
    spark = rows.sparkSession
    h = F.shiftrightunsigned(F.xxhash64(key), 64 - (atoms.bit_length() - 1))
    part = F.pmod(F.xxhash64(F.col(order), F.lit(13)), F.lit(PARTS))
    dealt = settle(rows.select("*", size.alias("_size"), h.cast("int").alias("_atom"), part.cast("int").alias("_part")), "shard-rows")
    counts = settle(dealt.groupBy("_atom", "_part").agg(F.count("*").alias("n"), F.sum("_size").alias("size")), "shard-parts")
    groups = counts.groupBy("_atom").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).toPandas().sort_values("_atom")
    sizes = [int(x) for x in groups["size"]]
    of = cut(sizes, shards) if sizes else []
    groups["shard"] = np.array(of, dtype="int32")
    groups["before"] = (groups.groupby("shard")["n"].cumsum() - groups["n"]).astype("int64")
    schema = T.StructType([T.StructField("_atom", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("before", T.LongType())])
    plan = spark.createDataFrame([(int(a), int(s), int(b)) for a, s, b in zip(groups["_atom"], groups["shard"], groups["before"])], schema)
    earlier = Window.partitionBy("_atom").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # at most 65,536 rows of 16 bytes
    starts = counts.join(F.broadcast(plan), "_atom").select(
        "_atom", "_part", "shard", (F.col("before") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_atom", "_part").orderBy(F.col(order)))
    numbered = dealt.withColumn("_rank", rank).join(starts, ["_atom", "_part"])
    return numbered.withColumn("slot", F.col("_start") + F.col("_rank") - 1).drop("_atom", "_part", "_rank", "_start", "_size")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """``doc_id``, ``size`` (UTF-8 bytes plus 8), ``text_crc32``, ``law`` ("bytes"), ``shard``, ``slot``, ``grown_shard`` (null).

    Equal texts share a shard; null and empty texts are one group of size 8
    and checksum 0.  An empty table gives an empty result.  Other columns are
    ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.xxhash64(text).alias("_text"))
    out = shard(rows, F.col("_text"), F.col("size"), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))
