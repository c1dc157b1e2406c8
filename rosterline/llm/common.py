"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import json
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: words of a text: runs without space, tab, line feed, vertical tab, form feed or carriage return
WORD = r"[^\x20\x09-\x0D]+"


def ship(module: str) -> None:
    """Send the functions of a module to executors by value; they need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)

#: shared folder of a session in one JVM that has no setting
_FOLDER: dict[str, str] = {}

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """New path below the folder that ``spark.checkpoint.dir`` names.

    Only where the setting is absent and everything runs in one JVM (tests) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _FOLDER.get("base")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _FOLDER["base"] = tempfile.mkdtemp(prefix="shared-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Later steps no longer depend on lost executors' shuffle files, are not
    computed twice, and the planner knows the size of what it reads.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches regrouped so that rows of equal keys, which must be adjacent, never span two of them."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        starts = group_starts(batch, keys)
        if len(starts) > 1:
            yield pd.concat([*held, batch.iloc[: starts[-1]]], ignore_index=True) if held else batch.iloc[: starts[-1]]
            held = [batch.iloc[starts[-1]:]]
        elif held and (held[0][keys].iloc[0] != batch[keys].iloc[0]).any():
            yield pd.concat(held, ignore_index=True)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True)


def group_starts(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Index of the first row of each run of equal keys."""
    new = np.zeros(len(frame), dtype=bool)
    new[:1] = True
    for k in keys:
        column = frame[k].to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def cells(rows: DataFrame, keys: list[str], element: str, block: int) -> DataFrame:
    """Split large buckets into cells that one task can compare.

    A bucket of n rows is dealt into g = ceil(n / block) blocks by a hash of
    ``element``; the pair of blocks i <= j is a cell, so that every pair of
    rows meets in exactly one cell, of about two blocks.  Added columns:
    ``own`` (the row's block), ``i`` and ``j`` (the cell).  Small buckets are
    one cell.  Rows of a cell come adjacent in one partition.
    """
    hot = settle(
        rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > block)
        .select(*keys, F.ceil(F.col("n") / block).cast("int").alias("g")), "hot-buckets")
    dealt = (
        rows.join(hot, keys, "left")
        .withColumn("g", F.coalesce("g", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64(element, F.lit(7)), F.col("g")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
        .drop("g", "other")
    )
    at = [*keys, "i", "j"]
    return dealt.repartition(*at).sortWithinPartitions(*at)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over links a[i]-b[i]."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


class Encoder:
    """Ids of a byte-level BPE vocabulary file, as the ``tokenizers`` library gives them without special tokens.

    Names of special tokens in a text are ordinary text.  The look-ahead of
    the published split pattern matters only before runs of white space; texts
    without such runs take the same pattern without it, which is faster.
    """

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        special = {t["content"] for t in data.get("added_tokens", [])}
        back = byte_alphabet()
        ranks = {bytes(back[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in special}
        whole = tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        plain = tiktoken.Encoding("plain", pat_str=pattern.replace(r"|\s+(?!\S)", ""), mergeable_ranks=ranks, special_tokens={})
        self._whole, self._plain = whole.encode_ordinary, plain.encode_ordinary
        self._whole_array, self._plain_array = whole.encode_to_numpy, plain.encode_to_numpy
        self._runs = regex.compile(r"\s\s").search
        self._ranks = ranks
        self.size = max(ranks.values()) + 1

    def ids(self, text: str) -> list[int]:
        return self._whole(text) if self._runs(text) else self._plain(text)

    def array(self, text: str) -> np.ndarray:
        """The same ids without a Python list."""
        return (self._whole_array if self._runs(text) else self._plain_array)(text, disallowed_special=())

    def tokens(self) -> dict[int, bytes]:
        return {i: token for token, i in self._ranks.items()}


def byte_alphabet() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable bytes stand for themselves, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def encoder(path: str | None) -> Encoder:
    """Encoder of a vocabulary file; the default is the 50k byte-level file of the installed public tokenizers."""
    import public_tokenizers

    return Encoder(path or public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
