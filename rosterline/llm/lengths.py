"""Exact length histogram of encoded documents; suffix sums answer for every context limit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import encoder, settle, ship

ship(__name__)

#: lengths of one block of the two-level sums
BLOCK = 1024


def token_lengths(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """``length`` of every row: ids of its whole text (null and empty: 0), without special tokens."""

    def run(batches):
        enc = None
        for b in batches:
            enc = enc or encoder(vocabulary)
            yield pa.RecordBatch.from_arrays([pa.array([len(enc.ids(t.as_py() or "")) for t in b.column(0)], pa.int64())], ["length"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "length long")


def histogram(lengths: DataFrame) -> DataFrame:
    """``length``, ``n_docs``: one row per length that occurs."""
    return lengths.groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """The histogram with sums over all lengths up to, and from, each length.

    ``docs_at_most``, ``tokens_at_most``, ``docs_at_least``, ``tokens_at_least``;
    ``truncated_tokens``: tokens left of the corpus when every document is cut
    to this length; ``lost_tokens``: what that cuts off; ``docs_cut``: documents
    it shortens; ``quantile``: share of documents up to this length; totals.

    Sums run within blocks of 1,024 lengths and over the blocks, so that no
    task sees more than 1,024 rows or one row per block.
    """
    block = F.floor(F.col("length") / BLOCK)
    rows = hist.withColumn("block", block).withColumn("tokens", F.col("length") * F.col("n_docs"))
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("tokens"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = sums.select(
        "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("docs", "tokens")],
        *[F.sum(c).over(whole).alias(f"total_{c}") for c in ("docs", "tokens")])
    inside = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    out = (
        rows.join(blocks, "block")
        .withColumn("docs_at_most", F.col("docs_before") + F.sum("n_docs").over(inside))
        .withColumn("tokens_at_most", F.col("tokens_before") + F.sum("tokens").over(inside))
    )
    cut = F.col("total_docs") - F.col("docs_at_most")
    truncated = F.col("tokens_at_most") + cut * F.col("length")
    return out.select(
        "length", "n_docs", F.col("tokens").alias("n_tokens"), "docs_at_most", "tokens_at_most",
        (cut + F.col("n_docs")).alias("docs_at_least"), (F.col("total_tokens") - F.col("tokens_at_most") + F.col("tokens")).alias("tokens_at_least"),
        cut.alias("docs_cut"), truncated.alias("truncated_tokens"), (F.col("total_tokens") - truncated).alias("lost_tokens"),
        (F.col("docs_at_most") / F.col("total_docs")).alias("quantile"), "total_docs", "total_tokens")


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """Smallest length that at least the share q of documents does not exceed; one row, null for an empty corpus."""
    return sums.filter(F.col("docs_at_most") >= F.lit(float(q)) * F.col("total_docs")).agg(F.min("length").alias("length"))


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """Totals at any context limit, also one that no document has: ``docs_cut``, ``truncated_tokens``, ``lost_tokens``."""
    over = F.col("length") > limit
    kept = F.sum(F.when(over, F.lit(limit)).otherwise(F.col("length")) * F.col("n_docs"))
    return sums.agg(
        F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("docs_cut"), F.coalesce(kept, F.lit(0)).alias("truncated_tokens"),
        F.coalesce(F.sum("n_tokens") - kept, F.lit(0)).alias("lost_tokens"))


def length_table(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Histogram and sums of a document table; an empty table gives an empty result.  Repeated rows count, other columns do not matter."""
    return suffix_sums(settle(histogram(token_lengths(docs, vocabulary)), "lengths"))
