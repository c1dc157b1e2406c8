"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, settle, ship

ship(__name__)

#: cells per source in which the cut is looked for
BINS = 4096


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def by_length(size: Column) -> Column:
    """Odds factor of a document in the registered mix: its words over 128, from 1/4 to 4, so that scraps are drawn less often."""
    return F.greatest(F.least(size / 128.0, F.lit(4.0)), F.lit(0.25))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """``source``, ``source_size``, ``target`` of one row per source (``source``, ``source_size``).

    Weights repeat over the sources in code-point order, null last.  The total
    is ``share`` of all sizes; a source stops at ``limit`` times its size and
    the excess goes to the others by weight, until none is above.  Each round
    fixes the sources that reached their limit; only sums go to the driver.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    s = settle(
        sizes.withColumn("rank", F.row_number().over(order) - 1)
        .withColumn("weight", F.get(turn, F.col("rank") % len(weights))).drop("rank"), "sources")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    left = float(min(share, limit) * total)
    level = 0.0
    while True:
        # a source is full once level * weight reaches its limit
        full = F.col("weight") * F.lit(level) >= F.col("source_size") * limit
        row = s.agg(F.sum(F.when(full, F.col("source_size") * limit).otherwise(0.0)).alias("held"),
                    F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        higher = (left - row["held"]) / row["open"]
        if higher <= level:
            break
        level = higher
    cap = F.col("source_size") * F.lit(float(limit))
    return s.select("source", "source_size", F.least(F.col("weight") * F.lit(level), cap).cast("double").alias("target"))


def _key(seed: int, pref: Column) -> Column:
    """Rank key of Pareto sampling, from the fractional part ``p`` of a source's ratio.

    With u from 52 bits of a hash, strictly between 0 and 1, q is
    (u / (1 - u)) / (p / (1 - p) * pref); the key q / (1 + q) grows with q and
    lies between 0 and 1, and 1 stands for documents that cannot be drawn.
    """
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source")), 12) + 0.5) / F.lit(float(1 << 52))
    odds = F.col("p") / (1 - F.col("p")) * pref
    q = u / (1 - u) / odds
    return F.when(odds > 0, q / (1 + q)).otherwise(1.0)


def cuts(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, seed: int = 5,
         size: Column | None = None, preference: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """What the mix takes of each source: ``source``, ``source_size``, ``target``, ``whole``, ``p``, ``cut``, ``cut_id``, ``rounds``.

    The second frame has the ``words`` of documents of several rows that lie beyond the cut (``source``, ``doc_id``, ``pref``).

    A source of size S and target T takes every document r = T/S times on
    average: floor(r) whole copies for certain, and one more for a sample of
    the words that remain.  The sample is Pareto order sampling: with u
    uniform on (0, 1) from a hash of the document and inclusion probability p,
    documents are ranked by (u / (1 - u)) / (p / (1 - p)) and taken in that
    order up to the words that remain.  p is the fractional part of r;
    ``preference`` multiplies its odds per document.  A document that does not
    fit is stepped over: the later ranks, without documents larger than the
    gap, are cut again by the gap, until no later document fits.  A round is
    the ranks it covers and the largest size it may take, so a row can tell
    by itself whether it is drawn.

    The cut is found without sorting a source in one task: words are summed in
    4,096 cells of the rank key per source, three times finer each time, and
    only the documents of the cell that holds the cut are ordered.
    """
    rows = docs.select("doc_id", "source", (word_count() if size is None else size).alias("size"),
                       (F.lit(1.0) if preference is None else preference).cast("double").alias("pref"))
    units = settle(rows.groupBy("source", "doc_id", "pref").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "mix-units")
    goal = targets(units.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, limit)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = settle(goal.withColumn("whole", F.floor(ratio)).withColumn("p", ratio - F.floor(ratio)), "mix-targets")
    ranked = settle(
        units.join(goal.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_")))
        .select("source", "doc_id", "pref", "words", "n", _key(seed, F.col("pref")).alias("key"),
                (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest")), "mix-ranks")
    found, beyond = _rounds(ranked)
    plan = settle(
        goal.alias("g").join(found.withColumnRenamed("source", "source_"), F.col("g.source").eqNullSafe(F.col("source_")), "left").drop("source_"),
        "mix-cuts")
    return plan, settle(beyond.filter("n > 1").select("source", "doc_id", "pref", "words"), "mix-repeated")


def taken(docs: DataFrame, plan: DataFrame, repeated: DataFrame, size: Column, seed: int = 5, preference: Column | None = None) -> DataFrame:
    """The rows with ``copies`` and their source's ``source_size`` and ``target``.

    Whether a row is drawn follows from its own hash and size and its source's
    row of ``plan``; only documents of several rows have their size in
    ``repeated``.  Texts are not shuffled unless one of these is too large to
    be broadcast (the planner knows their size).
    """
    rows = docs.withColumn("_size", size).withColumn("_pref", (F.lit(1.0) if preference is None else preference).cast("double"))
    rows = rows.join(plan.withColumnRenamed("source", "_source"), rows["source"].eqNullSafe(F.col("_source")))
    sums = repeated.select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("pref").alias("_p"), F.col("words").alias("_words"))
    rows = rows.join(
        sums, (rows["doc_id"] == F.col("_d")) & rows["source"].eqNullSafe(F.col("_s")) & rows["_pref"].eqNullSafe(F.col("_p")), "left")
    rows = rows.withColumn("_key", _key(seed, F.col("_pref"))).withColumn("_words", F.coalesce("_words", "_size"))
    drawn = (F.col("_key") < F.col("cut")) | ((F.col("_key") == F.col("cut")) & (F.col("doc_id") <= F.col("cut_id"))) | (
        (F.col("_words") > 0) & F.exists("rounds", lambda r: (
            (F.col("_words") <= r["largest"]) & _beyond("_key", r["low"], r["low_id"])
            & ((F.col("_key") < r["cut"]) | ((F.col("_key") == r["cut"]) & (F.col("doc_id") <= r["cut_id"]))))))
    return rows.withColumn("copies", (F.col("whole") + F.coalesce(drawn.cast("long"), F.lit(0))).cast("long")).drop(
        "_source", "whole", "p", "cut", "cut_id", "rounds", "_s", "_d", "_p", "_words", "_size", "_pref", "_key")


def _beyond(key: str, cut: Column, cut_id: Column) -> Column:
    """Whether a document ranks after a cut; those without an id do not."""
    return (F.col("doc_id").isNotNull()) & ((F.col(key) > cut) | ((F.col(key) == cut) & (F.col("doc_id") > cut_id)))


def mix(docs: DataFrame, seed: int = 5, size: Column | None = None, preference: Column | None = None, **options) -> DataFrame:
    """One row per document row: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``; see ``cuts``.

    Rows with equal source and doc_id are taken together.  Null source is a
    source, null text has size 0, documents of size 0 follow the same ranks
    (taken 0).  A source whose size is 0 takes nothing.  Rows without a doc_id
    are drawn like others but do not fill gaps.  An empty table gives an empty
    result.  Reruns agree whatever the partitioning.
    """
    narrow = settle(
        docs.select("doc_id", "source", (word_count() if size is None else size).alias("size"),
                    (F.lit(1.0) if preference is None else preference).cast("double").alias("pref")), "mix-sizes")
    plan, repeated = cuts(narrow, seed=seed, size=F.col("size"), preference=F.col("pref"), **options)
    return taken(narrow, plan, repeated, F.col("size"), seed, F.col("pref")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def _prefix(cells: DataFrame, by: list[str], order: str) -> DataFrame:
    """Words before each cell; at most ``BINS`` rows per group."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0)))


def _rounds(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``source``, ``cut``, ``cut_id``, ``rounds`` per source, and the documents beyond the first cut.

    Each round passes over the document at its end, which is larger than the
    gap that is left, and all others larger than that gap.
    """
    live = ranked.filter((F.col("rest") > 0) & (F.col("key") < 1.0))
    state = _cut(live.select("source", "doc_id", "words", "key", "rest")).withColumn("low", F.col("cut")).withColumn("low_id", F.col("cut_id")) \
        .withColumn("rounds", F.expr("cast(array() as array<struct<low:double,low_id:long,largest:long,cut:double,cut_id:long>>)"))
    first = state

    def after(documents, places):
        c = places.select(F.col("source").alias("source_"), "gap", "low", "low_id")
        return documents.join(c, F.col("source").eqNullSafe(F.col("source_"))).drop("source_").filter(_beyond("key", F.col("low"), F.col("low_id")))

    beyond = after(live.drop("rest"), first).drop("gap", "low", "low_id")
    left = beyond.select("source", "doc_id", "words", "key").filter("words > 0")
    while True:
        left = settle(
            after(left, state).filter("words <= gap").select("source", "doc_id", "words", "key", F.col("gap").cast("double").alias("rest")), "mix-left")
        if left.isEmpty():
            break
        found = _cut(left, 2).select(F.col("source").alias("s"), F.col("cut").alias("c"), F.col("cut_id").alias("i"), F.col("gap").alias("g"), F.lit(True).alias("found"))
        state = settle(
            state.join(found, F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source", "cut", "cut_id",
                F.when(F.col("found"), F.concat("rounds", F.array(F.struct(
                    "low", "low_id", F.floor("gap").cast("long").alias("largest"), F.col("c").alias("cut"), F.col("i").alias("cut_id")))))
                .otherwise(F.col("rounds")).alias("rounds"),
                F.coalesce("g", "gap").alias("gap"), F.coalesce("c", "low").alias("low"), F.coalesce("i", "low_id").alias("low_id")), "mix-cut")
        left = left.drop("rest")
    return state.select("source", "cut", "cut_id", "rounds"), beyond


def _cut(live: DataFrame, refinements: int = 3) -> DataFrame:
    """``source``, ``cut``, ``cut_id``, ``gap``: per source the last rank taken in order, and the words then left."""
    # refinements: the range that holds the cut is divided into cells, and the cell that holds it is the next range
    bounds = live.groupBy("source").agg(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"), F.lit(0).cast("long").alias("base"),
                                        F.first("rest").alias("rest"))
    for _ in range(refinements):
        bounds = settle(bounds, "mix-bounds")
        inside = live.drop("rest").join(bounds, live["source"].eqNullSafe(bounds["source"])).drop(bounds["source"]) \
            .filter("key >= low and key < high")
        step = (F.col("high") - F.col("low")) / BINS
        cell = F.least(F.floor((F.col("key") - F.col("low")) / step), F.lit(BINS - 1))
        summed = inside.withColumn("cell", cell).groupBy("source", "cell").agg(
            F.sum("words").alias("words"), F.first("low").alias("low"), F.first("high").alias("high"),
            F.first("base").alias("base"), F.first("rest").alias("rest"))
        at = _prefix(summed, ["source"], "cell").filter("base + before <= rest")
        last = at.groupBy("source").agg(F.max_by(F.struct("cell", "low", "high", "base", "before", "rest"), "cell").alias("c"))
        width = (F.col("c.high") - F.col("c.low")) / BINS
        bounds = last.select(
            "source", (F.col("c.low") + F.col("c.cell") * width).alias("low"),
            F.when(F.col("c.cell") == BINS - 1, F.col("c.high")).otherwise(F.col("c.low") + (F.col("c.cell") + 1) * width).alias("high"),
            (F.col("c.base") + F.col("c.before")).alias("base"), F.col("c.rest").alias("rest"))
    bounds = settle(bounds, "mix-bounds")
    near = live.drop("rest").join(bounds, live["source"].eqNullSafe(bounds["source"])).drop(bounds["source"])
    # a cell of 1 / 4096**3 of a source's ranks holds a handful of documents: order them
    w = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = near.filter("key >= low and key < high").withColumn("run", F.col("base") + F.sum("words").over(w)).filter("run <= rest") \
        .groupBy("source").agg(F.max(F.struct("run", "key", "doc_id")).alias("m"))
    return settle(
        bounds.alias("b").join(last.alias("l"), F.col("b.source").eqNullSafe(F.col("l.source")), "left").select(
            "b.source", F.coalesce("l.m.key", "b.low").alias("cut"), F.coalesce("l.m.doc_id", F.lit(-(1 << 63))).alias("cut_id"),
            (F.col("b.rest") - F.coalesce("l.m.run", "b.base")).alias("gap")), "mix-cut")


def mixed_documents(docs: DataFrame, seed: int = 5, odds: Callable[[Column], Column] | None = None, **options) -> DataFrame:
    """The documents, each as often as the mix takes it; columns as they came.  Copies repeat the row.

    ``odds`` gives the preference of a document from its number of words.
    """
    odds = odds or (lambda size: F.lit(1.0))
    plan, repeated = cuts(docs, seed=seed, preference=odds(word_count()), **options)
    columns = docs.columns
    rows = taken(docs.select(F.struct(*[docs[c] for c in columns]).alias("_row"), "doc_id", "source"), plan, repeated, word_count("_row.text"), seed,
                 odds(word_count("_row.text")))
    repeated = rows.select("_row", F.explode(F.expr("if(copies > 0, sequence(1, copies), cast(array() as array<bigint>))")).alias("_copy"))
    return repeated.select("_row.*")
