"""Toxicity by a classifier chain of linear models trained with out-of-fold predictions."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, ship

ship(__name__)

#: labelled documents that training uses at most (those of smallest hash), and word features at most
SAMPLE, FEATURES = 10_000, 2_048
#: a feature must tell the classes of some category apart this well (log-likelihood ratio)
TELLING = 15.0
FOLDS, PENALTY, STEPS = 5, 1e-3, 60
#: kinds of features
KINDS = 6

LETTERS = re.compile(r"[^\W\d_]+")
MARKS = re.compile(r"[^\w\s]{2,}|[|~^]")


def features(text: str | None) -> list[set[str]]:
    """Features of a whole text by kind: words, their first 4, 5 and 6 letters, runs of marks, and the size class."""
    low = (text or "").lower()
    words = LETTERS.findall(low)
    kinds = set(words)
    return [kinds, *({w[:n] for w in kinds if len(w) >= n} for n in (4, 5, 6)), {m[:3] for m in MARKS.findall(low)}, {str(len(words).bit_length())}]


def named(text: str | None) -> list[str]:
    """The features as single strings, the kind's number in front."""
    return [f"{k}{f}" for k, found in enumerate(features(text)) for f in found]


def numbered(text: str | None, numbers: list[dict[str, int]]) -> np.ndarray:
    """Numbers of the features that a model knows."""
    return np.array([n[f] for found, n in zip(features(text), numbers) for f in found & n.keys()], dtype=np.int64)


def fit(rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on sparse 0/1 rows and dense ``extra`` columns: weights, extra weights, intercept.

    Minimises the mean loss with a ridge penalty.  With one class only, the intercept is its smoothed share.
    """
    n, positives, more = len(y), float(y.sum()), extra.shape[1]
    base = float(np.log((positives + 1) / (n - positives + 1)))
    start = np.concatenate([np.zeros(width + more), [base]])
    if not 0 < positives < n:
        return start[:width], start[width:-1], base
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    col = np.concatenate(rows) if len(row) else np.empty(0, dtype=np.int64)

    def loss(x):
        z = np.bincount(row, weights=x[col], minlength=n) + extra @ x[width:-1] + x[-1]
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        gradient = np.concatenate([np.bincount(col, weights=r[row], minlength=width), extra.T @ r, [r.sum()]])
        gradient[:-1] += PENALTY * x[:-1]
        return np.logaddexp(0, z).mean() - (y @ z) / n + PENALTY / 2 * (x[:-1] @ x[:-1]), gradient

    x = minimise(loss, start)
    return x[:width], x[width:-1], float(x[-1])


def minimise(loss, x: np.ndarray, steps: int = STEPS, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with step halving."""
    value, g = loss(x)
    past: list[tuple] = []
    for _ in range(steps):
        d, alphas = g.copy(), []
        for s, t in reversed(past):
            alphas.append((s @ d) / (s @ t))
            d -= alphas[-1] * t
        if past:
            s, t = past[-1]
            d *= (s @ t) / (t @ t)
        for (s, t), alpha in zip(past, reversed(alphas)):
            d += (alpha - (t @ d) / (s @ t)) * s
        step = 1.0
        while step > 1e-8:
            moved = x - step * d
            after, h = loss(moved)
            if after <= value - 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            return x
        if (moved - x) @ (h - g) > 1e-12:
            past = [*past[1 - memory:], (moved - x, h - g)]
        done = value - after < 1e-7 * abs(value)
        x, value, g = moved, after, h
        if done:
            break
    return x


def logits(rows: list[np.ndarray], extra: np.ndarray, model) -> np.ndarray:
    w, v, b = model
    return np.array([w[r].sum() for r in rows]) + extra @ v + b


def train_chain(rows: list[np.ndarray], labels: np.ndarray, fold: np.ndarray, width: int) -> tuple[list, np.ndarray]:
    """Models of the categories in order, and the out-of-fold logits of each (rows x categories).

    Each model sees the earlier categories' logits.  In training these come
    from models that did not see the row, as they will for new documents.  Rows
    without a label (NaN) in a category are not learnt from there, but have a
    logit for the later ones.
    """
    n, categories = labels.shape
    held = np.zeros((n, 0))
    models = []
    for c in range(categories):
        y, own = labels[:, c], np.zeros(n)
        told = ~np.isnan(y)

        def model_of(at):
            return fit([rows[i] for i in at], held[at], y[at], width) if len(at) else (np.zeros(width), np.zeros(held.shape[1]), -30.0)

        for f in range(FOLDS):
            unseen = np.flatnonzero(fold == f)
            if len(unseen):
                own[unseen] = logits([rows[i] for i in unseen], held[unseen], model_of(np.flatnonzero((fold != f) & told)))
        models.append(model_of(np.flatnonzero(told)))
        held = np.column_stack([held, np.clip(own, -8, 8)])
    return models, held


def threshold_of(logit: np.ndarray, y: np.ndarray) -> float:
    """Probability in the middle of the range of thresholds with the best F1 on out-of-fold predictions; 0.5 without positives."""
    if not y.any():
        return 0.5
    p = 1 / (1 + np.exp(-logit))
    grid = np.arange(0.1, 0.91, 0.02)
    f1 = [2 * (y & (p >= g)).sum() / (y.sum() + (p >= g).sum()) for g in grid]
    best = grid[np.array(f1) >= max(f1) - 1e-12]
    return float(best[len(best) // 2])


class Chain:
    """Trained chain: categories, feature numbers, models, thresholds."""

    def __init__(self, categories: list[str], numbers: list[dict[str, int]], models: list, thresholds: list[float]):
        self.categories, self.numbers, self.models, self.thresholds = categories, numbers, models, thresholds

    def scores(self, texts) -> pd.DataFrame:
        """Probability of each category, in the order of the chain."""
        rows = [numbered(t, self.numbers) for t in texts]
        held = np.zeros((len(rows), 0))
        out = {}
        for name, model in zip(self.categories, self.models):
            z = np.clip(logits(rows, held, model), -30, 30) if len(rows) else np.zeros(0)
            out[f"p_{name}"] = 1 / (1 + np.exp(-z))
            held = np.column_stack([held, np.clip(z, -8, 8)])
        return pd.DataFrame(out)

    def column(self, text: Column) -> Column:
        """Struct of the probabilities."""
        chain = self

        def score(texts: pd.Series) -> pd.DataFrame:
            return chain.scores(texts)

        score.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
        return F.pandas_udf(score, ", ".join(f"p_{c} double" for c in self.categories))(text)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE) -> Chain:
    """Chain over the 0/1 columns ``categories`` of ``labels`` (``doc_id``), in that order.

    Uses at most ``sample`` labelled documents, those whose id hashes lowest.
    Words are counted on the executors; the driver gets the features that tell
    some category apart (2,048 at most) and, per document of the sample, the
    numbers of those it has.  Each category learns from the documents that have a
    label in it; rows with a null id or no label at all are left out.  Several
    labels of one document count with their largest, several texts of one id
    with the greatest.  Without labels nothing is toxic.
    """
    spark = docs.sparkSession
    known = labels.select("doc_id", *[F.col(c).cast("int").alias(c) for c in categories]).na.drop(subset=["doc_id"]).na.drop(how="all", subset=categories)
    picked = known.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories]).orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id").limit(sample)
    picked = settle(picked, "toxicity-sample")
    # at most `sample` rows of an id and a few small numbers
    train_docs = settle(
        docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", *categories).agg(F.max("text").alias("text"))
        .select("doc_id", "text", *categories), "toxicity-documents")
    names = list(categories)

    def count(batches):
        # documents with a feature: all, and per category those with a label and those with a positive one
        total, sums = Counter(), {k: Counter() for k in per_category}
        for b in batches:
            for row in b.to_dict("records"):
                found = named(row["text"])
                total.update(found)
                for c in names:
                    if pd.notna(row[c]):
                        sums[f"m_{c}"].update(found)
                        if row[c]:
                            sums[f"n_{c}"].update(found)
        if total:
            frame = pd.DataFrame({"feature": list(total), "n": list(total.values())})
            for k, h in sums.items():
                frame[k] = [h[f] for f in frame["feature"]]
            yield frame[frame["n"] > 0]

    per_category = [f"{k}_{c}" for c in names for k in ("m", "n")]
    counted = train_docs.mapInPandas(count, "feature string, n long, " + ", ".join(f"{k} long" for k in per_category))
    counted = counted.groupBy("feature").agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in per_category]).filter("n >= 3")
    totals = train_docs.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in names for k, f in (("m", F.count), ("n", F.sum))]).first()
    if not totals["n"]:
        return Chain(names, [{}] * KINDS, [(np.zeros(0), np.zeros(k), -30.0) for k in range(len(names))], [0.5] * len(names))

    def telling(c: str) -> Column:
        """Log-likelihood ratio of the 2 x 2 table of feature and category."""
        a, f, y, n = F.col(f"n_{c}").cast("double"), F.col(f"m_{c}").cast("double"), float(totals[f"n_{c}"] or 0), float(max(totals[f"m_{c}"], 1))
        cells = [(a, f * y / n), (f - a, f * (n - y) / n), (y - a, (n - f) * y / n), (n - f - y + a, (n - f) * (n - y) / n)]
        return 2 * sum((F.when(o > 0, o * F.log(o / e)).otherwise(0.0) for o, e in cells), F.lit(0.0))

    best = counted.withColumn("g", F.greatest(F.lit(0.0), *[telling(c) for c in names])).filter(F.col("g") > TELLING)
    chosen = [r["feature"] for r in best.orderBy(F.col("g").desc(), "feature").limit(FEATURES).collect()]
    numbers: list[dict[str, int]] = [{} for _ in range(KINDS)]
    for i, f in enumerate(sorted(chosen)):
        numbers[int(f[0])][f[1:]] = i

    def sparse(batches):
        for b in batches:
            out = b[["doc_id", *names]].copy()
            out["f"] = [sorted(numbered(t, numbers)) for t in b["text"]]
            yield out

    data = train_docs.mapInPandas(sparse, "doc_id long, " + ", ".join(f"{c} int" for c in names) + ", f array<int>").toPandas().sort_values("doc_id")
    rows = [np.asarray(f, dtype=np.int64) for f in data["f"]]
    y = data[names].to_numpy().astype(float)
    fold = np.array([hash((int(i) * 2654435761) & 0xFFFFFFFF) >> 7 for i in data["doc_id"]]) % FOLDS
    models, held = train_chain(rows, y, fold, len(chosen))
    return Chain(names, numbers, models, [threshold_of(held[told, k], y[told, k] > 0) for k, told in enumerate((~np.isnan(y)).T)])


def label_categories(labels: DataFrame) -> tuple[DataFrame, list[str]]:
    """The categories of the ``labels`` table in chain order: junk first, which tells how to read marks and odd words, then toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic").cast("int").alias("toxic")), ["low_quality", "toxic"]


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``p_low_quality``, ``p_toxic`` and ``toxic`` of every row.

    Null and empty texts have only their size class as a feature.  Repeated
    rows score alike, an empty table gives an empty result, other columns are
    ignored.
    """
    chain = train(docs, *label_categories(labels), sample)
    p = docs.select("doc_id", chain.column(F.col("text")).alias("p"))
    return p.select("doc_id", "p.*").withColumn("toxic", F.col("p_toxic") >= chain.thresholds[-1])


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that are not toxic; columns as they came."""
    chain = train(docs, *label_categories(labels), sample)
    # the row travels as one column, so that no column of it can be taken for another
    rows = docs.select(F.struct("*").alias("doc"), chain.column(F.col("text")).alias("p"))
    return rows.filter(F.col("p.p_toxic") < chain.thresholds[-1]).select("doc.*")
