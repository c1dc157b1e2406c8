"""The classifier chain: plain refit, labels of single categories, clashing columns, repeated ids."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterline.llm import toxicity


def corpus(spark, seed=3, n=400):
    rng = random.Random(seed)
    plain, bad, junk = ([f"{k}{i}" for i in range(60)] for k in ("plain", "vile", "junk"))
    docs, labels = [], []
    for i in range(n):
        kind = rng.choice(["plain", "plain", "bad", "junk", "both"])
        words = [rng.choice(plain) for _ in range(40)]
        if kind in ("bad", "both"):
            words[:6] = [rng.choice(bad) for _ in range(6)]
        if kind in ("junk", "both"):
            words[6:20] = [rng.choice(junk) for _ in range(14)]
        docs.append((i, " ".join(words)))
        labels.append((i, int(kind not in ("junk", "both")), int(kind in ("bad", "both"))))
    return docs, labels


DOC, LABEL = "doc_id long, text string", "doc_id long, quality int, toxic int"


def test_columns_come_back(spark):
    """Columns named like those of the operator keep their values."""
    docs, labels = corpus(spark)
    df = spark.createDataFrame(docs, DOC).selectExpr("*", "concat('own ', doc_id) AS _p", "7 AS p", "8 AS doc", "9 AS p_toxic", "10 AS toxic")
    kept = toxicity.without_toxic(df, spark.createDataFrame(labels, LABEL))
    assert kept.columns == df.columns
    rows = kept.collect()
    assert rows and all((r["_p"], r["p"], r["doc"], r["p_toxic"], r["toxic"]) == (f"own {r['doc_id']}", 7, 8, 9, 10) for r in rows)
    toxic = {i for i, _, t in labels if t}
    assert len({r["doc_id"] for r in rows} & toxic) < 0.05 * len(toxic)
    assert len({r["doc_id"] for r in rows} - toxic) > 0.95 * (len(docs) - len(toxic))


def test_labels_of_one_category(spark):
    """Documents that are labelled in one category only teach that one."""
    docs, labels = corpus(spark)
    half = [(i, q if i % 2 else None, t if not i % 2 else None) for i, q, t in labels] + [(None, 1, 1), (9999, 0, None), (5000, None, None)]
    got = {r["doc_id"]: r["toxic"] for r in toxicity.scored(spark.createDataFrame(docs, DOC), spark.createDataFrame(half, LABEL)).collect()}
    right = sum(got[i] == bool(t) for i, _, t in labels)
    assert right >= 0.95 * len(labels)
    only = [(i, None, t) for i, _, t in labels]
    got = {r["doc_id"]: r["toxic"] for r in toxicity.scored(spark.createDataFrame(docs, DOC), spark.createDataFrame(only, LABEL)).collect()}
    assert sum(got[i] == bool(t) for i, _, t in labels) >= 0.95 * len(labels)
    none = toxicity.scored(spark.createDataFrame(docs, DOC), spark.createDataFrame([], LABEL)).collect()
    assert len(none) == len(docs) and not any(r["toxic"] for r in none)


def test_repeated_ids(spark):
    """Several texts and labels of one id: reruns agree whatever the order of rows."""
    docs, labels = corpus(spark, n=200)
    docs = docs + [(i, f"other text {i} " * 5) for i in range(0, 200, 5)] + [(3, None), (4, ""), (None, "x"), (300, "long " * 100_000)]
    df, known = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels + labels[:20], LABEL)
    first = sorted(map(str, toxicity.scored(df.repartition(3), known).collect()))
    assert first == sorted(map(str, toxicity.scored(df.repartition(5, "text"), known.repartition(4)).collect()))
    assert len(first) == len(docs)


def plain_chain(rows, labels, fold, width):
    """The chain refitted by plain gradient descent on dense matrices."""
    x = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        x[i, r] = 1

    def fit(a, y):
        a = np.column_stack([a, np.ones(len(a))])
        w = np.zeros(a.shape[1])
        for _ in range(30_000):
            g = a.T @ (1 / (1 + np.exp(-a @ w)) - y) / len(y)
            g[:-1] += toxicity.PENALTY * w[:-1]
            w -= 0.5 * g
        return w

    held = np.zeros((len(rows), 0))
    for c in range(labels.shape[1]):
        own = np.zeros(len(rows))
        told = ~np.isnan(labels[:, c])
        for f in range(toxicity.FOLDS):
            seen, unseen = (fold != f) & told, fold == f
            w = fit(np.column_stack([x, held])[seen], labels[seen, c])
            own[unseen] = np.column_stack([x, held, np.ones(len(rows))])[unseen] @ w
        held = np.column_stack([held, np.clip(own, -8, 8)])
    return held


@pytest.mark.parametrize("missing", [0.0, 0.3])
def test_chain_against_plain(missing):
    """Out-of-fold logits of the chain equal those of a plain refit."""
    rng = np.random.default_rng(4)
    rows = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(90)]
    first = np.array([float((r < 3).sum() + rng.normal(0, 0.8) > 1.2) for r in rows])
    labels = np.column_stack([first, [float(a + (3 in r) + rng.normal(0, 0.5) > 0.9) for a, r in zip(first, rows)]])
    labels[rng.random(labels.shape) < missing] = np.nan
    fold = rng.integers(0, toxicity.FOLDS, 90)
    _, held = toxicity.train_chain(rows, labels, fold, 12)
    want = plain_chain(rows, labels, fold, 12)
    assert np.abs(held - want).max() < 0.15 and np.corrcoef(held[:, 1], want[:, 1])[0, 1] > 0.999
