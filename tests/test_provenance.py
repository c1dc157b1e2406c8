"""Places, contexts and blocks of candidates against plain loops."""

import random

from pyspark.sql import functions as F

from rosterline.functions import sql
from rosterline.functions import text as tx
from rosterline.operators import quality


def test_stab(spark):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        cuts = sorted(rng.sample(range(60), 2 * rng.randrange(5)))
        rows.append((i, list(zip(cuts[::2], cuts[1::2])), [rng.choice([None, *range(60)]) for _ in range(rng.randrange(8))]))
    df = spark.createDataFrame(rows, "k int, s array<struct<first:int,past:int>>, p array<int>")
    got = {r["k"]: r["g"] for r in df.select("k", F.expr(sql.stab("p", "s")).alias("g")).collect()}
    for k, spans, points in rows:
        assert got[k] == [None if p is None else next((n for n, (a, b) in enumerate(spans) if a <= p < b), None) for p in points]


def test_context_at(spark):
    rng = random.Random(6)
    text = "".join(rng.choice("ab é\n𝄞") for _ in range(1500))
    df = spark.createDataFrame([(text, p) for p in (0, 1, 19, 255, 256, 257, 511, 512, 900, 1480, 1499)], "t string, p int")
    assert all(a == b for a, b in df.select(F.expr(sql.context_at(sql.pieces("t"), "p", "20")), F.expr(tx.context("t", "p", 20))).collect())


def test_provenance(spark):
    text = ("Dear Team,\nPlease add two providers. TIN: 12-3456789\n\n\n\nProvider Name: Dr. Anna Abbott\nNPI: 1234567893\nSpecialty: Cardiology\n\n\n\n\n\n"
            "Provider Name: Dr. Brian Barnes\nNPI: 1679576722\nEffective Date: 01/02/2026\n" + "filler words\n" * 40)
    rows = [(1, text), (2, "NPI 1234567893 only"), (3, ""), (4, None)]
    prepared = spark.createDataFrame(rows, "msg_id long, text string").withColumn("html_content", F.lit(None).cast("string"))
    got = quality.provenance(prepared).collect()
    one = [r for r in got if r["msg_id"] == 1]
    fields = {r["field"] for r in one}
    assert {"npi", "tin", "date", "provider_name", "specialty", "transaction_type"} <= fields
    for r in one:
        if r["extractor_id"].startswith("npi_pattern"):
            line = text.count("\n", 0, r["position"])
            assert r["value"] in text[r["position"]:r["position"] + 40]
            assert r["block_id"] == (0 if line < 10 else 1)
        if r["position"] is not None:
            assert r["context"] == text[max(r["position"] - 30, 0):r["position"] + 30].replace("\n", " ").strip() or len(r["context"]) <= 40
    assert [r["block_id"] for r in one if r["field"] == "tin"] == [None] * sum(r["field"] == "tin" for r in one)
    assert all(sorted(r["rank"] for r in one if r["field"] == f) == list(range(sum(r["field"] == f for r in one))) for f in fields)
    assert {r["block_id"] for r in got if r["msg_id"] == 2 and r["field"] == "npi"} == {0}
    assert not [r for r in got if r["msg_id"] in (3, 4)]
    by_confidence = sorted((r for r in one if r["field"] == "npi"), key=lambda r: r["rank"])
    assert [r["confidence"] for r in by_confidence] == sorted((r["confidence"] for r in by_confidence), reverse=True)
