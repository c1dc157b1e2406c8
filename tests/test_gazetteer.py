"""Dictionary tables: the constant of the plan, the automaton and its shards give the same rows."""

import random

from pyspark.sql import functions as F

from rosterline.operators import gazetteer
from rosterline.sources import dictionaries

ENTRIES = [
    (5, "Heart", "Cardiology"), (1, "heart surgery", "Surgery"), (2, "er", "Emergency"), (3, "er", "Urgent Care"), (4, "pm&r", "Rehab"), (6, "ob/gyn", "Obstetrics"),
    (7, "im", "Internal"), (8, "café", "Food"), (9, "a", "Letter"), (10, "surgery", "Surgery"), (11, "art", "Art"), (12, "(x", "Odd"), (13, "\\Q", "Quote"),
    (14, "ÉCOLE", "School"), (15, None, "None"), (16, "", "Empty"), (17, "lost", None), (18, "heart  rate", "Rate"), (19, "m", "Metre"),
]


def texts(spark):
    rng = random.Random(2)
    parts = ["heart", "HEART surgery", "er", "provider er", "over", "ER,", "Im", "cafés", "café.", "CAFÉ", "pm&r", "xheart", "heart_", "hearts", "art", "heart\tsurgery",
             "a", "ob/gyn", "école", "ÉCOLE", "Kelvin", "İm", "(x", "\\q", "heart  rate", " er ", "m", "\n", "never im here", "smart"]
    rows = [(i % 60, rng.choice([" ", "", ", "]).join(rng.choice(parts) for _ in range(rng.randrange(9)))) for i in range(400)]
    rows += [(1, None), (2, ""), (3, " ".join(rng.choice(parts) for _ in range(5000)))]
    return spark.createDataFrame(rows, "k long, text string").withColumn("value", F.lit("clash")).repartition(3)


def test_both_ways(spark):
    table = dictionaries.synonym_table(spark.createDataFrame(ENTRIES, "ord long, synonym string, canonical string"))
    assert {tuple(r) for r in table.collect()} >= {(2, "er", "Urgent Care"), (5, "heart", "Cardiology")} and table.count() == 15
    found = [sorted(tuple(r)[2:] + (r["k"],) for r in gazetteer.synonym_hits(texts(spark), ["k"], table, **how).collect())
             for how in ({}, {"constant": 0}, {"constant": 0, "shard": 4})]
    assert found[0] == found[1] == found[2] and len(found[0]) > 300
    assert gazetteer.synonym_hits(texts(spark), ["k"], table.limit(0)).count() == 0
    assert gazetteer.synonym_hits(texts(spark).limit(0), ["k"], table, constant=0).count() == 0


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "er", now', "A\nB"), (2, "im", "Internal"), (3, "im", "Later")], "ord long, synonym string, canonical string")
    want = {(1, 'say "er", now', "A\nB"), (2, "im", "Later")}
    for fmt in ("csv", "json", "parquet"):
        path = str(tmp_path / fmt)
        (df.write.options(header=True, escape='"') if fmt == "csv" else df.write).format(fmt).save(path)
        assert {tuple(r) for r in dictionaries.read_synonyms(spark, path, fmt).collect()} == want
