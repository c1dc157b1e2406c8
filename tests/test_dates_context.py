"""Word dates by their context: the sweep against plain loops, and records that follow the cue."""

import random

from pyspark.sql import functions as F

from rosterline.functions import sql
from rosterline.operators import entities, fusion


def test_nearest(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        spans = [(a, a + rng.randrange(3)) for a in (rng.randrange(60) for _ in range(rng.randrange(7)))]
        # a place inside a span would be its own word; cues never stand there
        rows.append((i, spans, [p for p in (rng.randrange(60) for _ in range(rng.randrange(7))) if not any(a < p < b for a, b in spans)]))
    df = spark.createDataFrame(rows, "k int, s array<struct<first:int,last:int>>, p array<int>")
    got = {r["k"]: r["g"] for r in df.select("k", F.expr(sql.nearest("s", "p", 999)).alias("g")).collect()}
    for k, spans, places in rows:
        want = [min([999, *(max(a - p, p - b, 0) for p in places)]) for a, b in spans]
        assert got[k] == want, (spans, places)


def test_word_places(spark):
    text = "a bb  cc\n\nbb x\tbb.bb"
    got = spark.createDataFrame([(text,)], "t string").select(F.expr(sql.word_places("t", "bb", "w"))).first()[0]
    assert got == [1, 3, 5, 5]


def test_long_text(spark):
    """Thousands of dates and cues in one message stay linear."""
    text = "3 March 2024 is one of the days " + " ".join(f"effective {1 + i % 28} May {2000 + i % 90} some more words" for i in range(3000)) + " word" * 30 + " 9 June 2031"
    got = spark.createDataFrame([(text,)], "t string").select(F.expr(entities.word_dates_in_context("t")).alias("c")).first()["c"]
    first = [c for c in got if c["pattern_ord"] == 0]
    assert len(first) == 3002 and first[-1]["confidence"] == 0.8 and all(c["confidence"] == 0.9 for c in first[:-1])


def test_record_takes_the_date_at_the_cue(spark):
    far = " word" * 12
    rows = [(1, f"Please add Dr. Anna Abbott. We met on 3 March 2024{far} effective 5 May 2025{far}"),
            (2, f"Please add Dr. Anna Abbott. We met on 3 March 2024{far} and 5 May 2025"),
            (3, f"Please terminate Dr. Anna Abbott.{far} Seen 3 March 2024{far} last day, her term, is 5 May 2025"),
            (4, f"Please add Dr. Anna Abbott. effective 3 March 2024{far} Effective Date: 07/01/2026"), (5, None)]
    df = spark.createDataFrame(rows, "msg_id long, text_content string").withColumn("html_content", F.lit(None).cast("string"))
    got = {r["msg_id"]: (r["effective_date"], r["term_date"]) for r in fusion.extract(df).collect()}
    gone = "Information not found"
    assert got == {1: ("05/05/2025", gone), 2: ("03/03/2024", gone), 3: (gone, "05/05/2025"), 4: ("07/01/2026", gone), 5: (gone, gone)}
