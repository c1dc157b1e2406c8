"""The similarity join of a batch against the scan in the row."""

import random

from pyspark.sql import functions as F

from rosterline.functions import similarity
from rosterline.functions.frames import explode_rows
from rosterline.operators import entities, fusion, phrases
from rosterline.vocab.specialties import SPECIALTIES

NAMES = ["Cardiology", "Pain Management", "ENT", "Oncology", "General Surgery", "Sports Medicine", "X",
         "Hospice and Palliative Medicine with Specialised Care of the Elderly Patient"]


def edited(rng, text):
    chars = list(text)
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(chars) + 1)
        if rng.random() < 0.5 and chars:
            chars.pop(min(at, len(chars) - 1))
        else:
            chars.insert(at, rng.choice("aeiou ntx"))
    return "".join(chars)


def some_phrases(rng, names):
    out = ["", "x", "en", "ent", "entx", "a e i o u", "c-a-r-d-i-o-l-o-g-y", "plain words"]
    for _ in range(400):
        name = rng.choice(names).lower()
        cut = name[rng.randrange(len(name)):][: rng.randrange(1, 20)] or name
        out.append(" ".join(filter(None, [rng.choice(["", "the", "our very long clinic of"]), edited(rng, rng.choice([name, cut])), rng.choice(["", "unit", "and more words here"])])))
    return out


def test_similar_names(spark):
    """No pair that the exact scan finds is missed, whatever the lengths."""
    for names, ratio, partial in ((NAMES, 80.0, 85.0), (list(SPECIALTIES), 80.0, 85.0), (NAMES, 70.0, 90.0)):
        longest = max(map(len, names))
        table = similarity.pattern_rows([(n, n.lower()) for n in names], partial)
        df = spark.createDataFrame([(p,) for p in some_phrases(random.Random(len(names)), names)] + [(None,)], "phrase string")
        best = f"coalesce({similarity.best_ratio('phrase', table, ratio, longest)}, {similarity.best_partial_ratio('phrase', table, partial, longest)})"
        want = {tuple(r) for r in df.filter("phrase <> ''").select("phrase", F.expr(best).alias("b")).filter("b IS NOT NULL").select("phrase", "b.label", "b.score").collect()}
        got = [tuple(r) for r in phrases.similar_names(df, phrases.names_table(spark, names), ratio, partial, longest).collect()]
        assert len(want) > 50 and len(got) == len(set(got)) and set(got) == want


def mails(spark):
    rng = random.Random(3)
    lines = ["specialty: Cardiolgy", "field: pediatrics, x", "works in sport medicine", "Rheumatologi", "nothing here", "area: critical car", "Neurosurgry unit", "207r00000x"]
    rows = [(i % 50, "\n".join(rng.choice(lines) for _ in range(rng.randrange(6)))) for i in range(120)] + [(7, None), (8, "")]
    return spark.createDataFrame(rows, "msg_id long, text string").withColumn("html_content", F.lit(None).cast("string")).repartition(3)


def in_row(df, scan):
    out = df.transform(explode_rows, ["msg_id"], scan("text"), "c").select("msg_id", "c.value", "c.confidence", "c.extractor_id")
    return sorted(tuple(r) for r in out.collect())


def test_batch_equals_row(spark):
    """Also where several rows share a message id."""
    df = mails(spark)
    columns = ["msg_id", "value", "confidence", "extractor_id"]
    fuzzy = phrases.fuzzy_specialties(df, ["msg_id"]).select(*columns)
    every = phrases.specialties_of(df, ["msg_id"]).select(*columns)
    assert sorted(tuple(r) for r in fuzzy.collect()) == in_row(df, entities.specialty_fuzzy)
    assert sorted(tuple(r) for r in every.collect()) == in_row(df, entities.specialties_union)
    assert phrases.specialties_of(df.limit(0), ["msg_id"]).count() == 0


def test_known_phrases(spark):
    """Candidates do not depend on where phrases are scored."""
    df = mails(spark)
    known = fusion.known_phrases(df)
    assert known and phrases.known_phrases(df, most=2) is None
    plain = fusion.candidates(df)
    assert plain.exceptAll(fusion.candidates(df, known=known)).count() == 0
    assert fusion.candidates(df, known=known).count() == plain.count() > 100
    assert in_row(df, lambda t: entities.specialty_fuzzy(t, known={})) == []
