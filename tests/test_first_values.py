"""Values of records: the first candidates of the scans, found without making every candidate."""

import pytest
from pyspark.sql import functions as F

from rosterline.functions import sql
from rosterline.operators import entities, fusion, patterns
from rosterline.vocab.transactions import ATTRIBUTE_WEIGHTS, TYPE_WEIGHTS

from test_gates import odd_texts, values


@pytest.fixture(scope="module")
def texts(spark):
    frame = spark.createDataFrame(list(enumerate(odd_texts())), "id int, text string").repartition(4).cache()
    frame.count()
    return frame


@pytest.mark.parametrize("field", [f for f in patterns.FIELDS if f != "npi"])
def test_first_value_is_the_value_of_the_first_candidate(texts, field):
    exprs = {"lazy": patterns.first_value("text", field), "scan": f"get({patterns.scan('text', field)}, 0).value"}
    found = values(texts, exprs)
    assert all(r["lazy"] == r["scan"] for r in found.values())
    assert any(r["scan"] for r in found.values())


def test_first_values_are_the_first_candidates(texts):
    found = values(texts, {"lazy": patterns.first_values("text", "npi", 2), "scan": f"transform({patterns.scan('text', 'npi')}, c -> c.value)"})
    assert all(r["lazy"][:2] == r["scan"][:2] for r in found.values())
    assert any(len(r["scan"]) > 1 for r in found.values())


def test_best_date_is_the_most_confident(texts):
    plain = sql.let(
        f"concat({patterns.scan('text', 'date')}, {entities.word_dates_in_context('text')})", "every",
        "array_max(transform(every, (d, i) -> named_struct('confidence', d.confidence, 'ord', -i, 'value', d.value))).value")
    found = values(texts, {"lazy": fusion._best_date("text"), "plain": plain})
    assert all(r["lazy"] == r["plain"] for r in found.values())
    assert len({r["plain"] for r in found.values()}) > 5


@pytest.mark.parametrize("weights", [TYPE_WEIGHTS, ATTRIBUTE_WEIGHTS])
def test_weighted_sums_count_whole_phrases(spark, weights):
    phrases = [p for listed in weights.values() for p, _ in listed]
    # a phrase without its first character, and a word that ends in one, are no hits
    rows = [" / ".join(phrases[i::7]) for i in range(7)] + phrases + [p[1:] for p in phrases] + ["greet the suit", ""]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, low string")
    hits = entities.weighted_hits("low", weights)
    found = values(frame, {k.replace(" ", "_"): sql.let(hits, "wh", entities.weighted_sum("wh", k)) for k in weights})
    for i, text in enumerate(rows):
        for kind, listed in weights.items():
            total = 0.0
            for phrase, weight in listed:
                total += weight if phrase in text else 0.0
            assert found[i][kind.replace(" ", "_")] == total, (text, kind)


def test_blocks_are_scanned_only_for_what_is_missing(spark, monkeypatch):
    """The block's own specialty scan fails, yet a record whose specialty stands in a table cell is made."""
    plain = entities.first_specialty
    monkeypatch.setattr(
        entities, "first_specialty",
        lambda text, specialties=None: f"if(length({text}) > 0, cast(raise_error('scanned') as string), {plain(text, specialties)})")
    text = "Please add:\n\nProvider Name: Dr. Ann Lee\nProvider NPI: 1234567893\nSpecialty: Cardiology\nTIN: 12-3456789\n"
    messages = spark.createDataFrame([(1, text, None)], "msg_id long, text_content string, html_content string")
    row = fusion.extract(messages).first()
    assert row["provider_specialty"] == "Cardiology"
    with pytest.raises(Exception, match="scanned"):
        fusion.extract(messages.withColumn("text_content", F.lit("Please add Dr. Ann Lee, NPI: 1234567893"))).collect()
