"""Cheap tests before scans: same results as the plain scans on odd texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rosterline.functions import sql
from rosterline.operators import entities, patterns
from rosterline.vocab import specialties as sp

PIECES = [
    "NPI: 1234567890", "npi#1234567890", "1234567890 national", "Provider ID 1234567890", "TIN 12-3456789", "Tax  ID: 123456789", "EIN:12-3456789",
    "12-3456789", "PPG P123", "Group ID: AB12", "Shared Risk: x - P77", "ppg 's: a – Q12", "Phone: 555-123-4567", "Tel 5551234567", "(555) 123-4567",
    "Facsimile: 555 123 4567", "FAX 5551234567", "License A12345", "State Lic B12345", "Lic # C123456", "Effective Date: 01/02/2025", "End Date 1-2-25",
    "3/4/2025", "5 May 2025", "May 5, 2025", "22nd september  2025", "xmay 2025", "sep 2024", "term", "expires", "Dr. Ann Lee", "Ann Lee, M.D.", "Bob Ray MD",
    "Cy Fox DO", "D.O.", "Organization: Big Group", "Group Name: Acme", "Sunny Medical Group", "Pine Clinic & ABC", "Specialty: heart care", "field of ologists",
    "internal medicine", "pediatrician", "Practice area: eyes", "xCardiology.", "cardiology_", "obgyn,", "OB", "im", "pm&r", "children's emergency", "gié",
    "Kids", "İ", "hello", "under", ".", ",", "|", "\n", "\n", "\t",
]


def odd_texts(n=400):
    rng = random.Random(11)
    synonyms = list(sp.reverse_map())
    texts = []
    for _ in range(n):
        chosen = [rng.choice(PIECES if rng.random() < 0.75 else synonyms) for _ in range(rng.randint(0, 12))]
        chosen = [c.upper() if rng.random() < 0.2 else c for c in chosen]
        texts.append("".join(c + rng.choice([" ", " ", "", "\n", ", "]) for c in chosen))
    return texts


@pytest.fixture(scope="module")
def texts(spark):
    frame = spark.createDataFrame(list(enumerate(odd_texts())), "id int, text string").repartition(4).cache()
    frame.count()
    return frame


def values(frame, exprs):
    return {r["id"]: r.asDict(recursive=True) for r in frame.select("id", *[F.expr(e).alias(n) for n, e in exprs.items()]).collect()}


def scans():
    return {f: patterns.scan("text", f) for f in patterns.FIELDS} | {
        "name": entities.provider_names("text"), "org": entities.found_organizations("text"), "best_org": entities.organization("text"),
        "phrases": entities.specialty_phrases("text"), "dates": entities.word_dates("text"), "context": entities.word_dates_in_context("text"),
    }


def test_gated_scans_equal_plain_scans(texts, monkeypatch):
    gated = values(texts, scans())
    for module in (entities, patterns, sql):
        monkeypatch.setattr(module, "where", lambda test, array: array)
    monkeypatch.setattr(entities, "_organizations_likely", lambda text: "true")
    monkeypatch.setattr(entities, "_word_dates_likely", lambda text: "true")
    monkeypatch.setattr(sql, "FEW", -1)
    plain = values(texts, scans())
    assert gated == plain
    for name in scans():
        assert any(row[name] for row in plain.values()), name


def test_synonyms_are_found_by_their_endings(texts):
    """A custom dictionary too: one character, signs, and a synonym that ends like no word of the text."""
    own = {"A": ["x", "ob", "pm&r"], "B": ["lee", "care", "(eyes)"], "C": ["no such thing"]}
    for specialties in (None, own):
        got = values(texts, {"s": f"transform({entities.specialty_synonyms('text', specialties)}, h -> h.value)"})
        for n, text in enumerate(odd_texts()):
            assert got[n]["s"] == plain_synonyms(text, sp.reverse_map(specialties)), text


def plain_synonyms(text, entries):
    low, out = text.lower(), []
    for synonym, canonical in entries.items():
        body, short = re.escape(synonym), len(synonym) <= entities.SHORT_SYNONYM
        pattern = rf"(?ia)(?<![A-Za-z0-9_])(?:{body})(?![A-Za-z0-9_])" + ("" if short else rf"|{body}(?=[\s,.]|\Z)")
        found = re.search(pattern, text) if synonym in low else None
        if found and short:
            at, reach = found.start(), entities.VETO_REACH
            around = low[max(at - reach, 0):at] + low[at + len(synonym):at + len(synonym) + reach]
            found = not re.search(entities.SHORT_VETO, around)
        if found and canonical not in out:
            out.append(canonical)
    return out


def test_every_pattern_scan_is_gated():
    """Before, every pattern ran over every text, and a pattern of each word of a type was compiled for each text."""
    for field, needs in patterns.NEEDS.items():
        written = patterns.scan("text", field)
        assert len(re.findall(r"if\(\(contains\(lw", written)) == len(needs) + 1
    kind = entities.transaction_type("text")
    assert "w -> contains(low, w) AND low rlike" in kind and "w -> contains(low, w) AND get(" in kind
