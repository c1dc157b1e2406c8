"""Single functions against plain definitions."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rosterline.functions import checks, similarity
from rosterline.functions import text as tx
from rosterline.operators import records, tables
from rosterline.sources import attachments
from rosterline.vocab.headers import header_rows
from rosterline.vocab.specialties import FALLBACK_SPECIALTIES, SPECIALTIES, reverse_map, taxonomy_map


def run(spark, items, expr):
    df = spark.createDataFrame(list(enumerate(items)), "i int, x string").select("i", F.expr(expr).alias("y"))
    return [r.y for r in df.orderBy("i").collect()]


def test_dictionary_sizes():
    assert (len(SPECIALTIES), sum(map(len, SPECIALTIES.values())), len(reverse_map()), len(taxonomy_map())) == (41, 221, 211, 35)
    assert len(FALLBACK_SPECIALTIES) == 22 and len(header_rows()) == 95
    assert reverse_map()["207r00000x"] == "Neurology" and reverse_map()["obgyn"] == "Gynecology"


def test_npi_checksum(spark):
    rnd = random.Random(5)
    ids = [str(rnd.randrange(10 ** 9, 10 ** 10)) for _ in range(500)]

    def plain(npi, odd):
        total = 0
        for i, d in enumerate(reversed("80840" + npi[:9])):
            v = int(d) * (2 if i % 2 == odd else 1)
            total += v - 9 if v > 9 else v
        return (10 - total % 10) % 10 == int(npi[9])

    assert run(spark, ids, checks.npi_checksum("x", "standard")) == [plain(i, 0) for i in ids]
    assert run(spark, ids, checks.npi_checksum("x", "compat")) == [plain(i, 1) for i in ids]


def test_dates(spark):
    cases = {"1/2/25": "01/02/2025", "02/31/2025": "02/31/2025", "12-1-50": "12/01/1950", "13/1/2025": None, "2025/3/9": "03/09/2025",
             "1/1/202": None, "1/1/1899": None, "x": None, " 4/5/2030 ": "04/05/2030"}
    assert run(spark, list(cases), checks.normalize_date("x")) == list(cases.values())
    strict = {"13/02/2025": "02/13/2025", "1/2/25": "01/02/2025", "1/2/2025x": None, "2025-3-9": "03/09/2025", "32/32/2025": None}
    assert run(spark, list(strict), checks.normalize_date_strict("x")) == list(strict.values())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev, row = row, [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[j]))
    return row[-1]


def ratio(a, b):
    return 200 * lcs(a, b) / (len(a) + len(b))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abdeinoprstvx #", min_size=1, max_size=25), min_size=20, max_size=40))
def test_header_ratio(spark, headers):
    got = run(spark, headers, tables.map_header("x"))
    for h, g in zip(headers, got):
        h = h.lower().strip()
        best = max(((ratio(h, v), -i, f) for i, (f, _, v, _) in enumerate(header_rows()) if h), default=(0, 0, None))
        if best[0] < 60:
            assert g is None
        else:
            assert g.field == best[2] and abs(g.score - best[0]) < 1e-9


def partial(a, b):
    a, b = sorted((a, b), key=len)
    out = max(ratio(a, b[max(o, 0):o + len(a)]) for o in range(1 - len(a), len(b)))
    if len(a) == len(b):
        out = max([out] + [ratio(b, a[max(o, 0):o + len(b)]) for o in range(1 - len(b), len(a))])
    return out


def test_partial_ratio(spark):
    rnd = random.Random(7)
    names = [n.lower() for n in SPECIALTIES]
    phrases = []
    for _ in range(80):
        t = list(rnd.choice(names))
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = rnd.choice(["", "x", "e", "or"])
        lead = " ".join(rnd.choice(["the", "doctor", "history", "field"]) for _ in range(rnd.randint(0, 25)))
        phrases.append(f"{lead} {''.join(t)}".strip()[: rnd.choice([5, 12, 400])] or "abcd")
    table = similarity.pattern_rows(list(zip(SPECIALTIES, names)))
    got = run(spark, phrases, similarity.best_partial_ratio("x", table, 85.0))
    for p, g in zip(phrases, got):
        best = max((partial(p, n), -i) for i, n in enumerate(names))
        assert (g is None) == (best[0] < 85), p
        if g is not None:
            assert abs(g.score - best[0]) < 1e-9 and g.label == list(SPECIALTIES)[-best[1]], p


def test_title_case(spark):
    items = ["o'neil-smith", "MARY ann", "3rd avenue", "élan vital", "", "x2y"]
    assert run(spark, items, tx.title_case("x")) == [s.title() for s in items]


def test_html_to_text(spark):
    html = "<p>A <b>bold</b> x</p><style>p {}</style><table><tr><td>K</td>\n<td>V &amp; W</td></tr></table><!-- c --><p>end</p>"
    assert run(spark, [html], tx.html_to_text("x")) == ["A bold x\nK | V & W\nend"]
    assert run(spark, [html], tx.html_to_text("x", compat=True))[0].split("\n")[:3] == ["A", "bold", " x"]


def test_quotes_and_compat(spark):
    assert run(spark, ["“a” – ‘b’…"], tx.normalize_punctuation("x")) == ["\"a\" - 'b'..."]
    assert run(spark, ["“a” – ‘b’…"], tx.normalize_punctuation("x", compat=True)) == ["“a” - ‘b’..."]


def test_names(spark):
    cases = {"smith, md": "Smith, M.D.", "dr. ann o'neil iii": "Dr. Ann O'Neil III", "": "Information not found"}
    assert run(spark, list(cases), records.normalize_provider_name("x")) == list(cases.values())
    assert run(spark, ["pine clinic of the bay"], records.normalize_organization("x")) == ["Pine Clinic of the BAY"]


def test_csv_records(spark):
    got = run(spark, ['a,"b, ""c""",\r\n"x\ny",,z'], attachments.csv_records("x"))
    assert got == [[["a", 'b, "c"', ""], ["x\ny", "", "z"]]]


def test_attachment_headers(spark):
    cases = {"NPI #": "npi", "Provider  Name": "provider_name", "Group NPI": "npi", "Line Of Business": "lob", "Other": None}
    assert run(spark, list(cases), attachments.map_attachment_header("x")) == list(cases.values())


def test_partial_similarity_at_a_lower_threshold(spark):
    """The pre-filters follow the threshold: plain windows give the same best phrase."""
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    def partial(text, phrase):
        short, long = sorted([text, phrase], key=len)
        n = len(short)
        windows = {long[max(0, o):max(0, o) + n - max(0, -o)] if o < 0 else long[o:o + n] for o in range(1 - n, len(long))}
        return max(200 * lcs(short, w) / (len(short) + len(w)) for w in windows if w)

    rng = random.Random(3)
    phrases = ["cardiology", "family medicine", "urology"]
    texts = ["".join(rng.choice("cardiolgyfmenu ") for _ in range(rng.randint(8, 40))) for _ in range(40)]
    texts += ["a crdiolgy clinic", "famly mediine", "the urolgy dept"]
    table = similarity.pattern_rows([(p, p) for p in phrases], 70.0)
    df = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", f"{similarity.best_partial_ratio('t', table, 70.0, 15)} AS b")
    for r in df.collect():
        want = max((partial(r["t"], p) for p in phrases if len(p) <= len(r["t"])), default=0)
        got = r["b"]["score"] if r["b"] else 0
        if all(len(p) <= len(r["t"]) for p in phrases):
            assert got == (pytest.approx(want) if want >= 70 else 0), r


def test_similarity_of_long_phrases(spark):
    """Phrases of more than 62 characters, alone and next to short ones, score like a plain LCS."""
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(5)
    long = ("pediatric emergency medicine and transport of critically ill children " * 3)[:200].strip()
    phrases = [long, "urology", long[:63]]
    longest = max(map(len, phrases))

    def damaged(p):
        t = list(p)
        for _ in range(rng.randint(0, len(t) // 8)):
            t[rng.randrange(len(t))] = rng.choice(["", "x", "or"])
        return "".join(t)

    texts = [damaged(p) for p in phrases for _ in range(5)] + ["plain words", ""]
    table = similarity.pattern_rows([(p, p) for p in phrases], 70.0)
    got = run(spark, texts, similarity.best_ratio("x", table, 70.0, longest))
    for t, g in zip(texts, got):
        want = max((200 * lcs(t, p) / (len(t) + len(p)), -i) for i, p in enumerate(phrases))
        assert (g is None) == (want[0] < 70), t
        if g is not None:
            assert g.score == pytest.approx(want[0]) and g.label == phrases[-want[1]], t

    def partial(text, phrase):
        short, tall = sorted([text, phrase], key=len)
        n = len(short)
        cuts = [tall[max(o, 0):max(o + n, 0)] for o in range(1 - n, len(tall))]
        return max(200 * lcs(short, c) / (n + len(c)) for c in cuts if c)

    framed = [f"field of {damaged(long)} in town", damaged(long[20:120]), f"the {damaged('urology')} desk"]
    got = run(spark, framed, similarity.best_partial_ratio("x", table, 70.0, longest))
    for t, g in zip(framed, got):
        want = max((partial(t, p), -i) for i, p in enumerate(phrases))
        assert g.score == pytest.approx(want[0]) and g.label == phrases[-want[1]], t
