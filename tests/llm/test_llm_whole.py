"""Inputs on which the training-data operators once did less than the whole job."""

import math
import random

from rosterline.llm import html_extract, mixing, simhash


def test_template_texts_inside_articles(spark):
    """A line that every article of a host repeats belongs to the template; the article element is only evidence for the slot."""
    rows = [(i, f"http://h.example/{i}", f"<html><body><article><h1>Title {i}</h1><p>Send us your views</p><div><p>story {i} {'long ' * 20}</p></div>"
             f"<p>Send us your views</p></article></body></html>") for i in range(8)]
    rows += [(20 + i, f"http://g.example/{i}", f"<html><body><article>Teaser</article><div class=story><p>text {i} {'long ' * 20}</p></div></body></html>")
             for i in range(8)]
    rows.append((40, "http://one.example/", "<article><p>Send us your views</p></article>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    long = ("long " * 20).strip()
    assert [got[i] for i in range(8)] == [f"Title {i}\nstory {i} {long}" for i in range(8)]
    assert [got[20 + i] for i in range(8)] == [f"text {i} {long}" for i in range(8)]
    assert got[40] == "Send us your views"


def test_copies_of_a_page_are_no_template(spark):
    """Copies of one page hold more than half of a host's rows, exact and with another script; its text is no template text."""
    page = "<html><body><div>Our site</div><div><p>{0}</p></div><script>track({1})</script><div>All rights</div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format("the copied story " * 5, i // 2)) for i in range(12)]
    rows += [(20 + i, f"http://h.example/x{i}", page.format(f"story {i} " * 9, i)) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert {got[i] for i in range(12)} == {("the copied story " * 5).strip()}
    assert [got[20 + i] for i in range(5)] == [(f"story {i} " * 9).strip() for i in range(5)]


def test_names_inside_articles_are_judged_by_the_template(spark):
    """A telling class in an article is noise where the host's pages share it, and prose where one page has it."""
    def page(i):
        own = "<div class='related work'><p>prior studies</p></div><section class=search><p>how to search</p></section>" if i == 3 else ""
        return (f"<html><body class='p{i}'><div>Our site</div><article><p>story {i} {'long ' * 20}</p>{own}"
                f"<div class='share links'><p>tell {i}</p></div><div class='promo box'>offer {i * 7}</div></article><div>All rights</div></body></html>")

    pages = spark.createDataFrame([(i, f"http://h.example/{i}", page(i)) for i in range(9)], "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    long = ("long " * 20).strip()
    assert got == {i: f"story {i} {long}" + ("\nprior studies\nhow to search" if i == 3 else "") for i in range(9)}
    alone = {i: html_extract.main_text(html_extract.read_page(page(i))[0], None, set(), hash) for i in range(9)}
    assert all(alone[i] != got[i] for i in range(9))  # without the host's pages the names decide otherwise


def test_templates_equal_plain_occurrence_vectors(spark):
    """Fixed texts are those of valid classes, found by building every token's vector; without the template, results differ."""
    random.seed(4)
    lines = [f"line {k}" for k in range(6)]
    made = []
    for i in range(14):
        some = [x for x in lines if random.random() < 0.6]
        made.append("<html><body><div><p>Top of site</p></div><div>" + "".join(f"<p>{x}</p>" for x in some)
                    + f"<p>{' '.join(f'w{i}x{j}' for j in range(30))}</p></div><div><b>End of site</b></div></body></html>")
    made += made[:3]  # copies count once
    rows = [(i, f"http://h.example/{i}", x) for i, x in enumerate(made)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    vectors = {}
    distinct = list(dict.fromkeys(made))
    for i, x in enumerate(distinct):
        blocks, seen = html_extract.read_page(x)
        for path, n in seen.items():
            vectors.setdefault((path, None), [0] * len(distinct))[i] = n
        for b in blocks:
            vectors.setdefault((b.path, b.text), [0] * len(distinct))[i] = 1
    members = {}
    for token, v in vectors.items():
        if sum(map(bool, v)) >= max(3, 0.5 * len(distinct)):
            members.setdefault(tuple(v), []).append(token)
    fixed = {text for tokens in members.values() if len(tokens) >= 2 for _, text in tokens if text}
    found = html_extract.templates(pages.withColumn("host", html_extract.host_of())).collect()
    assert len(found) == 1 and {html_extract.hash_text(t) for t in fixed} == set(found[0]["fixed"])
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    for i, x in enumerate(made):
        assert got[i] == html_extract.main_text(html_extract.read_page(x)[0], found[0]["region"], fixed, lambda t: t, set())
        assert got[i] != html_extract.main_text(html_extract.read_page(x)[0], None, set(), hash)


def test_pages_of_any_length_and_repeated(spark):
    """A very long page is read whole; repeated rows give equal results; ids may be null."""
    long = "<p>" + "</p><p>".join(f"paragraph {i}" for i in range(60_000)) + "</p>"
    rows = [(1, "http://h.example/1", f"<article>{long}</article>"), (2, "http://h.example/2", "<p>x</p>"), (2, "http://h.example/2", "<p>x</p>"),
            (None, "http://h.example/3", "<p>y</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = sorted((r["page_id"] or 0, r["n_chars"], r["text"][-15:]) for r in html_extract.extract(pages).collect())
    whole = "\n".join(f"paragraph {i}" for i in range(60_000))
    assert got == [(0, 1, "y"), (1, len(whole), whole[-15:]), (2, 1, "x"), (2, 1, "x")]


def test_equal_fingerprints_are_compared(spark):
    """Texts that one repeated word rules have equal fingerprints; only those of similar text are copies, also of other texts than the first."""
    rng = random.Random(4)
    other = lambda: " ".join(f"x{rng.randrange(10**6)}" for _ in range(50))
    texts = ["ha " * 60 + other() for _ in range(6)]
    texts.append(texts[3] + " end")
    texts += [texts[2], " ".join(texts[2].split()).upper()]
    assert len({simhash.fingerprint(t) for t in texts}) == 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["id"]: r["component_id"] for r in simhash.near_duplicates(docs, radius=10, miss=0.05, similarity=0.8).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 3, 7: 2, 8: 2}
    assert {r["doc_id"] for r in simhash.deduplicated(docs).collect()} == set(range(6))


def test_bit_samples_keep_their_miss():
    """Whatever the number of fingerprints, all samples together miss a pair at the radius with the stated probability at most."""
    rng = random.Random(6)
    for n in (1000, 46_000, 230_000, 14_000_000):
        masks = simhash.sampled_masks(n, 14, 0.05)
        bits = masks[0].bit_count()
        assert (1 - math.comb(50, bits) / math.comb(64, bits)) ** len(masks) <= 0.05
        apart = [sum(1 << b for b in rng.sample(range(64), 14)) for _ in range(2000)]
        assert sum(all(m & d for m in masks) for d in apart) <= 0.08 * len(apart)


def test_near_copies_at_the_bound():
    """Texts at five-word Jaccard 0.8 lie within the radius and the sketch's limit."""
    rng = random.Random(8)
    lost = 0
    for _ in range(200):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        a, turn = simhash.shingle_set(" ".join(words), 5), list(words)
        while True:
            trial = list(turn)
            trial[rng.randrange(300)] = "new"
            b = simhash.shingle_set(" ".join(trial), 5)
            both = len(set(a) & set(b))
            if both < 0.8 * (len(a) + len(b) - both):
                break
            turn, c = trial, b
        x, y = simhash.fingerprint(" ".join(words)), simhash.fingerprint(" ".join(turn))
        far = ((x ^ y) & (2**64 - 1)).bit_count() > 14
        lost += far or ((simhash.sketch(a) ^ simhash.sketch(c)) & (2**64 - 1)).bit_count() > simhash.sketch_limit(0.8)
    assert lost <= 6


def test_gaps_are_filled_by_later_ranks(spark):
    """Documents that do not fit are stepped over, however many others it takes to come near the target."""
    rng = random.Random(12)
    rows = [(i, "w " * rng.randint(1, 150), "s") for i in range(600)] + [(1000 + i, "w " * 50_000, "s") for i in range(2)]
    rows += [(300, "w " * 40, "s"), (301, "w " * 70, "s"), (None, "w " * 5, "s"), (2000, "w " * 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for seed in (1, 2):
        got = mixing.mix(docs, seed=seed, weights=(1,), share=0.25)
        mine = [r for r in got.collect() if r["source"] == "s"]
        target = mine[0]["target"]
        taken = sum(r["taken"] for r in mine)
        units = {}
        for r in mine:
            units.setdefault(r["doc_id"], []).append(r)
        assert all(len({r["copies"] for r in u}) == 1 for u in units.values())
        open_ = [sum(r["size"] for r in u) for i, u in units.items() if i is not None and not u[0]["copies"]]
        assert taken <= target and all(taken + n > target for n in open_)
        again = mixing.mixed_documents(docs, seed=seed, weights=(1,), share=0.25)
        assert again.count() == got.agg({"copies": "sum"}).first()[0]
