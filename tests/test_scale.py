"""Plans and work of queries that must keep their pace on larger tables."""

import pytest

from rosterline.functions import similarity
from rosterline.operators import entities, gazetteer
from rosterline.plans import catalog
from rosterline.sources import dictionaries, mail
from rosterline.vocab import specialties as sp


def below_first_shuffle(df):
    """The part of a plan that runs in the tasks that read the tables."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.rindex("Exchange "):]


@pytest.mark.parametrize("name, scan", [("transaction_lexicon", "regexp_extract_all"), ("transaction_type", "rlike"), ("org_best", "regexp_extract")])
def test_scans_run_after_the_mails_are_dealt(spark, sf, name, scan):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().lower()
    assert scan in plan and scan not in below_first_shuffle(catalog.QUERIES[name](spark, sf)).lower()


def test_stream_deals_the_mails_of_one_file(spark, sf):
    assert len(catalog.QUERIES["mail_stream"](spark, sf).inputFiles()) > 1


@pytest.mark.parametrize("name, scan", [("header_field_map", "levenshtein"), ("attachment_header_map", "array_intersect")])
def test_headers_are_mapped_after_they_are_distinct(spark, sf, name, scan):
    df = catalog.QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString().lower()
    assert scan in plan and scan not in below_first_shuffle(df).lower()


def test_synonyms_of_one_piece_share_a_test():
    names = ["cardiology", "urology", "neurology", "im", "pediatric surgery"]
    groups = entities.shared_pieces(names)
    assert sorted(n for _, members in groups for n in members) == list(range(5)) and ("rology", [1, 2]) not in groups
    assert groups[0] == ("ology", [0, 1, 2]) and all(piece in names[n] for piece, members in groups for n in members)
    assert len(entities.shared_pieces(list(sp.reverse_map()))) < len(sp.reverse_map()) / 3


def test_texts_without_dates_in_words_are_not_scanned(spark):
    texts = ["NPI 1234567890 Suite 12", "May I call at 5 or in 2025", "on 3 March  2025", "JUNE 5, 2024", "dec\t2023", "", "Mar.2024"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    row = df.selectExpr("t", f"{entities._word_dates_likely('t')} AS likely", f"size({entities._word_dates('t')}) AS found",
                        f"size({entities.word_dates('t')}) AS kept", f"size({entities.word_dates_in_context('t')}) AS dated").collect()
    assert [r.likely for r in row] == [False, False, True, True, True, False, False]
    assert all(r.found == r.kept == r.dated and (r.likely or not r.found) for r in row) and sum(r.found for r in row) >= 3


def test_short_phrases_are_compared_with_names_that_share_a_piece(spark):
    """Equal results, without windows for names that share nothing with the phrase."""
    table = similarity.pattern_rows([("a", "cardiology"), ("b", "sports medicine")], 85.0)
    sql = similarity.best_partial_ratio("t", table, 85.0)
    assert "exists(hp" in sql and ".edge" not in sql
    got = spark.createDataFrame([("cardiolgy",), ("medicine",), ("license",), ("the rdiology",)], "t string").selectExpr(f"{sql} AS b").collect()
    assert [r.b and r.b.label for r in got] == ["a", "b", None, "a"]


def test_mail_files_are_read_by_a_bounded_number_of_tasks(spark, tmp_path):
    for i in range(70):
        (tmp_path / f"{i}.eml").write_text(f"Message-ID: <{i}@x>\n\nbody {i}")
    files = mail.read_mail_files(spark, str(tmp_path), tasks=2)
    assert files.rdd.getNumPartitions() == 2 < mail.read_mail_files(spark, str(tmp_path)).rdd.getNumPartitions()
    assert sorted(files.toPandas().content.map(bytes)) == sorted(p.read_bytes() for p in tmp_path.glob("*.eml"))


def test_a_text_is_read_once_whatever_the_size_of_the_dictionary(spark):
    """A dictionary of many automata is joined: equal rows, one scan of the texts."""
    words = spark.range(2000).selectExpr("id AS ord", "concat(if(id % 3 = 0, 'No. ', 'é'), cast(id % 900 as string), repeat('x', id % 4)) AS synonym", "cast(id % 70 as string) AS canonical")
    table = dictionaries.synonym_table(words)
    texts = spark.range(500).selectExpr("id AS k", "concat('no. ', id, if(id % 2 = 0, 'é', ' x'), id + 1, 'x, No. ', id * 3, if(id % 5 = 0, 's', '.')) AS text")
    one, joined = (gazetteer.synonym_hits(texts, ["k"], table, constant=0, shard=n).drop("row_id") for n in (10_000, 50))
    assert sorted(one.collect()) == sorted(joined.collect()) and one.count() > 150
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_the_filter_of_a_dictionary_misses_no_synonym(spark):
    names = ["ab", "heart surgery", "é" * 40, "(x", "no. 12", "\U0001F600 ward"]
    bits, held = gazetteer._filter(spark.createDataFrame([(n,) for n in names], "synonym string"), len(names))
    sizes = sorted({len(n) for n in names})
    found = gazetteer.likely_synonyms([f"Q {n.upper() if n.isascii() else n}, q" for n in names] + [""], sizes, bits, held)
    assert all(n in f for n, f in zip(names, found)) and found[-1] == [] and len(held) * 8 == 1 << bits


def test_mails_of_an_archive_are_dealt_before_they_are_decoded(spark, sf):
    plan = catalog.QUERIES["mailbox_roster"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan[plan.index("MapInArrow"):]
