"""Batches, counters across runs, and exported traces."""

import glob

import pytest
from pyspark.sql import functions as F

from rosterline.operators import batch, counters, fusion, quality
from rosterline.sources import fixture, mail, sinks
from rosterline.streaming import metrics_stream

GOOD = (b"From: a@example.com\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=\"b\"\n\n--b\nContent-Type: text/plain; charset=utf-8\n\n"
        b"Please add Provider Name: Dr. Anna Abbott\nNPI: 1234567893\n--b\nContent-Type: text/html; charset=nonsense\n\n<p>x</p>\n--b\n"
        b"Content-Type: text/csv\nContent-Disposition: attachment; filename=\"r.csv\"\n\nNPI\n1\n--b--\n")


def mails(spark, rows):
    return spark.createDataFrame(rows, "msg_id string, source_file string, content binary")


def test_batch(spark, tmp_path):
    df = mails(spark, [("1", "a.eml", GOOD), ("2", "b.eml", None), ("3", "c.eml", b"Subject: x\n\nNPI: 1679576722 for Dr. Brian Barnes")])
    state = str(tmp_path / "state")
    run = batch.run_batch(df, str(tmp_path / "one"), state=state, run="daily", number=0)
    log = {r["msg_id"]: r for r in run.log.collect()}
    assert (run.files, run.failed, run.ok) == (3, 1, False)
    assert [log[i]["success"] for i in "123"] == [True, False, True] and log["2"]["error"] == "no content"
    assert (log["1"]["attachments"], log["1"]["warnings"], log["3"]["warnings"]) == (1, 1, 0)
    assert all(r["seconds"] > 0 for r in log.values())
    stages = {r["stage"]: r for r in run.stages.collect()}
    assert set(stages) == {"decode", "log", "extract", "write"} and stages["decode"]["rows"] == 3 and stages["extract"]["rows"] == 2
    assert spark.read.parquet(run.roster).count() == 2
    assert batch.run_batch(df.filter("msg_id = '3'"), str(tmp_path / "two"), state=state, run="daily", number=1).ok
    assert not batch.run_batch(df.limit(0), str(tmp_path / "none")).ok
    sums = counters.run_analysis(counters.merged(spark, state)).first()
    assert (sums["success_count"], sums["failure_count"]) == (3, 1) and sums["total_seconds"] > 0
    assert counters.stage_analysis(counters.merged(spark, state)).filter("calls = 2").count() == 4


def messages(spark, sf):
    return fixture.messages(spark, sf)


def test_replayed_batch_counts_once(spark, sf, tmp_path):
    found = messages(spark, sf)
    state = str(tmp_path / "state")
    whole = counters.counted(records=fusion.extract(found), candidates=fusion.candidates(fusion.prepare(found)))
    for number, part in ((0, "msg_id % 3 = 0"), (1, "msg_id % 3 > 0"), (1, "msg_id % 3 > 0")):
        piece = found.filter(part)
        counters.record_batch(counters.counted(records=fusion.extract(piece), candidates=fusion.candidates(fusion.prepare(piece))), state, "a", number)
    merged = counters.merged(spark, state)
    assert sorted(map(str, merged.collect())) == sorted(map(str, counters.add(whole).collect()))
    assert sorted(map(str, counters.field_analysis(merged).collect())) == sorted(map(str, quality.field_analysis(quality.field_success(fusion.extract(found))).collect()))
    assert counters.merged(spark, state, ["other"]).count() == 0


def test_stream_runs_add_up(spark, sf, tmp_path):
    """Two queries with checkpoints of their own share a state; a run without new mails adds nothing."""
    found, base = messages(spark, sf).filter("msg_id < 40"), str(tmp_path)
    for run in ("x", "y"):
        found.filter(f"msg_id % 2 = {int(run == 'y')}").write.parquet(f"{base}/{run}")
        for _ in range(2):
            arriving = spark.readStream.schema(found.schema).parquet(f"{base}/{run}")
            metrics_stream(arriving, f"{base}/state", f"{base}/checkpoint-{run}", run).awaitTermination()
    fields = counters.field_analysis(counters.merged(spark, f"{base}/state"))
    assert {r["total"] for r in fields.collect()} == {fusion.extract(found).count()}


def test_traces(spark, sf, tmp_path):
    found = quality.traces(fusion.prepare(messages(spark, sf)))
    path = str(tmp_path / "traces")
    sinks.write_traces(found, path, buckets=4, records_per_file=10)
    assert sinks.trace_count(spark, path).first()[0] == found.count() == 150
    assert len(glob.glob(f"{path}/bucket=*")) == 4 and all(sum(1 for _ in open(f)) <= 10 for f in glob.glob(f"{path}/*/*.json"))
    one = sinks.read_traces(spark, path, 7, buckets=4).collect()
    assert len(one) == 1 and one[0]["msg_id"] == "7" and one[0]["field_traces"]
    with pytest.raises(Exception):
        sinks.trace_count(spark, str(tmp_path / "missing")).first()


def test_decode_keeps_its_rows(spark):
    got = mail.decode(mails(spark, [("1", "a", GOOD)])).select("msg_id", F.size("parts").alias("n"), "seconds").first()
    assert got["n"] == 4 and got["seconds"] > 0
