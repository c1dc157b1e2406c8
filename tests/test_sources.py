"""Mail files, streams, sinks and dictionaries on local folders."""

import os
from email.message import EmailMessage
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rosterline.operators import fusion, records
from rosterline.session import shared_folder
from rosterline.sources import attachments, dictionaries, fixture, mail, sinks
from rosterline.streaming import roster_stream


def write_mails(folder):
    os.makedirs(folder, exist_ok=True)
    for i in range(3):
        m = EmailMessage()
        m["Subject"], m["From"], m["To"] = f"Größe {i}", "a@example.com", "b@example.com"
        m.set_content(f"Please add the following provider.\n\nProvider Name: Dr. Ann Lee\nNPI: 123456789{i}\nTIN: 12-345678{i}\n")
        if i == 1:
            m.add_alternative("<table><tr><th>Name</th><td>Dr. Bo Ray</td></tr><tr><th>NPI</th><td>1111111111</td></tr></table>", subtype="html")
        if i == 2:
            m.add_attachment(b"NPI,Notes\n1,x\n", maintype="text", subtype="csv", filename="größe.csv")
        with open(os.path.join(folder, f"m{i}.eml"), "wb") as f:
            f.write(m.as_bytes())
    with open(os.path.join(folder, "skip.txt"), "w") as f:
        f.write("no mail")


def to_messages(files):
    return mail.messages(mail.decode(files))


def test_mail_files_to_roster(spark, tmp_path):
    folder = str(tmp_path / "mails")
    write_mails(folder)
    messages = to_messages(mail.read_mail_files(spark, folder))
    rows = {r.source_file: r for r in messages.collect()}
    assert sorted(rows) == ["m0.eml", "m1.eml", "m2.eml"] and rows["m0.eml"].headers["Subject"] == "Größe 0"
    roster = {r.msg_id[-6:]: r for r in messages.transform(fusion.extract).transform(records.process).collect()}
    assert roster["m0.eml"].provider_npi == "1234567890" and roster["m0.eml"].tin == "12-3456780"
    assert roster["m0.eml"].transaction_type == "Add" and roster["m0.eml"].provider_name == "Dr. Ann Lee"
    assert roster["m1.eml"].provider_name == "Dr. Bo Ray"
    found = attachments.manifest(mail.decode(mail.read_mail_files(spark, folder))).collect()
    assert [(r.filename, r.reader) for r in found] == [("größe.csv", "spreadsheet")]


def test_bad_message_keeps_a_row(spark):
    df = spark.createDataFrame([("a", "a.eml", None), ("b", "b.eml", bytearray(b"Subject: x\n\nhello"))], "msg_id string, source_file string, content binary")
    rows = {r.msg_id: r for r in to_messages(df).collect()}
    assert rows["a"].parse_error == "no content" and rows["a"].text_content.startswith("Error reading email: ")
    assert rows["b"].parse_error is None and rows["b"].text_content == "hello"


TEXTS = ["Subject: a\n\nb", "Subject: a\n\nb", "größe\r\n", "", None, *(f"Subject: {i}\n\n{i}" for i in range(40))]


def files_below(folder):
    return [os.path.join(at, name) for at, _, names in os.walk(folder) for name in names]


@pytest.mark.parametrize("local", [True, False])
def test_one_file_a_mail(spark, tmp_path, monkeypatch, local):
    """Equal and empty mails too; on a local folder nothing but the mails is written."""
    folder = f"file://{tmp_path}/mails"
    if not local:
        monkeypatch.setattr(mail, "local_path", lambda folder, default: None)
    mail.write_mail_files(spark.createDataFrame([(t,) for t in TEXTS], "value string").repartition(3), folder)
    if local:
        assert len(files_below(tmp_path)) == len(TEXTS) and len(os.listdir(tmp_path / "mails")) == 3
    files = mail.read_mail_files(spark, folder, "*.txt", subfolders=True)
    assert sorted(bytes(r.content) for r in files.collect()) == sorted((t or "").encode() + b"\n" for t in TEXTS)
    assert files.select("msg_id").distinct().count() == len(TEXTS)
    with pytest.raises(Exception, match="(?i)exists"):
        mail.write_mail_files(spark.createDataFrame([("x",)], "value string"), folder)


def test_no_mails_make_an_empty_folder(spark, tmp_path):
    folder = str(tmp_path / "mails")
    mail.write_mail_files(spark.createDataFrame([], "value string"), folder)
    assert mail.read_mail_files(spark, folder, "*.txt", subfolders=True).collect() == []


def test_attempts_of_a_task_leave_its_mails_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mail.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 7))
    batch = pa.RecordBatch.from_pydict({"value": pa.array([b"x", b"y"], pa.binary())})

    def broken():
        yield batch
        raise OSError("lost")

    write = mail._file_writer(str(tmp_path))
    with pytest.raises(OSError, match="lost"):
        list(write(broken()))
    assert files_below(tmp_path) == []
    counts = [list(write(iter([batch, batch])))[0].column(0).to_pylist() for _ in range(2)]
    assert counts == [[4], [4]] and os.listdir(tmp_path) == ["part-00007"] and len(files_below(tmp_path)) == 4
    os.mkdir(tmp_path / "_killed")
    (tmp_path / "_killed" / "mail-00000000.txt").write_bytes(b"x")
    assert mail.read_mail_files(spark, str(tmp_path), "*.txt", subfolders=True).count() == 4


@pytest.mark.parametrize("folder, default, path", [
    ("/a/b", "file:///", "/a/b"), ("/a/b", "hdfs://n:8020", None), ("file:///a b/c%20d", "hdfs://n", "/a b/c%20d"), ("file:/a", "hdfs://n", "/a"),
    ("s3a://bucket/a", "file:///", None), ("hdfs:///a", "file:///", None), ("a/b:c", "file:///", "a/b:c"),
])
def test_local_folders(folder, default, path):
    assert mail.local_path(folder, default) == path


def test_mail_files_query_writes_nothing_but_mails(spark, sf):
    from rosterline.plans import catalog

    files = [f.removeprefix("file://") for f in catalog.QUERIES["mail_files_roster"](spark, sf).inputFiles()]
    assert len(files) == len(set(files)) == spark.read.parquet(f"{sf}/customer.parquet").count()
    folders = {os.path.dirname(f) for f in files}
    assert len(folders) > 1 and sorted(files) == sorted(files_below(os.path.dirname(folders.pop())))


def test_mail_stream_resumes(spark, tmp_path):
    folder, base = str(tmp_path / "mails"), shared_folder(spark, "test")
    write_mails(folder)
    out, check = os.path.join(base, "out"), os.path.join(base, "check")

    def go():
        roster_stream(to_messages(mail.read_mail_stream(spark, folder)), out, check).awaitTermination()
        return spark.read.parquet(out).count()

    assert go() == 3
    os.link(os.path.join(folder, "m0.eml"), os.path.join(folder, "m9.eml"))
    assert go() == 4


def test_roster_sink(spark, tmp_path):
    data = spark.createDataFrame([("1", 0)], "msg_id string, block_id int")
    filled = data.withColumns({c: F.lit("v") for c in ("transaction_type", "tin", "provider_name")})
    path = str(tmp_path / "roster")
    sinks.write_roster(filled, path)
    assert sinks.validate_output(spark, path)
    row = spark.read.option("header", True).csv(path).first()
    assert row["TIN"] == "v" and row["Group NPI"] == "Information not found"
    template = str(tmp_path / "template.csv")
    with open(template, "w") as f:
        f.write("Provider Name,TIN\n")
    assert sinks.read_template(spark, template) == ["Provider Name", "TIN"]
    sinks.write_roster(filled.limit(0), path)
    assert not sinks.validate_output(spark, path)


def test_dictionaries(spark, tmp_path):
    assert dictionaries.header_variants(spark).count() == 95
    assert dictionaries.lob_synonyms(spark).count() == 37 and dictionaries.organization_types(spark).count() == 21
    assert len(dictionaries.read_specialty_dictionary(str(tmp_path / "none.yml"))) == 22


def test_own_dictionary(spark):
    own = {"Rare Field": ["rare field", "rf"]}
    df = spark.createDataFrame([("1", "Specialty note: rf here", None)], "msg_id string, text_content string, html_content string")
    assert fusion.extract(df, specialties=own).first().provider_specialty == "Rare Field"


def test_records_do_not_shuffle(spark, sf):
    """Mails to finished records is one narrow stage."""
    from rosterline.sources import fixture as fx

    messages = fx.table(spark, sf, "customer").transform(fx.mail_of).selectExpr("msg_id", "body AS text_content", "cast(null as string) AS html_content")
    plan = messages.transform(fusion.extract).transform(records.process)._jdf.queryExecution().executedPlan().toString()
    for operator in ("Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange RoundRobin", "Exchange SinglePartition",
                     "BroadcastExchange", "EvalPython", "MapInArrow"):
        assert operator not in plan


def test_roster_sink_template_and_line_breaks(spark, sf, tmp_path):
    from rosterline.operators.records import column_names
    from rosterline.plans import catalog
    from pyspark.sql import functions as F

    records = catalog.QUERIES["final_roster"](spark, sf).limit(5).withColumn("provider_name", F.lit('A "quoted"\nname, MD'))
    template = column_names()[:2]
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        sinks.write_roster(records, path, template, fmt)
        assert sinks.read_roster(spark, path, fmt).columns == template
        assert not sinks.validate_output(spark, path, fmt=fmt)
        sinks.write_roster(records, path, fmt=fmt)
        back = sinks.read_roster(spark, path, fmt)
        assert back.count() == 5 and {r["Provider Name"] for r in back.collect()} == {'A "quoted"\nname, MD'}
        assert sinks.validate_output(spark, path, fmt=fmt)


def test_stream_query_reads_a_folder_of_files(spark, sf, tmp_path):
    from rosterline.plans import catalog

    table = spark.read.parquet(f"{sf}/customer.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "customer.parquet"))
    assert catalog.QUERIES["mail_stream"](spark, str(tmp_path)).count() == catalog.QUERIES["mail_stream"](spark, sf).count() > 0


def test_ranking_does_not_shuffle(spark):
    messages = spark.createDataFrame([("1", "Provider NPI: 1234567893\nTIN: 12-3456789", None)], "msg_id string, text_content string, html_content string")
    ranked = fusion.ranked_candidates(fusion.prepare(messages))
    assert "Exchange hashpartitioning" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert {r["field"] for r in ranked.collect()} >= {"npi", "tin"}


def test_ranking_by_confidence(spark, sf):
    """The best candidate has the greatest confidence of its field; by priority some other candidate may win."""
    prepared = fusion.prepare(fixture.messages(spark, sf)).filter("msg_id <= 40")
    most = {(r.msg_id, r.field): r.m for r in fusion.candidates(prepared).groupBy("msg_id", "field").agg(F.max("confidence").alias("m")).collect()}
    by = {how: {(r.msg_id, r.field): r for r in fusion.ranked_candidates(prepared, rank_by=how).collect()} for how in ("priority", "confidence")}
    assert {k: r.confidence for k, r in by["confidence"].items()} == most and by["priority"].keys() == most.keys()
    # one of four headers is known, so the table's number has priority but little confidence
    html = ("<p>Provider NPI: 1234567893</p><table><tr><th>NPI</th><th>Qqq</th><th>Wxz</th><th>Zzk</th></tr>"
            "<tr><td>1987654321</td><td>a</td><td>b</td><td>c</td></tr></table>")
    one = fusion.prepare(spark.createDataFrame([("1", "", html)], "msg_id string, text_content string, html_content string"))
    first = {how: {r.field: (r.value, r.priority) for r in fusion.ranked_candidates(one, rank_by=how).collect()} for how in by}
    assert first["priority"]["npi"] == ("1987654321", 100) and first["confidence"]["npi"] == ("1234567893", 90)
    with pytest.raises(ValueError):
        fusion.ranked_candidates(prepared, rank_by="length")
