"""Delimited texts cut at any place give the records and cells of the text read at once."""

import random

import pytest
from pyspark.sql import functions as F

from rosterline.sources import attachments, delimited

CELLS = ["", "x", "1 2", "größe", '"a, b"', '"""q"""', '"two\nlines"', '"\n\n"', '"end,\r\n"",\r\n"', '"\r"', '""', '"a""\n""b"']


def text(rng, end, n):
    rows = ["NPI,Notes,\"Office, Phone\",Provider Name"]
    for i in range(n):
        rows.append(",".join([str(i), *rng.choices(CELLS, k=rng.choice([0, 1, 3, 5]))]))
        rows += [""] * (rng.random() < 0.1)
    return end.join(rows) + end * rng.randrange(3)


def keyed(rows):
    return sorted((r.name or "", r.row_idx, r.col_idx, r.header, r.field, r.value) for r in rows)


@pytest.mark.parametrize("block", [1, 3, 50, 65_536])
def test_payloads(spark, block):
    rng = random.Random(block)
    # equal rows, a null key, blank payloads, a header alone, a quote that stays open
    rows = [(f"f{i}", text(rng, rng.choice(["\n", "\r\n", "\r"]), 40)) for i in range(4)]
    rows += [rows[0], (None, rows[1][1]), ("empty", ""), ("null", None), ("blank", "\n\n"), ("head", "NPI,x"), ("open", 'NPI,x\n1,a\n2,"b\n3,c\n\n4,d')]
    files = spark.createDataFrame(rows, "name string, payload string")
    got = delimited.cells(delimited.payload_lines(files, block=block))
    assert got.columns == attachments.csv_cells(files).columns
    assert keyed(got.collect()) == keyed(attachments.csv_cells(files).collect())
    assert delimited.cells(delimited.payload_lines(files.limit(0), block=block)).count() == 0


@pytest.mark.parametrize("size", [23, 200, 1 << 20])
def test_files_are_read_by_many_tasks(spark, tmp_path, size):
    rng = random.Random(size)
    folder = tmp_path / "files"
    folder.mkdir()
    want = []
    for i, end in enumerate(["\n", "\r\n", "\n"]):
        content = text(rng, end, 60)
        (folder / f"a{i}.csv").write_bytes(content.encode())
        want.append((f"a{i}.csv", content))
    (folder / "none.csv").write_bytes(b"")
    (folder / "other.txt").write_bytes(b"NPI\n1\n")
    whole = attachments.csv_cells(spark.createDataFrame(want, "name string, payload string"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        lines = delimited.file_lines(spark, str(folder))
        assert size > 1000 or lines.rdd.getNumPartitions() > 4
        got = delimited.cells(lines).withColumnRenamed("source_file", "name").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert keyed(got) == keyed(whole.collect())


def test_a_large_file_is_no_hot_key(spark):
    """Texts are dealt by blocks; what is dealt by whole files holds no text."""
    files = spark.range(10).select(F.col("id").alias("name"), F.lit("a\nb").alias("payload"))
    plan = delimited.records(delimited.payload_lines(files))._jdf.queryExecution().optimizedPlan()
    windows, todo = [], [plan]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Window":
            windows.append((node.partitionSpec().size(), "value" in {a.name() for a in (node.child().output().apply(i) for i in range(node.child().output().size()))}))
    assert (2, True) in windows and (1, False) in windows and (1, True) not in windows
