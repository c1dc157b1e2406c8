"""Mailbox archives against the standard library's reader, for splits anywhere in a file."""

import mailbox as standard
import os
import random

import pytest

from rosterline.session import shared_folder
from rosterline.sources import mail, mailbox


def normal(raw):
    cut = raw.rstrip(b"\r\n")
    return cut + b"\n" if cut else b""


def plain(path):
    box = standard.mbox(path)
    return sorted(normal(box.get_bytes(k)) for k in box.keys())


@pytest.mark.parametrize("seed, end", [(1, b"\n"), (2, b"\r\n"), (3, b"\n")])
def test_cut_like_the_standard_reader(spark, tmp_path, seed, end):
    rng = random.Random(seed)
    lines = [b"", b"", b"From", b"Fro", b" From x", b">From y", b"From: a@b", b"caf\xe9 \xff\xfe", "größe".encode(), b"x" * 70, b"\x85From z", b"F"]
    box = end.join(
        end.join([b"From a@b Thu Jan  1 00:00:00 1970", b"Subject: %d" % i, b"", *rng.choices(lines, k=rng.randrange(12)), b""]) for i in range(120)) + end
    folder = tmp_path / "boxes"
    folder.mkdir()
    (folder / "a.mbox").write_bytes(box)
    (folder / "b.mbox").write_bytes(b"From a\nSubject: only\n\nlast line without end")
    (folder / "empty.mbox").write_bytes(b"")
    (folder / "skip.txt").write_bytes(box)
    want = plain(folder / "a.mbox") + plain(folder / "b.mbox")
    for size in (37, 64, 1000, 1 << 20):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        try:
            found = mailbox.read_mailboxes(spark, str(folder), unquote=False)
            rows = found.collect()
            assert sorted(bytes(r.content) for r in rows) == sorted(want)
            assert size > 1000 or found.rdd.getNumPartitions() > 4  # one file, several tasks
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r.source_file for r in rows} == {"a.mbox", "b.mbox"}


def test_round_trip(spark):
    bodies = [b"Subject: a\n\nFrom here\n>From there\n>>From\n", b"Subject: b\n\n\xff\xe9\x85\x00 bytes\n", b"Subject: c\n\nFrom \n", b"Subject: c\n\nFrom \n", b""]
    folder = os.path.join(shared_folder(spark, "boxes"), "box")
    rows = [(bytearray(b),) for b in bodies] + [(None,)]
    mailbox.write_mailboxes(spark.createDataFrame(rows, "content binary").coalesce(1), folder, mails_per_file=4)
    back = mailbox.read_mailboxes(spark, folder, "*.txt").collect()
    assert sorted(bytes(r.content) for r in back) == sorted([*bodies, b""])
    assert len({r.msg_id for r in back}) < len(back) == 6


def test_stream_reads_each_archive_once(spark, tmp_path):
    base = shared_folder(spark, "boxes")
    folder = tmp_path / "boxes"
    folder.mkdir()

    def go():
        (
            mail.decode(mailbox.read_mailbox_stream(spark, str(folder))).writeStream.format("parquet").option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
        )
        return sorted(r.headers["Subject"] for r in spark.read.parquet(f"{base}/out").collect())

    (folder / "a.mbox").write_bytes(b"From a\nSubject: 1\n\nx\n\nFrom a\nSubject: 2\n\ny\n\n")
    assert go() == ["1", "2"]
    (folder / "b.mbox").write_bytes(b"From a\nSubject: 3\n\nx\n")
    assert go() == ["1", "2", "3"]
