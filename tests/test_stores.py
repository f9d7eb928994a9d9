"""Heads of files and listings of folders: how much is read is asserted, not only what."""

import io
import os
import re

import pytest

from tidemark.operators import ledger
from tidemark.sources import stores


class Counted(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


@pytest.mark.parametrize(("at", "read"), [(10, 1000), (995, 2000), (2500, 3000), (8000, 5000), (None, 5000)])
def test_no_more_is_read_than_up_to_the_block_with_the_mark(at, read):
    mark = b"<b>Price</b> to\n the <i>public</i>"
    data = b"x" * 10_000 if at is None else b"x" * at + mark + b"x" * (10_000 - at)
    f = Counted(data)
    held, truncated = stores.head_of(f, len(data), 5000, 1000, re.compile(stores.COVER_END))
    assert (len(held), f.taken, truncated) == (read, read, read == 5000) and held == data[:read]


def test_heads_of_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    long = "é" * 30_000 + " Underwriting discounts and commissions " + "y" * 400_000
    for name, data in (("a.txt", b""), ("sub/b.txt", b"short"), ("c.txt", long.encode()), ("d.txt", b"z" * 300_000), ("e.txt", "“x”".encode("cp1252")), ("f.bin", b"no")):
        (tmp_path / name).write_bytes(data)
    got = {os.path.basename(r.path): r for r in stores.heads(spark, f"file://{tmp_path}", glob="*.txt", most=200_000, block=50_000, filesPerTask=2).collect()}
    assert {k: (r.bytes_read, r.length, r.truncated) for k, r in got.items()} == {"a.txt": (0, 0, False), "b.txt": (5, 5, False), "c.txt": (100_000, len(long.encode()), False), "d.txt": (200_000, 300_000, True), "e.txt": (3, 3, False)}
    assert got["c.txt"].text == long.encode()[:100_000].decode() and got["e.txt"].text == "“x”"
    assert stores.heads(spark, str(tmp_path), glob="none").count() == 0


def test_listings_tell_present_absent_refused_and_empty_apart(spark, tmp_path, monkeypatch):
    for folder, names in (("2024/QTR1", ["master.20240102.idx", "master.20240103.idx", "other"]), ("2024/QTR2", [])):
        (tmp_path / folder).mkdir(parents=True)
        for n in names:
            (tmp_path / folder / n).write_text("12345")
    (tmp_path / "2024/file").write_text("x")
    df = stores.listing(spark, str(tmp_path), ["2024/QTR1", "2024/QTR2", "2024/QTR3", "2024/file"], "master.*")
    assert sorted(map(tuple, df.collect()), key=str) == sorted([("2024/QTR1", "master.20240102.idx", 5, "present"), ("2024/QTR1", "master.20240103.idx", 5, "present"), ("2024/QTR2", None, None, "empty"), ("2024/QTR3", None, None, "absent"), ("2024/file", None, None, "absent")], key=str)
    assert stores.listing(spark, str(tmp_path), []).count() == 0
    # days that have a file and no outcome yet are read
    calendar = df.filter("state = 'present'").selectExpr("to_date(substring(name, 8, 8), 'yyyyMMdd') AS day")
    done = spark.createDataFrame([("2024-01-02", "ok", 1)], "day string, outcome string, tried_at int").selectExpr("to_date(day) AS day", "outcome", "tried_at")
    assert [(str(r.day), r.why) for r in ledger.days_to_read(calendar, done).collect()] == [("2024-01-03", "new")]


def test_a_refused_folder(monkeypatch):
    def refuse(self, what):
        raise PermissionError(13, "no")

    class Store:
        get_file_info = refuse

    monkeypatch.setattr(stores, "file_system", lambda uri: (Store(), "/x"))
    reader = stores._ListingReader({"path": "/x", "folders": "a"})
    assert list(reader.read(reader.partitions()[0])) == [("a", None, None, stores.REFUSED)]
