"""The back-fill source: resumed in the middle of a day, holidays never asked for, every line once."""

import datetime as dt

import pytest

from tidemark.sources import backfill
from tidemark.streaming import live

PATTERN = "%Y/master.%Y%m%d.idx"
HOLIDAY, MISSING = "2024-01-03", "2024-01-09"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "2024").mkdir()
    want = {}
    for n in range(14):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=n)
        if day.isoformat() == MISSING:
            continue
        rows = [f"{day}|{'é' * (i * 7 % 40)}|{i}" for i in range(n * 3)]
        (tmp_path / day.strftime(PATTERN)).write_bytes("\n".join(rows).encode() + (b"\n" if n % 2 and rows else b""))
        if day.weekday() < 5 and day.isoformat() != HOLIDAY:
            want[day.isoformat()] = rows
    return tmp_path, want


def test_parts_and_offsets_replay(folder):
    path, want = folder
    reader = backfill._Reader({"path": str(path), "first": "2024-01-01", "last": "2024-01-14", "pattern": PATTERN, "holidays": HOLIDAY, "perbatch": "3", "partbytes": "100"})
    offset, seen = reader.initialOffset(), []
    while True:
        rows, end = reader.read(offset)
        rows = list(rows)
        if not rows:
            break
        assert len(rows) <= 3 and list(reader.readBetweenOffsets(offset, end)) == rows
        seen, offset = seen + rows, end
    assert [r[2:] for r in seen if r[0] == MISSING] == [(None, None, None)]
    days = list(dict.fromkeys(r[0] for r in seen))
    assert days == sorted({*want, MISSING}) and reader.read(offset) is not None and list(reader.read(offset)[0]) == []
    for day in want:  # parts are gapless
        own = [r for r in seen if r[0] == day]
        assert [r[2] for r in own][1:] == [r[3] for r in own][:-1] and own[0][2] == 0 and own[-1][3] == own[-1][4]


@pytest.mark.parametrize("size", [1, 37, 100, 10**6])
def test_every_line_is_read_once_whatever_the_parts(folder, size):
    import pandas as pd

    path, want = folder
    reader = backfill._Reader({"path": str(path), "first": "2024-01-01", "last": "2024-01-14", "pattern": PATTERN, "holidays": HOLIDAY, "perbatch": "100000", "partbytes": str(size)})
    rows, _ = reader.read(reader.initialOffset())
    got = pd.concat(backfill._lines([pd.DataFrame(list(rows), columns=["day", "name", "begin", "end", "length"])], str(path)))
    assert {d: g.sort_values("at")["line"].tolist() for d, g in got.groupby("day")} == {d: r for d, r in want.items() if r}


def test_a_stream_goes_on_in_the_middle_of_a_day(spark, folder, tmp_path):
    path, want = folder
    counts = []
    for _ in range(12):  # every run is a new query over the same checkpoint, and is given a few parts
        found = backfill.parts(spark, str(path), "2024-01-01", "2024-01-14", PATTERN, [HOLIDAY], perBatch=6, partBytes=400)
        out = live.drained(backfill.lines(found, str(path)), "backfill", "append", str(tmp_path / "state"), clocked=True)
        counts.append(out.count())
        if len(counts) > 1 and counts[-1] == counts[-2]:
            break
    got = {}
    for r in out.orderBy("day", "at").collect():
        got.setdefault(r.day, []).append(r.line)
    assert got == {d: r for d, r in want.items() if r} and len(counts) > 3
