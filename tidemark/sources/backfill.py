"""A back-fill as a stream: the days of a calendar, in order, in parts of files, with an offset that survives restarts.

The source gives no data but which part of which day's file is next, some parts at a time (admission), and remembers the day
and the byte that it has come to. Executors read the parts. So a run that ends in the middle of a day's file goes on there,
holidays are never asked for, and nothing of a file passes the driver."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tidemark.sources.stores import file_system

PARTS = "day string, name string, begin long, end long, length long"
LINES = "day string, at long, line string"
#: Parts that a batch is given, and bytes of a part.
PER_BATCH, PART_BYTES = 64, 32 << 20


class Calendar:
    """Working days from first to last, less holidays, and the names of their files (a strftime pattern)."""

    def __init__(self, first: str, last: str, pattern: str, holidays: set[str]):
        self.first, self.last, self.pattern, self.holidays = dt.date.fromisoformat(first), dt.date.fromisoformat(last), pattern, holidays

    def after(self, day: dt.date) -> dt.date | None:
        while (day := day + dt.timedelta(days=1)) <= self.last:
            if day.weekday() < 5 and day.isoformat() not in self.holidays:
                return day
        return None

    def name(self, day: dt.date) -> str:
        return day.strftime(self.pattern)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.uri = options["path"].rstrip("/")
        self.calendar = Calendar(options["first"], options["last"], options["pattern"], set(filter(None, options.get("holidays", "").split(","))))
        self.most, self.bytes = int(options.get("perbatch", PER_BATCH)), int(options.get("partbytes", PART_BYTES))

    def initialOffset(self) -> dict:
        return {"day": (self.calendar.first - dt.timedelta(days=1)).isoformat(), "at": None}

    def _length(self, name: str) -> int | None:
        from pyarrow import fs

        store, path = file_system(self.uri)
        (info,) = store.get_file_info([f"{path}/{name}"])
        return info.size if info.type == fs.FileType.File else None

    def _parts(self, offset: dict) -> Iterator[tuple[tuple, dict]]:
        """Each next part with the offset after it. A day that is done has no place in it (at: None)."""
        day, at = dt.date.fromisoformat(offset["day"]), offset["at"]
        while True:
            if at is None:
                day, at = self.calendar.after(day), 0
                if day is None:
                    return
            name = self.calendar.name(day)
            length = self._length(name)
            end = None if length is None else min(length, at + self.bytes)
            done = length is None or end >= length
            yield (day.isoformat(), name, None if length is None else at, end, length), {"day": day.isoformat(), "at": None if done else end}
            at = None if done else end

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], start
        for row, end in self._parts(start):
            rows.append(row)
            if len(rows) >= self.most:
                break
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for row, after in self._parts(start):
            yield row
            if after == end:
                return


class Backfill(DataSource):
    """A stream of (day, name, begin, end, length): parts of the days' files under path; a day without a file has one row with
    nulls. Options: path, first, last, pattern, holidays (days by commas), perBatch (parts), partBytes."""

    @classmethod
    def name(cls) -> str:
        return "backfill"

    def schema(self) -> str:
        return PARTS

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def parts(spark: SparkSession, path: str, first: str, last: str, pattern: str, holidays: list[str] | None = None, **options: int) -> DataFrame:
    spark.dataSource.register(Backfill)
    return spark.readStream.format("backfill").options(path=path, first=first, last=last, pattern=pattern, holidays=",".join(holidays or []), **options).load()


def _lines(batches, uri: str):
    store, path = file_system(uri)
    for pdf in batches:
        for day, name, begin, end in pdf[["day", "name", "begin", "end"]].itertuples(index=False):
            if pd.isna(begin):
                continue
            out = []
            with store.open_input_file(f"{path}/{name}") as f:
                at = int(begin)
                if at:  # the line that the part before began is its own
                    f.seek(at - 1)
                    at = at - 1 + len(_line(f))
                else:
                    f.seek(0)
                while at < end and (line := _line(f)):
                    out.append((day, at, line.rstrip(b"\r\n").decode("utf-8", "replace")))
                    at += len(line)
                    if len(out) == 10_000:
                        yield pd.DataFrame(out, columns=["day", "at", "line"])
                        out = []
            yield pd.DataFrame(out, columns=["day", "at", "line"])


def _line(f, step: int = 1 << 16) -> bytes:
    """The rest of a line, its end included; the stream stands behind it."""
    held, start = b"", f.tell()
    while b"\n" not in held:
        more = f.read(step)
        if not more:
            return held
        held += more
    held = held[: held.index(b"\n") + 1]
    f.seek(start + len(held))
    return held


def lines(found: DataFrame, path: str) -> DataFrame:
    """(day, at, line) of parts: each line once, in the part in which it begins, whatever the parts' size; at is its byte."""
    return found.mapInPandas(lambda batches: _lines(batches, path), LINES)
