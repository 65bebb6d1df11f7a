"""Python data sources: tables of a SQLite file, and a folder of growing line files."""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import LongType, StringType, StructField, StructType


class SqliteSource(DataSource):
    """``format("sqlite_table")``: options path, table, columns (wanted, as name:type), required, since, key and ids.

    Wanted columns that the file lacks read as NULL, missing required ones are an error.
    ``since`` is a time_updated from which on rows are read, itself included, so that ties are not lost.
    ``ids``, parted by U+001F, are the only values of the column ``key`` that are read.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def _wanted(self) -> list[tuple[str, str]]:
        return [tuple(c.split(":")) for c in self.options["columns"].split(",")]  # type: ignore[misc]

    def schema(self) -> StructType:
        return StructType([StructField(n, LongType() if t == "bigint" else StringType()) for n, t in self._wanted()])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(self.options, self._wanted())


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int) -> None:
        self.lo, self.hi = lo, hi


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, wanted: list[tuple[str, str]]) -> None:
        self.path, self.table, self.wanted = options["path"], options["table"], wanted
        self.required = [c for c in (options.get("required") or "").split(",") if c]
        self.since = options.get("since")
        self.key, ids = options.get("key"), options.get("ids")
        self.ids = None if ids is None else ids.split("\x1f")
        self.rows = int(options.get("rows") or 100_000)

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open() as c:
            lo, hi = c.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
        if lo is None:
            return [_Range(0, -1)]
        return [_Range(a, min(hi, a + self.rows - 1)) for a in range(lo, hi + 1, self.rows)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with self._open() as c:
            live = {r[1] for r in c.execute(f'pragma table_info("{self.table}")')}
            if gone := [x for x in self.required if x not in live]:
                raise ValueError(f"{self.table} lacks {', '.join(gone)}")
            cols = ", ".join(f'"{n}"' if n in live else "null" for n, _ in self.wanted)
            more = " and time_updated >= ?" if self.since and "time_updated" in live else ""
            args: list = [partition.lo, partition.hi, *([int(self.since)] if more else [])]
            if self.ids is not None:
                c.execute("create temp table wanted (id text primary key)")
                c.executemany("insert or ignore into wanted values (?)", [(i,) for i in self.ids])
                more += f' and "{self.key}" in (select id from wanted)'
            for row in c.execute(f'select {cols} from "{self.table}" where rowid between ? and ?{more}', args):
                yield tuple(
                    (None if v is None else int(v)) if t == "bigint" else (None if v is None else str(v)) for v, (_, t) in zip(row, self.wanted)
                )


class TailSource(DataSource):
    """``readStream.format("line_tail")``: whole new lines of all files below option path.

    The offset maps each file to the byte behind its last whole line, so a file may
    grow between batches and a line cut short waits for its rest.
    """

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> StructType:
        return StructType([StructField("file", StringType()), StructField("byte_offset", LongType()), StructField("raw_text", StringType())])

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _TailReader(self.options)


class _TailReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.suffix = options["path"], options.get("suffix") or ".jsonl"
        self.most = int(options.get("maxBytesPerFile") or 16 << 20)

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def _files(self) -> list[str]:
        out = []
        for folder, _, names in os.walk(self.path):
            out += [os.path.join(folder, n) for n in names if n.endswith(self.suffix) and not n.startswith(".")]
        return sorted(out)

    def _lines(self, f: str, lo: int, hi: int | None) -> tuple[list[tuple], int]:
        with open(f, "rb") as h:
            h.seek(lo)
            data = h.read(self.most if hi is None else hi - lo)
            # a line longer than one step: on until it ends
            while hi is None and b"\n" not in data and (more := h.read(self.most)):
                data += more
        end = data.rfind(b"\n") + 1
        rows, at = [], 0
        for line in data[:end].split(b"\n")[:-1]:
            rows.append((f, lo + at, line.decode("utf-8", "replace")))
            at += len(line) + 1
        return rows, lo + end

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        seen = json.loads(start["files"])
        rows: list[tuple] = []
        for f in self._files():
            new, seen[f] = self._lines(f, seen.get(f, 0), None)
            rows += new
        return iter(rows), {"files": json.dumps(seen, sort_keys=True)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        a, b = json.loads(start["files"]), json.loads(end["files"])
        for f in sorted(b):
            yield from self._lines(f, a.get(f, 0), b[f])[0]


def register(spark) -> None:
    spark.dataSource.register(SqliteSource)
    spark.dataSource.register(TailSource)
