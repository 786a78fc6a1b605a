"""Collected data as files: market tables, Telegram and feed messages, and SQLite as a source and a sink.

Collecting itself needs a network and is not the engine's; collectors land files, and these readers give them the
engine's schemas. ``register`` adds two Python data sources: ``landed_messages`` (JSON lines, one file a partition)
and ``sqlite_table`` (a table read in key ranges). Message files are opened through Arrow's file systems, so they may lie in any
store that the cluster shares. SQLite itself reads only mounted paths: the database must be on one that all executors mount.
"""

from __future__ import annotations

import io
import json
import sqlite3
from collections.abc import Iterator
from datetime import datetime

from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark import schemas
from tidemark.work import open_fs

MARKET = {"candles": schemas.CANDLE, "index": schemas.CANDLE, "brent": schemas.SERIES, "usd_rub": schemas.SERIES, "rate": schemas.RATE, "dividends": schemas.DIVIDEND, "capitalization": schemas.CAPITALIZATION}


def read_market(spark: SparkSession, kind: str, path: str, fmt: str = "parquet") -> DataFrame:
    """One of ``MARKET`` from landed files of any built-in format, with its schema declared, never inferred.

    Files may have further columns and any order of them where the format names its columns (Parquet, JSON); CSV files must have the schema's.
    """
    reader = spark.read.schema(MARKET[kind])
    return schemas.conform((reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path), MARKET[kind])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by: list[str] | None = None) -> None:
    """A result or a report as a folder of files of any built-in format; an earlier one there is replaced."""
    writer = df.write.mode("overwrite").format(fmt)
    (writer.partitionBy(*by) if by else writer).save(path)


def message(line: bytes | str, kind: str) -> tuple:
    m = json.loads(line)
    return m["id"], kind, m.get("channel"), datetime.fromisoformat(m["date"]), m.get("text")


class MessageFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class LandedMessages(DataSource):
    """Options: ``kind`` (``tg`` or ``media``) and ``paths``, comma-separated files of JSON lines; as a stream ``path``, a folder of such files, and ``split``, the most bytes of a partition (32 MiB)."""

    @classmethod
    def name(cls) -> str:
        return "landed_messages"

    def schema(self):
        return schemas.NEWS

    def reader(self, schema):
        return MessageReader(self.options)

    def streamReader(self, schema):
        return MessageStream(self.options)


class MessageReader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.kind = options["paths"].split(","), options.get("kind", "tg")

    def partitions(self):
        return [MessageFile(p) for p in self.paths]

    def read(self, partition: MessageFile) -> Iterator[tuple]:
        fs, path = open_fs(partition.path)
        with fs.open_input_stream(path) as raw:
            for line in io.TextIOWrapper(raw, encoding="utf-8"):
                if line.strip():
                    yield message(line, self.kind)


class MessageBytes(InputPartition):
    """The lines of a file that begin at ``low`` or later and before ``high``; ``first`` is known to begin one."""

    def __init__(self, name: str, first: int, low: int, high: int):
        self.name, self.first, self.low, self.high = name, first, low, high


class MessageStream(DataSourceStreamReader):
    """Files of a folder that grow line by line, and new ones. An offset holds how far each file has been read, so it has as many numbers as there are channels' files.

    Only whole lines count: one that a collector is still writing waits for its end. A file that shrinks has been changed behind the
    stream's back and is an error; one that goes has been read as far as the last offset says. Names that begin with ``_`` or ``.`` are no input.
    """

    TAIL = 1 << 16

    def __init__(self, options):
        self.path, self.kind, self.split, self.seen = options["path"].rstrip("/"), options.get("kind", "tg"), int(options.get("split", 32 << 20)), {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, at = open_fs(self.path)
        sizes = {f.base_name: f.size for f in fs.get_file_info(FileSelector(at, allow_not_found=True)) if f.type == FileType.File and f.base_name[0] not in "._"}
        self.seen = {n: self.seen[n] if self.seen.get(n, (None,))[0] == size else (size, self._whole(fs, f"{at}/{n}", size)) for n, size in sizes.items()}
        return {n: end for n, (_, end) in sorted(self.seen.items()) if end}

    def _whole(self, fs, path: str, size: int) -> int:
        """Where the last whole line ends, sought from the end."""
        with fs.open_input_file(path) as f:
            while size > 0:
                low = max(size - self.TAIL, 0)
                f.seek(low)
                if (k := f.read(size - low).rfind(b"\n")) >= 0:
                    return low + k + 1
                size = low
        return 0

    def partitions(self, start: dict, end: dict) -> list[MessageBytes]:
        parts = []
        for name, high in end.items():
            low = start.get(name, 0)
            if high < low:
                raise ValueError(f"{name} has shrunk from {low} to {high} bytes")
            parts += [MessageBytes(name, low, a, min(a + self.split, high)) for a in range(low, high, self.split)]
        return parts

    def read(self, partition: MessageBytes) -> Iterator[tuple]:
        fs, at = open_fs(self.path)
        with fs.open_input_file(f"{at}/{partition.name}") as raw:
            begins = partition.low == partition.first
            raw.seek(partition.low - (not begins))
            f = io.BufferedReader(raw, 1 << 20)
            place = partition.low if begins else partition.low - 1 + len(f.readline())
            while place < partition.high:
                line = f.readline()
                place += len(line)
                if line.strip():
                    yield message(line, self.kind)


class RowRange(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteTable(DataSource):
    """Options: ``path``, ``table``, ``ddl`` (Spark schema), ``rows`` (rowids per partition, 100000 by default)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self):
        return self.options["ddl"]

    def reader(self, schema):
        return SqliteReader(self.options, [f.name for f in schema])


class SqliteReader(DataSourceReader):
    def __init__(self, options, columns):
        self.path, self.table, self.step, self.columns = options["path"], options["table"], int(options.get("rows", 100_000)), columns

    def _quote(self, name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    def partitions(self):
        with sqlite3.connect(self.path) as db:
            low, high = db.execute(f"select min(rowid), max(rowid) from {self._quote(self.table)}").fetchone()
        return [RowRange(a, a + self.step) for a in range(low, high + 1, self.step)] if low is not None else [RowRange(0, 0)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        names = ", ".join(map(self._quote, self.columns))
        with sqlite3.connect(self.path) as db:
            yield from db.execute(f"select {names} from {self._quote(self.table)} where rowid >= ? and rowid < ?", (partition.low, partition.high))


def write_sqlite(df: DataFrame, path: str, table: str, batch: int = 10_000) -> None:
    """Streams rows to one SQLite file through the driver: a format with one writer, for small results only; ``sqlite_parts`` is the sink for tables."""
    q = lambda n: '"' + n.replace('"', '""') + '"'
    with sqlite3.connect(path) as db:
        db.execute(f"create table if not exists {q(table)} ({', '.join(map(q, df.columns))})")
        insert, rows = f"insert into {q(table)} values ({', '.join('?' * len(df.columns))})", []
        for r in df.toLocalIterator():
            rows.append([v if v is None or isinstance(v, (int, float, str, bytes)) else str(v) for v in r])
            if len(rows) == batch:
                db.executemany(insert, rows)
                rows = []
        db.executemany(insert, rows)
    db.close()


def register(spark: SparkSession) -> None:
    for source in (LandedMessages, SqliteTable):
        spark.dataSource.register(source)
