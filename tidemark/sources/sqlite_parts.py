"""A table as SQLite files, one or more a task, with a list of those that count: a sink no row of which goes through the driver, and its source.

``register`` adds the format ``sqlite_parts``. Options: ``path``, a folder in any store that the cluster shares, ``table`` (``data`` by
default) and ``rows``, the most rows of a file (200,000). A task builds each file in memory and puts it into the folder as a whole, so no
machine mounts anything. The driver writes the list when all tasks are done: files of lost or repeated attempts are not on it, and no reader sees them.
"""

from __future__ import annotations

import json
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyarrow.fs import FileType
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegralType, StringType, StructType, TimestampNTZType

from tidemark.work import open_fs

LIST = "_files.json"
ROWS = 200_000


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def to_sqlite(v):
    return v if v is None or isinstance(v, (int, float, str, bytes)) else v.isoformat() if isinstance(v, (date, datetime)) else str(v)


def from_sqlite(kind: DataType):
    """What makes a stored value one of ``kind``, or None where it is one already. SQLite has no not-a-number and stores null for it."""
    makers = {BooleanType: bool, DateType: date.fromisoformat, TimestampNTZType: datetime.fromisoformat, DecimalType: Decimal}
    return next((make for k, make in makers.items() if isinstance(kind, k)), None)


def check(schema: StructType) -> None:
    plain = (IntegralType, FloatType, DoubleType, StringType, BinaryType, BooleanType, DateType, DecimalType, TimestampNTZType)
    odd = [f.name for f in schema if not isinstance(f.dataType, plain)]
    if odd:
        raise ValueError(f"SQLite columns hold numbers, texts, bytes, days and times without a zone; cast or take apart: {odd}")
    if len({f.name.lower() for f in schema}) < len(schema.fields):
        raise ValueError("SQLite tells no columns apart by case")


def read_list(path: str) -> dict:
    fs, at = open_fs(path)
    if fs.get_file_info(f"{at}/{LIST}").type == FileType.NotFound:
        return {}
    with fs.open_input_stream(f"{at}/{LIST}") as f:
        return json.loads(f.read())


class SqliteParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_parts"

    def schema(self) -> StructType:
        found = read_list(self.options["path"])
        if not found:
            raise ValueError(f"no table at {self.options['path']}")
        return StructType.fromJson(found["schema"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return PartsReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        check(schema)
        return PartsWriter(self.options["path"].rstrip("/"), self.options.get("table", "data"), int(self.options.get("rows", ROWS)), schema, overwrite)


@dataclass
class Written(WriterCommitMessage):
    """A task's files and their rows."""

    files: list[tuple[str, int]]


class PartsWriter(DataSourceArrowWriter):
    def __init__(self, path: str, table: str, rows: int, schema: StructType, overwrite: bool):
        self.path, self.table, self.rows, self.names, self.json, self.overwrite = path, table, rows, schema.names, schema.jsonValue(), overwrite

    def write(self, iterator) -> Written:
        files, db, n = [], None, 0
        insert = f"insert into {quoted(self.table)} values ({', '.join('?' * len(self.names))})"
        for batch in iterator:
            done = 0
            while done < batch.num_rows:
                if db is None:
                    db, n = sqlite3.connect(":memory:"), 0
                    db.execute(f"create table {quoted(self.table)} ({', '.join(map(quoted, self.names))})")
                part = batch.slice(done, self.rows - n)
                db.executemany(insert, zip(*([to_sqlite(v) for v in c.to_pylist()] for c in part.columns), strict=True))
                done, n = done + part.num_rows, n + part.num_rows
                if n == self.rows:
                    files.append((self._put(db), n))
                    db = None
        if db is not None:
            files.append((self._put(db), n))
        return Written(files)

    def _put(self, db: sqlite3.Connection) -> str:
        db.commit()
        name = f"part-{uuid.uuid4().hex}.db"
        fs, at = open_fs(self.path)
        fs.create_dir(at)
        with fs.open_output_stream(f"{at}/{name}") as f:
            f.write(db.serialize())
        db.close()
        return name

    def commit(self, messages) -> None:
        before = read_list(self.path)
        mine = [list(f) for m in messages if m is not None for f in m.files]
        if before and not self.overwrite and (before["schema"], before["table"]) != (self.json, self.table):
            self.abort(messages)
            raise ValueError("what is appended must have the table's name and schema")
        kept = [] if self.overwrite else before.get("files", [])
        fs, at = open_fs(self.path)
        fs.create_dir(at)
        passing = f"{at}/{LIST}.{uuid.uuid4().hex}"
        with fs.open_output_stream(passing) as f:
            f.write(json.dumps({"table": self.table, "schema": self.json, "files": kept + mine}).encode())
        fs.move(passing, f"{at}/{LIST}")
        if self.overwrite:
            self._drop(before.get("files", []))

    def abort(self, messages) -> None:
        self._drop([f for m in messages if m is not None for f in m.files])

    def _drop(self, files) -> None:
        fs, at = open_fs(self.path)
        for name, _ in files:
            fs.delete_file(f"{at}/{name}")


@dataclass
class PartFile(InputPartition):
    name: str
    table: str


class PartsReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names, self.kinds = path.rstrip("/"), schema.names, [f.dataType for f in schema]

    def partitions(self) -> list[PartFile]:
        found = read_list(self.path)
        return [PartFile(name, found["table"]) for name, _ in found["files"]] or [PartFile("", "")]

    def read(self, partition: PartFile) -> Iterator[tuple]:
        if not partition.name:
            return
        fs, at = open_fs(self.path)
        with fs.open_input_stream(f"{at}/{partition.name}") as f:
            content = f.read()
        makers = [from_sqlite(k) for k in self.kinds]
        db = sqlite3.connect(":memory:")
        db.deserialize(content)
        for row in db.execute(f"select {', '.join(map(quoted, self.names))} from {quoted(partition.table)}"):
            yield tuple(v if v is None or make is None else make(v) for v, make in zip(row, makers, strict=True))
        db.close()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteParts)
