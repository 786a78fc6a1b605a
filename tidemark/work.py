"""Intermediate tables and files in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder. Only a local master (tests) may do without: a cluster
without it is an error, since a machine-local temporary folder is invisible to the other machines.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MADE: list[str] = []
_SCOPE: ContextVar[list[str] | None] = ContextVar("tidemark_folders", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this session, as a URI or a path."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tidemark-work-"))


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared one; nothing is created yet."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(folder)
    if (scope := _SCOPE.get()) is not None:
        scope.append(folder)
    return folder


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write and reread: the lineage ends, and a lost executor costs one read."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_uri(uri: str) -> str:
    """Hadoop's name of a folder as Arrow spells it: ``s3a`` is its ``s3``, and blob storage is reached by ``abfss``."""
    if uri.startswith("/"):
        return "file://" + uri
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    return re.sub(r"^wasb(s?)://([^@/]+)@([^./]+)\.blob\.", r"abfs\1://\2@\3.dfs.", uri)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI or an absolute path, and the path in it."""
    return pafs.FileSystem.from_uri(arrow_uri(uri))


def discard(folders: list[str]) -> None:
    """Remove folders that ``fresh`` has named, and forget them. It only tidies up: what a store does not let it remove stays, with a warning."""
    for folder in folders:
        try:
            fs, path = open_fs(folder)
            if fs.get_file_info(path).type != pafs.FileType.NotFound:
                fs.delete_dir(path)
        except (OSError, pa.ArrowException) as e:
            warnings.warn(f"{folder} stays: {e}", stacklevel=2)
        if folder in _MADE:
            _MADE.remove(folder)


@contextmanager
def passing() -> Iterator[list[str]]:
    """Folders that this thread names inside are removed at the end, those put on the yielded list aside. What reads them must have run by then."""
    outer, mine, kept = _SCOPE.get(), [], []
    token = _SCOPE.set(mine)
    try:
        yield kept
    finally:
        _SCOPE.reset(token)
        if outer is not None:
            outer.extend(kept)
        discard([f for f in mine if f not in kept])


def clean_up() -> None:
    """Remove all tables and files that this process has put into shared folders: queries' results must have been read."""
    discard(list(_MADE))
