"""What the operators share: the shared folder, written tables, null-safe texts, files inside tasks."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import HOT_ROWS, HOT_SHARE, drop_path, join_hot, new_path, scratch, scratched, shared_dir, written  # noqa: F401

#: Up to so many rows (of some bytes each) are sent to all executors; beyond, they are joined by shuffles.
SMALL_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """df, a written table of short rows, marked for broadcast if it is small."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def named(column: str) -> Column:
    """A column by its name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def whole_text(column: str = "text") -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(named(column).cast("string"), F.lit(""))


_kept: dict[str, dict] = {}


def cache_of(operator: str) -> dict:
    """What a Python worker keeps between tasks of an operator. Spark reuses workers, so others' is dropped."""
    others = [k for k in _kept if k != operator]
    for k in others:
        del _kept[k]
    if others:
        release()
    return _kept.setdefault(operator, {})


def release() -> None:
    """Gives free memory of this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def open_store(uri: str):
    """pyarrow's file system and path for a URI of the shared folder; used inside tasks."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):]
    if "://" not in uri:
        uri = "file://" + os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def publish(uri: str, data_writer) -> int:
    """Writes a file under an attempt's own name and moves it into place; returns its size.

    data_writer(stream) writes the content. A file that is in place already, by an attempt of the same task, is whole
    and stays: so no store needs to move onto an existing name, and a lost executor leaves no half-written file there.
    """
    from pyarrow.fs import FileType

    store, path = open_store(uri)
    there = lambda: store.get_file_info(path).type != FileType.NotFound
    store.create_dir(path.rpartition("/")[0], recursive=True)
    attempt = f"{path.rpartition('/')[0]}/.{path.rpartition('/')[2]}.{uuid.uuid4().hex}"
    with store.open_output_stream(attempt, compression=None) as out:
        data_writer(out)
        size = out.tell()
    try:
        if not there():
            store.move(attempt, path)
            return size
    except OSError:
        if not there():
            raise
    store.delete_file(attempt)
    return size


def let(value: Column, use) -> Column:
    """use(value) with value computed once a row, however often use names it; also inside lambdas of use."""
    return F.element_at(F.transform(F.array(value), use), 1)
