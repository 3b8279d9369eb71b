"""The folder that driver and executors share, and tables written there to end a plan's lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session (tests) that has none gets a temporary folder; on a cluster that would be one machine's own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sonagrid-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, but those that are to be kept."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            drop_path(spark, path)


def scratched(path: str) -> None:
    """The table at the path is deleted with others of the scratch around, if there is one."""
    if _scratch:
        _scratch[-1].append(path)


def written(df: DataFrame, name: str, codec: str = "zstd", keep: bool = False) -> DataFrame:
    """df, written as a Parquet table in the shared folder and read again: its lineage ends there.

    keep: it outlives the scratch around it, and belongs to the next one if there is one.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if not keep:
        scratched(path)
    elif len(_scratch) > 1:
        _scratch[-2].append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_of(spark: SparkSession, path: str):
    """Hadoop's path and its file system, as the driver's gateway has them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = path_of(spark, path)
    return fs.exists(p)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a written table or file folder of this run."""
    p, fs = path_of(spark, path)
    fs.delete(p, True)


def open_store(uri: str):
    """pyarrow's file system and path for a URI as Spark writes it (not encoded), for use inside tasks."""
    from pyarrow import fs

    scheme, there, rest = uri.partition("://")
    if not there or scheme == "file":
        return fs.LocalFileSystem(), os.path.abspath(rest if there else uri.removeprefix("file:"))
    authority, _, path = rest.partition("/")
    store, root = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return store, f"{root.rstrip('/')}/{path}"


#: A key with this share of all rows, and so many at least, is joined by broadcast: 1 / HOT_SHARE keys at most.
HOT_SHARE, HOT_ROWS = 0.001, 1_000


def join_hot(rows: DataFrame, other: DataFrame, keys: list[str], n: str, total: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows with other's columns by keys, an inner join without hot keys.

    other has distinct keys and in column n how many of all `total` rows have each. The few keys that many rows have
    are broadcast; their number is bounded by HOT_SHARE. The rest is joined as Spark likes.
    """
    if total < hot_rows:  # no key can have so many
        return rows.join(other.drop(n), keys).select(*rows.columns, *(c for c in other.columns if c not in (*keys, n)))
    hot = F.col(n) >= max(hot_rows, int(HOT_SHARE * total))
    told = rows.join(F.broadcast(other.filter(hot).select(*keys, F.struct(*(c for c in other.columns if c not in (*keys, n))).alias("hot_row"))), keys, "left")
    often = told.filter("hot_row is not null").select(*rows.columns, "hot_row.*")
    seldom = told.filter("hot_row is null").drop("hot_row").join(other.filter(~hot).drop(n), keys)
    return often.union(seldom.select(*often.columns))
