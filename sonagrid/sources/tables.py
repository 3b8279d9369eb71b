"""Readers and writers of the engine's tables: CSV with declared types, Parquet for nested scores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import names
from ..operators.review import ROI_KEYS, without
from ..operators.rois import coerced
from ..schemas import DETECTIONS, ROIS, SCORES, SOUNDSCAPES
from ..shared import path_of


#: A record up to its line end, which may stand inside quotes; a cell; both without backtracking, so of any length.
_QUOTED = r'"(?:[^"]++|"")*+"'
RECORD, CELL = rf'((?:[^"\n]++|{_QUOTED}|")*+)(?:\n|$)', rf'({_QUOTED}|[^,]*+)(?:,|$)'


def read_rois(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """All ROI tables under a path: *_roi_*.csv, columns as text, then coerced; roi_path and roi_file name the table.

    Tables may have other columns or another order: each file is read by its own header. Quoted cells may hold line
    ends, commas and doubled quotes. A path without such tables is an error.
    """
    texts = spark.read.option("pathGlobFilter", "*_roi_*.csv").option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True)
    if texts.select(F.col("_metadata.file_path")).isEmpty():
        raise ValueError(f"no ROI tables under {path}")
    records = F.filter(F.regexp_extract_all(F.regexp_replace("value", "\r\n?", "\n"), F.lit(RECORD), F.lit(1)), lambda r: r != "")
    files = texts.select(F.col("_metadata.file_path").alias("roi_path"), records.alias("records"))
    cells = lambda c: F.transform(F.regexp_extract_all(c, F.lit(CELL), F.lit(1)), lambda v: F.replace(F.regexp_replace(v, '(?s)^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))
    rows = files.filter(F.size("records") > 0).select("roi_path", cells(F.element_at("records", 1)).alias("head"), F.explode(F.slice("records", 2, F.size("records"))).alias("line"))
    parsed = rows.select("roi_path", F.map_from_arrays(F.transform("head", lambda h, i: F.when(h == "", F.concat(F.lit("_c"), i.cast("string"))).otherwise(h)), F.slice(F.concat(cells(F.col("line")), F.array_repeat(F.lit(""), F.size("head"))), 1, F.size("head"))).alias("m"))
    own = [F.try_element_at("m", F.lit(f.name)).alias(f.name) for f in ROIS.fields if f.name not in ("roi_path", "roi_file")]
    return coerced(parsed.select("roi_path", names.base_name(F.col("roi_path")).alias("roi_file"), *own))


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("nullValue", "NA").csv(path)


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, DETECTIONS)


def read_soundscapes(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, SOUNDSCAPES)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORES).parquet(path)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """Files of their own for each task; append leaves those that are there."""
    df.write.mode("append" if append else "overwrite").option("header", True).option("nullValue", "NA").csv(path)


def append_new(df: DataFrame, done: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose keys aren't in what was written before."""
    write_csv(df.join(done.select(*keys).distinct(), keys, "left_anti").select(*df.columns), path, append=True)


def write_missing_log(metadata: DataFrame, files: DataFrame, path_col: str, output: str, timestamp: str) -> DataFrame:
    """Metadata rows whose file is still listed; the paths of the others are written beside `output`, in a table named by the time."""
    gone = missing_files(metadata, files, path_col).select(F.col(path_col).alias("missing_files"))
    if not gone.isEmpty():
        write_csv(gone, f"{output.removesuffix('.csv')}_missing_recordings_log_{timestamp}.csv")
    return metadata.join(files.select(F.col("path").alias(path_col)).distinct(), path_col, "left_semi").select(*metadata.columns)


def save_rois(rois: DataFrame, soundscape_file: str, path: str) -> bool:
    """Writes the active recording's ROIs over its table, if there are differences from what is saved; whether it did.

    Rows are told apart by recording, user, label and time of input. A recording whose ROIs are all gone gets an empty
    table. The new table is written beside the old one, which keeps its rows under another name until the new one has
    its place; a run that was stopped in between is mended by the next call, or by `recovered`.
    """
    spark = rois.sparkSession
    current = rois.filter(F.col("soundscape_file") == soundscape_file)
    if recovered(spark, path):
        saved = coerced(spark.read.option("header", True).option("inferSchema", False).option("nullValue", "NA").csv(path, schema=", ".join(f"`{c}` string" for c in rois.columns)))
        same = lambda a, b: without(a, b, ROI_KEYS).isEmpty()
        if not current.isEmpty() and same(current, saved) and same(saved, current):
            return False
    attempt = f"{path}.{uuid.uuid4().hex}"
    write_csv(current, attempt)
    target, store = path_of(spark, path)
    before, _ = path_of(spark, f"{path}{BEFORE}")
    if store.exists(target) and not store.rename(target, before):
        raise OSError(f"{path} can't be renamed")
    if not store.rename(path_of(spark, attempt)[0], target):
        raise OSError(f"{attempt} can't be renamed")
    store.delete(before, True)
    return True


#: The end of the name under which a table is kept while another takes its place.
BEFORE = ".before"


def recovered(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at the path; one that a stopped save left under another name gets its place back."""
    target, store = path_of(spark, path)
    before, _ = path_of(spark, f"{path}{BEFORE}")
    if store.exists(target):
        store.delete(before, True)
    elif store.exists(before):
        store.rename(before, target)
    return store.exists(target)


def missing_files(metadata: DataFrame, files: DataFrame, path_col: str) -> DataFrame:
    """Metadata rows whose file is no longer listed."""
    return metadata.join(files.select(F.col("path").alias(path_col)).distinct(), path_col, "left_anti")
