"""Matching in batches that are kept: a run that was stopped goes on where it was, a run with more recordings or templates scores the new pairs only.

A batch is a folder of two tables, its detections and the pairs that were scored for them (the ledger), which appears
whole or not at all: it is written under an attempt's name and renamed. Before scoring, the pairs of all ledgers are
taken from the grid; pairs without detections are in the ledger too, so they aren't scored again. A ledger names the
parameters of its run; others are another run's and need another folder.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prefix
from ..schemas import DETECTIONS
from ..shared import drop_path, exists, path_of, scratch, written
from .template_matching import run_matching

#: What tells pairs apart.
PAIR = ["soundscape_path", "template_path", "template_wl", "template_ovlp"]
LEDGER = "soundscape_path string, template_path string, template_wl double, template_ovlp double, parameters string"


def commit_batch(folder: str, name: str, tables: dict[str, DataFrame]) -> bool:
    """Writes tables as <folder>/<name>/<table>, all at once; False if that batch is there already."""
    spark = next(iter(tables.values())).sparkSession
    target, attempt = f"{folder}/{name}", f"{folder}/_attempt-{name}"
    if exists(spark, target):
        return False
    drop_path(spark, attempt)  # of a run that was stopped
    for table, df in tables.items():
        df.write.parquet(f"{attempt}/{table}")
    source, fs = path_of(spark, attempt)
    if not fs.rename(source, path_of(spark, target)[0]):
        raise OSError(f"{attempt} can't be renamed to {target}")
    return True


def _batches(spark: SparkSession, folder: str, table: str, schema) -> DataFrame:
    """A table of all committed batches."""
    path, fs = path_of(spark, folder)
    names = [s.getPath().toString() for s in fs.listStatus(path) if s.getPath().getName().startswith("batch-")] if fs.exists(path) else []
    return spark.read.schema(schema).parquet(*(f"{n}/{table}" for n in names)) if names else spark.createDataFrame([], schema)


def detections_of(spark: SparkSession, folder: str) -> DataFrame:
    """The detections of all committed batches."""
    return _batches(spark, folder, "detections", DETECTIONS)


def scored_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _batches(spark, folder, "ledger", LEDGER)


def remaining_pairs(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """The pairs of the grid that no ledger has."""
    return pairs.join(done.select(*PAIR).distinct(), PAIR, "left_anti").select(*pairs.columns)


def resume_matching(spark: SparkSession, pairs: DataFrame, files: DataFrame, folder: str, pairs_a_batch: int = 1_000_000, **parameters) -> int:
    """Scores the pairs that aren't in the folder's ledgers and commits their detections batch by batch; the number of pairs scored.

    A batch has whole recordings, so each is read once in it. After a stop at any time a further call leaves the same
    rows as one that wasn't stopped.
    """
    told = json.dumps(parameters, sort_keys=True)
    done = scored_pairs(spark, folder)
    other = done.filter(F.col("parameters") != told).select("parameters").first()
    if other:
        raise ValueError(f"the folder holds a run with other parameters: {other[0]}")
    left = written(remaining_pairs(pairs, done), "remaining-pairs")
    total = left.count()
    # recordings in order, cut where a batch is full
    sizes = prefix.running(left.groupBy("soundscape_path").agg(F.count("*").alias("n_pairs")), [], [F.asc("soundscape_path")], {"upto": F.col("n_pairs")})
    batch_of = F.floor((F.col("upto") - F.col("n_pairs")) / pairs_a_batch).alias("batch_of_pair")
    left = written(left.join(sizes.select("soundscape_path", batch_of), "soundscape_path"), "remaining-pairs")
    n = -(-total // pairs_a_batch)
    first = 1 + max([int(r[0]) for r in done.select(F.regexp_extract(F.input_file_name(), r"/batch-(\d+)/", 1)).distinct().collect() if r[0]], default=-1)
    for k in range(n):
        with scratch(spark):  # a batch's scores go when its detections are committed
            batch = written(left.filter(F.col("batch_of_pair") == k).drop("batch_of_pair"), "batch-pairs")
            if batch.isEmpty():
                continue
            found = run_matching(spark, batch, files, **parameters)
            ledger = batch.select(*(F.col(c).cast("string" if c.endswith("path") else "double") for c in PAIR), F.lit(told).alias("parameters"))
            commit_batch(folder, f"batch-{first + k:08d}", {"detections": found, "ledger": ledger})
    return total
