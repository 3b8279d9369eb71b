"""New recordings as a stream: each file is seen once, by the stream's checkpoint instead of a list of processed files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import grid
from ..plans.resumable import PAIR, commit_batch
from ..plans.template_matching import run_matching
from ..shared import scratch, written
from ..sources import wav

FILES = "path string, modificationTime timestamp, length long, content binary"


def recordings(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.[wW][aA][vV]").load(path).select("path", "length")


def append_metadata(spark: SparkSession, path: str, output: str, checkpoint: str) -> StreamingQuery:
    """Appends the metadata of recordings that came since the last run, then ends."""
    out = wav.soundscape_metadata(recordings(spark, path))
    return out.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(output)


def append_detections(spark: SparkSession, path: str, templates_path: str, output: str, checkpoint: str, files_a_batch: int = 1000, **parameters) -> StreamingQuery:
    """Matches recordings that came since the last run with the templates, then ends; plans.resumable.detections_of reads the output.

    Each micro-batch of new recordings meets the static table of templates; its detections are committed as one folder
    named by the batch's number. A batch that is run again, because the stream was stopped between its commit and the
    checkpoint's, finds its folder and leaves it: a recording's detections are there once.
    """
    cuts = wav.listing(spark, templates_path, recursive=False, needed=True)
    shapes = written(wav.template_metadata(cuts), "templates")

    def match(batch: DataFrame, number: int) -> None:
        with scratch(spark):
            new = written(batch.select("path"), "new-recordings")
            pairs = written(grid.match_grid(wav.soundscape_metadata(new), shapes), "grid")
            found = run_matching(spark, pairs, new.union(cuts.select("path")), **parameters)
            ledger = pairs.select(*(F.col(c).cast("string" if c.endswith("path") else "double") for c in PAIR), F.lit(json.dumps(parameters, sort_keys=True)).alias("parameters"))
            commit_batch(output, f"batch-{number:08d}", {"detections": found, "ledger": ledger})

    new_files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.[wW][aA][vV]").option("maxFilesPerTrigger", files_a_batch).load(path).select("path")
    return new_files.writeStream.foreachBatch(match).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
