"""From files to detections: metadata, grid, spectrograms, scores, peaks."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid, matching, peaks
from ..schemas import DETECTIONS
from ..shared import written
from ..sources import wav


def template_models(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """(template_id, lo, hi, model): each template's frames, cropped to its band."""
    own = pairs.select("template_path", F.col("template_wl").cast("int").alias("wl"), F.col("template_ovlp").alias("ovlp"), "template_sample_rate", "template_min_freq", "template_max_freq").distinct()
    shapes = wav.spectrograms(files, own.select(F.col("template_path").alias("path"), "wl", "ovlp").distinct())
    shapes = shapes.groupBy(F.col("path").alias("template_path"), "wl", "ovlp").agg(F.sort_array(F.collect_list(F.struct("frame_idx", "amp"))).alias("all_bins"))  # as long as a template
    step = F.col("template_sample_rate") / F.col("wl") / 1000
    lo, hi = F.ceil(F.col("template_min_freq") / step).cast("int") + 1, F.least(F.floor(F.col("template_max_freq") / step).cast("int") + 1, (F.col("wl") / 2).cast("int"))
    joined = own.withColumn("lo", lo).withColumn("hi", hi).join(shapes, ["template_path", "wl", "ovlp"])
    return joined.select(F.concat_ws("|", "template_path", "wl", "ovlp").alias("template_id"), "lo", "hi", F.transform("all_bins", lambda x: F.slice(x["amp"], F.col("lo"), F.col("hi") - F.col("lo") + 1)).alias("model"))


def run_matching(spark: SparkSession, pairs: DataFrame, files: DataFrame, score_method: str = "cor", buffer_size: int | str = "template", min_score: float | None = None, min_quant: float | None = None, top_n: int | None = None, output: str = "detections") -> DataFrame:
    """Detections (or scores) of the grid's pairs. files: (path) of recordings and templates.

    A recording's spectrogram is made once for each window setting in its pairs, in blocks of frames; the templates,
    cropped to their band, are sent to the executors (TOLD_BYTES of them a pass; usually there is one pass), and every
    pair is scored once, whatever the templates' lengths. Templates of fewer than two frames have no scores. The shuffle
    that scoring needs has a row a block.
    """
    peaks.check_parameters(min_score, min_quant, top_n, buffer_size)
    wl, ovlp = F.col("template_wl").cast("int"), F.col("template_ovlp").cast("double")
    asked = pairs.groupBy(F.col("soundscape_path").alias("path"), wl.alias("wl"), ovlp.alias("ovlp")).agg(F.collect_set(F.concat_ws("|", "template_path", wl, ovlp)).alias("template_ids"))
    asked = asked.withColumn("file", F.concat_ws("|", "path", "wl", "ovlp"))
    found: list[DataFrame] = []
    part: dict[str, tuple[np.ndarray, int, int]] = {}
    size = 0

    blocks = written(wav.frame_blocks(files.select("path").join(asked, "path")), "frame-blocks")
    if score_method == "dtw":
        blocks = written(blocks.join(wav.tops(blocks), ["path", "wl", "ovlp"]), "frame-blocks")

    def scored() -> DataFrame:
        return matching.score_blocks(blocks, dict(part), score_method)

    for r in template_models(pairs, files).toLocalIterator():  # a template at a time
        model = np.array(r["model"], float)
        if len(model) < 2 or not model.size:
            continue
        if part and size + model.nbytes > matching.TOLD_BYTES:
            found.append(scored())
            part, size = {}, 0
        part[r["template_id"]] = model, r["lo"], r["hi"]
        size += model.nbytes
    if part:
        found.append(scored())
    raw = found[0] if found else spark.createDataFrame([], matching.RAW_SCHEMA)
    for more in found[1:]:
        raw = raw.union(more)
    scores = matching.finished(written(raw, "block-scores"), score_method)
    if output == "scores":
        return scores
    hits = peaks.score_peaks(scores, ["file", "template_id"], "score_sliding_window", buffer_size, min_score, min_quant, top_n)
    named = pairs.withColumn("file", F.concat_ws("|", "soundscape_path", wl, ovlp)).withColumn("template_id", F.concat_ws("|", "template_path", wl, ovlp))
    out = hits.join(named, ["file", "template_id"])
    values = {"detection_wl": F.col("template_wl"), "detection_ovlp": F.col("template_ovlp"), "detection_sample_rate": F.col("template_sample_rate")}
    return out.select(*(values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in DETECTIONS.fields))


def template_matching(spark: SparkSession, soundscapes_path: str, templates_path: str, recursive_soundscapes: bool = True, recursive_templates: bool = False, **parameters) -> DataFrame:
    """Everything from two folders: metadata of both, the grid, and its detections."""
    sounds, cuts = wav.listing(spark, soundscapes_path, recursive_soundscapes, needed=True), wav.listing(spark, templates_path, recursive_templates, needed=True)
    known, shapes = written(wav.soundscape_metadata(sounds), "soundscapes"), written(wav.template_metadata(cuts), "templates")
    dropped = sounds.count() - known.count()
    if dropped:
        warnings.warn(f"{dropped} files under {soundscapes_path} can't be read as WAV; sources.wav.unreadable lists them", stacklevel=2)
    return run_matching(spark, written(grid.match_grid(known, shapes), "grid"), sounds.select("path").union(cuts.select("path")), **parameters)
