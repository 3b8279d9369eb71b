"""Validation of detections by overlap with annotated regions (ROIs): TP, FP and FN rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written
from . import prefix

#: The notes of the output contract, spelled as existing tables have them.
NOTE_TP, NOTE_FP, NOTE_NO_ROI, NOTE_FN = "instersection with a ROI", "no intersection with a ROI", "no ROIs to intersect with", "no detections to intersect with"
TEMPLATE_COLUMNS = ("template_path", "template_file", "template_name", "template_min_freq", "template_max_freq", "template_start", "template_end")


def numbered(df: DataFrame, name: str, *order: str, ranges: int = 0) -> DataFrame:
    """Numbers rows from 1 by an order, nulls first. ranges: tasks that the order is cut into, by default as many as shuffle partitions."""
    return prefix.numbered(df, name, *order, n=ranges)


def overlap_pairs(detections: DataFrame, rois: DataFrame) -> DataFrame:
    """(detection_id, template_file, species, roi_id): pairs of the same recording and species whose times meet, ends included.

    Times are cut into bins of the mean length of the longer side's intervals, so that all intervals together cover
    twice their number of bins at most. Each interval is a row in each bin that it covers; recording, species and bin
    are the join's keys, and a pair is made once, in the bin where the later of the two begins. So a recording of many
    intervals isn't compared with itself as a whole.
    """
    length = lambda df, a, b: df.agg(F.avg(F.abs(F.col(b) - F.col(a)))).first()[0] or 0.0
    width = max(length(detections, "detection_start", "detection_end"), length(rois, "roi_start", "roi_end"), 1e-6)
    at = lambda c: F.floor(F.col(c) / width)

    def binned(df: DataFrame, a: str, b: str, *columns: str) -> DataFrame:
        covered = F.sequence(F.least(at(a), at(b)), F.greatest(at(a), at(b)))
        return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select("soundscape_file", "species", a, b, *columns, F.explode(covered).alias("bin"))

    template = F.col("template_file") if "template_file" in detections.columns else F.lit(None).cast("string")
    d = binned(detections.withColumn("template_file", template), "detection_start", "detection_end", "detection_id", "template_file")
    r = binned(rois, "roi_start", "roi_end", "roi_id")
    meet = (F.col("detection_start") <= F.col("roi_end")) & (F.col("detection_end") >= F.col("roi_start"))
    once = F.col("bin") == F.floor(F.greatest("detection_start", "roi_start") / width)
    return d.join(r, ["soundscape_file", "species", "bin"]).filter(meet & once).select("detection_id", "template_file", "species", "roi_id")


def overlaps(detections: DataFrame, rois: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """overlap_pairs with the detections' and ROIs' columns. Ids tell rows apart."""
    roi_columns = [c for c in rois.columns if c.startswith("roi_")]
    pairs = (overlap_pairs(detections, rois) if pairs is None else pairs).select("detection_id", "roi_id")
    return pairs.join(detections, "detection_id").join(rois.select(*roi_columns), "roi_id").select(*detections.columns, *roi_columns)


def missing_species(detections: DataFrame, rois: DataFrame) -> DataFrame:
    """Species that were detected but have no ROI; their detections aren't validated."""
    return detections.select("species").distinct().join(rois.select("species").distinct(), "species", "left_anti")


def true_positives(detections: DataFrame, rois: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row a detection that meets a ROI; of several ROIs that of the smallest id."""
    pairs = overlap_pairs(detections, rois) if pairs is None else pairs
    return overlaps(detections, rois, pairs.groupBy("detection_id").agg(F.min("roi_id").alias("roi_id")))


def false_positives(detections: DataFrame, rois: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Detections of known species that meet no ROI, with validation_note."""
    pairs = overlap_pairs(detections, rois) if pairs is None else pairs
    known = detections.join(rois.select("species").distinct(), "species", "left_semi")
    free = known.join(pairs.select("detection_id").distinct(), "detection_id", "left_anti")
    files = rois.select("soundscape_file", "species").distinct().withColumn("__file", F.lit(True))
    shared = detections.join(files, ["soundscape_file", "species"], "left_semi").select("species", "template_file").distinct().withColumn("__group", F.lit(True))
    noted = free.join(files, ["soundscape_file", "species"], "left").join(shared, ["species", "template_file"], "left")
    # without any recording in common the group's note is the first one, whatever the recording
    note = F.when(F.col("__group").isNull() | F.col("__file").isNotNull(), NOTE_FP).otherwise(NOTE_NO_ROI)
    return noted.select(*detections.columns, note.alias("validation_note"))


def false_negatives(detections: DataFrame, rois: DataFrame, restrict_to_scanned: bool = False, pairs: DataFrame | None = None) -> DataFrame:
    """ROIs that no detection of a template meets, for each template of the species.

    A template without any recording in common with its species' ROIs has none. By default ROIs of recordings that were
    never scanned count as missed; restrict_to_scanned leaves them out.
    """
    pairs = overlap_pairs(detections, rois) if pairs is None else pairs
    files = rois.select("soundscape_file", "species").distinct()
    templates = detections.join(files, ["soundscape_file", "species"], "left_semi")
    columns = [c for c in TEMPLATE_COLUMNS if c in detections.columns]
    per_template = templates.groupBy("species", "template_file").agg(F.count("*").alias("__n"), *(F.min(c).alias(c) for c in columns if c != "template_file")).drop("__n")
    hits = pairs.select("species", "template_file", "roi_id").distinct()
    missed = rois.join(per_template, "species").join(hits, ["species", "template_file", "roi_id"], "left_anti")
    return missed.join(detections.select("soundscape_file").distinct(), "soundscape_file", "left_semi") if restrict_to_scanned else missed


def validate_by_overlap(detections: DataFrame, rois: DataFrame, validation_user: str, validation_time: str | None = None, restrict_to_scanned: bool = False) -> DataFrame:
    """TP, FP and FN rows. detections need detection_id and species, rois roi_id and species; missing columns are null.

    The pairs that meet are found once, as a written table, from which all three kinds of rows follow.
    """
    if not validation_user:
        raise ValueError("validation_user is needed")
    pairs = written(overlap_pairs(detections, rois), "overlaps")
    tp = true_positives(detections, rois, pairs).withColumn("validation", F.lit("TP")).withColumn("validation_note", F.lit(NOTE_TP))
    fp = false_positives(detections, rois, pairs).withColumn("validation", F.lit("FP"))
    fn = false_negatives(detections, rois, restrict_to_scanned, pairs).withColumn("validation", F.lit("FN")).withColumn("validation_note", F.lit(NOTE_FN))
    out = tp.unionByName(fp, allowMissingColumns=True).unionByName(fn, allowMissingColumns=True)
    return out.withColumn("validation_user", F.lit(validation_user)).withColumn("validation_time", F.lit(validation_time).cast("string"))
