"""ROI tables: types, projections, names, views, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..schemas import DETECTIONS, NULL_TOKENS, ROIS


def coerced(df: DataFrame) -> DataFrame:
    """The declared columns in order, with their types: null tokens and what doesn't parse are null, others are dropped."""
    known = {c.lower(): c for c in df.columns}
    out = []
    for f in ROIS.fields:
        text = F.col(known[f.name]).cast("string") if f.name in known else F.lit(None).cast("string")
        out.append(F.when(~text.isin(*NULL_TOKENS), text).try_cast(f.dataType).alias(f.name))
    return df.select(*out)


def roi_cut_names(rois: DataFrame, extension: str = ".wav") -> DataFrame:
    c = F.col
    name = names.cut_name(names.stem(c("soundscape_file")), c("roi_start"), c("roi_end"), c("roi_min_freq"), c("roi_max_freq"), c("roi_wl"), c("roi_ovlp"), c("roi_label"), extension)
    return rois.withColumn("cut_name", name)


def require(df: DataFrame, columns: list[str]) -> None:
    """ValueError with the columns that df lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError("the table lacks the columns " + ", ".join(missing))


def detections_to_rois(detections: DataFrame, username: str, timestamp: str, filter_tp: bool = False) -> DataFrame:
    """Detections as ROIs; the label of each row is its own template's. All columns of detections are needed."""
    require(detections, [*DETECTIONS.names, *(["validation"] if filter_tp else [])])
    if filter_tp:
        detections = detections.filter(F.col("validation") == "TP")
    c = lambda n: F.col(n) if n in detections.columns else F.lit(None)
    pairs = [F.concat(F.lit(f"{n}="), F.coalesce(c(n).cast("string"), F.lit("NA"))) for n in ("template_name", "detection_id", "peak_score", "validation")]
    return detections.select(
        "soundscape_path", "soundscape_file", names.clean_user(F.lit(username)).alias("roi_user"), F.lit(timestamp).alias("roi_input_timestamp"),
        names.species_of(F.col("template_name")).alias("roi_label"), F.col("detection_start").alias("roi_start"), F.col("detection_end").alias("roi_end"),
        F.col("template_min_freq").alias("roi_min_freq"), F.col("template_max_freq").alias("roi_max_freq"), F.lit("detection").alias("roi_type"),
        F.when(F.coalesce(c("validation") == "TP", F.lit(False)), "certain").otherwise("uncertain").alias("roi_label_confidence"), F.lit("complete").alias("roi_is_complete"),
        F.concat_ws("|", *pairs).alias("roi_comment"), c("detection_wl").alias("roi_wl"), c("detection_ovlp").alias("roi_ovlp"),
        c("detection_sample_rate").alias("roi_sample_rate"), F.lit(1).alias("roi_pitch_shift"),
    )


def write_per_table(rois: DataFrame, path: str) -> None:
    """One folder of CSV for each ROI table."""
    rois.repartition("roi_file").write.mode("overwrite").partitionBy("roi_file").option("header", True).csv(path)


def visible(rois: DataFrame, zoom_start: Column, zoom_end: Column) -> DataFrame:
    """ROIs that reach into a time window; touching its edge isn't enough."""
    return rois.filter((F.col("roi_start") < zoom_end) & (F.col("roi_end") > zoom_start))


def near_duplicates(new: DataFrame, old: DataFrame, within: float = 0.001) -> DataFrame:
    """New ROIs that an old one of the same recording and label repeats: each bound within a tolerance.

    Starts are cut into intervals; an equal start falls into the same or a neighbouring one, so the join has a key.
    """
    step = within * 4
    bounds = ("roi_start", "roi_end", "roi_min_freq", "roi_max_freq")
    n = new.withColumn("__bin", F.floor(F.col("roi_start") / step))
    o = old.select("soundscape_file", "roi_label", *(F.col(b).alias(f"o_{b}") for b in bounds))
    o = o.withColumn("__bin", F.explode(F.sequence(F.floor((F.col("o_roi_start") - within) / step), F.floor((F.col("o_roi_start") + within) / step))))
    close = F.lit(True)
    for b in bounds:
        close = close & (F.abs(F.col(f"n.{b}") - F.col(f"o.o_{b}")) <= within)
    same = [F.col(f"n.{k}") == F.col(f"o.{k}") for k in ("soundscape_file", "roi_label", "__bin")]
    return n.alias("n").join(o.alias("o"), same[0] & same[1] & same[2] & close, "left_semi").drop("__bin")


def no_signal_rows(soundscapes: DataFrame, rois: DataFrame, user: str, timestamp: str) -> DataFrame:
    """For each recording without ROIs one that covers it, labelled as without signals."""
    free = soundscapes.join(rois.select("soundscape_file").distinct(), "soundscape_file", "left_anti")
    given = {"roi_user": F.lit(user), "roi_input_timestamp": F.lit(timestamp), "roi_label": F.lit("no signals of interest"), "roi_start": F.lit(0.0), "roi_end": F.col("soundscape_duration"), "soundscape_path": F.col("soundscape_path"), "soundscape_file": F.col("soundscape_file"), "roi_sample_rate": F.col("soundscape_sample_rate")}
    return free.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ROIS.fields))


#: The reviewer's columns, and the decimals of those that are rounded.
REVIEW_COLUMNS = ("template_name", "soundscape_file", "detection_id", "detection_start", "detection_end", "template_min_freq", "template_max_freq", "peak_score", "validation_user", "validation_time", "validation", "validation_note")
REVIEW_DIGITS = {"detection_start": 3, "detection_end": 3, "peak_score": 3, "template_min_freq": 1, "template_max_freq": 1}
ROI_COLUMNS = ("roi_label", "roi_start", "roi_end", "roi_min_freq", "roi_max_freq", "roi_type", "roi_label_confidence", "roi_is_complete", "roi_comment")


def review_view(validated: DataFrame) -> DataFrame:
    """The columns a reviewer sees: times and scores with 3 decimals, frequencies with 1; those that aren't there are null."""
    c = lambda n: F.col(n) if n in validated.columns else F.lit(None).cast("string")
    return validated.select(*((F.round(c(n), REVIEW_DIGITS[n]) if n in REVIEW_DIGITS else c(n)).alias(n) for n in REVIEW_COLUMNS))


def roi_view(rois: DataFrame) -> DataFrame:
    """The columns of a ROI table that an annotator sees."""
    return rois.select(*((F.col(n) if n in rois.columns else F.lit(None).cast(ROIS[n].dataType)).alias(n) for n in ROI_COLUMNS))


def roi_ruler(rois: DataFrame) -> DataFrame:
    return rois.withColumn("roi_duration", F.col("roi_end") - F.col("roi_start")).withColumn("roi_bandwidth", F.col("roi_max_freq") - F.col("roi_min_freq"))


def latest_tables(tables: DataFrame, file_col: str = "roi_file") -> DataFrame:
    """For each recording its ROI table of the last name."""
    recording = names.recording_of_roi_table(F.col(file_col))
    return tables.select(recording.alias("recording"), F.col(file_col)).filter("recording <> ''").groupBy("recording").agg(F.max(file_col).alias("roi_file"))


def with_table_flag(soundscapes: DataFrame, tables: DataFrame) -> DataFrame:
    """Whether a recording has a ROI table: an equal join on the name before the mark, not a prefix search."""
    found = tables.select(names.recording_of_roi_table(F.col("roi_file")).alias("__stem")).distinct().withColumn("__has", F.lit(True))
    return soundscapes.join(found, names.stem(F.col("soundscape_file")) == F.col("__stem"), "left").withColumn("has_table", F.coalesce("__has", F.lit(False))).drop("__stem", "__has")


def delete_rows(rois: DataFrame, chosen: DataFrame) -> DataFrame:
    return rois.join(chosen.select("roi_id").distinct(), "roi_id", "left_anti")


def first_per(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key, by an order that leaves no ties: an aggregate, no group is gathered."""
    rest = [c for c in df.columns if c != key]
    least = F.min_by(F.struct(*rest), F.struct(*order)).alias("first_row")
    return df.groupBy(key).agg(least).select(key, "first_row.*").select(*df.columns)
