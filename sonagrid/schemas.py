"""The engine's tables. Times are seconds from a file's start, frequencies kHz, timestamps text at the boundary."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

_KIND = {"s": StringType(), "d": DoubleType(), "i": IntegerType()}


def _schema(spec: str) -> StructType:
    return StructType([StructField(name, _KIND[kind]) for name, _, kind in (x.partition(":") for x in spec.split())])


SOUNDSCAPES = _schema("soundscape_path:s soundscape_file:s soundscape_duration:d soundscape_sample_rate:i soundscape_bitrate:i soundscape_layout:s")
TEMPLATES = _schema("template_path:s template_file:s template_name:s template_label:s template_start:d template_end:d template_sample_rate:i template_min_freq:d template_max_freq:d template_wl:d template_ovlp:d")
GRID = StructType(SOUNDSCAPES.fields + TEMPLATES.fields)
SCORES = StructType([
    *GRID.fields, StructField("score_sliding_window", IntegerType()), StructField("score_method", StringType()),
    StructField("score_vec", ArrayType(StructType([StructField("time_vec", DoubleType()), StructField("score_vec", DoubleType())]))),
])
DETECTIONS = _schema(
    "soundscape_path:s soundscape_file:s template_path:s template_file:s template_name:s template_min_freq:d template_max_freq:d template_start:d template_end:d "
    "detection_start:d detection_end:d detection_wl:i detection_ovlp:i detection_sample_rate:i detection_buffer:i detection_min_score:d detection_min_quant:d detection_top_n:i "
    "peak_index:i peak_score:d peak_quant:d"
)
ROIS = _schema(
    "soundscape_path:s soundscape_file:s roi_path:s roi_file:s roi_user:s roi_input_timestamp:s roi_label:s roi_start:d roi_end:d roi_min_freq:d roi_max_freq:d "
    "roi_type:s roi_label_confidence:s roi_is_complete:s roi_comment:s roi_wl:i roi_ovlp:i roi_sample_rate:i roi_pitch_shift:i"
)
VALIDATIONS = ("TP", "FP", "FN", "UN", "NV")
#: Texts that stand for a missing value in ROI tables.
NULL_TOKENS = ("", "NA", "NULL")
