"""What plots show, as tables: spectrogram cells and score series in a window of time, frequency and score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import decibels, full_scale, quantised
from .peaks import marked

#: Files whose largest amplitudes are told to every task; more are joined by a shuffle.
TOLD_FILES = 1_000_000


def spectro_levels(frames: DataFrame, norm: bool = True, bits: int = 16) -> DataFrame:
    """frames (file, ..., amp) of raw amplitudes with amp in decibels: below the file's largest amplitude (norm) or below full scale.

    A file's largest amplitude is a grouped maximum; an amplitude of 0 stands at minus infinity.
    """
    if not norm:
        return frames.withColumn("amp", F.transform("amp", lambda v: full_scale(v.cast("double"), F.lit(bits))))
    tops = frames.groupBy("file").agg(F.max(F.array_max("amp")).cast("double").alias("top_of_file"))
    joined = frames.join(F.broadcast(tops) if tops.count() <= TOLD_FILES else tops, "file", "left")
    level = lambda v: decibels(F.when(F.col("top_of_file") > 0, v.cast("double") / F.col("top_of_file")).otherwise(v.cast("double")))
    return joined.withColumn("amp", F.transform("amp", level)).select(*frames.columns)


def spectro_view(frames: DataFrame, rate: int, wl: int, tlim: tuple[float, float] | None = None, flim: tuple[float, float] | None = None, dyn_range: tuple[float, float] = (-80.0, 0.0), n_colors: int = 124, pitch_shift: float = 1.0) -> DataFrame:
    """(file, time, freq, level, color) of frames whose amp is in decibels.

    Frames outside the time limits go before their bins are taken apart, and only bins inside the frequency limits are.
    A pitch shift of p divides times and multiplies frequencies by |p|; limits are those of the result.
    """
    by = abs(pitch_shift)
    time = F.col("time_vec") / by
    step = rate / wl / 1000 * by  # kHz a bin
    if tlim:
        frames = frames.filter(time.between(*tlim))
    amp, first = F.col("amp"), 0
    if flim:
        first = max(0, -int(-flim[0] // step))
        last = int(flim[1] // step)
        amp = F.slice(amp, first + 1, max(0, last - first + 1))
    cells = frames.select("file", time.alias("time"), F.posexplode(amp).alias("i", "level"))
    level = F.least(F.greatest(F.col("level").cast("double"), F.lit(dyn_range[0])), F.lit(dyn_range[1]))
    return cells.select("file", "time", ((F.col("i") + first) * step).alias("freq"), level.alias("level"), quantised(F.col("level").cast("double"), *dyn_range, n_colors).alias("color"))


def score_view(scores: DataFrame, keys: list[str], sw: int, zoom_time: tuple[float, float] | None = None, zoom_score: tuple[float, float] | None = None, buffer: int | None = None) -> DataFrame:
    """The series inside a window, with detection: whether a frame is a peak of the whole series."""
    out = marked(scores, keys, sw, buffer).select(*keys, "frame_idx", "time_vec", "score", (F.col("candidate") & F.col("dominant") & F.col("inside")).alias("detection"))
    for column, zoom in (("time_vec", zoom_time), ("score", zoom_score)):
        if zoom:
            out = out.filter(F.col(column).between(*zoom))
    return out
