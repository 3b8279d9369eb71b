"""What a recording's frames (file, frame_idx, time_vec, amp) say of it, or of a ROI if they are its frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dominant_frequency(frames: DataFrame, lo: int, hi: int, width: float = 1.0) -> DataFrame:
    """(file, dominant): the mean over frames of the strongest of the bins lo to hi (1-based); width: kHz a bin.

    The lower bin counts among equals.
    """
    bins = frames.select("file", "frame_idx", F.posexplode("amp").alias("i", "a")).select("file", "frame_idx", (F.col("i") + 1).alias("bin"), F.abs(F.col("a").cast("double")).alias("a"))
    top = bins.filter(F.col("bin").between(lo, hi)).groupBy("file", "frame_idx").agg(F.max_by("bin", F.struct("a", -F.col("bin"))).alias("bin"))
    return top.groupBy("file").agg((F.avg("bin") * width).alias("dominant"))


def energy_quantiles(frames: DataFrame, low: float = 0.1, high: float = 0.9, lo: int = 1, hi: int | None = None) -> DataFrame:
    """(file, t10, t90, f10, f90): the frames, and bins of lo to hi, at which the running share of energy reaches the levels."""
    cells = frames.select("file", "frame_idx", F.posexplode("amp").alias("i", "a")).select("file", "frame_idx", (F.col("i") + 1).alias("bin"), (F.col("a").cast("double") * F.col("a").cast("double")).alias("e"))
    cells = cells.filter(F.col("bin") >= lo) if hi is None else cells.filter(F.col("bin").between(lo, hi))

    def reached(axis: str, a: str, b: str) -> DataFrame:
        own = Window.partitionBy("file")
        sums = cells.groupBy("file", axis).agg(F.sum("e").alias("e"))
        share = sums.withColumn("share", F.round(F.sum("e").over(own.orderBy(axis)) / F.sum("e").over(own), 9))
        return share.groupBy("file").agg(F.min(F.when(F.col("share") >= low, F.col(axis))).alias(a), F.min(F.when(F.col("share") >= high, F.col(axis))).alias(b))

    return reached("frame_idx", "t10", "t90").join(reached("bin", "f10", "f90"), "file")
