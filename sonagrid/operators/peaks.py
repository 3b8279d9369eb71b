"""Peaks of score series as detections: window functions within blocks of a pair's series, quantiles from ranks in two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import join_hot, written
from . import prefix

SERIES = ["frame_idx", "time_vec", "score"]
#: Widths are below half of it.
UNIT = 1 << 24


def check_parameters(min_score=None, min_quant=None, top_n=None, buffer_size="template") -> None:
    for name, value in (("min_score", min_score), ("min_quant", min_quant)):
        if value is not None and not 0 <= value <= 1:
            raise ValueError(f"{name} must be from 0 to 1")
    if top_n is not None and top_n < 1:
        raise ValueError("top_n must be 1 or more")
    if buffer_size != "template" and not (isinstance(buffer_size, int) and buffer_size >= 0):
        raise ValueError("buffer_size must be 'template' or a number of frames")


#: Frames of a block of a series; twice the reach of the widest window, at least.
BLOCK = 1 << 16


def in_blocks(scores: DataFrame, reach: Column, block: int) -> DataFrame:
    """scores with block_of_frames: each row in its own block and, within reach of an end, in the neighbour's too.

    A window over (pair, block) then sees all frames that a block's own frames need; `own` marks them.
    """
    at = F.col("frame_idx").cast("long") - 1
    home = F.floor(at / block)
    near = F.array_distinct(F.array(F.floor((at - reach) / block), home, F.floor((at + reach) / block)))
    copies = scores.withColumn("home_block", home).withColumn("block_of_frames", F.explode(F.filter(near, lambda b: b >= 0)))
    return copies.withColumn("own", F.col("block_of_frames") == F.col("home_block")).drop("home_block")


def peak_candidates(scores: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Frames at which the slope falls: rise to flat, rise to fall, flat to fall."""
    w = Window.partitionBy(*keys, "block_of_frames").orderBy("frame_idx")
    up, down = F.signum(F.col("score") - F.lag("score").over(w)), F.signum(F.lead("score").over(w) - F.col("score"))
    return in_blocks(scores, F.lit(1), block).withColumn("fall", down - up).filter("own and fall < 0").select(*scores.columns)


def marked(scores: DataFrame, keys: list[str], sw: int | str, buffer: int | None = None, block: int = BLOCK) -> DataFrame:
    """scores with candidate, dominant, inside, start and end of each frame.

    sw: the templates' frames, a number or a column that has one value a pair. dominant: no score within `buffer`
    frames (by default sw; 0 counts as 1) is higher, so equals stay. inside: more than sw frames from either end.

    Windows are partitioned by the pair and a block of frames with as many of its neighbours' as they reach, so that a
    long series is many tasks. Frames of a width that differs by pair are ranges over the frame's number in units of
    that width, UNIT to a width.
    """
    width = F.col(sw) if isinstance(sw, str) else F.lit(sw)
    b, h = F.greatest(F.lit(1), width if buffer is None else F.lit(buffer)), F.greatest(F.lit(1), F.floor(width / 2))
    if isinstance(sw, str):
        widest = scores.agg(F.max(sw)).first()[0] or 1
    else:
        widest = sw
    block = max(block, 2 * max(widest, buffer or 0, 1))
    lengths = scores.groupBy(*keys).agg(F.count("*").alias("n_of_frames"), F.count("*").alias("rows_of_pair"))
    total = lengths.agg(F.sum("n_of_frames")).first()[0] or 0
    sized = join_hot(scores, lengths, keys, "rows_of_pair", total)
    own = Window.partitionBy(*keys, "block_of_frames")
    by = lambda n: own.orderBy(F.call_function("div", F.col("frame_idx").cast("long") * UNIT, n.cast("long")))
    w, near, half = own.orderBy("frame_idx"), by(b), by(h)
    up, down = F.signum(F.col("score") - F.lag("score").over(w)), F.signum(F.lead("score").over(w) - F.col("score"))
    left, right = F.floor(width / 2) < F.col("frame_idx"), F.col("frame_idx") + F.floor(width / 2) <= F.col("n_of_frames")
    found = in_blocks(sized, F.greatest(b, h), block).select(
        "*", F.coalesce(down - up < 0, F.lit(False)).alias("candidate"),
        (F.col("score") >= F.max("score").over(near.rangeBetween(-UNIT, UNIT))).alias("dominant"),
        ((F.col("frame_idx") - width > 0) & (F.col("frame_idx") + width < F.col("n_of_frames"))).alias("inside"),
        F.when(left, F.when(width < 2, F.col("time_vec")).otherwise(F.min("time_vec").over(half.rangeBetween(-UNIT, 0)))).alias("detection_start"),
        F.when(right, F.when(width < 2, F.col("time_vec")).otherwise(F.max("time_vec").over(half.rangeBetween(0, UNIT)))).alias("detection_end"),
    )
    return found.filter("own").select(*scores.columns, "candidate", "dominant", "inside", "detection_start", "detection_end")


def with_quantiles(rows: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """rows of scores with peak_quant, the share of their pair's scores that aren't higher, 3 decimals.

    Distinct scores are counted, their counts summed in order in two levels; no task holds a pair.
    """
    counts = scores.groupBy(*keys, "score").agg(F.count("*").alias("n_of_score"))
    upto = written(prefix.running(counts, keys, [F.col("score").asc_nulls_first()], {"n_upto": F.col("n_of_score")}), "score-ranks")
    totals = upto.groupBy(*keys).agg(F.max("n_upto").alias("n_of_pair"), F.count("*").alias("n_distinct"))
    shares = join_hot(upto, written(totals, "score-totals"), keys, "n_distinct", upto.count()).withColumn("peak_quant", F.round(F.col("n_upto") / F.col("n_of_pair"), 3))
    total = upto.agg(F.sum("n_of_score")).first()[0] or 0
    return join_hot(rows, shares.select(*keys, "score", "peak_quant", "n_of_score"), [*keys, "score"], "n_of_score", total).select(*rows.columns, "peak_quant")


def score_peaks(scores: DataFrame, keys: list[str], sw: int | str, buffer_size: int | str = "template", min_score: float | None = None, min_quant: float | None = None, top_n: int | None = None, block: int = BLOCK) -> DataFrame:
    """Detections of each pair: dominant candidates inside the series, filtered, the best top_n by quantile.

    sw: the templates' frames, a number or the column that has them. A limit is noted in its column. top_n has no effect
    on a pair with fewer detections. scores are read several times: give a table, not a plan that is dear.
    """
    check_parameters(min_score, min_quant, top_n, buffer_size)
    buffer = None if buffer_size == "template" else buffer_size
    found = marked(scores, keys, sw, buffer, block).filter("candidate and dominant and inside")
    if min_score is not None:
        found = found.filter(F.col("score") >= min_score)
    found = with_quantiles(found, scores, keys)
    if min_quant is not None:
        found = found.filter(F.col("peak_quant") >= min_quant)
    found = best_per_pair(found, keys, top_n)
    extra = [c for c in scores.columns if c not in (*keys, *SERIES)]
    noted = F.lit(buffer) if buffer is not None else F.col(sw) if isinstance(sw, str) else F.lit(sw)
    return found.select(
        *keys, *extra, "detection_start", "detection_end", noted.cast("int").alias("detection_buffer"),
        F.lit(min_score).cast("double").alias("detection_min_score"), F.lit(min_quant).cast("double").alias("detection_min_quant"),
        "detection_top_n", F.col("frame_idx").cast("int").alias("peak_index"), F.col("score").alias("peak_score"), "peak_quant",
    )


def best_per_pair(peaks: DataFrame, keys: list[str], top_n: int | None) -> DataFrame:
    """The top_n of each pair by quantile, earlier frames first among equals; pairs with fewer stay whole."""
    if top_n is None:
        return peaks.withColumn("detection_top_n", F.lit(None).cast("int"))
    own = Window.partitionBy(*keys)
    ranked = peaks.withColumn("__n", F.count("*").over(own)).withColumn("__rank", F.row_number().over(own.orderBy(F.desc("peak_quant"), "frame_idx")))
    kept = ranked.filter((F.col("__n") < top_n) | (F.col("__rank") <= top_n))
    return kept.withColumn("detection_top_n", F.when(F.col("__n") >= top_n, F.lit(top_n)).cast("int")).drop("__n", "__rank")
