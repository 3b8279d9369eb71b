"""Scoring templates against recordings.

A spectrogram is made once a recording and window setting, not once a pair, block by block: a task reads the samples of a
block of frames and of as many of its neighbours as the longest template needs, and scores it against each template of
its grid in NumPy, so a long recording is many tasks of bounded memory. What depends on a whole series, its lowest score or longest distance, follows
as a window over the pair. The DataFrame form of the correlation shares its results and serves where Python isn't wanted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signal
from ..shared import join_hot, written
from ..sources import wav

RAW_SCHEMA = "file string, template_id string, frame_idx int, time_vec double, score double, has_window boolean, score_sliding_window int"
#: Frames of a block.
BLOCK = 4096
#: Bytes of templates that one pass sends to all executors; more templates take more passes.
TOLD_BYTES = 128 << 20


def _raw(file: str, found: list[tuple], first: int, times: np.ndarray) -> pd.DataFrame:
    """Rows of RAW_SCHEMA for a block's own frames; found: (template_id, scores, has a window, sw) of each template."""
    n, m = len(times), len(found)
    names = [pd.Series(np.repeat(np.array(x, dtype=object), n * m // len(x)), dtype=object) for x in ([file], [t for t, *_ in found])]
    return pd.DataFrame({
        "file": names[0], "template_id": names[1], "frame_idx": np.tile(np.arange(first, first + n), m), "time_vec": np.tile(times, m),
        "score": np.concatenate([x for _, x, _, _ in found]), "has_window": np.concatenate([x for _, _, x, _ in found]), "score_sliding_window": np.repeat([sw for *_, sw in found], n),
    })


def finished(raw: DataFrame, method: str) -> DataFrame:
    """(file, template_id, frame_idx, time_vec, score, score_sliding_window) of block scores, by their pairs' series.

    Distances become 1 - d / the longest. Frames without a score get the series' lowest (0 without any); a series
    without a window has no rows. raw is read twice: give a table. What holds for a series is a grouped aggregate, so
    a long series is not one task's.
    """
    keys = ["file", "template_id"]
    stats = raw.groupBy(*keys).agg(F.count("*").alias("n"), F.max("has_window").alias("some"), F.min("score").alias("low"), F.max("score").alias("top"))
    stats = written(stats, "series")  # a row a pair
    total = stats.agg(F.sum("n")).first()[0] or 0
    out = join_hot(raw, stats, keys, "n", total).filter("some")
    score, low = F.col("score"), F.col("low")
    if method == "dtw":
        scaled = lambda d: F.when(F.col("top") > 0, 1 - d / F.col("top")).otherwise(1.0)
        score, low = F.when(score.isNotNull(), scaled(score)), F.when(F.col("top").isNotNull(), scaled(F.col("top")))
    return out.withColumn("score", F.coalesce(score, low, F.lit(0.0))).select(*keys, "frame_idx", "time_vec", "score", "score_sliding_window")


def _check(method: str, sw: int) -> None:
    if method not in ("cor", "dtw"):
        raise ValueError("method is cor or dtw")
    if sw < 2:
        raise ValueError("a template needs two frames at least")


def match_scores(frames: DataFrame, pairs: DataFrame, method: str = "cor", block: int = BLOCK) -> DataFrame:
    """(file, template_id, frame_idx, time_vec, score, score_sliding_window), a score for each frame.

    pairs: (file, template_id, frames array<array<double>>, lo, hi), a row for each pair of the grid: the template's
    frames of the bins lo to hi (1-based). A task holds a block of a recording and the templates that the grid pairs with it.
    """
    shortest, reach = pairs.agg(F.min(F.size("frames")), F.max(F.size("frames"))).first()
    _check(method, 2 if shortest is None else shortest)
    n, reach = max(block, 2 * (reach or 2)), reach or 2
    at = F.col("frame_idx") - 1
    near = F.sequence(F.greatest(F.lit(0), F.floor((at - reach) / n)), F.floor((at + reach) / n))
    dealt = frames.select("file", "frame_idx", "time_vec", "amp", F.explode(near).alias("block"))
    last = frames.groupBy("file").agg(F.max("frame_idx").alias("last"))
    asked = pairs.join(last, "file").select(F.col("file").alias("of_file"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - 1) / n))).alias("of_block"), "template_id", "frames", "lo", "hi")

    def score(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("frame_idx")
        idx = left["frame_idx"].to_numpy()
        own = (idx - 1) // n == key[1]
        out = []
        if own.any():
            amp, times, first = np.stack(left["amp"].to_numpy()).astype(float), left["time_vec"].to_numpy()[own], int(idx[own][0])
            block_of = signal.Windows(amp)
            for t in right.itertuples():
                model = np.stack(t.frames).astype(float)
                out.append((t.template_id, *signal.block_scores(block_of, int(idx[0]), first, len(times), model, t.lo, t.hi, method), len(model)))
        return _raw(key[0], out, first, times) if out else _raw("", [("", np.zeros(0), np.zeros(0, bool), 0)], 1, np.zeros(0))

    return finished(written(dealt.groupBy("file", "block").cogroup(asked.groupBy("of_file", "of_block")).applyInPandas(score, RAW_SCHEMA), "block-scores"), method)


def score_blocks(blocks: DataFrame, templates: dict[str, tuple[np.ndarray, int, int]], method: str, block: int = BLOCK) -> DataFrame:
    """Block scores of wav.frame_blocks (path, wl, ovlp, block, n_frames, file, template_ids, and top for dtw) with templates {id: (frames, lo, hi)}.

    A task reads the samples of its block's frames and of as many neighbours as its longest template needs, transforms
    them, and scores all templates of the block: samples and spectrograms are never shuffled. Correlations don't depend
    on a recording's level, so they need no pass that finds it. The templates are sent to the executors once.
    """
    _check(method, min((len(m) for m, _, _ in templates.values()), default=2))
    told = blocks.sparkSession.sparkContext.broadcast(templates)

    def run(batches):
        readers = wav.Readers()
        for pdf in batches:
            for r in pdf.itertuples():
                own = [(name, *told.value[name]) for name in r.template_ids if name in told.value]
                if not own:
                    continue
                reach = max(len(m) for _, m, _, _ in own)
                first, end = int(r.block), int(min(r.block + block, r.n_frames))
                low = max(0, first - reach)
                reader, h = readers(r.path)
                times, amp = wav.block_amplitudes(reader, h, low, int(min(end + reach, r.n_frames)), int(r.wl), float(r.ovlp))
                windows = signal.Windows(signal.levels(amp, 1.0 if method == "cor" else r.top))
                times = times[first - low : end - low]
                for name, model, lo, hi in own:
                    scores, there = signal.block_scores(windows, low + 1, first + 1, len(times), model, lo, hi, method)
                    yield _raw(r.file, [(name, scores, there, len(model))], first + 1, times)

    return wav.dealt(blocks).mapInPandas(run, RAW_SCHEMA)


def sliding_correlation(frames: DataFrame, template: list[list[float]], lo: int, hi: int) -> DataFrame:
    """(file, start, score): the correlation of each complete window that begins at frame start, by joins and sums.

    template: its frames, cropped to the bins lo to hi. A frame takes part in as many windows as the template has
    frames; their sums are over rows (file, start). Null without variance.
    """
    n_rows = len(template)
    model = F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in template))
    crop = F.slice("amp", lo, hi - lo + 1)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    x = frames.select("file", "frame_idx", crop.cast("array<double>").alias("x"))
    x = x.select("*", total("x").alias("sx"), total(F.transform("x", lambda v: v * v)).alias("sxx"))
    pairs = x.select("*", F.posexplode(model).alias("k", "model")).select("file", (F.col("frame_idx") - F.col("k")).alias("start"), "sx", "sxx", total(F.zip_with("x", "model", lambda a, b: a * b)).alias("sxy"), total("model").alias("sy"), total(F.transform("model", lambda v: v * v)).alias("syy"))
    sums = pairs.groupBy("file", "start").agg(F.count("*").alias("rows"), *(F.sum(c).alias(c) for c in ("sx", "sxx", "sxy", "sy", "syy"))).filter(F.col("rows") == n_rows)
    n = float(n_rows * (hi - lo + 1))
    variance = (n * F.col("sxx") - F.col("sx") ** 2) * (n * F.col("syy") - F.col("sy") ** 2)
    return sums.select("file", "start", F.try_divide(n * F.col("sxy") - F.col("sx") * F.col("sy"), F.when(variance > 0, F.sqrt(variance))).alias("score"))


def padded(frames: DataFrame, scores: DataFrame, sw: int) -> DataFrame:
    """(file, frame_idx, time_vec, score): scores of windows brought to frames, other frames at the file's minimum.

    A window's middle is frame start + sw // 2; its score stands one frame before.
    """
    if sw < 2:
        raise ValueError("a template needs two frames at least")
    placed = scores.select("file", (F.col("start") + (sw // 2 - 1)).alias("frame_idx"), "score")
    own = Window.partitionBy("file")
    return frames.select("file", "frame_idx", "time_vec").join(placed, ["file", "frame_idx"], "left").withColumn("score", F.coalesce("score", F.min("score").over(own)))


def template_frames(frames: DataFrame, file: str, first: int, n: int, lo: int, hi: int) -> list[list[float]]:
    """n frames of a recording from first on, bins lo to hi: a template, small by nature."""
    rows = frames.filter((F.col("file") == file) & F.col("frame_idx").between(first, first + n - 1)).select("frame_idx", F.slice("amp", lo, hi - lo + 1).cast("array<double>").alias("m")).collect()
    return [r["m"] for r in sorted(rows, key=lambda r: r["frame_idx"])]


def nested(scores: DataFrame, keys: list[str]) -> DataFrame:
    """One row a pair, its series as an array in frame order."""
    series = F.sort_array(F.collect_list(F.struct("frame_idx", "time_vec", F.col("score").alias("score_vec"))))
    return scores.groupBy(*keys).agg(F.transform(series, lambda x: F.struct(x["time_vec"], x["score_vec"])).alias("score_vec"))


def unnested(scores: DataFrame) -> DataFrame:
    """The long form of nested scores, with frame_idx from 1."""
    rest = [c for c in scores.columns if c != "score_vec"]
    out = scores.select(*rest, F.posexplode("score_vec").alias("i", "v"))
    return out.select(*rest, (F.col("i") + 1).alias("frame_idx"), "v.time_vec", F.col("v.score_vec").alias("score"))


def series_spectrograms(recordings: DataFrame, wl: int, ovlp: float) -> DataFrame:
    """(file, frame_idx, time_vec, amp) of recordings (file, rate, samples) that are columns already."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                t, _, amp = signal.spectrogram(np.asarray(r.samples, float), int(r.rate), wl, ovlp)
                yield pd.DataFrame({"file": r.file, "frame_idx": np.arange(1, len(t) + 1), "time_vec": t, "amp": list(amp)})

    return recordings.select("file", "rate", "samples").mapInPandas(run, "file string, frame_idx int, time_vec double, amp array<double>")
