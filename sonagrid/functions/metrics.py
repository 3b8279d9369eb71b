"""Scalar expressions: classification metrics, decibels, colour bins, pitch shift, time clips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def metrics(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall, sensitivity, specificity, F1; a ratio without cases is null."""
    tp, fp, tn, fn = (c.cast("double") for c in (tp, fp, tn, fn))
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return {"precision": precision, "recall": recall, "sensitivity": recall, "specificity": F.try_divide(tn, tn + fp), "F1_score": F.try_divide(2 * precision * recall, precision + recall)}


def decibels(amplitude: Column) -> Column:
    """20 log10; an amplitude of 0 gives minus infinity."""
    return F.when(amplitude > 0, 20 * F.log10(amplitude)).when(amplitude == 0, F.lit(float("-inf")))


def full_scale(amplitude: Column, bits: Column) -> Column:
    """Decibels below the loudest that samples of that depth can be: amplitudes of whole-number samples, over 2 ** (bits - 1)."""
    return decibels(amplitude / F.pow(F.lit(2.0), bits - 1))


def quantised(db: Column, low: float, high: float, n_colors: int) -> Column:
    """The colour of a level, 1 to n_colors: equal steps over [low, high], levels outside at the ends."""
    clamped = F.least(F.greatest(db, F.lit(low)), F.lit(high))
    return F.least(F.floor((clamped - low) / ((high - low) / n_colors)) + 1, F.lit(n_colors)).cast("int")


def pitch_shifted(rate: Column, time: Column, freq: Column, shift: Column) -> tuple[Column, Column, Column]:
    """Rate, time and frequency after a shift by a factor, whose sign doesn't matter."""
    by = F.abs(shift).cast("double")
    return rate / by, time / by, freq * by


def frequency_view(low: Column, high: Column, top: float = 23.0) -> tuple[Column, Column]:
    return F.greatest(F.round(low - 1), F.lit(0.0)), F.least(F.round(high + 1), F.lit(top))


def padded_clip(start: Column, end: Column, duration: Column, pad: float) -> tuple[Column, Column]:
    """A clip widened on both sides, inside its recording."""
    return F.greatest(start - pad, F.lit(0.0)), F.least(end + pad, duration)
