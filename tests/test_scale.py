"""Joins, windows and sums that are split: equal to whole ones, and no plan of a single task or of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonagrid.operators import diagnostics, peaks, validation

DET = "detection_id long, soundscape_file string, species string, template_file string, detection_start double, detection_end double"
ROI = "roi_id long, soundscape_file string, species string, roi_start double, roi_end double"


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(8)
    d, r = [], []
    for i in range(300):
        start = round(rng.random() * 50, 1)
        d.append((i, rng.choice("ab"), rng.choice("xy"), f"t{i % 3}", start, round(start + rng.choice([0, 0.1, 1, 5, 60]), 1)))
        r.append((1000 + i, rng.choice("ab"), rng.choice("xy"), start, round(start + rng.choice([0, 0.1, 2, 9]), 1)))
    d += [(900, "a", "x", "t0", -3.5, -1.0), (901, "a", "x", "t0", None, 4.0), (902, "a", None, "t0", 1.0, 2.0), (903, "a", "x", "t0", 7.0, 5.0)]
    r += [(2900, "a", "x", -2.0, -1.5), (2901, "a", "x", 3.0, None), (2902, None, "x", 1.0, 2.0)]
    got = sorted((x["detection_id"], x["roi_id"]) for x in validation.overlaps(spark.createDataFrame(d, DET), spark.createDataFrame(r, ROI)).collect())
    want = sorted((a[0], b[0]) for a in d for b in r if None not in (*a, *b) and a[1:3] == b[1:3] and a[4] <= b[4] and a[5] >= b[3])
    assert got == want and len(want) > 1000
    none = spark.createDataFrame([], DET)
    assert validation.validate_by_overlap(none, spark.createDataFrame(r, ROI), "u").count() == 0


def test_validation_joins_times_once(spark):
    """One recording of 100,000 intervals a side: candidates stay near the pairs, and one plan makes them."""
    n = 100_000
    at = F.col("id") * 0.7
    d = spark.range(n).select(F.col("id").alias("detection_id"), F.lit("rec").alias("soundscape_file"), F.lit("sp").alias("species"), F.lit("t").alias("template_file"), at.alias("detection_start"), (at + 1.0).alias("detection_end"))
    r = spark.range(n).select(F.col("id").alias("roi_id"), F.lit("rec").alias("soundscape_file"), F.lit("sp").alias("species"), (at + 0.5).alias("roi_start"), (at + 0.9).alias("roi_end"))
    pairs = validation.overlap_pairs(d, r)
    want = sum(1 for i in range(n) for j in (i - 3, i - 2, i - 1, i, i + 1, i + 2) if 0 <= j < n and i * 0.7 <= j * 0.7 + 0.9 and i * 0.7 + 1.0 >= j * 0.7 + 0.5)
    assert abs(pairs.count() - want) <= 10  # ends that meet to the last bit
    out = validation.validate_by_overlap(d, r, "u")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "detection_start" in plan and "roi_end" not in "".join(line for line in plan.split("\n") if "Join" in line and "<=" in line)  # times were joined before, once
    assert out.groupBy("validation").count().collect()[0]["count"] == n


@pytest.mark.parametrize("block", [7, 64])
def test_peaks_at_block_edges(spark, block):
    """Small blocks give the peaks, bounds and quantiles of whole series, for widths that differ by pair."""
    rng = np.random.default_rng(block)
    rows, series = [], {}
    for name, n, sw in (("a", 200, 3), ("b", 90, 6), ("c", 15, 2), ("flat", 30, 3)):
        x = np.round(rng.random(n), 1) if name != "flat" else np.ones(n)
        series[name] = x, sw
        rows += [(name, i + 1, i * 0.5, float(v), sw) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "pair string, frame_idx int, time_vec double, score double, sw int").repartition(3)
    got = sorted((r["pair"], r["peak_index"], r["detection_start"], r["detection_end"], r["peak_quant"]) for r in peaks.score_peaks(df, ["pair"], "sw", block=block).collect())
    want = []
    for name, (x, sw) in series.items():
        n = len(x)
        for i in range(1, n - 1):
            f = i + 1
            if np.sign(x[i + 1] - x[i]) - np.sign(x[i] - x[i - 1]) < 0 and x[i] >= x[max(0, i - sw) : i + sw + 1].max() and f - sw > 0 and f + sw < n:
                h = max(1, sw // 2)
                want.append((name, f, (i - h) * 0.5, (i + h) * 0.5, math.floor((x <= x[i]).sum() / n * 1000 + 0.5) / 1000))
    assert got == sorted(want) and len(want) > 20
    plain = sorted((r["pair"], r["frame_idx"]) for r in peaks.peak_candidates(df, ["pair"], block).collect())
    assert plain == sorted((name, i + 1) for name, (x, _) in series.items() for i in range(1, len(x) - 1) if np.sign(x[i + 1] - x[i]) - np.sign(x[i] - x[i - 1]) < 0)


def test_curves_of_a_hot_template(spark):
    """A template of nearly all rows is cut into ranges: counts and areas are those of a loop."""
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    rng = random.Random(2)
    rows = [("hot", round(rng.random(), 3), rng.choice(["TP", "FP", "FN"])) for _ in range(3000)] + [("few", 0.5, "TP"), ("few", 0.25, "FP"), (None, 0.1, "TP"), (None, 0.2, "FP")]
    rows = [(t, None if v == "FN" else s, v) for t, s, v in rows]
    df = spark.createDataFrame(rows, "template_name string, peak_score double, validation string")
    curve = [r for r in diagnostics.roc_curve(df).collect() if r["template_name"] == "hot"]
    own = [r for r in rows if r[0] == "hot"]
    for r in curve:
        assert r["tp"] == sum(v == "TP" and s >= r["peak_score"] for _, s, v in own) and r["fp"] == sum(v == "FP" and s >= r["peak_score"] for _, s, v in own)
    assert len(curve) == len({s for _, s, v in own if v != "FN"})
    points = sorted(((1 - r["specificity"], r["sensitivity"], -r["peak_score"]) for r in curve), key=lambda p: p[2])
    want = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:], strict=False))
    auc = {r["template_name"]: r["roc_auc"] for r in diagnostics.roc_auc(diagnostics.roc_curve(df)).collect()}
    assert abs(auc["hot"] - want) < 1e-3
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_density(spark):
    rng = random.Random(4)
    rows = [("t", rng.gauss(0.5, 0.1), "TP") for _ in range(400)] + [("t", rng.random(), "FP") for _ in range(300)] + [("one", 0.5, "TP"), ("same", 0.3, "TP"), ("same", 0.3, "TP"), ("t", None, "FN")]
    out = diagnostics.score_density(spark.createDataFrame(rows, "template_name string, peak_score double, validation string"), 64).collect()
    found = {}
    for r in out:
        found.setdefault((r["template_name"], r["class"]), []).append((r["i"], r["score"], r["density"]))
    assert set(found) == {("t", "TP"), ("t", "FP"), ("t", "All"), ("same", "TP"), ("same", "All")}
    for (t, c), points in found.items():
        x = np.array([s for n, s, v in rows if n == t and s is not None and (c == "All" or v == c)])
        q = np.percentile(x, [25, 75])
        least = min(x.std(ddof=1), (q[1] - q[0]) / 1.34) or x.std(ddof=1) or abs(x[0]) or 1.0
        bw = 0.9 * least * len(x) ** -0.2
        at = np.linspace(x.min() - 3 * bw, x.max() + 3 * bw, 64)
        want = np.exp(-(((at[:, None] - x) / bw) ** 2) / 2).sum(axis=1) / (len(x) * bw * (2 * np.pi) ** 0.5)
        points.sort()
        assert np.allclose([s for _, s, _ in points], at) and np.allclose([d for *_, d in points], want, atol=2e-3 * want.max())
        assert abs(np.trapezoid([d for *_, d in points], at) - 1) < 0.01
