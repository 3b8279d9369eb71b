"""Edge cases and invariants of the operators."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonagrid.functions import names, signal
from sonagrid.operators import diagnostics, grid, matching, peaks, review, rois, validation
from sonagrid.schemas import DETECTIONS, ROIS, SOUNDSCAPES, TEMPLATES


def series(spark, values, pair="p"):
    return spark.createDataFrame([(pair, i + 1, i * 0.5, float(v)) for i, v in enumerate(values)], "pair_id string, frame_idx int, time_vec double, score double")


def at(df):
    return sorted(r["peak_index"] for r in df.collect())


def test_plateau_and_ties(spark):
    s = series(spark, [0, 0, 0, 1, 1, 0, 0, 0])
    assert sorted(r["frame_idx"] for r in peaks.peak_candidates(s, ["pair_id"]).collect()) == [4, 5]
    assert at(peaks.score_peaks(s, ["pair_id"], sw=2)) == [4, 5]


def test_constant_and_edges(spark):
    assert at(peaks.score_peaks(series(spark, [3] * 8), ["pair_id"], sw=2)) == []
    assert at(peaks.score_peaks(series(spark, [0, 5, 0, 0, 0, 0, 4, 0]), ["pair_id"], sw=2)) == []


def test_buffer_zero_is_one(spark):
    s = series(spark, [0, 0, 1, 0, 2, 0, 3, 0, 0, 0])
    assert at(peaks.score_peaks(s, ["pair_id"], sw=2, buffer_size=0)) == at(peaks.score_peaks(s, ["pair_id"], sw=2, buffer_size=1)) == [3, 5, 7]
    assert at(peaks.score_peaks(s, ["pair_id"], sw=2, buffer_size=2)) == [7]


def test_top_n(spark):
    s = series(spark, [0, 0, 0, 1, 0, 2, 0, 3, 0, 0, 0])
    few = peaks.score_peaks(s, ["pair_id"], sw=2, buffer_size=1, top_n=5).collect()
    assert len(few) == 3 and all(r["detection_top_n"] is None for r in few)
    two = peaks.score_peaks(s, ["pair_id"], sw=2, buffer_size=1, top_n=2)
    assert at(two) == [6, 8] and {r["detection_top_n"] for r in two.collect()} == {2}


@pytest.mark.parametrize("bad", [{"min_score": 2}, {"min_quant": -1}, {"top_n": 0}, {"buffer_size": -1}])
def test_parameters(bad):
    with pytest.raises(ValueError):
        peaks.check_parameters(**bad)


def test_correlation_tiers_agree(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 6))
    t = x[10:15]
    naive = [np.corrcoef(x[i : i + 5].ravel(), t.ravel())[0, 1] for i in range(36)]
    assert np.allclose(signal.sliding_pearson(x, t), naive, atol=1e-9)
    frames = spark.createDataFrame([("f", i + 1, i * 1.0, row.tolist()) for i, row in enumerate(x)], "file string, frame_idx int, time_vec double, amp array<double>")
    native = sorted((r["start"], r["score"]) for r in matching.sliding_correlation(frames, t.tolist(), 1, 6).collect())
    assert np.allclose([s for _, s in native], naive, atol=1e-9)
    pairs = spark.createDataFrame([("f", "t", t.tolist(), 1, 6)], "file string, template_id string, frames array<array<double>>, lo int, hi int")
    arrow = sorted((r["frame_idx"], r["score"]) for r in matching.match_scores(frames, pairs).collect())
    padded = matching.padded(frames, matching.sliding_correlation(frames, t.tolist(), 1, 6), 5)
    assert len(arrow) == 40 and np.allclose([s for _, s in arrow], [r["score"] for r in padded.orderBy("frame_idx").collect()], atol=1e-9)
    assert max(arrow, key=lambda r: r[1])[0] == 12 and abs(max(s for _, s in arrow) - 1) < 1e-9


def test_zero_variance(spark):
    x = np.ones((8, 3))
    assert np.isnan(signal.sliding_pearson(x, np.arange(6.0).reshape(2, 3))).all()
    frames = spark.createDataFrame([("f", i + 1, 0.0, [1.0, 1.0]) for i in range(4)], "file string, frame_idx int, time_vec double, amp array<double>")
    assert {r["score"] for r in matching.sliding_correlation(frames, [[0.0, 1.0], [1.0, 0.0]], 1, 2).collect()} == {None}
    with pytest.raises(ValueError):
        matching.padded(frames, frames, 1)


def test_dtw_against_plain_recursion():
    rng = np.random.default_rng(2)
    x, t = rng.random((9, 3)), rng.random((4, 3))

    def distance(w):
        d = np.full((4, 4), np.inf)
        for i in range(4):
            for j in range(4):
                before = min([d[i - 1, j]] * (i > 0) + [d[i, j - 1]] * (j > 0) + [d[i - 1, j - 1]] * (i > 0 and j > 0), default=0)
                d[i, j] = np.abs(w[j] - t[i]).sum() + before
        return d[-1, -1]

    expected = np.array([distance(x[i : i + 4]) for i in range(6)])
    assert np.allclose(signal.warping_distances(x, t), expected)


def test_nested_round_trip(spark):
    s = series(spark, [1, 2, 3])
    back = matching.unnested(matching.nested(s, ["pair_id"]))
    assert sorted(map(tuple, back.select("pair_id", "frame_idx", "time_vec", "score").collect())) == sorted(map(tuple, s.collect()))


def intervals(spark, dets, regions):
    d = spark.createDataFrame([(i, f, s, t, a, b, 0.5) for i, f, s, t, a, b in dets], "detection_id long, soundscape_file string, species string, template_file string, detection_start double, detection_end double, peak_score double")
    r = spark.createDataFrame(regions, "roi_id long, soundscape_file string, species string, roi_start double, roi_end double")
    return d, r


def rows(df):
    return sorted(((r["detection_id"], r["roi_id"], r["validation"], r["validation_note"]) for r in df.collect()), key=str)


def test_touching_and_two_rois(spark):
    d, r = intervals(spark, [(1, "a", "s", "t", 1.0, 2.0), (2, "a", "s", "t", 5.0, 9.0)], [(1, "a", "s", 2.0, 3.0), (2, "a", "s", 5.5, 6.0), (3, "a", "s", 7.0, 8.0), (4, "b", "s", 0.0, 1.0)])
    got = rows(validation.validate_by_overlap(d, r, "u"))
    assert [x[:3] for x in got] == [(1, 1, "TP"), (2, 2, "TP"), (None, 4, "FN")]
    assert [x[:3] for x in rows(validation.validate_by_overlap(d, r, "u", restrict_to_scanned=True))] == [(1, 1, "TP"), (2, 2, "TP")]


def test_false_positive_notes(spark):
    d, r = intervals(spark, [(1, "a", "s", "t", 0.0, 1.0), (2, "b", "s", "t", 0.0, 1.0), (3, "z", "s", "other", 0.0, 1.0), (4, "a", "unknown", "t", 0.0, 1.0)], [(1, "a", "s", 5.0, 6.0)])
    got = {x[0]: x[3] for x in rows(validation.validate_by_overlap(d, r, "u")) if x[2] == "FP"}
    assert got == {1: validation.NOTE_FP, 2: validation.NOTE_NO_ROI, 3: validation.NOTE_FP}
    assert [x[0] for x in validation.missing_species(d, r).collect()] == ["unknown"]
    with pytest.raises(ValueError):
        validation.validate_by_overlap(d, r, "")


def scored(spark, data):
    return spark.createDataFrame(data, "template_name string, peak_score double, validation string")


def test_curve_branches_and_sums(spark):
    many = [("m", i / 20, "TP" if i % 3 else "FP") for i in range(1, 19)] + [("m", None, "FN")]
    v = scored(spark, many + [("few", 0.2, "TP"), ("few", 0.5, "FP"), ("few", None, "FN")])
    curve = diagnostics.curves(v).collect()
    assert {r["tp"] + r["fn"] for r in curve if r["template_name"] == "m"} == {13}
    assert {r["tp"] + r["fp"] + r["tn"] + r["fn"] for r in curve} == {19, 3}
    assert len([r for r in curve if r["template_name"] == "few"]) == 50


def test_confusion_grid_against_counts(spark):
    data = [("t", s, k) for s, k in zip([0.0, 0.005, 0.01, 0.07, 0.29, 0.3, 0.57, 0.58, 1.0, 1.4], "TP FP TP FP TP FP TP FP TP FP".split(), strict=True)]
    got = {round(r["peak_score"] * 100): (r["tp"], r["fp"], r["tn"], r["fn"]) for r in diagnostics.confusion_grid(scored(spark, data)).collect()}
    for i in range(101):
        t = i / 100
        assert got[i] == tuple(sum(1 for _, s, k in data if k == want and (s >= t) == over) for want, over in (("TP", True), ("FP", True), ("FP", False), ("TP", False)))


def test_logistic_and_cutpoints(spark):
    rng = np.random.default_rng(3)
    x = rng.random(400)
    y = rng.random(400) < 1 / (1 + np.exp(-(12 * x - 6)))
    v = scored(spark, [("a", float(s), "TP" if k else "FP") for s, k in zip(x, y, strict=True)] + [("sep", i / 10, "TP" if i > 4 else "FP") for i in range(9)])
    fit = {r["template_name"]: r for r in diagnostics.logistic_fit(v).collect()}
    a = fit["a"]
    p = 1 / (1 + np.exp(-(a["intercept"] + a["slope"] * x)))
    assert a["status"] == "ok" and abs((y - p).sum()) < 1e-6 and abs(((y - p) * x).sum()) < 1e-6
    assert fit["sep"]["status"] in ("separated", "not_converged")
    cut = {r["template_name"]: r for r in diagnostics.auto_cutpoint(diagnostics.logistic_fit(v), 0.5).collect()}["a"]["score_cut"]
    assert cut == pytest.approx(np.ceil(-a["intercept"] / a["slope"] * 100) / 100)
    curve, _ = diagnostics.diagnostics(v, pos_prob=0.5)
    assert curve.filter("selected and template_name = 'a'").count() >= 1


def test_update_and_patch(spark):
    old = spark.createDataFrame([(1, "NV", None), (2, "TP", "x"), (3, "FP", "y")], "detection_id long, validation string, validation_user string")
    new = spark.createDataFrame([(1, "TP", "n"), (2, "FP", "n"), (9, "TP", "n")], "detection_id long, validation string, validation_user string")
    both = ["validation", "validation_user"]
    assert sorted(map(tuple, review.rows_update(old, new, "detection_id", both).collect())) == [(1, "TP", "n"), (2, "FP", "n"), (3, "FP", "y")]
    assert sorted(map(tuple, review.rows_patch(old, new, "detection_id", both).collect())) == [(1, "TP", "n"), (2, "TP", "x"), (3, "FP", "y")]
    own = review.rows_update(old, new, "detection_id", both, allowed=F.col("validation") == "NV")
    assert sorted(map(tuple, own.collect())) == [(1, "TP", "n"), (2, "TP", "x"), (3, "FP", "y")]


def test_balancing(spark):
    df = spark.createDataFrame([(i, "TP" if i < 3 else "FP", i / 20) for i in range(13)], "detection_id long, validation string, peak_score double")
    count = lambda d: dict(d.groupBy("validation").count().collect())
    assert count(review.balanced(df, "down")) == {"TP": 3, "FP": 3}
    assert count(review.balanced(df, "up")) == {"TP": 10, "FP": 10}
    assert count(review.rose(df)) == {"TP": 6, "FP": 6}
    assert sorted(map(tuple, review.rose(df).collect())) == sorted(map(tuple, review.rose(df).collect()))
    with pytest.raises(ValueError):
        review.balanced(df.filter("validation = 'TP'"), "up")


def test_grid_counts(spark):
    s = spark.createDataFrame([("a", 24000, 10.0), ("b", 48000, 1.0)], "soundscape_file string, soundscape_sample_rate int, soundscape_duration double")
    t = spark.createDataFrame([(24000, 1.0, 5.0, 0.0, 2.0), (24000, 12.0, 13.0, 0.0, 2.0), (24000, 1.0, 12.0, 0.0, 2.0), (48000, 1.0, 5.0, 0.0, 1.0)], "template_sample_rate int, template_min_freq double, template_max_freq double, template_start double, template_end double")
    assert grid.match_grid(s, t).count() == 1
    assert dict(grid.grid_rejections(s, t).collect()) == {"sample_rate": 4, "min_freq": 1, "max_freq": 1, "duration": 1}


def test_names_round_binary_numbers_as_c_does(spark):
    rng = np.random.default_rng(3)
    values = [0.0, -0.0, 0.0625, 0.1875, 0.0005, 0.0015, 1.0005, 2.0015, 0.9995, 0.99951, 999.9995, -0.0001, -1.0625, -0.9999, 1e-12, 5e-324, 1234567.0625, 123456789012.0625, 1e15]
    values += [float(x) for x in np.round(rng.random(500) * 2000, 4)] + [float(x) / 16 for x in rng.integers(0, 1 << 30, 500)] + [float(x) for x in np.round(rng.random(200), 4)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").select("v", names.fixed(F.col("v"), 7).alias("text"))
    assert [r["text"] for r in df.collect()] == [f"{v:.3f}".rjust(7, "0") for v in values] + [None]


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_numbering_by_ranges(spark, ranges):
    rows = [(i, None if i % 7 == 0 else f"k{i * 37 % 11}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k string")
    want = {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0])), 1)}
    assert {r["id"]: r["n"] for r in validation.numbered(df, "n", "k", "id", ranges=ranges).collect()} == want
    assert validation.numbered(df.limit(0), "n", "k", "id", ranges=ranges).count() == 0


def test_grid_by_salt_and_missing_files(spark):
    sounds = spark.createDataFrame([(f"s{i}", f"s{i}", 10.0 + i, 24000 if i % 3 else 48000, 16, "mono") for i in range(30)], SOUNDSCAPES)
    templates = spark.createDataFrame([(f"t{i}", f"t{i}", f"t{i}", "x", 0.0, 5.0 + 2 * i, 24000, 1.0, 5.0 + i, 512.0, 50.0) for i in range(9)], TEMPLATES)
    pairs = lambda df: sorted((r["soundscape_path"], r["template_path"]) for r in df.collect())
    plain = pairs(grid.match_grid(sounds, templates))
    assert plain == pairs(grid.match_grid(sounds, templates, told=3)) and plain
    files = spark.createDataFrame([(f"s{i}",) for i in range(2, 30)] + [(f"t{i}",) for i in range(8)], "path string")
    kept = pairs(grid.match_grid(sounds, templates, files))
    assert kept == [(s, t) for s, t in plain if s not in ("s0", "s1") and t != "t8"]
    n = {r["reason"]: r["n"] for r in grid.grid_rejections(sounds, templates, files).collect()}
    assert (n["soundscape_file"], n["template_file"]) == (2 * 9, 28 * 1) and sum(n.values()) + len(kept) == 30 * 9


def test_grid_of_many_templates_sends_the_recordings(spark):
    """With more templates than can be told and few recordings no template is multiplied; frequencies are tested before."""
    sounds = spark.createDataFrame([(f"s{i}", f"s{i}", 10.0 + i, 24000 if i % 3 else 48000, 16, "mono") for i in range(30)], SOUNDSCAPES)
    templates = spark.createDataFrame([(f"t{i}", f"t{i}", f"t{i}", "x", 0.0, 5.0 + 2 * i, 24000 if i % 2 else 48000, 1.0, 5.0 + 2 * i, 512.0, 50.0) for i in range(12)], TEMPLATES)
    grids = [grid.match_grid(sounds, templates), grid.match_grid(sounds, templates, told=3), grid.match_grid(sounds, templates, told=3, told_recordings=3)]
    assert len({tuple(g.columns) for g in grids}) == 1
    rows = [sorted(map(repr, g.collect())) for g in grids]
    assert rows[0] == rows[1] == rows[2] and rows[0]
    plans = [g._jdf.queryExecution().optimizedPlan().toString() for g in grids]
    assert ["Generate" in p for p in plans] == [False, False, True] and all("Repartition" in p for p in plans[:2])


@pytest.mark.parametrize("told", [3, 100])
def test_grid_tasks_pair_rows_of_a_rate(spark, told):
    """Each side in turn is dealt in the order of rates, so that a file of a written grid has the names of few of them."""
    rates = [24000, 44100, 48000, 96000]
    sounds = spark.createDataFrame([(f"s{i}", f"s{i}", 10.0 + i % 9, rates[i % 4], 16, "mono") for i in range(80)], SOUNDSCAPES).repartition(3)
    templates = spark.createDataFrame([(f"t{i}", f"t{i}", f"t{i}", "x", 0.0, 5.0 + i % 9, rates[i % 4], 1.0, 5.0, 512.0, 50.0) for i in range(80)], TEMPLATES).repartition(3)
    df = grid.match_grid(sounds, templates, told=told)
    rows = df.select("soundscape_path", "template_path", F.spark_partition_id().alias("task"), F.col("soundscape_sample_rate").alias("rate")).collect()
    want = sorted((f"s{i}", f"t{j}") for i in range(80) for j in range(80) if i % 4 == j % 4 and 5 + j % 9 < 10 + i % 9)
    assert sorted((r["soundscape_path"], r["template_path"]) for r in rows) == want
    dealt = {r["template_path" if told == 3 else "soundscape_path"]: r["task"] for r in rows}
    tasks = {r["task"] for r in rows}
    assert len(tasks) >= 4 and max(list(dealt.values()).count(t) for t in tasks) <= 80 // len(tasks) + 4
    assert len({(r["task"], r["rate"]) for r in rows}) <= len(tasks) + len(rates) - 1


def test_required_columns_and_repeated_keys(spark):
    with pytest.raises(ValueError, match="template_path, template_file"):
        rois.detections_to_rois(spark.createDataFrame([], "soundscape_path string, soundscape_file string"), "u", "t")
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(Exception, match="isn't unique"):
        review.rows_update(old, new, "k", ["v"]).collect()
    assert sorted(map(tuple, review.rows_update(old, new.limit(1), "k", ["v"]).collect()))[1] == (2, "b")


def test_balancing_takes_rows_by_their_order(spark):
    df = spark.createDataFrame([(i, "TP" if i % 5 else "FP", i / 2000) for i in range(2000)], "detection_id long, validation string, peak_score double")
    rank = {r[0]: r[1] for r in df.select("detection_id", F.xxhash64(F.lit(1), "detection_id")).collect()}
    tp = sorted((i for i in range(2000) if i % 5), key=lambda i: (rank[i], i))
    fp = sorted((i for i in range(2000) if not i % 5), key=lambda i: (rank[i], i))
    down = sorted(r["detection_id"] for r in review.balanced(df, "down").collect())
    assert down == sorted(fp + tp[:400])
    up = review.balanced(df.filter("detection_id % 7 <> 0 or detection_id % 5 = 0"), "up")
    few = [i for i in fp]
    n = sum(1 for i in tp if i % 7)
    got = Counter(r["detection_id"] for r in up.filter("validation = 'FP'").collect())
    assert sum(got.values()) == n and {i for i, c in got.items() if c == n // 400 + 1} == set(few[: n % 400])


def test_rose_draws_rows(spark):
    scores = {"TP": [0.9, 0.5, 0.1], "FP": [0.2] * 50 + [0.8]}
    df = spark.createDataFrame([(i, k, s) for i, (k, s) in enumerate((k, s) for k, v in scores.items() for s in v)], "detection_id long, validation string, peak_score double")
    out = {k: np.array([r["peak_score"] for r in review.rose(df, n=6000).filter(F.col("validation") == k).collect()]) for k in scores}
    for k, v in scores.items():
        width = np.std(v, ddof=1) * (4 / (3 * len(v))) ** 0.2
        assert len(out[k]) == 3000 and abs(out[k].mean() - np.mean(v)) < 0.05
        assert abs(out[k].std() - np.sqrt(np.var(v) + width**2)) < 0.05
    assert 20 < (out["FP"] > 0.7).sum() < 110  # the rare row, drawn about once in 51


def test_coercion_of_missing_and_extra(spark):
    df = spark.createDataFrame([("1", "NA", "x", "0.5")], "_c0 string, roi_label string, ROI_WL string, roi_start string")
    out = rois.coerced(df)
    assert out.schema == ROIS
    r = out.first()
    assert (r["roi_label"], r["roi_wl"], r["roi_start"]) == (None, None, 0.5)
    assert len(DETECTIONS) == 21 and len(ROIS) == 19


def test_empty_tables(spark):
    assert peaks.score_peaks(spark.createDataFrame([], "pair_id string, frame_idx int, time_vec double, score double"), ["pair_id"], 3).count() == 0
    d, r = spark.createDataFrame([], "detection_id long, soundscape_file string, species string, template_file string, detection_start double, detection_end double"), spark.createDataFrame([], "roi_id long, soundscape_file string, species string, roi_start double, roi_end double")
    assert validation.validate_by_overlap(d, r, "u").count() == 0
