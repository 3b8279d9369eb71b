"""Threshold diagnostics of validated detections, for all templates at once.

Rows: (template_name, peak_score, validation in TP, FP, FN). Curves are grouped counts and running sums over a template's
distinct scores, in two levels (prefix), so that a template with any share of the rows is many tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import metrics
from . import prefix

KEY = "template_name"


def totals(validated: DataFrame) -> DataFrame:
    return validated.groupBy(KEY).agg(*(F.count_if(F.col("validation") == v).alias(f"n_{v.lower()}") for v in ("TP", "FP", "FN")))


def with_metrics(counts: DataFrame) -> DataFrame:
    return counts.select("*", *(c.alias(n) for n, c in metrics(*(F.col(x) for x in ("tp", "fp", "tn", "fn"))).items()))


def roc_curve(validated: DataFrame) -> DataFrame:
    """tp, fp, tn, fn at each distinct score as threshold; missed ROIs count as fn everywhere."""
    scored = validated.filter(F.col("validation").isin("TP", "FP") & F.col("peak_score").isNotNull())
    at = scored.groupBy(KEY, "peak_score").agg(F.count_if(F.col("validation") == "TP").alias("t"), F.count_if(F.col("validation") == "FP").alias("f"))
    curve = prefix.running(at, [KEY], [F.desc("peak_score")], {"tp": F.col("t"), "fp": F.col("f")}).join(totals(validated), KEY)
    counts = curve.select(KEY, "peak_score", "tp", "fp", (F.col("n_fp") - F.col("fp")).alias("tn"), (F.col("n_tp") - F.col("tp") + F.col("n_fn")).alias("fn"))
    return with_metrics(counts)


def confusion_grid(validated: DataFrame) -> DataFrame:
    """tp, fp, tn, fn at the thresholds 0, 0.01, ..., 1 below a template's highest score.

    Scores are counted by threshold interval, then summed over the intervals above: no product of rows and thresholds.
    """
    scored = validated.filter(F.col("validation").isin("TP", "FP") & F.col("peak_score").isNotNull())
    top = validated.groupBy(KEY).agg(F.max("peak_score").alias("top"))
    grid = top.select(KEY, "top", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("i")).withColumn("threshold", F.col("i") / 100).filter("threshold < top")
    # the last threshold that a score reaches
    i = F.least(F.greatest(F.floor(F.col("peak_score") * 100 + 1e-9), F.lit(-1)), F.lit(100))
    i = i - ((i / 100) > F.col("peak_score")).cast("int")
    binned = scored.select(KEY, i.cast("int").alias("i"), "validation").groupBy(KEY, "i").agg(F.count_if(F.col("validation") == "TP").alias("t"), F.count_if(F.col("validation") == "FP").alias("f"))
    down = Window.partitionBy(KEY).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    spine = top.select(KEY, F.explode(F.sequence(F.lit(-1), F.lit(100))).alias("i")).join(binned, [KEY, "i"], "left").na.fill(0, ["t", "f"])
    above = spine.select(KEY, "i", F.sum("t").over(down).alias("tp"), F.sum("f").over(down).alias("fp"))
    counts = grid.join(above, [KEY, "i"]).join(totals(validated), KEY)
    return with_metrics(counts.select(KEY, F.col("threshold").alias("peak_score"), "tp", "fp", (F.col("n_fp") - F.col("fp")).alias("tn"), (F.col("n_tp") - F.col("tp") + F.col("n_fn")).alias("fn")))


def filled(curve: DataFrame) -> DataFrame:
    """Ratios without cases become the template's largest, as the grid branch has it."""
    own = Window.partitionBy(KEY)
    return curve.withColumns({c: F.coalesce(c, F.max(c).over(own)) for c in ("precision", "recall", "sensitivity", "specificity")}).distinct()


def curves(validated: DataFrame, least: int = 4) -> DataFrame:
    """The full curve for templates with `least` TP and FP at least, the threshold grid for others."""
    enough = totals(validated).filter((F.col("n_tp") >= least) & (F.col("n_fp") >= least)).select(KEY)
    few = totals(validated).filter((F.col("n_tp") < least) | (F.col("n_fp") < least)).select(KEY)
    return roc_curve(validated.join(enough, KEY, "left_semi")).unionByName(filled(confusion_grid(validated.join(few, KEY, "left_semi"))))


def area(curve: DataFrame, x: Column, y: Column, name: str) -> DataFrame:
    """The trapezoidal area under y over x of each template in descending order of thresholds, 3 decimals."""
    points = curve.select(KEY, "peak_score", x.alias("x"), y.alias("y"))
    steps = prefix.running(points, [KEY], [F.desc("peak_score")], leads={"x2": F.col("x"), "y2": F.col("y")})
    return steps.groupBy(KEY).agg(F.round(F.sum((F.col("x2") - F.col("x")) * (F.col("y") + F.col("y2")) / 2), 3).alias(name))


def roc_auc(curve: DataFrame) -> DataFrame:
    return area(curve, 1 - F.col("specificity"), F.col("sensitivity"), "roc_auc")


def pr_auc(curve: DataFrame) -> DataFrame:
    return area(curve, F.col("recall"), F.col("precision"), "pr_auc")


def logistic_fit(validated: DataFrame, steps: int = 25, tolerance: float = 1e-10) -> DataFrame:
    """(template_name, intercept, slope, status) of the logistic regression of TP on the score.

    Newton's steps for all templates together: each is one grouped sum; two numbers a template reach the driver, and
    go back as a table that Spark broadcasts while it is small.
    """
    spark = validated.sparkSession
    rows = validated.filter(F.col("validation").isin("TP", "FP") & F.col("peak_score").isNotNull()).select(KEY, F.col("peak_score").alias("x"), (F.col("validation") == "TP").cast("double").alias("y"))
    rows = rows.groupBy(KEY, "x").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("t")).cache()
    try:
        return _newton(spark, rows, steps, tolerance)
    finally:
        rows.unpersist()


def _newton(spark, rows: DataFrame, steps: int, tolerance: float) -> DataFrame:
    schema = f"{KEY} string, b0 double, b1 double"
    names = [r[0] for r in rows.select(KEY).distinct().collect()]
    fit = {name: np.zeros(2) for name in names}
    status = dict.fromkeys(names, "not_converged")
    for _ in range(steps):
        left = [(n, float(fit[n][0]), float(fit[n][1])) for n in names if status[n] == "not_converged"]
        if not left:
            break
        p = 1 / (1 + F.exp(-(F.col("b0") + F.col("b1") * F.col("x"))))
        parts = rows.join(spark.createDataFrame(left, schema), KEY).withColumn("p", p).withColumn("w", F.col("n") * F.col("p") * (1 - F.col("p")))
        residual = F.col("t") - F.col("n") * F.col("p")
        sums = parts.groupBy(KEY).agg(F.sum(residual).alias("g0"), F.sum(residual * F.col("x")).alias("g1"), F.sum("w").alias("h00"), F.sum(F.col("w") * F.col("x")).alias("h01"), F.sum(F.col("w") * F.col("x") ** 2).alias("h11"))
        for r in sums.collect():
            h = np.array([[r["h00"], r["h01"]], [r["h01"], r["h11"]]])
            if not np.isfinite(h).all() or np.linalg.det(h) < 1e-14:
                status[r[KEY]] = "separated"
                continue
            step = np.linalg.solve(h, [r["g0"], r["g1"]])
            fit[r[KEY]] = fit[r[KEY]] + step
            if np.abs(step).max() < tolerance * (1 + np.abs(fit[r[KEY]]).max()):
                status[r[KEY]] = "ok"
    return spark.createDataFrame([(n, float(fit[n][0]), float(fit[n][1]), status[n]) for n in names], f"{KEY} string, intercept double, slope double, status string")


def auto_cutpoint(fit: DataFrame, pos_prob: float = 0.95) -> DataFrame:
    """The first of the scores 0.01 to 0.99 at which a TP has at least the probability pos_prob; none: no_cutpoint."""
    tried = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(99))).alias("i")).withColumn("s", F.col("i") / 100)
    ok = 1 / (1 + F.exp(-(F.col("intercept") + F.col("slope") * F.col("s")))) >= pos_prob
    cut = tried.groupBy(KEY, "intercept", "slope", "status").agg(F.min(F.when(ok, F.col("s"))).alias("score_cut"))
    return cut.withColumn("status", F.when(F.col("score_cut").isNull(), "no_cutpoint").otherwise(F.col("status")))


def manual_cutpoint(validated: DataFrame, diag_cut: float) -> DataFrame:
    if not 0 <= diag_cut <= 1:
        raise ValueError("diag_cut must be from 0 to 1")
    return validated.select(KEY).distinct().withColumn("score_cut", F.lit(float(diag_cut))).withColumn("status", F.lit("ok"))


def select_cutpoint(curve: DataFrame, cuts: DataFrame) -> DataFrame:
    """curve with selected: of the points at least as precise as the lowest one at or over the cut, those of the
    largest recall. Without a point over the cut none is selected."""
    joined = curve.join(cuts.select(KEY, "score_cut"), KEY, "left")
    own = Window.partitionBy(KEY)
    at = F.min_by("precision", F.when(F.col("peak_score") >= F.col("score_cut"), F.col("peak_score"))).over(own)
    marked = joined.withColumn("__at", at).withColumn("__ok", F.coalesce(F.col("precision") >= F.col("__at"), F.lit(False)))
    best = F.max(F.when(F.col("__ok"), F.col("recall"))).over(own)
    return marked.withColumn("selected", F.coalesce(F.col("__ok") & (F.col("recall") == best), F.lit(False))).drop("__at", "__ok")


def diagnostics(validated: DataFrame, pos_prob: float = 0.95, diag_cut: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(curves with the selected points, cut-points) of all templates."""
    cuts = manual_cutpoint(validated, diag_cut) if diag_cut is not None else auto_cutpoint(logistic_fit(validated), pos_prob)
    return select_cutpoint(curves(validated), cuts), cuts


def density_rows(validated: DataFrame) -> DataFrame:
    """Scores of TP and FP, and all of them once more as class All."""
    rows = validated.filter(F.col("validation").isin("TP", "FP")).select(KEY, "peak_score", F.col("validation").alias("class"))
    return rows.union(rows.withColumn("class", F.lit("All")))


def score_histogram(validated: DataFrame, n_bins: int = 20) -> DataFrame:
    """Counts of density_rows in equal bins of the scores from 0 to 1; scores outside fall into the ends."""
    i = F.least(F.greatest(F.floor(F.col("peak_score") * n_bins), F.lit(0)), F.lit(n_bins - 1)).cast("int")
    return density_rows(validated).groupBy(KEY, "class", i.alias("bin")).agg(F.count("*").alias("n"))


def score_density(validated: DataFrame, n_grid: int = 512, n_bins: int = 1024) -> DataFrame:
    """(template_name, class, i, score, density) of density_rows: Gaussian kernel densities on n_grid points.

    The bandwidth is the rule of thumb: 0.9 times the smaller of the standard deviation and the interquartile range over
    1.34, times n to the power -1/5; where the smaller is 0 the other, else the size of the first score, else 1 stands
    for it. Points go from three bandwidths below the least score to three above the greatest. Scores are binned
    linearly first: each gives its weight to the two nearest of n_bins points, so the kernel is summed over points, not
    over rows. Everything is grouped sums; a class is n_bins rows at most, whatever its scores. Quartiles are those of
    Spark's percentile. A class of fewer than two scores has no density.
    """
    rows = density_rows(validated).filter(F.col("peak_score").isNotNull())
    keys = [KEY, "class"]
    stats = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_samp("peak_score").alias("sd"), F.percentile("peak_score", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.min("peak_score").alias("low"), F.max("peak_score").alias("high"))
    iqr = (F.col("q")[1] - F.col("q")[0]) / 1.34
    least = F.least("sd", iqr)
    scale = F.when(least > 0, least).when(F.col("sd") > 0, F.col("sd")).when(F.col("low") != 0, F.abs("low")).otherwise(1.0)
    grid = stats.filter("n > 1").withColumn("bw", 0.9 * scale * F.pow(F.col("n"), F.lit(-0.2))).select(*keys, "n", "bw", (F.col("low") - 3 * F.col("bw")).alias("left"), (F.col("high") + 3 * F.col("bw")).alias("right"))
    step = (F.col("right") - F.col("left")) / (n_bins - 1)
    place = (F.col("peak_score") - F.col("left")) / step
    at = F.least(F.floor(place), F.lit(n_bins - 2))
    near = rows.join(F.broadcast(grid), keys).select(*keys, F.explode(F.array(F.struct(at.alias("j"), (at + 1 - place).alias("w")), F.struct((at + 1).alias("j"), (place - at).alias("w")))).alias("x"))
    binned = near.groupBy(*keys, "x.j").agg(F.sum("x.w").alias("w")).join(F.broadcast(grid), keys)
    points = binned.withColumn("x", F.col("left") + F.col("j") * step).groupBy(*keys).agg(F.collect_list(F.struct("x", "w")).alias("points"))  # n_bins at most
    spread = grid.join(points, keys).select("*", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))).alias("i"))
    score = F.col("left") + F.col("i") * (F.col("right") - F.col("left")) / (n_grid - 1)
    kernel = lambda p: p["w"] * F.exp(-F.pow((F.col("score") - p["x"]) / F.col("bw"), 2) / 2)
    total = F.aggregate(F.transform("points", kernel), F.lit(0.0), lambda s, v: s + v)
    return spread.withColumn("score", score).select(*keys, "i", "score", (total / (F.col("n") * F.col("bw") * (2 * np.pi) ** 0.5)).alias("density"))
