"""Mixing to target weights with soft membership, in DataFrame functions only.

A classifier fitted on the labelled table gives each document the posteriors of its domains. It is a Gaussian
discriminant over a fixed set of text statistics: the class moments are one grouped aggregate over labelled rows, and
scoring is arithmetic on columns. Document rates are then fitted: nonnegative numbers r whose expected token totals,
the sums of r * tokens * posterior over all documents, match the targets of the domains in least squares, starting from
rate 1. Each step of the projected gradient is one pass that sums the totals of the present rates; the
residuals, one number a domain, are all that reaches the driver, where the inverse of the domains' moment matrix scales
them (least squares in that metric, so a few steps suffice). A document's rate is a fold of its posteriors over the
steps so far, so no rates are stored between steps. The result says how near the targets it came.

Edge cases: a null or empty text has no tokens and keeps its rate; a class without labelled rows gets posterior 0, and
a target for it can't be met; without any labels all posteriors are equal; null labels are no labels; of several
labels of an id the highest domain counts; rows that agree in id and text have one rate and one draw; very long texts
are rows like others; an empty table gives an empty result; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, named, scratch, small, table, whole_text, written

#: The domains that the labelled table tells apart: text of low and of high quality.
DOMAINS = ("low", "high")
TARGETS = {"low": 0.05, "high": 0.95}
#: The mean rate of the domain with the largest weight where no budget is given: a little over 1, so that documents
#: that clearly belong to it stay; the rest over 1 is drawn as second copies.
ANCHOR_RATE = 1.02
#: The least s.d. of a statistic within a class.
FLOOR = 0.02


def tokens(text: Column) -> Column:
    """Words: runs of characters that aren't white space, as they begin."""
    return F.regexp_count(text, F.lit(r"(?:^|\s)(?=\S)")).cast("long")


def statistics(text: Column) -> dict[str, Column]:
    """Shares of kinds of characters and lengths; all in the range of about 0 to 1."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: (n - F.length(F.regexp_replace(text, pattern, ""))) / n
    return {
        "symbols": share(r"[^\p{L}\p{N}\s.,]"), "capitals": share(r"\p{Lu}"), "digits": share(r"\p{N}"), "spaces": share(r"\s"),
        "marks": share("[.,]"), "length": F.log(n + 1.0) / 12.0, "repeats": share(r"\b([\p{L}\p{N}]+)(?=[^\p{L}\p{N}]+\1\b)"),
        "line ends": F.sqrt(share("\n")),
    }


def features_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rh, n_tokens, s): a document's statistics, rh the hash of its text."""
    text = whole_text(text_col)
    return docs.select(named(id_col).alias("id"), F.xxhash64(text).alias("rh"), tokens(text).alias("n_tokens"), F.array(*(c.cast("double") for c in statistics(text).values())).alias("s"))


def domain_labels(labels: DataFrame) -> DataFrame:
    """(id, domain) by the labelled table: number in DOMAINS."""
    domain = F.when(F.col("quality") == 0, 0).when(F.col("quality") > 0, 1)
    return labels.select(F.col("doc_id").alias("id"), domain.alias("domain")).filter("domain is not null").groupBy("id").agg(F.max("domain").alias("domain"))


def posteriors(features: DataFrame, labels: DataFrame) -> DataFrame:
    """features with p, the posteriors of DOMAINS."""
    m = len(statistics(F.lit("")))
    moments = [f(F.col("s")[i]).alias(f"{name}{i}") for i in range(m) for name, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    rows = features.join(labels, "id").groupBy("domain").agg(F.count("*").alias("n"), *moments).collect()  # a row a domain
    total = sum(r["n"] for r in rows)
    logs = []
    for k in range(len(DOMAINS)):
        r = next((r for r in rows if r["domain"] == k), None)
        if r is None:
            logs.append(F.lit(float("-inf")) if rows else F.lit(0.0))
            continue
        log = F.lit(math.log(r["n"] / total))
        for i in range(m):
            sd = max(r[f"sd{i}"] or 0.0, FLOOR)
            log = log - ((F.col("s")[i] - r[f"mean{i}"]) / sd) ** 2 / 2 - math.log(sd)
        logs.append(log)
    top = F.array_max(F.col("logs"))
    raised = features.withColumn("logs", F.array(*logs)).withColumn("e", F.transform("logs", lambda x: F.exp(x - top)))
    total_e = F.aggregate("e", F.lit(0.0), lambda s, x: s + x)
    return raised.withColumn("p", F.transform("e", lambda x: x / total_e)).drop("logs", "e")


def fitted_rates(members: DataFrame, targets: list[float], steps: int = 30, enough: float = 1e-7) -> DataFrame:
    """members (n_tokens, p, ...) with rate, residual and converged. targets: the tokens that each domain is to have, as shares of all tokens.

    residual: the largest difference from a target; converged: it is at most `enough`. Targets that no nonnegative rates
    meet, such as those of a domain without documents, end as near as the steps come, not converged.
    """
    k = range(len(targets))

    def rates(slopes: list[list[float]]) -> Column:
        """The fold over the steps so far: from 1, each against its slope and never below 0."""
        rate = F.lit(1.0)
        if not slopes:
            return rate
        history = F.lit(slopes).cast("array<array<double>>")

        def step(r: Column, d: Column) -> Column:
            slope = F.aggregate(F.zip_with(F.col("p"), d, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
            return F.greatest(F.lit(0.0), r - slope)

        return F.aggregate(history, rate, step)

    slopes: list[list[float]] = []
    best: tuple[float, int] = (math.inf, 0)
    for _ in range(steps + 1):
        now = members.select("n_tokens", "p", rates(slopes).alias("rate"))
        share = lambda i: F.col("n_tokens") * F.col("p")[i]
        moment = [F.sum(F.when(F.col("rate") > 0, share(i) * F.col("p")[j])) for i in k for j in k]
        got = now.agg(F.sum("n_tokens"), *(F.sum(share(i) * F.col("rate")) for i in k), *moment).first()
        total = float(got[0] or 0)
        if not total:
            best = (0.0 if not any(targets) else math.inf, 0)
            break
        residual = np.array(got[1 : 1 + len(targets)], dtype=float) / total - np.array(targets)
        best = min(best, (float(np.abs(residual).max()), len(slopes)))
        if best[0] <= enough:
            break
        # rates at 0 don't move, so the moments of the others scale the step
        free = np.array([x or 0.0 for x in got[1 + len(targets) :]], dtype=float).reshape(len(targets), -1) / total
        slopes.append((np.linalg.inv(free + 1e-9 * np.eye(len(targets))) @ residual).tolist())
    return members.withColumns({"rate": rates(slopes[: best[1]]), "residual": F.lit(best[0]), "converged": F.lit(best[0] <= enough)})


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = TARGETS, budget: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rh, n_tokens, p, rate, residual, converged) of each document.

    budget: the tokens wanted as a share of those there; by default such that the domain of the largest weight has
    the mean rate ANCHOR_RATE.
    """
    members = written(posteriors(written(features_of(docs, id_col, text_col), "text-statistics"), labels), "posteriors")
    order = [weights.get(d, 0.0) for d in DOMAINS]
    if budget is None:
        k = order.index(max(order))
        share = members.agg(F.try_divide(F.sum(F.col("n_tokens") * F.col("p")[k]), F.sum("n_tokens"))).first()[0]
        budget = ANCHOR_RATE * (share or 1.0) / order[k]
    return fitted_rates(members, [budget * w for w in order])


def draw(rate: Column, *key: str) -> Column:
    """How many copies of a document the mixture has at its rate: the whole part, and one more if a uniform number hashed from its key is below the rest."""
    uniform = F.pmod(F.xxhash64(F.lit("mix"), *key), F.lit(1 << 40)) / float(1 << 40)
    return (F.floor(rate) + (uniform < rate - F.floor(rate)).cast("long")).cast("long")


def thinned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """docs in the mixture: each row as often as its rate draws, so that expected totals are the targets at any rate."""
    own_hash, own_id, rh, copies = fresh(docs, "hash", "own_id", "rh", "copies")
    with scratch(docs.sparkSession):
        rates = mix(docs, labels, id_col=id_col, text_col=text_col, **parameters)
        # what is told of rows is which go or are repeated: a small table, where the mixture leaves most as they are
        drawn = rates.select(F.col("id").alias(own_id), F.col("rh").alias(rh), draw(F.col("rate"), "id", "rh").alias(copies))
        changed = written(drawn.filter(F.col(copies) != 1).distinct(), "thinned", keep=True)
    own = docs.withColumn(own_hash, F.xxhash64(whole_text(text_col)))
    told = own.join(small(changed), (F.col(own_hash) == F.col(rh)) & named(id_col).eqNullSafe(F.col(own_id)), "left")
    n = F.coalesce(F.col(copies), F.lit(1)).cast("int")
    return told.select(*map(named, docs.columns), F.explode(F.array_repeat(F.lit(0), n)).alias(copies)).drop(copies)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, posteriors, rate and copies."""
    rates = mix(table(spark, sf_dir, "documents"), domain_labels(table(spark, sf_dir, "labels")))
    p = [F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)]
    copies = draw(F.col("rate"), "id", "rh")
    return rates.select(F.col("id").alias("doc_id"), "n_tokens", *p, "rate", (copies > 0).alias("kept"), copies.alias("copies"), "residual", "converged")
