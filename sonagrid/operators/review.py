"""A review session's operations as functions of tables: subset, order, progress, update, differences, balancing."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import prefix


def review_subset(df: DataFrame, template: str, low: float, high: float, kinds: tuple[str, ...]) -> DataFrame:
    return df.filter((F.col("template_name") == template) & F.col("peak_score").between(low, high) & F.col("validation").isin(*kinds))


def top_with_ties(df: DataFrame, n: int, by: list[str] | None = None, score: str = "peak_score") -> DataFrame:
    """Rows among the n highest, equals included; for each value of `by` if given. n = 0 is off.

    Over the whole table the n-th score is found by a limited sort, and rows are filtered by it: no single sorted task.
    """
    if not n:
        return df
    if by:
        return df.withColumn("__rank", F.rank().over(Window.partitionBy(*by).orderBy(F.desc(score)))).filter(F.col("__rank") <= n).drop("__rank")
    nth = df.filter(F.col(score).isNotNull()).orderBy(F.desc(score)).limit(n).agg(F.min(score).alias("__nth"))
    return df.join(F.broadcast(nth), F.col(score) >= F.col("__nth")).drop("__nth")


def shuffled(key: str, seed: int, *more: str) -> Column:
    """A hash, as text, by which rows are put in a random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *map(F.lit, more), F.col(key).cast("string")).cast("binary"))


def uniform(key: str, seed: int, *more: str) -> Column:
    """A number from 0 up to 1, hashed from the key."""
    return F.conv(F.substring(shuffled(key, seed, *more), 1, 13), 16, 10).cast("double") / float(1 << 52)


def ordered(df: DataFrame, *keys: tuple[str, bool], seed: int | None = None) -> DataFrame:
    """Sorted by (column, ascending) keys, detection_id last; with a seed in a random order of its own, that of a hash of seed and id."""
    if seed is not None:
        return df.orderBy(shuffled("detection_id", seed), "detection_id")
    return df.orderBy(*(F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in keys), "detection_id")


def _orders() -> dict[str, tuple[tuple[str, bool], ...]]:
    """The review orders by name: none, each key, and both keys in either place, each up or down."""
    keys = {"file": "soundscape_file", "score": "peak_score"}
    one = {f"{k}_{way}": ((c, way == "asc"),) for k, c in keys.items() for way in ("asc", "desc")}
    two = {f"{a}_{b}": (*one[a], *one[b]) for a in one for b in one if a.split("_")[0] != b.split("_")[0]}
    return {"original": (), **one, **two}


#: Besides these there is a random order, by `ordered` with a seed.
ORDERS = _orders()


def validation_pivot(df: DataFrame, kinds: tuple[str, ...] = ("TP", "FP", "UN", "NV")) -> DataFrame:
    """A row a template with the count of each kind; null where there is none."""
    return df.groupBy("template_name").pivot("validation", list(kinds)).count()


def progress(df: DataFrame, done: Column, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(done).alias("done"), F.count("*").alias("total"), F.round(F.count_if(done) / F.count("*"), 6).alias("share"))


def rows_update(df: DataFrame, new: DataFrame, key: str, columns: list[str], allowed: Column | None = None) -> DataFrame:
    """Overwrites columns by key where `new` has the key (and `allowed`, a condition on the old row, holds)."""
    hit = F.col("__new").isNotNull() & (allowed if allowed is not None else F.lit(True))
    return _merged(df, new, key, {c: F.when(hit, F.col(f"__new.{c}")).otherwise(F.col(c)) for c in columns})


def rows_patch(df: DataFrame, new: DataFrame, key: str, columns: list[str], empty: tuple[str, ...] = ("NV",)) -> DataFrame:
    """Fills columns by key where the old value is null or one of `empty`."""
    old = lambda c: F.when(~F.col(c).cast("string").isin(*empty), F.col(c)) if empty else F.col(c)
    return _merged(df, new, key, {c: F.coalesce(old(c), F.col(f"__new.{c}"), F.col(c)) for c in columns})


def _merged(df: DataFrame, new: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    # a key that is there twice leaves open which row counts: an error of the run, found where the join has the rows anyway
    row = F.when(F.count("*") > 1, F.raise_error(F.lit(f"{key} isn't unique in the new rows"))).otherwise(F.any_value(F.struct(*values)))
    packed = new.groupBy(key).agg(row.alias("__new"))
    return df.join(packed, key, "left").select(*(values[c].alias(c) if c in values else F.col(c) for c in df.columns))


def cell_update(df: DataFrame, key: str, value, column: str, new) -> DataFrame:
    return df.withColumn(column, F.when(F.col(key) == value, F.lit(new)).otherwise(F.col(column)))


def without(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't in other; null keys match each other."""
    o = other.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    return df.join(o, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)), "left_anti")


ROI_KEYS = ["soundscape_file", "roi_user", "roi_label", "roi_input_timestamp"]


def unsaved(current: DataFrame, saved: DataFrame) -> DataFrame:
    """Reviews whose user, time and state the saved table doesn't have together."""
    return without(current, saved, ["validation_user", "validation_time", "validation"])


def path_lookup(df: DataFrame, paths: DataFrame, key: str, column: str) -> DataFrame:
    return rows_update(df, paths.dropDuplicates([key]), key, [column])


def neighbours(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """The previous and next row's name in an ordered list of each key; at its ends the row's own."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("previous", F.coalesce(F.lag(name).over(w), F.col(name))).withColumn("next", F.coalesce(F.lead(name).over(w), F.col(name)))


#: A hash's leading bits number the buckets in which rows are counted, so the driver gets as many numbers at most.
BUCKET_BITS = 14


def _bucket(rank: Column) -> Column:
    return F.shiftright(rank, 64 - BUCKET_BITS)


def _lowest(df: DataFrame, rank: Column, key: str, n: int) -> DataFrame:
    """The n rows that come first by (rank, key). Rows are counted by bucket; only the bucket of the cut is ordered."""
    ranked = df.withColumn("rank_of_row", rank).withColumn("bucket_of_row", _bucket(F.col("rank_of_row")))
    total, cut, rest = 0, None, 0
    for r in sorted(ranked.groupBy("bucket_of_row").count().collect()):
        if total + r["count"] >= n:
            cut, rest = r["bucket_of_row"], n - total
            break
        total += r["count"]
    if cut is None:
        return df
    last = ranked.filter(F.col("bucket_of_row") == cut).orderBy("rank_of_row", key).limit(rest)
    return ranked.filter(F.col("bucket_of_row") < cut).union(last).select(*df.columns)


def balanced(df: DataFrame, method: str, label: str = "validation", key: str = "detection_id", seed: int = 1, rank: Column | None = None) -> DataFrame:
    """Equal numbers of both classes: 'down' samples the larger, 'up' repeats the smaller, 'none' leaves them.

    Rows are taken in the order of `rank`, by default a hash of their key, then of the key, which tells rows apart.
    """
    if method == "none":
        return df
    counts = {r[0]: r["count"] for r in df.groupBy(label).count().collect()}  # two classes
    if len(counts) != 2:
        raise ValueError("balancing needs two classes")
    low, high = min(counts, key=counts.get), max(counts, key=counts.get)
    rank = F.xxhash64(F.lit(seed), key) if rank is None else rank.cast("long")
    if method == "down":
        return df.filter(F.col(label) == low).union(_lowest(df.filter(F.col(label) == high), rank, key, counts[low]))
    if method == "up":
        whole, rest = divmod(counts[high], counts[low])
        small = df.filter(F.col(label) == low)
        copies = small.withColumn("copy_of_row", F.explode(F.sequence(F.lit(1), F.lit(whole)))).select(*df.columns)
        return df.filter(F.col(label) == high).union(copies).union(_lowest(small, rank, key, rest) if rest else small.limit(0))
    raise ValueError("method is none, up or down")


def rose(df: DataFrame, label: str = "validation", score: str = "peak_score", n: int | None = None, seed: int = 1, key: str = "detection_id") -> DataFrame:
    """(draw, label, score) by smoothed bootstrap: each class in equal numbers, drawn rows with normal noise of Silverman's width.

    Rows have a place in their class by the order of a hash, numbered in two levels. A draw names a class and a place,
    hashed from its number, and meets its row by a join.
    """
    rows = df.filter(F.col(score).isNotNull()).select(F.col(label).alias("label"), F.col(score).alias("score"), F.col(key).alias("key"))
    stats = {r["label"]: r for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.stddev("score").alias("sd")).collect()}
    if len(stats) != 2 or min(r["n"] for r in stats.values()) < 2:
        raise ValueError("ROSE needs two classes of two rows at least")
    total = (n or sum(r["n"] for r in stats.values())) // 2 * 2
    placed = prefix.running(rows, ["label"], [shuffled("key", seed).asc(), F.col("key").asc()], {"place": F.lit(1).cast("long")})
    draws = df.sparkSession.range(total)
    of = lambda f: F.when(F.col("id") % 2 == 0, F.lit(f(min(stats)))).otherwise(F.lit(f(max(stats))))
    place = (F.floor(uniform("id", seed, "place") * of(lambda name: float(stats[name]["n"]))) + 1).cast("long")
    width = of(lambda name: float((stats[name]["sd"] or 0.0) * (4 / (3 * stats[name]["n"])) ** 0.2))
    noise = F.sqrt(-2 * F.log(F.greatest(uniform("id", seed, "radius"), F.lit(1e-300)))) * F.cos(2 * np.pi * uniform("id", seed, "angle")) * width
    drawn = draws.select(F.col("id").alias("draw"), of(str).alias("label"), place.alias("place"), noise.alias("noise"))
    return drawn.join(placed, ["label", "place"]).select("draw", F.col("label").alias(label), (F.col("score") + F.col("noise")).alias(score))
