"""Numbers and running aggregates over an order of any size, in two levels.

Rows are dealt to ranges of the order and sorted inside them, once, as a written table; each range is a task of rows in
proportion to its share, so equal groups of any size are split over ranges. Every range's totals are one row; the totals
before it, summed over these few rows, go back by a broadcast (a row a range, at most two for groups that cross one).
Inside a range a window adds what stands before. Nothing in the plan grows with the ranges.

Edge cases: nulls come first in an ascending order; rows of equal order keys get distinct numbers, split over ranges too
(a hash of the row and the place where it was read break ties); an empty table gives an empty result; a null in a
running sum counts as nothing; columns of the input keep their names, whatever they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

#: monotonically_increasing_id: the number of the partition stands above this bit, the row's place in it below.
PLACE_BITS = 33


def _names(df: DataFrame, *names: str) -> list[str]:
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def _quoted(df: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def ranged(df: DataFrame, order: Sequence[Column], at: str, n: int = 0) -> DataFrame:
    """df dealt to n ranges of the order and sorted, a written table; column `at` holds the range above PLACE_BITS and the row's place below.

    Reading the source again must give the same rows (a file, a written table): ties are split by where a row was read.
    """
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie, = _names(df, "read_at")
    keys = [*order, F.col(tie)]
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return written(dealt.select(*_quoted(df), F.monotonically_increasing_id().alias(at)), "ranged")


def _part(at: str) -> Column:
    return F.shiftright(F.col(at), PLACE_BITS)


def numbered(df: DataFrame, name: str, *order: Column | str, n: int = 0) -> DataFrame:
    """df with the rows' numbers in the order, from 1, as column `name`."""
    order = [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order]
    at, part, before = _names(df, "at", "part", "rows_before")
    rows = ranged(df, order, at, n)
    counts = rows.groupBy(_part(at).alias(part)).agg(F.count("*").alias("n"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = counts.select(part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    place = F.col(at).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    told = rows.withColumn(part, _part(at)).join(F.broadcast(starts), part)
    return told.select(*_quoted(df), (F.col(before) + place + 1).alias(name))


def running(df: DataFrame, group: Sequence[str], order: Sequence[Column], sums: dict[str, Column] | None = None, xors: dict[str, Column] | None = None, leads: dict[str, Column] | None = None, n: int = 0) -> DataFrame:
    """df with running sums (and bitwise xors of longs) of each group in the order, each row's own value included.

    leads: values of the next row of the group, null after its last. A group may hold any share of all rows: it is cut
    into ranges like the whole. xors stand for sums that can't overflow.
    """
    sums, xors, leads = sums or {}, xors or {}, leads or {}
    at, part, g, carry, opened, nexts = _names(df, "at", "part", "group_key", "carry", "opened", "next_opens")
    folds = {name: F.sum for name in sums} | {name: F.bit_xor for name in xors}
    values = {**sums, **xors, **leads}
    own = dict(zip(values, _names(df, *(f"value_{i}" for i in range(len(values)))), strict=True))
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in group]
    first_values = df.withColumns({own[k]: c for k, c in values.items()})
    rows = ranged(first_values, [*(c.asc_nulls_first() for c in quoted), *order], at, n)
    rows = rows.withColumn(part, _part(at)).withColumn(g, F.struct(F.lit(0).alias("k"), *(c.alias(f"k{i}") for i, c in enumerate(quoted))))
    ends = rows.groupBy(part).agg(F.min_by(g, at).alias("first"), F.max_by(g, at).alias("last"), F.min_by(F.struct(F.lit(0).alias("k"), *(F.col(own[k]) for k in leads)), at).alias(nexts))
    parts = Window.orderBy(part)  # a row a range
    ends = written(ends.select(part, "first", "last", F.lag("last").over(parts).eqNullSafe(F.col("first")).alias(opened), F.lead("first").over(parts).eqNullSafe(F.col("last")).alias("goes_on"), F.lead(nexts).over(parts).alias(nexts)), "range-ends")
    cut = ends.filter(opened).select(part, F.col("first").alias(g)).union(ends.filter("goes_on").select(part, F.col("last").alias(g))).distinct()
    totals = rows.join(F.broadcast(cut), [part, g]).groupBy(part, g).agg(*(f(own[k]).alias(own[k]) for k, f in folds.items()), F.count("*").alias("n"))
    earlier = Window.partitionBy(g).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = written(totals.select(part, g, F.struct(F.lit(0).alias("k"), *(f(own[k]).over(earlier).alias(own[k]) for k, f in folds.items())).alias(carry)), "range-carries")
    inside = Window.partitionBy(part, g).orderBy(at)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({own[k]: folds[k](own[k]).over(so_far) if k in folds else F.lead(F.struct(own[k])).over(inside) for k in values})
    told = local.join(F.broadcast(before), [part, g], "left")
    if leads:
        told = told.join(F.broadcast(ends.filter("goes_on").select(part, F.col("last").alias(g), nexts)), [part, g], "left")

    def value(k: str) -> Column:
        if k in leads:
            return F.when(F.col(own[k]).isNull(), F.col(nexts)[own[k]]).otherwise(F.col(own[k])[own[k]])
        a, b = (F.coalesce(c, F.lit(0)) for c in (F.col(own[k]), F.col(carry)[own[k]]))
        return a + b if k in sums else a.bitwiseXOR(b)

    return told.select(*_quoted(df), *(value(k).alias(k) for k in values))
