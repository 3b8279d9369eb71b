"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps; and those of similar members of groups.

Each step links vertices to the smallest vertex of their neighbourhood, found by an aggregate with partial sums; no
vertex's neighbours are gathered in one place, and a vertex that many edges share is joined by broadcast. Each round's
edges are written to the shared folder, which ends their lineage. The number of rounds grows with the logarithm of the
longest path.

Members that share a key are paired while they are few. In crowded groups they meet two leaders. Then a group is done if
its members are one component; if its pairs of different components are few for its rows, they are all compared; else
its members are split by further keys, of which every pair that passes shares one, and the same is done with these. So
the pairs that are compared are a bounded multiple of the members of each level. Only where no further keys are left are
the pairs of different components of a crowded group all compared, whatever their number, so that no link is lost.

A key that many members share is dealt to many tasks: it is found in a sample, salted for the counts, and joined by
broadcast; what the sample misses costs evenness, not results.

Edge cases: an empty edge table gives an empty result; edges from a vertex to itself and repeated edges change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import HOT_ROWS, HOT_SHARE, drop_path, join_hot, new_path, scratched, written

#: Groups of a shared key up to SMALL_GROUP are paired at once; crowded ones whose pairs of different components are
#: PAIRS_A_ROW at most for each row are compared as a whole, others are split.
SMALL_GROUP, PAIRS_A_ROW = 64, 64
#: One in so many members is in the sample that finds keys of many members.
SAMPLED = 64


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return join_hot(both, least, ["a"], "n", 2 * total).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    linked = join_hot(down, least, ["a"], "n", total).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex but the roots: root is the smallest vertex that v reaches. edges: (a, b) of longs."""
    spark = edges.sparkSession
    current, path, before = edges.select("a", "b").filter("a <> b"), "", None

    def put(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        new, seen = new_path(spark, "components"), Observation()
        df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).write.parquet(new)
        return spark.read.schema("a long, b long").parquet(new), new, (seen.get["n"], seen.get["h"])

    current, path, before = put(current)
    while before[0]:
        starred, between, n = _large_star(current, before[0]), "", 2 * before[0]
        if n >= HOT_ROWS:  # written, so that its joins aren't made again for the next ones; a smaller graph has no hot vertex
            starred, between, (n, _) = put(starred)
        last, (current, path, state) = path, put(_small_star(starred, n))
        for done in filter(None, (last, between)):
            drop_path(spark, done)
        if state == before:
            break
        before = state
    scratched(path)
    return current.select(F.col("a").alias("v"), F.col("b").alias("root"))


def hot_keys(keyed: DataFrame) -> DataFrame:
    """(key) of the keys that a sample of the members v says have HOT_SHARE of all rows: 1 / HOT_SHARE keys at most."""
    seen = Observation()
    sample = keyed.filter(F.pmod(F.xxhash64("v"), F.lit(SAMPLED)) == 0).groupBy("key").agg(F.count("*").alias("n"))
    counts = written(sample.observe(seen, F.sum("n").alias("total")).filter("n > 15"), "often")
    return counts.filter(F.col("n") >= HOT_SHARE * (seen.get["total"] or 0)).select("key")


def key_groups(keyed: DataFrame, once: bool = True) -> DataFrame:
    """(..., n) of keyed (v, key, ...): the rows of keys that n > 1 rows share, a written table.

    once: of keys with the same sharers (by their number and two hash sums) one stays. The rows are shuffled once, for the
    counts and the join (`seen` reads all columns, so that both want the same shuffle); those of hot keys are salted.
    """
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = keyed.join(F.broadcast(hot_keys(keyed).withColumn("hot", F.lit(True))), "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    salted = told.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("v"), F.lit(n)).cast("int")).otherwise(0)).repartition(n, "key", "salt")
    parts = salted.groupBy("key", "salt", "hot").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v")).alias("s1"), F.bit_xor(F.xxhash64("v", F.lit(1))).alias("s2"), F.max(F.xxhash64(*keyed.columns)).alias("seen"))
    shared = parts.filter((F.col("hot") | (F.col("n") > 1)) & F.col("seen").isNotNull()).groupBy("key", "hot").agg(F.sum("n").alias("n"), F.bit_xor("s1").alias("s1"), F.bit_xor("s2").alias("s2")).filter("n > 1")
    groups = shared.groupBy("n", "s1", "s2").agg(F.min(F.struct("key", "hot")).alias("k")).select("k.key", "n", "k.hot") if once else shared
    hot = F.broadcast(groups.filter("hot").select("key", F.col("n").alias("hot_n")))
    some = groups.filter("not hot").select("key", F.lit(0).alias("salt"), F.col("n").alias("some_n"))
    joined = salted.join(some, ["key", "salt"], "left").join(hot, "key", "left").withColumn("n", F.when(F.col("hot"), F.col("hot_n")).otherwise(F.col("some_n")))
    return written(joined.filter("n is not null").select(*keyed.columns, "n"), "key-groups")


def similar_components(
    members: DataFrame, verify: Callable[[DataFrame], DataFrame], similarity: float, split: Callable[[DataFrame, int], DataFrame | None],
    candidates: DataFrame | None = None, small_group: int = SMALL_GROUP,
) -> DataFrame:
    """(v, root) of the graph of all pairs that share a key, or are candidates (a, b), and pass.

    members: key_groups. verify takes pairs (a, b) and keeps those that hold; none holds of which one size is less than
    similarity times the other. split takes rows of members and the next level (2, 3, ...) and gives the rows under
    further keys, of which any two that hold share one; None where there are no further keys.
    """
    alike = F.least("x.size", "y.size") >= similarity * F.greatest("x.size", "y.size") - 1e-9
    ordered = (F.least("x.v", "y.v").alias("a"), F.greatest("x.v", "y.v").alias("b"))
    same, apart = F.col("x.key") == F.col("y.key"), F.col("x.v") != F.col("y.v")

    def first_pairs(rows: DataFrame, total: int) -> DataFrame:
        """All pairs of small groups, and those of crowded groups' members with two leaders."""
        few, many = rows.filter(F.col("n") <= small_group).alias("x"), rows.filter(F.col("n") > small_group)
        member = F.struct("v", "size")
        led = many.groupBy("key").agg(F.array(F.min_by(member, F.xxhash64("v", "key")), F.max_by(member, F.xxhash64("v", "key"))).alias("leaders"), F.count("*").alias("n"))
        met = join_hot(many.select("key", "v", "size"), written(led, "leaders"), ["key"], "n", total).select("v", "size", F.explode("leaders").alias("l"))
        met = met.select(F.struct("v", "size").alias("x"), F.col("l").alias("y")).filter(apart & alike)
        return few.join(few.alias("y"), same & (F.col("x.v") < F.col("y.v")) & alike).select(*ordered).union(met.select(*ordered))

    pairs = first_pairs(members, members.count())
    if candidates is not None:
        pairs = pairs.union(candidates.select("a", "b"))
    roots = connected_components(written(verify(pairs.distinct()), "similar"))
    level, many = 2, members.filter(F.col("n") > small_group)
    while not many.isEmpty():
        placed = written(many.drop("n", "root").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v")), "placed")
        parts = placed.groupBy("key", "root").agg(F.count("*").alias("c"))
        sums = F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("own"), F.count("*").alias("parts"), F.max_by("root", F.struct("c", "root")).alias("main")
        mixed = parts.groupBy("key").agg(*sums).filter("parts > 1").withColumn("whole", (F.col("n") * F.col("n") - F.col("own")) / 2 <= PAIRS_A_ROW * F.col("n"))
        mixed = written(mixed.select("key", "n", "main", "whole"), "mixed")
        if mixed.isEmpty():
            return roots
        x = written(join_hot(placed, mixed, ["key"], "n", placed.count()), "mixed-members")
        further = split(x.filter("not whole").drop("main", "whole"), level)
        whole = x if further is None else x.filter("whole")
        # of two members outside the main component each would meet the other: once is enough
        outside, differ = whole.filter("root <> main"), F.col("x.root") != F.col("y.root")
        once = (F.col("x.v") < F.col("y.v")) | (F.col("y.root") == F.col("y.main"))
        pairs = outside.alias("x").join(whole.alias("y"), same & differ & once & alike).select(*ordered)
        if further is not None:
            grouped = key_groups(further)
            pairs = pairs.union(first_pairs(grouped, grouped.count()))
            many = grouped.filter(F.col("n") > small_group)
        new = written(verify(pairs.distinct()), "similar")
        roots = connected_components(new.union(roots.select(F.col("v").alias("a"), F.col("root").alias("b"))))
        if further is None:
            break
        level += 1
    return roots
