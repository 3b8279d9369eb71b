"""Two-level numbers and running aggregates against loops, with hot groups, ties, nulls and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from sonagrid.operators import prefix

SCHEMA = "g string, o int, v long, at string, part int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [("hot", rng.randrange(400), rng.randrange(-50, 50), "at", 1) for _ in range(700)]  # a group over several ranges
    out += [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(9)]), rng.choice([None, 1, 2, 3]), "at", 1) for _ in range(300)]
    return out


def key(r):
    return (r[0] is not None, r[0] or ""), (r[1] is not None, r[1] or 0)


def test_numbers(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = prefix.numbered(df, "number", "g", "o", n=7).collect()
    assert sorted(r["number"] for r in got) == list(range(1, len(rows) + 1))
    got.sort(key=lambda r: r["number"])
    assert [key(r) for r in got] == sorted(map(key, rows))
    assert sorted(map(str, (r[:5] for r in got))) == sorted(map(str, rows))
    assert prefix.numbered(spark.createDataFrame([], SCHEMA), "number", "g").count() == 0
    plan = prefix.numbered(df, "number", "g", n=200)._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 4_000  # nothing grows with the ranges


def test_running(spark, rows):
    unique = [(g, i, v, a, p) for i, (g, _, v, a, p) in enumerate(rows)]
    df = spark.createDataFrame(unique, SCHEMA).repartition(5)
    got = prefix.running(df, ["g"], [F.desc("o")], {"total": F.col("v"), "rows": F.lit(1)}, {"mixed": F.xxhash64("o")}, {"next_o": F.col("o"), "next_v": F.col("v")}, n=6).collect()
    hashes = {r["o"]: r["h"] for r in df.select("o", F.xxhash64("o").alias("h")).collect()}
    want = []
    for g in {r[0] for r in unique}:
        total = n = mixed = 0
        own = sorted((r for r in unique if r[0] == g), key=lambda r: -r[1])
        for r, after in zip(own, [*own[1:], None], strict=True):
            total, n, mixed = total + (r[2] or 0), n + 1, mixed ^ hashes[r[1]]
            want.append((*r, total, n, mixed, after and after[1], after and after[2]))
    assert sorted(map(tuple, got), key=lambda r: r[1]) == sorted(want, key=lambda r: r[1])
    whole = prefix.running(df, [], [F.asc("o")], {"rows": F.lit(1)}, n=6).collect()
    assert all(r["rows"] == r["o"] + 1 for r in whole)
    assert prefix.running(spark.createDataFrame([], SCHEMA), ["g"], [F.asc("o")], {"x": F.col("v")}).count() == 0
