"""Document fingerprints by a homomorphic multiset hash of paragraphs, in DataFrame functions only.

A fingerprint is a vector of integers. Each paragraph (line) is hashed to a wide vector, and a document's vector is the
sum of its paragraphs' vectors, lane by lane, modulo a power of two. So the order of paragraphs doesn't matter, and a
paragraph can be inserted or deleted by adding or subtracting its vector, without the rest of the text.

The vector has two parts. EQUAL_LANES lanes modulo 2**32 are independent hashes of the whole paragraph: equal multisets
have equal sums, others differ but for chance. 64 lanes modulo 2**32 add up signs hashed from the paragraph's word pairs
(of the paragraph alone, so the sum stays homomorphic): the inner product of two documents' lanes estimates how many
word pairs they share, and its cosine is the likeness of two fingerprints.

Edge cases: a null text is the empty one; the empty text has the zero vector, two zero vectors are alike (1) and a zero
vector and another are not (0); repeated rows have equal fingerprints. The next document of a repeated id is another row
of that id while there is one, in the order of the texts. Very long texts are paragraphs and word pairs like others,
summed as they are cut; an empty table gives an empty result; only key and text columns are read, so that others can't
clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, whole_text, written

EQUAL_LANES = 4
SIGN_LANES = 64
MOD = 1 << 32
#: Two counters of 32 bits share a long: bit i of a hash and bit i + 32.
PAIR_MASK = (1 << 32) | 1
HALF = SIGN_LANES // 2


def _words(paragraph: Column) -> Column:
    return F.filter(F.split(paragraph, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _pairs(words: Column) -> Column:
    """Word pairs, the last word with the paragraph's end; so n words give n pairs, none crosses a paragraph."""
    ends = F.concat(F.slice(words, 2, F.size(words)), F.array(F.lit("")))
    return F.when(F.size(words) > 0, F.zip_with(words, ends, lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))


def paragraph_units(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Rows (keys, p0, p1, i, h): h the hash of word pair i of a paragraph, p0 and p1 the paragraph's own hashes.

    A paragraph without words has one row without a pair, a text without paragraphs one row of nulls.
    """
    lines = df.select(*keys, F.explode_outer(F.filter(F.split(text, "\n"), lambda p: p != "")).alias("paragraph"))
    hashes = [F.when(F.col("paragraph").isNotNull(), F.xxhash64(F.lit(f"lane{i}"), F.col("paragraph"))).alias(f"p{i}") for i in range(EQUAL_LANES // 2)]
    units = lines.select(*keys, *hashes, _pairs(_words(F.col("paragraph"))).alias("pairs"))
    return units.select(*keys, *(f"p{i}" for i in range(EQUAL_LANES // 2)), F.posexplode_outer("pairs").alias("i", "h"))


def fingerprints(units: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, equal, signs) of units: the sums that make a fingerprint. Each map task sums before the shuffle."""
    first = F.coalesce(F.col("i"), F.lit(0)) == 0
    equal = []
    for i in range(EQUAL_LANES // 2):
        lane = F.when(first, F.col(f"p{i}"))
        equal += [F.sum(lane.bitwiseAND(F.lit(MOD - 1))).alias(f"e{2 * i}"), F.sum(F.shiftrightunsigned(lane, 32)).alias(f"e{2 * i + 1}")]
    ones = [F.sum(F.shiftrightunsigned(F.col("h"), i).bitwiseAND(F.lit(PAIR_MASK))).alias(f"s{i}") for i in range(HALF)]
    sums = units.groupBy(*keys).agg(F.count("h").alias("n_pairs"), *equal, *ones)
    low = [F.col(f"s{i}").bitwiseAND(F.lit(MOD - 1)) for i in range(HALF)]
    high = [F.shiftrightunsigned(F.col(f"s{i}"), 32) for i in range(HALF)]
    signs = F.array(*(F.coalesce(2 * c - F.col("n_pairs"), F.lit(0)).cast("long") for c in (*low, *high)))
    lanes = F.array(*(F.pmod(F.coalesce(F.col(f"e{i}"), F.lit(0)), F.lit(MOD)) for i in range(EQUAL_LANES)))
    return sums.select(*keys, lanes.alias("equal"), signs.alias("signs"))


def fingerprint_of(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, equal, signs, fingerprint) of the texts; the keys must tell rows apart."""
    out = fingerprints(paragraph_units(docs.select(*keys, whole_text(text_col).alias("text")), keys, "text"), keys)
    return out.withColumn("fingerprint", as_text(F.col("equal"), F.col("signs")))


def as_text(equal: Column, signs: Column) -> Column:
    """A fingerprint as lowercase hex: its lanes, 8 digits each, modulo 2**32."""
    lanes = F.concat(equal, signs)
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(F.pmod(x, F.lit(MOD)))), 8, "0")), "")


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes after inserting (sign 1) or deleting (-1) the paragraphs of b; for either part of a fingerprint.

    Lanes are kept from -2**31 to 2**31 - 1, so signed sums stay what they are, and equal lanes are equal.
    """
    return F.zip_with(a, b, lambda x, y: F.pmod(x + F.lit(sign) * y + F.lit(MOD // 2), F.lit(MOD)) - F.lit(MOD // 2))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the sign lanes, 0 to 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    aa, bb = dot(a, a), dot(b, b)
    cosine = F.coalesce(F.try_divide(dot(a, b), F.sqrt(aa) * F.sqrt(bb)), F.lit(0.0))
    return F.when((aa == 0) & (bb == 0), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


#: Rows of a range are numbered from one; the range stands above this bit.
RANGE_BIT = 40


def with_next(docs: DataFrame, n_ranges: int) -> DataFrame:
    """Adds pos, next_pos and next_text to (doc_id, text): the next row by descending id, after the last the first.

    Rows are dealt to ranges of the id, found from its distribution, and ordered inside each range; a range's last row
    takes the first text of the following range. No task holds more than its ranges: several small ones, so that tasks
    are even. A row finds its range in two steps, among every m-th bound and then among m. Null ids come last.
    """
    shares = [i / n_ranges for i in range(1, n_ranges)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * n_ranges))).first()[0] or []
    bounds = sorted(set(bounds))
    m = max(1, round(len(bounds) ** 0.5))
    # one constant each in the plan, however many bounds there are: texts that are split and folded
    told = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    above = F.lit(0)
    if bounds:  # the bounds below the first one that isn't, counted by whole parts and inside one
        below = lambda xs: F.size(F.filter(xs, lambda b: b < F.col("doc_id")))
        tops = bounds[m - 1 :: m] + ([bounds[-1]] if len(bounds) % m else [])
        part = below(told(tops))
        above = len(bounds) - F.when(part < len(tops), part * m + below(F.slice(told(bounds), part * m + 1, m))).otherwise(len(bounds))
    n = len(bounds)
    ranged = docs.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(n + 1)).otherwise(above).cast("long"))
    inside = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").asc())
    led = ranged.select("*", F.lead("text").over(inside).alias("led"), F.lead(F.lit(True)).over(inside).alias("inner"), F.row_number().over(inside).cast("long").alias("n"))
    firsts = ranged.groupBy("range").agg(F.min_by("text", F.struct(F.coalesce(-F.col("doc_id"), F.lit(0)), F.col("text"))).alias("first_text"))
    order = Window.orderBy("range")  # a row a range
    before = ranged.select("range").distinct().select("range", F.coalesce(F.lag("range").over(order), F.max("range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    following = firsts.join(F.broadcast(before), "range").select(F.col("before").alias("range"), F.col("range").alias("next_range"), "first_text")
    joined = led.join(following, "range", "left")
    start = lambda c: F.shiftleft(c, RANGE_BIT)
    return joined.select(
        "doc_id", "text", (start("range") + F.col("n")).alias("pos"),
        F.when(F.col("inner"), start("range") + F.col("n") + 1).otherwise(start("next_range") + 1).alias("next_pos"),
        F.when(F.col("inner"), F.col("led")).otherwise(F.col("first_text")).alias("next_text"),
    )


def op9_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text of documents and of its edited text, and how alike they and the next document are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text"))
    third = "cast(floor(length(text) / 3) as int)"
    pairs = with_next(docs, 8 * max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))).select(
        "doc_id", "pos", "next_pos", "text", F.length("text").cast("long").alias("n_chars"),
        F.expr(f"concat(substr(text, 1, length(text) - {third}), substr(next_text, 1, {third}))").alias("edited"),
    )
    both = pairs.withColumn("edited_sha256", F.sha2("edited", 256)).select(
        "doc_id", "pos", "next_pos", "n_chars", "edited_sha256",
        F.posexplode(F.array("text", "edited")).alias("kind", "version"),
    )
    keys = ["pos", "kind", "next_pos", "doc_id", "n_chars", "edited_sha256"]
    sums = fingerprints(paragraph_units(both, keys, "version"), keys)
    found = written(sums.withColumn("signs", F.col("signs").cast("array<int>")), "multiset-hash")
    own = found.filter("kind = 0").drop("kind")
    edited = found.filter("kind = 1").select("pos", F.col("equal").alias("edited_equal"), F.col("signs").alias("edited_signs"))
    following = found.filter("kind = 0").select(F.col("pos").alias("next_pos"), F.col("signs").alias("next_signs"))
    return own.join(edited, "pos").join(following, "next_pos").select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("equal"), F.col("signs").cast("array<bigint>")).alias("fingerprint"),
        as_text(F.col("edited_equal"), F.col("edited_signs").cast("array<bigint>")).alias("edited_fingerprint"),
        likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"),
        likeness(F.col("signs"), F.col("next_signs")).alias("near_next"),
    )
