"""SimHash near-duplicates, linked through deletion-variant signatures; and near-duplicates by Jaccard similarity.

A fingerprint is cut into so few segments that of two linked fingerprints at least one segment differs by one bit at
most. Each segment is indexed under all its one-wildcard variants (the segment with one bit left out): segments that
differ by one bit or not at all share a variant. Fingerprints that share one are joined by equality and verified.

Groups: equal fingerprints are merged first. Sharers of a variant are paired while they are `small_group` at most, so
pairs stay in proportion to the rows. Larger groups go another way: each member is hashed to its own value and its 64
one-bit neighbours; two fingerprints share one of these 65 values exactly if they differ by two bits at most, so linking
each to the smallest sharer gives the exact components without pairs.

Near-duplicates by Jaccard similarity (5-word shingles, 0.8 or more: the pipeline's stage) take the same variants of the
distinct shingles' fingerprints as candidates. A pair of similarity 0.8 differs in about 10 of 64 bits, beyond what
variants reach, so texts that share a shingle of their prefixes are candidates too, which misses no pair. Candidates
are sieved by a bound (parity bitmaps of their sets differ in no more bits than the sets in shingles), and whole sets of
shingles verify the rest; texts with equal sets are one class.

Edge cases: a null text is the empty one; texts without words have the fingerprint zero and are linked with each other;
repeated rows are equal fingerprints, of near-duplicates one stays; a null id is ignored in the smallest id of a
component unless all are null, and is the smallest id of a group of near-duplicates; ties in the id go to the least hash
of the text; an empty table gives an empty result; very long texts are hashed in blocks of shingles; other columns are
kept as they are by one_of_each_group, whatever their names, and not read by near_duplicates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cache_of, fresh, let, named, release, scratch, small, table, whole_text, written
from .components import SMALL_GROUP, connected_components, key_groups, similar_components

SLICE = 256
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15
#: The bits of each byte's value, lowest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(float)


def shingle_hashes(text: str, width: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of `width` words, A-Z lower-cased; of all words together if they are fewer."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change; space and 9 to 13 separate
    if not words:
        return
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < width:
        yield np.array([digest(joined, seed)], np.uint64)
        return
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, ends = np.concatenate([[0], ends[:-1]]), ends - 1
    for at in range(0, len(words) - width + 1, BLOCK):
        a = starts[at : min(at + BLOCK, len(words) - width + 1)]
        b = ends[at + width - 1 :][: len(a)]
        yield np.array([digest(joined[i:j], seed) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.uint64)


def spread(h: np.ndarray, word: int) -> np.ndarray:
    """Further 64-bit words from a hash (word 0: the hash itself), by the finaliser of splitmix64."""
    if not word:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(word) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def set_digest(hashes: np.ndarray) -> bytes:
    """16 bytes that tell sets of shingle hashes apart; the hashes are distinct and sorted."""
    return hashlib.blake2b(hashes.astype("<u8").tobytes(), digest_size=16).digest()


def ones_of(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, lowest first: the values of each byte are counted, then their bits."""
    at = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + (np.arange(8, dtype=np.intp) << 8)
    return (np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ BITS).ravel()


def simhash_bits(text: str, width: int, seed: int = 42) -> np.ndarray:
    """The fingerprint's 64 bits, lowest first: 1 where over half of the shingles' hashes have it."""
    ones, n = np.zeros(64), 0
    for h in shingle_hashes(text, width, seed):
        n += len(h)
        ones += ones_of(h)
    return 2 * ones > n


def segment_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, segments: int = 2) -> DataFrame:
    """(id, segs): fingerprints of 64 bits cut into equal segments, lowest bits first."""
    bits = 64 // segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = np.left_shift(np.int64(1), np.arange(bits))
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                found = [(simhash_bits(t, width).reshape(segments, bits) * power).sum(axis=1) for t in batch.column(1).to_pylist()]
                flat = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)
                segs = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, segments, dtype=np.int32), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0), segs.cast(pa.list_(pa.field("element", pa.int64())))], names=[id_col, "segs"])

    if 64 % segments or bits > 40:
        raise ValueError("segments must divide the fingerprint, into 40 bits at most")
    quoted = id_col.replace("`", "``")
    schema = f"`{quoted}` {docs.schema[id_col].dataType.simpleString()}, segs array<bigint>"
    return docs.select(named(id_col), whole_text(text_col).alias("text")).mapInArrow(run, schema)


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def variants(vertices: DataFrame, segments: int = 2, bits: int = 32) -> DataFrame:
    """(v, key, bit, n) of vertices (v, segs): the one-wildcard variants that n > 1 fingerprints share, a written table.

    key: segment, wildcard and the segment without that bit, which is in `bit`. The fingerprints are dealt evenly first,
    as each makes `segments * bits` rows.
    """
    wild = F.expr(f"cast(w % {bits} as int)")
    value = F.col("segs")[F.expr(f"cast(w div {bits} as int)")]
    bit = F.expr("shiftright(value, wild)").bitwiseAND(F.lit(1))
    dealt = vertices.select("v", "segs").repartition(int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions")), "v")
    rows = dealt.select("v", F.explode(F.sequence(F.lit(0), F.lit(segments * bits - 1))).alias("w"), "segs")
    rows = rows.select("v", "w", wild.alias("wild"), value.alias("value")).withColumn("bit", bit)
    masked = F.col("value") - F.expr("shiftleft(bit, wild)")
    keyed = rows.select("v", (F.shiftleft(F.col("w").cast("long"), 40) + masked).alias("key"), F.col("bit").cast("byte").alias("bit"))
    return key_groups(keyed, once=False)


def paired(members: DataFrame, bits: int = 32) -> DataFrame:
    """(a, b), a < b: the pairs that share a variant; a variant of a segment without difference pairs under the first wildcard only."""
    once = (F.col("x.bit") != F.col("y.bit")) | (F.shiftright("x.key", 40) % bits == 0)
    pairs = members.alias("x").join(members.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.v") < F.col("y.v")) & once)
    return pairs.select(F.col("x.v").alias("a"), F.col("y.v").alias("b")).distinct()


def links(vertices: DataFrame, segments: int, bits: int, max_distance: int, small_group: int = 64) -> DataFrame:
    """(a, b) edges over vertices (v, segs) with distinct v; for 2 segments of 32 bits, v is the fingerprint."""
    if (segments, bits, max_distance) != (2, 32, 2):
        raise ValueError("exact for two segments of 32 bits and two differing bits only")
    members = variants(vertices, segments, bits)
    many = members.filter(F.col("n") > small_group)
    sides = [vertices.select(F.col("v").alias(c), F.col("segs").alias(f"segs_{c}")) for c in "ab"]
    close = paired(members.filter(F.col("n") <= small_group), bits).join(sides[0], "a").join(sides[1], "b").filter(distance(F.col("segs_a"), F.col("segs_b")) <= max_distance).select("a", "b")
    near = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("v").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    balls = many.select("v").distinct().select("v", F.explode(F.concat(F.array("v"), near)).alias("hub"))
    least = balls.groupBy("hub").agg(F.min("v").alias("m"), F.count("*").alias("n")).filter("n > 1")
    return close.union(balls.join(least, "hub").filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) by 3-word shingles and two bits, as the module says."""
    found = written(segment_fingerprints(docs, id_col, text_col).select(named(id_col).alias("id"), F.col("segs")[0].bitwiseOR(F.shiftleft(F.col("segs")[1], 32)).alias("v")), "simhash")
    classes = found.groupBy("v").agg(F.min("id").alias("first"))
    vertices = classes.select("v", F.array(F.col("v").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned("v", 32)).alias("segs"))
    roots = connected_components(links(vertices, 2, 32, 2))
    rooted = classes.join(roots, "v", "left").select("v", "first", F.coalesce("root", "v").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    told = rooted.join(least, "root").select("v", "component_id")
    return found.join(told, "v").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("v"), 16, "0")).alias("fingerprint"), "component_id")


#: Shingles of so many words make the pipeline's near-duplicates.
WIDTH = 5
#: Of documents in the sample that finds common shingles, one in so many; of shingles, one that so many of the sample have
#: is common, and so many common ones are told to tasks at most.
SAMPLED, OFTEN, COMMON = 16, 2, 200_000
#: Bits of a set's parity bitmap; sets of over LONG shingles have one of LONG_PARITY bits too.
PARITY, LONG, LONG_PARITY = 512, 600, 4096
#: So many shingles beyond its prefix are told of a text, to split crowded groups of texts with one in common.
FURTHER = 3
#: Distinct words whose hashes a task keeps.
KEPT_WORDS = 300_000


class _WordHashes(dict):
    """XXH64 of words, kept."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


def distinct_shingles(text: str, width: int, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, mixed from their words' hashes; of all words together if they are fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    if not width:
        return h
    mixed = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        mixed = spread(mixed ^ h[i : len(h) - width + 1 + i], i + 1)
    return np.unique(mixed)


def common_shingles(rows: DataFrame, width: int, sampled: int = SAMPLED, often: int = OFTEN, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and sampled counts of shingles that many texts of (k, text) have; the most common ones, `most` at most.

    They only set the order in which prefixes are taken, so what the sample misses costs pairs, not results.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_of("shingles")
        hashes = _WordHashes()
        for whole in batches:
            for text in whole.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(distinct_shingles(text, width, hashes).view(np.int64))], names=["h"])

    chosen = rows.filter(F.pmod(F.xxhash64("k"), F.lit(sampled)) == 0).select("text")
    counted = written(chosen.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= often), "common-shingles")
    sizes = sorted(((r["n"], r["rows"]) for r in counted.groupBy("n").agg(F.count("*").alias("rows")).collect()), reverse=True)
    total, cut = 0, None
    for n, many in sizes:
        total += many
        if total > most:
            break
        cut = n
    found = [] if cut is None else counted.filter(F.col("n") >= cut).collect()
    h, n = np.array([r["h"] for r in found], np.int64).view(np.uint64), np.array([r["n"] for r in found], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def described(rows: DataFrame, width: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(k, digest, size, segs, parity, long, keys): a text's number of distinct shingles, their fingerprint and parity bitmaps, the first ones in an order.

    The order is by the sampled count, then by hash. Of the first n - ceil(similarity * n) + k of a set of n, two sets of
    that Jaccard similarity have k in common at least, whatever the order. FURTHER more than for k = 1 are taken.
    """
    hs, ns = common
    power = np.left_shift(np.int64(1), np.arange(32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_of("shingles")
        hashes = _WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                digests, sizes, segs, parity, long, keys = [], [], [], [], [], []
                for text in batch.column(1).to_pylist():
                    s = distinct_shingles(text, width, hashes)
                    digests.append(set_digest(s))
                    sizes.append(len(s))
                    segs.append(((2 * ones_of(s) > len(s)).reshape(2, 32) * power).sum(axis=1))
                    for into, bits in ((parity, PARITY), (long, LONG_PARITY if len(s) > LONG else 0)):
                        odd = np.bincount((s >> np.uint64(40)).astype(np.intp) % bits, minlength=bits).astype(np.uint8) & 1 if bits else np.zeros(0, np.uint8)
                        into.append(np.packbits(odd).view(np.int64))
                    taken = len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1 + FURTHER if len(s) else 0
                    if len(hs):
                        place = np.minimum(np.searchsorted(hs, s), len(hs) - 1)
                        often = np.flatnonzero(hs[place] == s)
                        rare = np.delete(s, often)
                        s = rare[:taken] if len(rare) >= taken else np.concatenate([rare, s[often][np.argsort(ns[place[often]], kind="stable")]])
                    keys.append(s[:taken].view(np.int64))
                lists = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)]).astype(np.int32), np.concatenate([*x, np.zeros(0, np.int64)])).cast(pa.list_(pa.field("element", pa.int64()))) for x in (segs, parity, long, keys)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), *lists], names=["k", "digest", "size", "segs", "parity", "long", "keys"])
        hashes.clear()
        release()

    return rows.select("k", "text").mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, digest binary, size long, segs array<bigint>, parity array<bigint>, long array<bigint>, keys array<bigint>")


def shingle_set(text: Column, width: int) -> Column:
    """Hashes of a text's distinct shingles, as the fingerprint takes them; an empty array where there is no word."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.filter(F.split(F.translate(text, upper, lower), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def shingles(ws: Column) -> Column:
        side_by_side = F.arrays_zip(*(F.slice(ws, i + 1, F.size(ws)) for i in range(width)))
        full = F.slice(side_by_side, 1, F.greatest(F.lit(1), F.size(ws) - (width - 1)))
        return F.array_distinct(F.transform(full, lambda x: F.xxhash64(x)))

    return let(words, shingles)


def verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (a, b) whose sets (v, s) have that Jaccard similarity."""
    x, y = (sets.select(F.col("v").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    common = F.size(F.array_intersect("sa", "sb"))
    total = F.size("sa") + F.size("sb") - common
    return edges.join(x, "a").join(y, "b").filter((total == 0) | (common >= similarity * total)).select("a", "b")


def sieved(edges: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The edges (a, b) whose sets can have that Jaccard similarity, by their sizes and parity bitmaps."""
    x, y = (classes.select(F.col("v").alias(c), F.col("size").alias(f"n{c}"), F.col("parity").alias(f"p{c}"), F.col("long").alias(f"l{c}")) for c in "ab")
    most = (F.col("na") + F.col("nb")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    return edges.join(x, "a").join(y, "b").filter(distance(F.col("pa"), F.col("pb")) <= most).filter((F.size("la") != F.size("lb")) | (distance(F.col("la"), F.col("lb")) <= most)).select("a", "b")


def near_components(classes: DataFrame, rows: DataFrame, similarity: float, width: int = WIDTH, small_group: int = SMALL_GROUP) -> DataFrame:
    """(v, root) of classes (v, k, size, segs, parity, long, keys) that are linked by that similarity; rows: (k, text).

    Candidates are sharers of a variant of their fingerprints (in crowded variants, with two leaders) and of a prefix
    key. Only texts of candidates that pass the sieve are cut into shingles again.
    """
    shared = variants(classes)
    crowd = shared.filter(F.col("n") > small_group)
    led = crowd.groupBy("key").agg(F.array(F.min_by("v", F.xxhash64("v")), F.max_by("v", F.xxhash64("v"))).alias("l"))
    stars = crowd.join(led.select("key", F.explode("l").alias("m")), "key").filter("v <> m").select(F.least("v", "m").alias("a"), F.greatest("v", "m").alias("b"))
    candidates = paired(shared.filter(F.col("n") <= small_group)).union(stars.distinct())
    prefix = lambda k: (F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + k).cast("int")
    members = key_groups(classes.select("v", F.col("size").cast("int").alias("size"), F.posexplode(F.slice("keys", 1, F.greatest(F.lit(0), prefix(1)))).alias("at", "key")))

    def split(rows: DataFrame, level: int) -> DataFrame | None:
        """The key with each later shingle of the prefix for `level` shingles in common."""
        if level > 1 + FURTHER:
            return None
        told = rows.select("v", "size", "key", "at", "root").join(classes.select("v", "keys"), "v")
        later = told.select("v", "size", "root", F.col("key").alias("first"), "at", F.posexplode(F.slice("keys", 1, F.greatest(F.lit(0), prefix(level)))).alias("next", "key")).filter("next > at")
        return later.select("v", "size", "root", F.col("next").alias("at"), F.xxhash64("first", "key").alias("key"))

    def verify(edges: DataFrame) -> DataFrame:
        left = written(sieved(edges, classes, similarity), "sieved-pairs")
        of = left.select(F.col("a").alias("v")).union(left.select(F.col("b").alias("v"))).distinct()
        wanted = written(classes.join(of, "v").select("v", "k"), "wanted")  # its size tells Spark whether texts need a shuffle
        sets = written(rows.join(wanted, "k").dropDuplicates(["v"]).select("v", shingle_set(F.col("text"), width).alias("s")), "shingle-sets")
        return verified(left, sets, similarity)

    return similar_components(members, verify, similarity, split, candidates, small_group)


def one_of_each_group(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each group the row of the smallest id stays, the text breaks ties."""
    text, (sha, drop_id, drop_sha, again) = whole_text(text_col), fresh(docs, "sha", "drop_id", "drop_sha", "again")
    own = docs.withColumn(sha, F.unhex(F.sha2(text, 256)))
    rows = own.select(F.struct(named(id_col).alias("id"), F.col(sha).alias("sha")).alias("k"), text.alias("text"))
    with scratch(docs.sparkSession):
        with scratch(docs.sparkSession):  # what is told of every row goes as soon as classes of equal sets are there
            found = written(described(rows, WIDTH, similarity, common_shingles(rows, WIDTH)), "shingles")
            ids = written(found.select("k", "digest"), "digests", keep=True)
            repeated = written(ids.groupBy("digest").count().filter("count > 1").select("digest"), "repeated")
            parts = ("size", "segs", "parity", "long", "keys")
            several = found.join(repeated, "digest", "left_semi").groupBy("digest").agg(F.min("k").alias("k"), *(F.first(c).alias(c) for c in parts))
            classes = found.join(repeated, "digest", "left_anti").select("digest", "k", *parts).union(several)
            classes = written(classes.withColumn("v", F.monotonically_increasing_id()), "shingle-classes", keep=True)
        roots = near_components(classes, rows, similarity)
        rooted = classes.join(roots, "v", "left").select("digest", "k", F.coalesce("root", "v").alias("root"))
        kept = rooted.join(rooted.groupBy("root").agg(F.min("k").alias("kept")), "root").select("digest", "kept")
        # what is told of rows is what goes, and which rows that stay are there several times: few rows of many
        per_row = ids.groupBy("k", "digest").agg(F.count("*").alias("n")).join(kept, "digest").withColumn("again", F.col("k") == F.col("kept")).filter("not again or n > 1")
        marks = written(per_row.select(F.col("k.id").alias(drop_id), F.col("k.sha").alias(drop_sha), F.col("again").alias(again)), "marks", keep=True)
    marked = own.join(small(marks), (F.col(sha) == F.col(drop_sha)) & named(id_col).eqNullSafe(F.col(drop_id)), "left")
    once = marked.filter(F.col(again).isNull()).select(*map(named, docs.columns))
    if marks.filter(F.col(again)).isEmpty():
        return once
    return once.union(marked.filter(F.col(again)).dropDuplicates([drop_id, drop_sha]).select(*map(named, docs.columns)))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every text of documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
