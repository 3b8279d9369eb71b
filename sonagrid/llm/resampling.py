"""Importance resampling towards a target distribution, by hashed word-run features.

Features are runs of consecutive words, hashed to buckets. A bucket's gain is the log ratio of its smoothed shares in
the target texts and in the corpus, in whole thousandths; a document's weight is the mean gain of its features, and its
score adds Gumbel noise hashed from its id, so that the highest scores are a draw without replacement.

Each text is cut into words once: its buckets are kept as an array of 16 or 32 bits a feature, next to the id. Corpus
counts are sums of these arrays' histograms, scores are gathers from the array of gains; both run over all documents.
The gains, one number a bucket, are all that is told to tasks; the number of buckets is a parameter.

The cut between drawn and other documents is found by weighted median-of-medians selection. Each partition of the keys
gives the median of those that remain between two bounds, and their number; the median of these medians, weighted by the
numbers, has at least a quarter of all that remain on either side, so each round discards a quarter at least, exactly.
A row a partition reaches the driver. What remains is written anew once a quarter of it is left, so all rounds together
read the keys a few times. The winners are then numbered in their order, range by range.

Edge cases: a null or empty text and one without words have no features, the weight 0 and are not drawn; ties in the
score go to the smaller id, null ids are last, repeated ids in the order in which rows were read; so each drawn row has a
rank of its own. A null id hashes as the text `null`. An empty target leaves gains by smoothing alone; an empty table
gives an empty result; very long texts are cut in blocks of a megabyte, between words; only id and text are read, so
other columns can't clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import numbered
from .common import cache_of, named, scratch, table, written

#: Bytes of words: digits, a to z, and all beyond ASCII. Texts are lower-cased as bytes, which changes A-Z only.
WORDS, GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
BLOCK = 1 << 20
#: Distinct words whose buckets a worker keeps.
KEPT_WORDS = 500_000
SLICE = 1024


class _Buckets(dict):
    """The buckets of words, kept."""

    def __init__(self, n_buckets: int):
        super().__init__()
        self.n_buckets = n_buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        b = self[word] = zlib.crc32(word) % self.n_buckets
        return b


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in blocks of bounded size that end between words."""
    low, at = text.lower(), 0
    while at < len(low):
        gap = GAP.search(low, at + BLOCK) if at + BLOCK < len(low) else None
        end = gap.start() if gap else len(low)
        yield WORDS.findall(low, at, end)
        at = end


def buckets_of(text: bytes, runs: int, known: _Buckets) -> tuple[np.ndarray, int]:
    """The buckets of all runs of 1 to `runs` words, and the number of words."""
    parts, n, tail = [np.zeros(0, np.int64)], 0, []
    for words in words_of(text):
        n += len(words)
        parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        if runs > 1:
            joined, old = tail + words, len(tail)
            for k in range(2, runs + 1):  # runs that end in this block
                parts.append(np.array([zlib.crc32(b" ".join(joined[i - k + 1 : i + 1])) % known.n_buckets for i in range(max(old, k - 1), len(joined))], np.int64))
            tail = joined[-(runs - 1) :]
    return np.concatenate(parts), n


def hashed_features(docs: DataFrame, n_buckets: int, runs: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, buckets): a text's features in little-endian unsigned integers, of 16 bits where buckets allow it."""
    dtype = "<u2" if n_buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = cache_of("resampling").setdefault(n_buckets, _Buckets(n_buckets))
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                found = [buckets_of(t.as_buffer().to_pybytes() if t.is_valid else b"", runs, known) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in found], pa.int64()), pa.array([b.astype(dtype).tobytes() for b, _ in found], pa.binary())], names=["id", "n_words", "buckets"])

    rows = docs.select(named(id_col).alias("id"), named(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, buckets binary")


def bucket_counts(features: DataFrame, n_buckets: int) -> np.ndarray:
    """How many features fall into each bucket: histograms by task, then a sum a bucket."""
    dtype = "<u2" if n_buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for b in batch.column(0):
                total += np.bincount(np.frombuffer(b.as_buffer(), dtype), minlength=n_buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counts = np.zeros(n_buckets, np.int64)
    summed = features.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in summed.collect():  # n_buckets rows at most
        counts[r["bucket"]] = r["n"]
    return counts


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of smoothed shares, a bucket each."""
    n, s, t = len(corpus), corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def scored(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean gain of a document's features."""
    dtype = "<u2" if len(gains) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(b.as_buffer(), dtype) for b in batch.column(2)]
            n = [len(x) for x in found]
            weight = [int(gains[x].sum()) // len(x) if len(x) else 0 for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(weight, pa.int64())], names=["id", "n_words", "n_features", "weight"])

    return features.mapInArrow(run, f"id {features.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


#: A key in the order of the draw: the score's negative, whether the id is null, the id, the place where the row was read.
KEY = ("negative", "no_id", "id", "place")


def partition_medians(keys: DataFrame, low: tuple | None, high: tuple | None) -> DataFrame:
    """(KEY..., n): of each partition the lower median of the keys over low and up to high, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[np.ndarray] = []
        for batch in batches:
            cols = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns], np.int64)
            keep = np.ones(cols.shape[1], bool)
            for bound, above in ((low, True), (high, False)):
                if bound is None:
                    continue
                over, tied = np.zeros(cols.shape[1], bool), np.ones(cols.shape[1], bool)
                for c, b in zip(cols, bound, strict=True):
                    over |= tied & (c > b)
                    tied &= c == b
                keep &= over if above else ~over
            columns.append(cols[:, keep])
        left = np.concatenate([np.zeros((len(KEY), 0), np.int64), *columns], axis=1)
        n = left.shape[1]
        if n:
            median = left[:, np.lexsort(left[::-1])[(n - 1) // 2]]
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in median.tolist()), pa.array([n], pa.int64())], names=[*KEY, "n"])

    return keys.mapInArrow(run, ", ".join(f"{c} long" for c in (*KEY, "n")))


def _after(bound: tuple):
    """Whether a key stands after the bound."""
    return F.struct(*KEY) > F.struct(*(F.lit(x).cast("long").alias(c) for c, x in zip(KEY, bound, strict=True)))


def cutoff(keys: DataFrame, k: int) -> tuple | None:
    """The k-th smallest of the distinct keys, by weighted medians of the partitions' medians; None for k = 0.

    keys: a written table of KEY, all longs. low is a key with at most k - 1 keys up to it, high one with k at least.
    """
    if k <= 0:
        return None
    low = high = None
    table_rows = keys.count()
    if k > table_rows:
        raise ValueError("fewer keys than that")
    left, before = table_rows, 0  # keys between the bounds; keys up to low
    while True:
        medians = sorted(tuple(r) for r in partition_medians(keys, low, high).collect())  # a row a partition
        seen = 0
        for *key, n in medians:
            seen += n
            if 2 * seen >= left:
                pivot = tuple(key)
                break
        inside = keys.filter(~_after(pivot)) if low is None else keys.filter(_after(low) & ~_after(pivot))
        upto = before + inside.count()
        if upto == k:
            return pivot
        if upto > k:
            high, remaining = pivot, upto - before
        else:
            low, before, remaining = pivot, upto, left - (upto - before)
        if remaining == 1:
            one = keys.filter(F.lit(True) if low is None else _after(low)).filter(F.lit(True) if high is None else ~_after(high)).first()
            return tuple(one)
        left = remaining
        if 4 * left <= table_rows:
            part = keys.filter(F.lit(True) if low is None else _after(low)).filter(F.lit(True) if high is None else ~_after(high))
            keys, table_rows = written(part, "remaining-keys"), left


def resampled(docs: DataFrame, target: DataFrame, share: Callable[[int], int] = lambda n: 10 * n // 100, n_buckets: int = 10_000, runs: int = 1, min_words: int = 20, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every document; rank is null where it isn't drawn.

    share: how many of the n documents with min_words words are drawn. Ids are whole numbers.
    """
    spark = docs.sparkSession
    with scratch(spark):
        features = written(hashed_features(docs, n_buckets, runs, id_col, text_col), "features")
        sought = hashed_features(target.select(F.lit(0).alias("id"), named(target_text).alias("text")), n_buckets, runs, "id", "text")
        gains = gains_of(bucket_counts(features, n_buckets), bucket_counts(sought, n_buckets))
        h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
        noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
        rows = written(scored(features, gains).withColumn("score", F.col("weight") + noise).withColumn("place", F.monotonically_increasing_id()), "scores", keep=True)
        key = (-F.col("score")).alias("negative"), F.col("id").isNull().cast("long").alias("no_id"), F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), F.col("place")
        able = rows.filter(F.col("n_words") >= min_words)
        keys = written(able.select(*key), "keys")
        cut = cutoff(keys, share(keys.count()))
        winners = keys.filter(~_after(cut)) if cut else keys.limit(0)
        ranks = written(numbered(winners, "rank", *KEY).select("place", "rank"), "ranks", keep=True)
    return rows.join(ranks, "place", "left").select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and score of every document towards the benchmark texts, and the rank of the tenth that is drawn."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
