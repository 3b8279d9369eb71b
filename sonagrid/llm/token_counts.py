"""Token counts through a digest cache.

Content digests (SHA-256 of the normalised text) and the digest of the tokenizer file are the key of a stored count.
Only distinct contents whose key the cache lacks are encoded; their counts are appended. Copies are merged before the
shuffle (partial aggregation), so a group of copies of any size reaches the encoder once.

The default normaliser leaves a text as it is: the tokenizer tells every two different texts apart. Another one may be
given where several spellings are to share one count.

Edge cases: a null text is the empty text with zero tokens; repeated rows each get their count; an empty table gives
an empty result; very long texts are encoded whole, one at a time beyond the batch; columns besides id and text are not
read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, named, new_path, table, whole_text, written
from .encoding import encoder

SLICE = 256
CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


def tokenizer_digest(tokenizer_file: str) -> str:
    with open(tokenizer_file, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def encode_counts(texts: DataFrame, tokenizer_file: str) -> DataFrame:
    """(content_digest, n_tokens) of rows (content_digest, content)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_file)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                ids = enc.encode(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64())], names=["content_digest", "n_tokens"])

    return texts.select("content_digest", "content").mapInArrow(count, "content_digest binary, n_tokens long")


def cached_counts(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """The cache's counts for one tokenizer; a key that two runs have both appended counts once."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path) if there else spark.createDataFrame([], CACHE_SCHEMA)
    return cache.filter(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache_path: str, tokenizer_file: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; appends new counts to the cache at cache_path."""
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_file)
    content = normalise(whole_text(text_col))
    keyed = docs.select(named(id_col).alias(id_col), whole_text(text_col).alias("text"), content.alias("content")).withColumn("content_digest", F.unhex(F.sha2("content", 256)))
    distinct = keyed.groupBy("content_digest").agg(F.first("content").alias("content"))
    misses = distinct.join(cached_counts(spark, cache_path, version), "content_digest", "left_anti")
    new = encode_counts(misses, tokenizer_file).withColumn("tokenizer_digest", F.lit(version))
    new.select("content_digest", "tokenizer_digest", "n_tokens").write.mode("append").parquet(cache_path)
    # digests are hashed once more, as rows of a few bytes: those of copies join without a hot key
    rows = written(keyed.select(named(id_col).alias("id"), F.octet_length("text").cast("long").alias("n_bytes"), "content_digest"), "digests")
    copies = rows.groupBy("content_digest").agg(F.count("*").alias("n"))
    counts = written(cached_counts(spark, cache_path, version).join(copies, "content_digest"), "counts")
    counted = join_hot(rows, counts, ["content_digest"], "n", rows.count())
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text of documents for the 50k byte-level BPE, with a cache that begins empty."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), new_path(spark, "token-counts"), public_tokenizers.path("byte_bpe_50k.json"))
