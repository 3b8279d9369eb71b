"""Token ids in raw binary shards, with a minimal perfect hash index for keyed access.

Documents are dealt by ranges of their key and sorted, each task encodes its range and publishes two files in the
shared folder: `<shard>.ids`, the ids as little-endian unsigned integers of 16 or 32 bits, one document after the
other, and `<shard>.mph`, an index. The index is a cascade of bit arrays: a key that is alone at its place in a level
gets that place, the others go on to the next level, and the rank of the place among all set bits is a number from 0
to n - 1. At that number stand the key's 32-bit fingerprint, which tells foreign keys apart, and its offset and length
in the shard. A lookup reads a fixed expected number of bits, one slot, and the document's own ids. The manifest has
each shard's least and greatest key, so `lookup` opens the shards of its keys only, and of these what the keys need.

Edge cases: a null text is the empty one, only the end id is written; repeated keys are told apart by their number of
repetition and keep the order of their texts; a null key comes first and can be looked up; a key without document is one
row of nulls; an empty table gives an empty result; very long texts are encoded whole, one at a time beyond a batch;
columns besides key and text are not read, so their names can't clash.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.prefix import numbered, running
from .common import named, new_path, open_store, publish, table, whole_text, written
from .encoding import encoder

SLICE = 256
#: Bits of a level for each key that reaches it.
GAMMA = 2.0


def mix(keys: np.ndarray, repeats: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of (key, repetition) by the finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.int64).view(np.uint64) + (repeats.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
        z = z + np.uint64(seed + 1) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


#: A word of a level's bits with the number of set bits before it, and what stands in a key's slot.
WORD = np.dtype([("bits", "<u8"), ("rank", "<u8")])
SLOT = np.dtype([("fingerprint", "<u4"), ("offset", "<u8"), ("length", "<u8")])


class PerfectHash:
    """A minimal perfect hash of distinct (key, repetition) pairs, with stored fingerprints and values.

    As bytes: the numbers of keys, of null keys and of levels, each level's number of words; then the levels' words, the
    slots, and the keys in order, nulls first. So a lookup needs a word a level and one slot, wherever they are.
    """

    def __init__(self, levels: list[np.ndarray], slots: np.ndarray, keys: np.ndarray, n_null: int = 0):
        self.levels, self.slots_, self.keys, self.n_null = levels, slots, keys, n_null
        self.sizes = [len(x) for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray, repeats: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, n_null: int = 0) -> PerfectHash:
        levels, before = [], 0
        left = np.arange(len(keys))
        while len(left):
            words = max(1, int(np.ceil(GAMMA * len(left) / 64)))
            at = (mix(keys[left], repeats[left], len(levels)) % np.uint64(words * 64)).astype(np.int64)
            alone = np.bincount(at, minlength=words * 64) == 1
            level = np.zeros(words, WORD)
            level["bits"] = np.packbits(alone, bitorder="little").view("<u8")
            counts = np.bitwise_count(level["bits"]).astype(np.int64)
            level["rank"] = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            levels.append(level)
            left = left[~alone[at]]
            if len(levels) > 200:
                raise ValueError("the keys aren't distinct")
        self = cls(levels, np.zeros(len(keys), SLOT), keys, n_null)
        slot = self.slots(keys, repeats)
        for name, values in (("fingerprint", cls.fingerprint(keys, repeats)), ("offset", offsets), ("length", lengths)):
            self.slots_[name][slot] = values
        return self

    @staticmethod
    def fingerprint(keys: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        return (mix(keys, repeats, 1_000_003) >> np.uint64(32)).astype("<u4")

    def words(self, level: int, at: np.ndarray) -> np.ndarray:
        return self.levels[level][at]

    def stored(self, slots: np.ndarray) -> np.ndarray:
        return self.slots_[slots]

    def slots(self, keys: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level holds it."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = (mix(keys[left], repeats[left], level) % np.uint64(size * 64)).astype(np.int64)
            word, bit = self.words(level, at >> 6), (at & 63).astype(np.uint64)
            hit = (word["bits"] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word["bits"] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (word["rank"].astype(np.int64) + below)[hit]
            left = left[~hit]
            if not len(left):
                break
        return out

    def find(self, keys: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset and length of each key; -1 and -1 for a key whose fingerprint isn't the stored one."""
        slot = self.slots(keys, repeats)
        offset, length = np.full(len(keys), -1, np.int64), np.full(len(keys), -1, np.int64)
        there = np.flatnonzero(slot >= 0)
        found = self.stored(slot[there])
        ok = found["fingerprint"] == self.fingerprint(keys[there], repeats[there])
        offset[there[ok]], length[there[ok]] = found["offset"][ok], found["length"][ok]
        return offset, length

    def dump(self) -> bytes:
        head = np.array([len(self.keys), self.n_null, len(self.levels), *self.sizes], "<i8")
        return b"".join(x.tobytes() for x in (head, *self.levels, self.slots_, self.keys.astype("<i8")))

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        n, n_null, n_levels = np.frombuffer(data, "<i8", 3).tolist()
        at, levels = 24 + 8 * n_levels, []
        for size in np.frombuffer(data, "<i8", n_levels, 24).tolist():
            levels.append(np.frombuffer(data, WORD, size, at))
            at += size * WORD.itemsize
        return cls(levels, np.frombuffer(data, SLOT, n, at), np.frombuffer(data, "<i8", n, at + n * SLOT.itemsize), n_null)


class StoredHash(PerfectHash):
    """The same in an open file: of it the head is read, and for a lookup the words and slots that it needs."""

    def __init__(self, file):
        self.file, self.n_reads = file, 0
        n, self.n_null, n_levels = np.frombuffer(self._read(0, 24), "<i8").tolist()
        self.sizes = np.frombuffer(self._read(24, 8 * n_levels), "<i8").tolist()
        ends = 24 + 8 * n_levels + np.cumsum([0, *self.sizes]) * WORD.itemsize
        self.level_at, self.slots_at = ends[:-1].tolist(), int(ends[-1])

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        self.n_reads += 1
        return self.file.read(size)

    def words(self, level: int, at: np.ndarray) -> np.ndarray:
        return np.frombuffer(b"".join(self._read(self.level_at[level] + i * WORD.itemsize, WORD.itemsize) for i in at.tolist()), WORD)

    def stored(self, slots: np.ndarray) -> np.ndarray:
        return np.frombuffer(b"".join(self._read(self.slots_at + i * SLOT.itemsize, SLOT.itemsize) for i in slots.tolist()), SLOT)


def repeats_of(keys: np.ndarray, null: np.ndarray) -> np.ndarray:
    """The number of equal keys before each, in a sorted array."""
    if not len(keys):
        return np.zeros(0, np.int64)
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (null[1:] != null[:-1])])
    first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    return np.arange(len(keys)) - first


def write_shards(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int, n_shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards; returns the manifest (shard, n_docs, n_null, least, greatest, n_ids, width), a written table."""
    spark = docs.sparkSession
    n = n_shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        enc = encoder(tokenizer_file)
        dtype = "<u2" if max(len(enc.opens_unit) - 1, end_id) < 1 << 16 else "<u4"
        end = np.array([end_id], dtype).tobytes()
        keys: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def payload(out) -> None:
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(at, SLICE)
                    ids = enc.encode(batch.column(1).to_pylist())
                    out.write(b"".join(np.frombuffer(x, "<u4").astype(dtype).tobytes() + end for x in ids))
                    lengths.append(np.array([len(x) // 4 + 1 for x in ids], np.int64))
                    keys.append(np.array([[k is None, k or 0] for k in batch.column(0).to_pylist()], np.int64).reshape(-1, 2))

        publish(f"{folder}/{shard:08d}.ids", payload)
        key, length = np.concatenate([*keys, np.zeros((0, 2), np.int64)]), np.concatenate([*lengths, np.zeros(0, np.int64)])
        null, key = key[:, 0].astype(bool), key[:, 1]
        repeats = repeats_of(key, null) + null * (1 << 40)
        index = PerfectHash.build(key, repeats, np.cumsum(length) - length, length, int(null.sum()))
        publish(f"{folder}/{shard:08d}.mph", lambda out: out.write(index.dump()))
        ends = key[~null][[0, -1]].tolist() if not null.all() else [None, None]
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": pa.array([len(key)], pa.int64()), "n_null": pa.array([index.n_null], pa.int64()), "least": pa.array(ends[:1], pa.int64()), "greatest": pa.array(ends[1:], pa.int64()), "n_ids": pa.array([int(length.sum())], pa.int64()), "width": pa.array([np.dtype(dtype).itemsize], pa.int32())})

    rows = docs.select(named(id_col).cast("long").alias("key"), whole_text(text_col).alias("text")).repartitionByRange(n, "key").sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
    return written(rows.mapInArrow(write, "shard int, n_docs long, n_null long, least long, greatest long, n_ids long, width int"), "manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The ids before each shard. One row for each shard is summed here, however many documents there are."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def fetch(index: PerfectHash, payload, width: int, keys: np.ndarray, repeats: np.ndarray) -> Iterator[tuple[int, np.ndarray] | None]:
    """Offset and ids of each key, read from the raw payload; None for a key that the shard doesn't hold."""
    for offset, length in zip(*(a.tolist() for a in index.find(keys, repeats)), strict=True):
        if offset < 0:
            yield None
            continue
        payload.seek(offset * width)
        yield offset, np.frombuffer(payload.read(length * width), f"<u{width}")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, each found through its shard's index."""
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(f"{folder}/{row['shard']:08d}")
                with store.open_input_stream(path + ".mph", compression=None) as f:
                    index = PerfectHash.load(f.read())
                keys, null = index.keys, np.arange(len(index.keys)) < index.n_null
                repeats = repeats_of(keys, null) + null * (1 << 40)
                with store.open_input_file(path + ".ids") as payload:
                    for at in range(0, len(keys), 4096):
                        part = slice(at, at + 4096)
                        found = list(fetch(index, payload, row["width"], keys[part], repeats[part]))
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(keys[part], pa.int64(), mask=null[part]),
                            "start": pa.array([row["before"] + x[0] for x in found], pa.int64()),
                            "n_tokens": pa.array([len(x[1]) for x in found], pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(x[1].astype("<u4").tobytes()) for x in found], pa.int64()),
                        })

    shards = with_starts(manifest).filter("n_docs > 0").repartition(n, "shard")
    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


#: Shards whose bounds are told to every task (24 bytes each); with more, keys and bounds are sorted together.
TOLD_SHARDS = 1_000_000


def placed_by_order(keys: DataFrame, manifest: DataFrame) -> DataFrame:
    """(key, shard, width) of distinct keys: shards' least keys and the keys in one order, each key after its shard's least."""
    filled = manifest.filter("n_docs > 0")
    bounds = numbered(filled.filter("greatest is not null").select("shard", "width", "least", "greatest"), "nth", "least", "shard")
    both = bounds.select(F.col("least").alias("key"), F.lit(1).cast("long").alias("bound")).union(keys.filter("key is not null").select("key", F.lit(0).cast("long")))
    found = running(written(both, "keys-and-bounds"), [], [F.asc("key"), F.desc("bound")], {"nth": F.col("bound")}).filter("bound = 0")
    told = found.select("key", "nth").join(bounds, "nth", "left")  # a shard's keys are at most its documents
    inside = F.col("key") <= F.col("greatest")
    null = filled.filter("n_null > 0").select("shard", "width").first()
    nulls = keys.filter("key is null").select("key", *(F.lit(null and null[c]).cast("int").alias(c) for c in ("shard", "width")))
    return told.select("key", F.when(inside, F.col("shard")).alias("shard"), F.when(inside, F.col("width")).alias("width")).union(nulls.select("key", "shard", "width"))


def placed_by_bounds(keys: DataFrame, manifest: DataFrame) -> DataFrame:
    """(key, shard, width) of distinct keys, by the shards' bounds told to every task."""
    told = manifest.filter("n_docs > 0").select("shard", "n_null", "least", "greatest", "width").orderBy("shard")
    shards = told.collect()  # a row a shard, TOLD_SHARDS at most
    filled = [r for r in shards if r["greatest"] is not None]
    greatest, of = np.array([r["greatest"] for r in filled], np.int64), np.array([r["shard"] for r in filled], np.int32)
    least = np.array([r["least"] for r in filled], np.int64)
    width, with_null = {r["shard"]: r["width"] for r in shards}, next((r["shard"] for r in shards if r["n_null"]), None)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null = np.asarray(batch.column(0).is_null())
            key = batch.column(0).fill_null(0).to_numpy()
            at = np.searchsorted(greatest, key)
            ok = at < len(greatest)
            ok[ok] = least[at[ok]] <= key[ok]
            shard = [with_null if n else int(of[i]) if k else None for n, i, k in zip(null.tolist(), at.tolist(), ok.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shard, pa.int32()), pa.array([None if x is None else width[x] for x in shard], pa.int32())], names=["key", "shard", "width"])

    return keys.mapInArrow(place, "key long, shard int, width int")


def lookup(keys: DataFrame, manifest: DataFrame, folder: str, key_col: str = "key", told_shards: int = TOLD_SHARDS) -> DataFrame:
    """(key, copy, ids) of the distinct keys: a row for each document of a key, copy numbers them; null ids if there is none."""
    wanted = keys.select(named(key_col).cast("long").alias("key")).distinct()
    placed = placed_by_order(wanted, manifest) if manifest.count() > told_shards else placed_by_bounds(wanted, manifest)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, index, payload = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                found = []
                if row["shard"] is not None:
                    if row["shard"] != opened:
                        store, path = open_store(f"{folder}/{row['shard']:08d}")
                        opened, index, payload = row["shard"], StoredHash(store.open_input_file(path + ".mph")), store.open_input_file(path + ".ids")
                    key, repeat = np.array([row["key"] or 0], np.int64), (row["key"] is None) * (1 << 40)
                    while (one := next(fetch(index, payload, row["width"], key, np.array([repeat + len(found)])))) is not None:
                        found.append(one[1])
                n = max(1, len(found))
                yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * n, pa.int64()), pa.array(range(n) if found else [None], pa.int32()), pa.array(found or [None], pa.list_(pa.field("element", pa.int64())))], names=["key", "copy", "ids"])

    # keys without a shard have nothing to open: they are dealt by themselves, not all to one task
    deal = F.when(F.col("shard").isNull(), F.xxhash64("key"))
    return placed.repartition("shard", deal).sortWithinPartitions("shard", "key").mapInArrow(read, "key long, copy int, ids array<bigint>")


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents as ids with the end id 2, written to shards and read back through their indexes."""
    import public_tokenizers

    folder = new_path(spark, "shards")
    manifest = write_shards(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_shards(manifest, folder)
