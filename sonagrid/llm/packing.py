"""Packing of documents into sequences of a fixed number of tokens, by Karmarkar-Karp multiway differencing.

A task reads its documents once, encodes them and packs them as they come, in groups of bounded size: no shuffle, and
no more than a group of ids in memory. A document that fills whole sequences gives them at once; what is left of it, and
every shorter one, goes to the group, in even pieces of `longest` tokens at most. When a group has the tokens that
`windows` windows are to hold, each a little under capacity (`slack`), its last piece is cut there and the group is
partitioned: each piece is a partial partition of one filled slot, and the two partial partitions of the largest spread
are merged, the fullest slots of one with the emptiest of the other, until one is left, whose windows are near-equal.
Where a window still exceeds the capacity, pieces are halved and partitioned again, and with pieces of HALVED tokens the
number of windows rises. A task's last group has as many windows as it fills; the tokens beyond fill sequences of
powers of two, which need no padding.

Sequences are numbered by the partition of the input and their place in it, so a task that runs again gives the same.

Edge cases: a null or empty text is its end id alone; rows of one id are documents of their own; null ids are ids; an
empty table gives an empty result; very long texts are encoded whole and cut; only id and text are read, so other columns
can't clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, table, whole_text
from .encoding import encoder

SLICE = 256
#: Pieces are not halved below this for the sake of a window over capacity; the number of windows rises instead.
HALVED = 32
#: Sequences of a partition are numbered from its own number above this bit.
SEQUENCE_BITS = 40


def differenced(sizes: list[int], k: int) -> tuple[np.ndarray, int]:
    """The window, from 0 to k - 1, of each piece, and the fullest window's sum, by k-way differencing."""
    n = len(sizes)
    if k == 1 or n == 0:
        return np.zeros(n, np.int64), sum(sizes)
    heap = []
    for i, s in enumerate(sizes):
        slots = np.zeros(k, np.int32)
        slots[-1] = s
        heap.append((-s, i, slots))
    heapq.heapify(heap)
    merged: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        raw = x + y[::-1]
        order = raw.argsort(kind="stable")
        slots = raw[order]
        merged.append((a, b, order.astype(np.int32)))
        heapq.heappush(heap, (int(slots[0] - slots[-1]), n + len(merged) - 1, slots))
    windows: list[np.ndarray | None] = [None] * (n + len(merged))
    windows[heap[0][1]] = np.arange(k)
    for at in range(len(merged) - 1, -1, -1):
        a, b, order = merged[at]
        placed = np.empty(k, np.int64)
        placed[order] = windows[n + at]
        windows[a], windows[b], windows[n + at] = placed, placed[::-1], None
    return np.array([w[-1] for w in windows[:n]]), int(heap[0][2][-1])


class Piece:
    """A run of a document's ids."""

    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, n: int) -> tuple[Piece, Piece]:
        """The first n ids and the rest."""
        return Piece(self.doc, self.start, self.ids[:n], self.total), Piece(self.doc, self.start + n, self.ids[n:], self.total)


def windows_of(pieces: list[Piece], k: int, capacity: int) -> list[list[Piece]]:
    """The pieces in k windows of at most capacity ids, in more where they can't be had."""
    longest = max((len(p.ids) for p in pieces), default=0)
    while True:
        at, top = differenced([len(p.ids) for p in pieces], k)
        if top <= capacity:
            break
        if longest > HALVED:
            longest = (longest + 1) // 2
            pieces = [q for p in pieces for q in even(p, longest)]
        else:
            k += 1
    out: list[list[Piece]] = [[] for _ in range(k)]
    for p, w in zip(pieces, at.tolist(), strict=True):
        out[w].append(p)
    return out


def even(piece: Piece, longest: int) -> list[Piece]:
    """The piece in equal parts of `longest` ids at most."""
    n = len(piece.ids)
    if n <= longest:
        return [piece]
    m = -(-n // longest)
    cuts = [n * i // m for i in range(m + 1)]
    return [Piece(piece.doc, piece.start + a, piece.ids[a:b], piece.total) for a, b in zip(cuts, cuts[1:], strict=False)]


def powers(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces, cut where needed, in windows of which each has a power of two of ids, the largest first."""
    left, out = sum(len(p.ids) for p in pieces), []
    queue = pieces[::-1]
    while left:
        room = size = 1 << (left.bit_length() - 1)
        window = []
        while room:
            p = queue.pop()
            if len(p.ids) > room:
                p, rest = p.cut(room)
                queue.append(rest)
            window.append(p)
            room -= len(p.ids)
        out.append(window)
        left -= size
    return out


def pack_stream(documents: Iterator[tuple[object, np.ndarray]], capacity: int, windows: int, slack: int, longest: int) -> Iterator[list[Piece]]:
    """Sequences of pieces of the documents (id, ids)."""
    full, group, held = capacity - slack, [], 0
    for doc, ids in documents:
        at = 0
        while len(ids) - at >= capacity:
            yield [Piece(doc, at, ids[at : at + capacity], len(ids))]
            at += capacity
        if at == len(ids):
            continue
        for p in even(Piece(doc, at, ids[at:], len(ids)), longest):
            while held + len(p.ids) >= windows * full:
                p, rest = p.cut(windows * full - held)
                yield from windows_of([*group, p], windows, capacity)
                group, held, p = [], 0, rest
            if len(p.ids):
                group.append(p)
                held += len(p.ids)
    k, beyond, rest = held // full, held % full, []
    while beyond:
        p = group.pop()
        if len(p.ids) > beyond:
            p, tail = p.cut(len(p.ids) - beyond)
            group.append(p)
            p = tail
        rest.append(p)
        beyond -= len(p.ids)
    if k:
        yield from windows_of(group, k, capacity)
    yield from powers(rest[::-1])


def packed(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int = 4096, windows: int = 256, slack: int = 8, longest: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset) of every piece; ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, partition = encoder(tokenizer_file), np.array([end_id], "<u4").tobytes(), [0]

        def documents() -> Iterator[tuple[object, np.ndarray]]:
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(at, SLICE)
                    partition[0] = batch.column(2)[0].as_py()
                    for doc, ids in zip(batch.column(0), enc.encode(batch.column(1).to_pylist()), strict=True):
                        yield doc.as_py(), np.frombuffer(ids + end, "<u4")

        rows, held, n = [], 0, 0
        for window in pack_stream(documents(), capacity, windows, slack, longest):
            offset = 0
            for p in window:
                rows.append((p.doc, p.start, len(p.ids), p.ids.tobytes(), p.total, (partition[0] << SEQUENCE_BITS) + n, offset))
                offset += len(p.ids)
            n, held = n + 1, held + offset
            if held >= 1 << 20:
                yield batch_of(rows)
                rows, held = [], 0
        if rows:
            yield batch_of(rows)

    kind = docs.schema[id_col].dataType
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(kind), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    read = docs.select(named(id_col).alias("id"), whole_text(text_col).alias("text"), F.spark_partition_id().cast("long").alias("partition"))
    out = read.mapInArrow(run, f"id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of documents in sequences of 4096 tokens."""
    import public_tokenizers

    pieces = packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
