"""WAV files as a source and a sink: listing, headers, samples, ranges, cuts.

Files are listed by Spark and read in tasks by seeking, through pyarrow's file systems: a header costs some KiB, a range
its own bytes, whatever the file's length. PCM of 8 to 32 bits, floats of 32 and 64, plain and extensible formats, and
RF64 files over 4 GB are read. A file that isn't one of these is left out of tables; `unreadable` names it.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, signal
from ..schemas import SOUNDSCAPES, TEMPLATES
from ..shared import open_store, written

PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
#: Least bytes of one read.
PAGE = 4096


class RangeReader:
    """Ranges of an open file, read by seeking; n_bytes counts what was read."""

    def __init__(self, file, size: int):
        self.file, self.size, self.n_bytes, self.page = file, size, 0, (0, b"")

    def read(self, at: int, n: int) -> bytes:
        start, held = self.page
        if not start <= at <= at + n <= start + len(held):
            self.file.seek(at)
            held = self.file.read(max(n, PAGE))
            self.n_bytes += len(held)
            self.page = start, held = at, held
            if n > PAGE:
                self.page = (0, b"")  # a long range isn't kept
        return held[at - start : at - start + n]


def opened(uri: str) -> RangeReader:
    store, path = open_store(uri)
    file = store.open_input_file(path)
    return RangeReader(file, file.size())


def _format(fmt: bytes | None) -> dict | None:
    """What a format chunk says; None if its samples can't be read."""
    if fmt is None or len(fmt) < 16:
        return None
    code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", fmt)
    if code == EXTENSIBLE:  # the kind of samples stands at the head of the subformat
        code = struct.unpack_from("<H", fmt, 24)[0] if len(fmt) >= 26 else PCM
    if not channels or not rate or bits not in {PCM: (8, 16, 24, 32), FLOAT: (32, 64)}.get(code, ()):
        return None
    return {"channels": channels, "rate": rate, "bits": bits, "float": code == FLOAT, "frame": channels * bits // 8}


def read_header(reader: RangeReader) -> dict | None:
    """Format, channels, rate, bits, the place and number of the samples that are there; None if it isn't a WAV file that can be read."""
    try:
        head = reader.read(0, 12)
        if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
            return None
        at, fmt, long = 12, None, None
        while at + 8 <= reader.size:
            kind, size = struct.unpack("<4sI", reader.read(at, 8))
            if kind == b"ds64":
                long = struct.unpack("<QQ", reader.read(at + 8, 16))[1]
            elif kind == b"fmt ":
                fmt = reader.read(at + 8, min(size, 40))
            elif kind == b"data":
                h = _format(fmt)
                size = long if size == 0xFFFFFFFF and long is not None else size
                return h and h | {"at": at + 8, "n": min(size, reader.size - at - 8) // h["frame"]}
            at += 8 + size + size % 2
    except struct.error:
        pass
    return None


def read_frames(reader: RangeReader, h: dict, first: int, n: int) -> np.ndarray:
    """The bytes of n frames from `first` on: (n, channels, bytes of a sample); fewer at the end."""
    n = max(0, min(n, h["n"] - first))
    data = reader.read(h["at"] + first * h["frame"], n * h["frame"]) if n else b""
    return np.frombuffer(data, np.uint8, len(data) // h["frame"] * h["frame"]).reshape(-1, h["channels"], h["bits"] // 8)


def samples_of(raw: np.ndarray, h: dict, channel: int | None = 0) -> np.ndarray:
    """A channel's samples: whole numbers, or floats as they are; None: (n, channels)."""
    if channel is not None:
        raw = raw[:, channel : channel + 1]
    if h["float"]:
        out = np.ascontiguousarray(raw).view(f"<f{h['bits'] // 8}")[:, :, 0].astype(float)
    elif h["bits"] == 8:
        out = raw[:, :, 0].astype(np.int32) - 128
    else:
        wide = np.zeros((*raw.shape[:2], 4), np.uint8)
        wide[:, :, 4 - raw.shape[2] :] = raw
        out = wide.view("<i4")[:, :, 0] >> (32 - h["bits"])
    return out if channel is None else out[:, 0]


def _range(h: dict, start: float | None, end: float | None) -> tuple[int, int]:
    """The first frame and the number of frames of a range of seconds."""
    a = 0 if start is None else min(h["n"], max(0, int(round(start * h["rate"]))))
    b = h["n"] if end is None else min(h["n"], int(round(end * h["rate"])))
    return a, max(0, b - a)


def decode(data: bytes, start: float | None = None, end: float | None = None, channel: int | None = 0) -> tuple[np.ndarray, dict]:
    """A channel's samples, the left one by default, of a range of seconds if given; None: (n, channels)."""
    reader = RangeReader(io.BytesIO(data), len(data))
    h = read_header(reader)
    if h is None:
        raise ValueError("not a WAV file that can be read")
    return samples_of(read_frames(reader, h, *_range(h, start, end)), h, channel), h


def _file(body: bytes, rate: int, bits: int, channels: int, code: int = PCM) -> bytes:
    frame = channels * bits // 8
    pad = b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 36 + len(body) + len(pad)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, code, channels, rate, rate * frame, frame, bits) + b"data" + struct.pack("<I", len(body)) + body + pad


def encode(samples: np.ndarray, rate: int, bits: int = 16) -> bytes:
    """A PCM file of whole-number samples, (n,) or (n, channels), cut off at the depth's limits."""
    if bits not in (8, 16, 24, 32):
        raise ValueError("8, 16, 24 or 32 bits are written")
    x = np.atleast_2d(np.asarray(samples).T).T
    top = (1 << (bits - 1)) - 1
    whole = np.clip(x, -top - 1, top).astype(np.int64)
    body = (whole + 128).astype(np.uint8) if bits == 8 else np.ascontiguousarray(whole.astype("<i4")).view(np.uint8).reshape(*x.shape, 4)[:, :, : bits // 8]
    return _file(body.tobytes(), rate, bits, x.shape[1])


def encode_float(samples: np.ndarray, rate: int, bits: int = 32) -> bytes:
    """A file of float samples, (n,) or (n, channels)."""
    x = np.atleast_2d(np.asarray(samples).T).T
    return _file(x.astype(f"<f{bits // 8}").tobytes(), rate, bits, x.shape[1], FLOAT)


def cut(reader: RangeReader, h: dict, start: float, end: float) -> bytes:
    """A range of seconds as a file of its own, with the source's channels, depth and kind of samples, byte for byte."""
    return _file(read_frames(reader, h, *_range(h, start, end)).tobytes(), h["rate"], h["bits"], h["channels"], FLOAT if h["float"] else PCM)


def listing(spark: SparkSession, path: str, recursive: bool = True, needed: bool = False) -> DataFrame:
    """(path, length) of the WAV files; no content is read. needed: a folder without any is an error."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length")
    if needed and found.isEmpty():
        raise ValueError(f"no WAV files under {path}")
    return found


#: Files whose headers one task reads, at most.
FILES_A_TASK = 256


def _each(files: DataFrame, run, schema: str, n: int | None = None) -> DataFrame:
    """run over rows that only name what a task is to read, dealt evenly."""
    n = n or -(-files.count() // FILES_A_TASK)
    return files.repartition(max(1, n)).mapInPandas(run, schema)


def headers(files: DataFrame) -> DataFrame:
    """(path, samples, rate, bits, channels) of the files that are WAV, wherever in them their samples begin."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for path in pdf["path"]:
                h = read_header(opened(path))
                if h:
                    found.append((path, h["n"], h["rate"], h["bits"], h["channels"]))
            yield pd.DataFrame(found, columns=["path", "samples", "rate", "bits", "channels"])

    # streams can't be counted, and a scan of names is split by Spark
    rows = files.select("path")
    schema = "path string, samples long, rate int, bits int, channels int"
    return rows.mapInPandas(run, schema) if files.isStreaming else _each(rows, run, schema)


def unreadable(files: DataFrame) -> DataFrame:
    """(path) of the files whose headers can't be read."""
    return files.select("path").join(headers(files).select("path"), "path", "left_anti")


def soundscape_metadata(files: DataFrame) -> DataFrame:
    h = headers(files)
    layout = F.when(F.col("channels") == 1, "mono").when(F.col("channels") == 2, "stereo").otherwise("other")
    values = (F.col("path"), names.base_name(F.col("path")), F.col("samples") / F.col("rate"), F.col("rate"), F.col("bits"), layout)
    return h.select(*(v.cast(f.dataType).alias(f.name) for v, f in zip(values, SOUNDSCAPES.fields, strict=True)))


def template_metadata(files: DataFrame) -> DataFrame:
    """Templates whose names follow the grammar; others are left out."""
    name = names.base_name(F.col("path"))
    p = names.parsed(name)
    h = headers(files.filter(names.is_template_name(name)))
    values = (F.col("path"), name, name, p["label"], F.lit(0.0), F.col("samples") / F.col("rate"), F.col("rate"), p["min_freq"], p["max_freq"], p["wl"], p["ovlp"])
    return h.select(*(v.cast(f.dataType).alias(f.name) for v, f in zip(values, TEMPLATES.fields, strict=True)))


#: Frames of a block of a spectrogram.
BLOCK = 4096


def frame_blocks(settings: DataFrame, block: int = BLOCK) -> DataFrame:
    """settings (path, wl, ovlp, ...) with block (first frame, from 0), n_frames of the whole recording and n_samples: a row a block.

    A row names the frames, their samples are read where it is worked on. A recording is as many rows as it needs.
    """
    files = settings.select("path").distinct()
    sized = settings.join(headers(files).select("path", F.col("samples").alias("n_samples")), "path")
    hop = F.col("wl") * (1 - F.col("ovlp") / 100)
    n = F.when(F.col("n_samples") >= F.col("wl"), F.floor((F.col("n_samples") - F.col("wl")) / hop) + 1).otherwise(0)
    counted = sized.withColumn("n_frames", n.cast("long")).filter("n_frames > 0")
    return counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames") - 1, F.lit(block).cast("long"))).alias("block"))


def dealt(blocks: DataFrame) -> DataFrame:
    """Blocks dealt evenly to tasks: a row is small, its work is not."""
    spark = blocks.sparkSession
    most = 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(max(1, min(most, blocks.count())))


def block_amplitudes(reader: RangeReader, h: dict, low: int, high: int, wl: int, ovlp: float) -> tuple[np.ndarray, np.ndarray]:
    """Times and amplitudes of the frames low to high - 1: their samples are all that is read."""
    starts = signal.frame_starts(low, high, wl, ovlp)
    samples = samples_of(read_frames(reader, h, int(starts[0]), int(starts[-1] - starts[0]) + wl), h)
    starts_here = starts - starts[0]
    whole = starts_here[starts_here + wl <= len(samples)]  # a file may have become shorter
    return starts[: len(whole)] / h["rate"], signal.amplitudes(samples, whole, wl)


class Readers:
    """The file that a task has open: blocks of one file mostly follow each other."""

    def __init__(self):
        self.path, self.reader, self.header = None, None, None

    def __call__(self, path: str) -> tuple[RangeReader, dict | None]:
        if path != self.path:
            self.path, self.reader = path, opened(path)
            self.header = read_header(self.reader)
        return self.reader, self.header


def tops(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(path, wl, ovlp, top): a recording's largest amplitude, from those of its blocks. The first of the two passes of a spectrogram."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = Readers()
        for pdf in batches:
            for r in pdf.itertuples():
                reader, h = readers(r.path)
                amp = block_amplitudes(reader, h, int(r.block), int(min(r.block + block, r.n_frames)), int(r.wl), float(r.ovlp))[1]
                yield pd.DataFrame({"path": [r.path], "wl": [int(r.wl)], "ovlp": [float(r.ovlp)], "top": [float(amp.max(initial=0.0))]})

    rows = dealt(blocks.select("path", "wl", "ovlp", "block", "n_frames"))
    return rows.mapInPandas(run, "path string, wl int, ovlp double, top double").groupBy("path", "wl", "ovlp").agg(F.max("top").alias("top"))


def spectrograms(files: DataFrame, settings: DataFrame, block: int = BLOCK) -> DataFrame:
    """(path, wl, ovlp, frame_idx, time_vec, amp) in decibels below a recording's highest level.

    settings: (path, wl, ovlp), distinct. Two passes over blocks of frames: the first finds a recording's level, the
    second makes the decibels; no task holds more than a block.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = Readers()
        for pdf in batches:
            for r in pdf.itertuples():
                reader, h = readers(r.path)
                t, amp = block_amplitudes(reader, h, int(r.block), int(min(r.block + block, r.n_frames)), int(r.wl), float(r.ovlp))
                db = signal.levels(amp, r.top)
                for at in range(0, len(t), 256):
                    part = slice(at, at + 256)
                    n = len(t[part])
                    yield pd.DataFrame({"path": r.path, "wl": int(r.wl), "ovlp": float(r.ovlp), "frame_idx": np.arange(n) + int(r.block) + at + 1, "time_vec": t[part], "amp": list(db[part])})

    blocks = frame_blocks(files.select("path").join(settings, "path"), block)
    rows = dealt(blocks.join(tops(blocks, block), ["path", "wl", "ovlp"]).select("path", "wl", "ovlp", "block", "n_frames", "top"))
    return rows.mapInPandas(run, "path string, wl int, ovlp double, frame_idx int, time_vec double, amp array<double>")


#: Seconds of a recording whose ROIs are cut together.
CUT_SPAN = 600.0


def cuts(files: DataFrame, rois: DataFrame) -> DataFrame:
    """(cut_name, content): each ROI's range as a file of its own, with its recording's channels and depth.

    rois: (soundscape_path, roi_start, roi_end, cut_name). Those of CUT_SPAN seconds are cut by one task, which reads
    their ranges only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = Readers()
        for pdf in batches:
            for r in pdf.itertuples():
                reader, h = readers(r.soundscape_path)
                for x in r.rois if h else ():
                    yield pd.DataFrame([(x["cut_name"], cut(reader, h, x["roi_start"], x["roi_end"]))], columns=["cut_name", "content"])

    span = F.floor(F.col("roi_start") / CUT_SPAN).alias("span")
    grouped = rois.groupBy("soundscape_path", span).agg(F.collect_list(F.struct("cut_name", "roi_start", "roi_end")).alias("rois"))
    listed = files.select(F.col("path").alias("soundscape_path")).distinct()
    return grouped.join(listed, "soundscape_path", "left_semi").select("soundscape_path", "rois").mapInPandas(run, "cut_name string, content binary")


def write_files(cuts: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """Writes (cut_name, content) as files under folder, a URI that tasks can write; returns (cut_name, status): written, or exists where a file was left as it is.

    All files appear when all tasks have ended, whole, and one for a name, however often a task was run.
    """
    from .wav_format import register

    spark = cuts.sparkSession
    register(spark)
    there = spark.createDataFrame(existing_files(folder), "path string")
    found = written(there.select(names.base_name(F.col("path")).alias("cut_name")), "files-before")
    rows = written(cuts.select("cut_name").distinct().join(found.withColumn("there", F.lit(True)), "cut_name", "left").select("cut_name", F.when(F.col("there") & F.lit(not overwrite), "exists").otherwise("written").alias("status")), "files-status")
    new = cuts if overwrite else cuts.join(found, "cut_name", "left_anti")
    new.select("cut_name", "content").write.format("wav_files").mode("overwrite" if overwrite else "append").save(folder)
    return rows


def existing_files(folder: str) -> list[tuple[str]]:
    """(path) of the files right under a folder: names only, as a listing of a file system gives them."""
    from pyarrow import fs

    store, path = open_store(folder)
    return [(f.path,) for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.type == fs.FileType.File]
