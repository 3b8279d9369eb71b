"""Spark data sources of WAV files: `wav` reads headers or sample blocks by byte ranges, `wav_files` writes files with a commit.

    register(spark)
    spark.read.format("wav").load(folder)                                  # a row a file, from its header
    spark.read.format("wav").option("read", "samples").load(folder)        # a row a block of samples
    cuts.write.format("wav_files").mode("append").save(folder)             # (cut_name, content) as files

Reading headers costs a page of a few KiB a file. Partitions of samples are byte ranges of files, so a file of any length
is many tasks, and a task seeks to its range. Filters on path, start_time and end_time go to the reader: files and blocks outside are not read.

Writing: a task writes to a folder of its own attempt; when all tasks have ended the driver moves the files of the
attempts that Spark has committed into place, one after the other, and the attempts' folder goes. A task that is run twice
leaves one whole file; a job that fails leaves none. A file that is there already is replaced in mode overwrite and kept
in mode append.

Edge cases: files that can't be read as WAV give no rows; an empty folder gives no rows; names are told apart by case.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..shared import open_store
from . import wav

HEADERS = "path string, length long, samples long, rate int, bits int, channels int, is_float boolean"
SAMPLES = "path string, rate int, first long, start_time double, end_time double, samples array<double>"
#: Bytes of a file that are one partition, files whose headers are one, and samples of a row.
RANGE, FILES, BLOCK = 64 << 20, 64, 1 << 18


@dataclass
class Files(InputPartition):
    """Files whose headers a task reads."""

    paths: list[str]


@dataclass
class Range(InputPartition):
    """The bytes of a file from low to high - 1: the blocks that begin there are the task's."""

    path: str
    low: int
    high: int


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.samples = options["path"], options.get("read", "headers") == "samples"
        self.recursive = str(options.get("recursive", "true")).lower() == "true"
        self.range, self.block = int(options.get("range", RANGE)), int(options.get("block", BLOCK))
        self.only: str | None = None
        self.after, self.before = float("-inf"), float("inf")
        self.n_bytes = 0  # read by this object's read()

    def pushFilters(self, filters: list) -> Iterator:
        """Takes note of what rules out files and blocks; Spark checks all filters once more."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.only = f.value
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("end_time",):
                self.after = max(self.after, float(f.value))
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("start_time",):
                self.before = min(self.before, float(f.value))
            yield f

    def listed(self) -> list[tuple[str, int]]:
        """Paths, as Spark writes them, and lengths of the files."""
        from pyarrow import fs

        store, root = open_store(self.path)
        base = self.path.rstrip("/") if "://" in self.path or self.path.startswith("file:") else f"file:{root}"
        found = store.get_file_info(fs.FileSelector(root, recursive=self.recursive, allow_not_found=True))
        files = [(f"{base}{f.path.removeprefix(root.rstrip('/'))}", f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".wav")]
        return sorted(f for f in files if self.only in (None, f[0]))

    def partitions(self) -> list[InputPartition]:
        files = self.listed()
        if not self.samples:
            return [Files([p for p, _ in files[i : i + FILES]]) for i in range(0, len(files), FILES)] or [Files([])]
        return [Range(p, low, min(low + self.range, size)) for p, size in files for low in range(0, size, self.range)] or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if isinstance(partition, Files):
            for path in partition.paths:
                reader = wav.opened(path)
                h = wav.read_header(reader)
                self.n_bytes += reader.n_bytes
                if h:
                    yield path, reader.size, h["n"], h["rate"], h["bits"], h["channels"], h["float"]
            return
        reader = wav.opened(partition.path)
        h = wav.read_header(reader)
        if h is None:
            self.n_bytes += reader.n_bytes
            return
        at = lambda byte: max(0, -(-(byte - h["at"]) // (h["frame"] * self.block)))  # the first block that begins there or behind
        end = min(at(partition.high), -(-h["n"] // self.block))
        for k in range(at(partition.low) if partition.low else 0, end):
            first, n = k * self.block, min(self.block, h["n"] - k * self.block)
            start, stop = first / h["rate"], (first + n) / h["rate"]
            if stop < self.after or start > self.before:
                continue
            samples = wav.samples_of(wav.read_frames(reader, h, first, n), h)
            yield partition.path, h["rate"], first, start, stop, samples.astype(float).tolist()
        self.n_bytes += reader.n_bytes


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SAMPLES if self.options.get("read", "headers") == "samples" else HEADERS

    def reader(self, schema) -> WavReader:
        return WavReader(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    """The files of a task's attempt and its folder."""

    folder: str
    names: list[str]


class WavWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, f"_attempts-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        folder, names = f"{self.job}/{uuid.uuid4().hex}", []
        store, root = open_store(self.path)
        store.create_dir(f"{root}/{folder}", recursive=True)
        for row in rows:
            with store.open_output_stream(f"{root}/{folder}/{row['cut_name']}", compression=None) as out:
                out.write(bytes(row["content"]))
            names.append(row["cut_name"])
        return Written(folder, names)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, root = open_store(self.path)
        for m in messages:
            for name in m.names if m else ():
                target = f"{root}/{name}"
                if store.get_file_info(target).type != fs.FileType.NotFound:
                    if not self.overwrite:
                        continue
                    store.delete_file(target)
                store.move(f"{root}/{m.folder}/{name}", target)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, root = open_store(self.path)
        if store.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.job}")


class WavFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_files"

    def schema(self) -> str:
        return "cut_name string, content binary"

    def writer(self, schema, overwrite: bool) -> WavWriter:
        return WavWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session, and lets Spark hand filters to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WavSource)
    spark.dataSource.register(WavFiles)
