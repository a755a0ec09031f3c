"""WAV source: durations from headers, samples by byte ranges, clips of events, and whole files.

``blocks`` is a data source whose tasks read byte ranges, so a day-long file is several tasks; wanted files and times
are pushed down to it. ``Clips`` reads the stretches of a file that events need. Both open files by themselves, in the
stores of ``SEEKABLE``; from any other store ``waves`` reads whole files through Spark's binary file reader.

Integer samples are always scaled to -1..1; 8, 16, 24 and 32 bit PCM and 32 and 64 bit floats are read. A file that is
no WAV gives nulls and the reason in ``error``. Of a file that ends before its stated size (cut, or written as a stream)
what is there counts, in whole frames.
"""

from __future__ import annotations

import fnmatch
import io
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains,
    StringStartsWith,
)

from callgrid.runtime import by_value, slices

by_value(__name__)

HEADER = "audio_path string, rate int, channels int, frames long, duration double, error string"
WAVE = "audio_path string, rate int, samples array<float>, error string"


def read_header(f, length: int) -> tuple[int, int, int, int, int, int]:
    """(format, channels, rate, bits, offset of the samples, their bytes) of an open file of ``length`` bytes, from chunk to
    chunk: only chunk headers and the format are read, whatever lies before the samples. An extensible header's format is
    its subtype. The samples' bytes are those that the file holds, whatever the chunk states."""
    if (start := f.read(12))[:4] != b"RIFF" or start[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, kind = 12, None
    while len(head := f.read(8)) == 8:
        name, size = head[:4], struct.unpack("<I", head[4:])[0]
        if name == b"fmt ":
            body = f.read(min(size, 40))
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            kind = (struct.unpack_from("<H", body, 24)[0] if tag == 0xFFFE else tag, channels, rate, bits)
        elif name == b"data":
            if kind is None:
                raise ValueError("data before format")
            if not (kind[1] * (kind[3] // 8) and kind[2]):
                raise ValueError("format without channels, bits or rate")
            return *kind, at + 8, min(size, max(0, length - at - 8))
        at += 8 + size + size % 2
        f.seek(at)
    raise ValueError("no data chunk")


def header(data: bytes) -> tuple[int, int, int, int, int, int]:
    return read_header(io.BytesIO(data), len(data))


def samples_of(raw: bytes, tag: int, channels: int, bits: int) -> np.ndarray:
    """Frames x channels float32 of the bytes of whole frames."""
    raw = raw[: len(raw) // (channels * bits // 8) * (channels * bits // 8)]
    if tag == 3 and bits in (32, 64):
        x = np.frombuffer(raw, f"<f{bits // 8}").astype(np.float32)
    elif tag == 1 and bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif tag == 1 and bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / 2**23
    elif tag == 1 and bits in (16, 32):
        x = np.frombuffer(raw, f"<i{bits // 8}").astype(np.float32) / 2 ** (bits - 1)
    else:
        raise ValueError(f"format {tag} with {bits} bits")
    return x.reshape(-1, channels)


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """(frames x channels float32, rate)."""
    tag, channels, rate, bits, at, size = header(data)
    return samples_of(data[at : at + size], tag, channels, bits), rate


def encode(samples: np.ndarray, rate: int) -> bytes:
    """Mono float32 WAV."""
    data = np.asarray(samples, "<f4").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, 1, rate, 4 * rate, 4,
        32) + b"data" + struct.pack("<I", len(data)) + data


def _files(spark: SparkSession, path: str | list[str], glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def listing(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    """(audio_path, bytes, modified): contents are not read."""
    return _files(spark, path, glob).select(F.col("path").alias("audio_path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


#: Stores whose files tasks open by themselves, to read headers and ranges only.
SEEKABLE = ("file", "hdfs", "s3", "s3a", "gs", "abfss")


def seekable(path: str) -> bool:
    return path.startswith("/") or path.partition(":")[0] in SEEKABLE


def _store(path: str):
    """(file system of pyarrow, name in it) of a path as Spark names it."""
    from urllib.parse import quote

    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if path.startswith("/") or scheme == "file":
        return fs.LocalFileSystem(), path if path.startswith("/") else "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(quote(path.replace("s3a:", "s3:", 1), safe=":/@"))


def open_file(path: str):
    system, name = _store(path)
    return system.open_input_file(name)


def durations(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    """HEADER of every file. In stores that tasks can open, only headers are read; from others Spark reads whole files."""
    found = listing(spark, path, glob)
    first = found.select("audio_path").first()
    seek = first is not None and seekable(first[0])
    files = found.select("audio_path") if seek else _files(spark, path, glob).select("path", "content")
    names, kinds = [x.split()[0] for x in HEADER.split(", ")], (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.string())

    def run(batches):
        for b in slices(batches, 64):
            rows = []
            for p, *content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    with io.BytesIO(content[0]) if content else open_file(p) as f:
                        _, channels, rate, bits, _, size = read_header(f, len(content[0]) if content else f.size())
                    n = size // (channels * bits // 8)
                    rows.append((p, rate, channels, n, n / rate, None))
                except (ValueError, struct.error) as e:
                    rows.append((p, None, None, None, None, str(e)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.mapInArrow(run, HEADER)


#: Bytes that a clip reader takes at once at least, so that near clips of a file share a read.
AHEAD = 1 << 18


class Clips:
    """Mono samples of one open file by ranges of frames."""

    def __init__(self, path: str):
        self.file = open_file(path)
        self.tag, self.channels, self.rate, self.bits, self.at, size = read_header(self.file, self.file.size())
        samples_of(b"", self.tag, self.channels, self.bits)  # an unknown format is an error at once
        self.width = self.channels * self.bits // 8
        self.frames, self.held = size // self.width, (0, np.zeros(0, np.float32))

    def read(self, first: int, last: int) -> np.ndarray:
        """Frames ``first`` up to ``last``, as far as the file has them."""
        first, last = max(0, first), min(last, self.frames)
        if last <= first:
            return np.zeros(0, np.float32)
        self.file.seek(self.at + first * self.width)
        raw = self.file.read((last - first) * self.width)
        return samples_of(raw, self.tag, self.channels, self.bits).mean(1).astype(np.float32)

    def mono(self, first: int, last: int) -> np.ndarray:
        """As ``read``, for ranges that mostly ascend: what was read ahead is used again."""
        first, last = max(0, first), min(last, self.frames)
        low, have = self.held
        if first < low or last > low + len(have):
            low, have = self.held = first, self.read(first, max(last, first + AHEAD // self.width))
        return have[first - low : max(first, last) - low]

    def close(self) -> None:
        self.file.close()


BLOCK = "audio_path string, rate int, frames long, first long, start_seconds double, end_seconds double, samples array<float>, error string"
#: Bytes of a task, and frames of a row.
RANGE_BYTES, BLOCK_FRAMES = 32 << 20, 1 << 18


class Ranges(InputPartition):
    """(path, first byte, byte behind the last) of a task: one range of a long file, or several short files."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class BlockReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.glob = options["path"], options.get("glob", "*.wav")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.tests, self.after, self.before = [], None, None

    def pushFilters(self, filters):
        """Filters of paths are settled here: other files are never opened. Of times only the stretch that can matter is
        read, and Spark looks at the blocks again."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("audio_path",) and isinstance(f, (EqualTo, In, StringStartsWith, StringContains)):
                self.tests.append(f)
                continue
            if column == ("end_seconds",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.after = max(value, value if self.after is None else self.after)
            if column == ("start_seconds",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.before = min(value, value if self.before is None else self.before)
            yield f

    def wanted(self, path: str) -> bool:
        rules = {EqualTo: lambda f: path == f.value, In: lambda f: path in f.value, StringStartsWith: lambda f: path.startswith(f.value),
            StringContains: lambda f: f.value in path}
        return all(rules[type(f)](f) for f in self.tests)

    def partitions(self):
        """Ranges of the listed files, as Spark lists and packs files: by their lengths, without opening one."""
        from pyarrow import fs

        system, root = _store(self.path)
        scheme = "" if self.path.startswith(("/", "file:")) else self.path[: self.path.index(root)] if root in self.path else ""
        found = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [
            system.get_file_info(root)]
        files = sorted((scheme + x.path, x.size) for x in found if x.is_file and fnmatch.fnmatch(x.base_name, self.glob))
        out, held, room = [], [], self.range_bytes
        for path, size in files:
            if not self.wanted(path):
                continue
            for low in range(0, max(size, 1), self.range_bytes):
                part = (path, low, min(low + self.range_bytes, max(size, 1)))
                if part[2] - part[1] > room:
                    out.append(Ranges(held))
                    held, room = [], self.range_bytes
                held.append(part)
                room -= part[2] - part[1]
        return [*out, Ranges(held)] if held else out or [Ranges([])]

    def read(self, partition):
        for path, low, high in partition.ranges:
            try:
                clips = Clips(path)
            except (ValueError, struct.error) as e:
                if low == 0:
                    yield _block(path, None, None, None, None, str(e))
                continue
            try:
                # a range owns the frames whose first byte it holds; the header belongs to the first range
                first, last = (min(clips.frames, max(0, -(-(x - clips.at) // clips.width))) for x in (low, high))
                if self.after is not None:
                    first = max(first, int(np.floor(self.after * clips.rate)) - 1)
                if self.before is not None:
                    last = min(last, int(np.ceil(self.before * clips.rate)) + 1)
                for at in range(first, last, BLOCK_FRAMES):
                    yield _block(path, clips.rate, clips.frames, at, clips.read(at, min(last, at + BLOCK_FRAMES)), None)
            except ValueError as e:
                if low == 0:
                    yield _block(path, clips.rate, clips.frames, None, None, str(e))
            finally:
                clips.close()


def _block(path, rate, frames, first, samples, error) -> pa.RecordBatch:
    there = samples is not None
    values = pa.ListArray.from_arrays(pa.array([0, len(samples)], pa.int32()), pa.array(samples, pa.float32())) if there else pa.array([None],
        pa.list_(pa.float32()))
    times = (first / rate, (first + len(samples)) / rate) if there else (None, None)
    columns = [pa.array([x], t) for x, t in ((path, pa.string()), (rate, pa.int32()), (frames, pa.int64()), (first, pa.int64()), (times[0], pa.float64()),
        (times[1], pa.float64()))]
    return pa.RecordBatch.from_arrays([*columns, values, pa.array([error], pa.string())], names=[x.split()[0] for x in BLOCK.split(", ")])


class BlockSource(DataSource):
    """Samples of WAV files in blocks. Options: path, glob, rangeBytes."""

    @classmethod
    def name(cls):
        return "wav_blocks"

    def schema(self):
        return BLOCK

    def reader(self, schema):
        return BlockReader(self.options)


def blocks(spark: SparkSession, path: str, glob: str = "*.wav", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """BLOCK rows: mono samples of all files under a path, at most BLOCK_FRAMES a row, from tasks of ``range_bytes``. Local
    paths are plain (``/...``). Filters on audio_path choose the files that are opened; those on end_seconds from below
    and on start_seconds from above choose what is read of them."""
    if not seekable(path):
        raise ValueError(f"tasks cannot open {path!r} by themselves; read whole files with waves()")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BlockSource)
    return spark.read.format("wav_blocks").option("path", path).option("glob", glob).option("rangeBytes", range_bytes).load()


def audio(events: DataFrame, path: str, glob: str = "*.wav") -> DataFrame:
    """What events read their samples from: the listed files (audio_path, bytes), whose clips tasks read by themselves; in
    other stores ``waves`` of the files that the events name. Local paths are plain (``/...``)."""
    spark, plain = events.sparkSession, F.regexp_replace("audio_path", "^file:/+", "/")
    found = listing(spark, path, glob)
    first = found.select("audio_path").first()
    if first is None or seekable(first[0]):
        return found.select(plain.alias("audio_path"), "bytes")
    named = found.join(events.select("audio_path").distinct(), "audio_path", "left_semi")
    paths = [r[0] for r in named.select("audio_path").collect()]  # a part of the list of files that Spark holds for any scan
    return waves(spark, paths, glob) if paths else spark.createDataFrame([], WAVE)


def waves(spark: SparkSession, path: str | list[str], glob: str = "*.wav") -> DataFrame:
    """WAVE of every file: mono samples (the channels' mean)."""
    files = _files(spark, path, glob).select("path", "content")

    def run(batches):
        for b in slices(batches, 1):
            p, data = b.column(0)[0].as_py(), b.column(1)[0].as_py()
            x, rate, error = None, None, None
            try:
                x, rate = decode(data)
            except (ValueError, struct.error) as e:
                error = str(e)
            mono = pa.array(x.mean(1).astype(np.float32)) if x is not None else pa.array([], pa.float32())
            samples = pa.ListArray.from_arrays(pa.array([0, len(mono)], pa.int32()), mono) if x is not None else pa.array([None], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([rate], pa.int32()), samples, pa.array([error], pa.string())], names=["audio_path",
                "rate", "samples", "error"])

    return files.mapInArrow(run, WAVE)
