"""Notes from and to Standard MIDI files.

spark.read.format("midi") lists the files below a folder and packs them into partitions by bytes, so that many small files are few
tasks; a filter on track_id (the folder a file lies in) leaves the other folders unlisted.  df.write.format("midi") writes a file for each
(track_id, file_no).  Both work where pyarrow can open the path; read_midi reads any other store through Spark's binaryFile."""

from __future__ import annotations

import bisect
import itertools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from ..schemas import NOTES

_COLUMNS = [c.split()[0] for c in NOTES.split(", ")]


def _number(data: bytes, at: int) -> tuple[int, int]:
    """Variable-length number at a place, and the place after it."""
    value = 0
    while True:
        byte = data[at]
        value, at = value << 7 | byte & 127, at + 1
        if byte < 128:
            return value, at


def _events(track: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(tick, status, payload); meta events have status 0xFF and their type before the payload."""
    at = tick = status = 0
    while at < len(track):
        wait, at = _number(track, at)
        tick += wait
        if track[at] >= 128:
            status, at = track[at], at + 1
        if status == 0xFF:
            kind = track[at : at + 1]
            n, at = _number(track, at + 1)
            yield tick, status, kind + track[at : at + n]
        elif status in (0xF0, 0xF7):
            n, at = _number(track, at)
        else:
            n = 1 if status >> 4 in (0xC, 0xD) else 2
            yield tick, status, track[at : at + n]
        at += n


def parse_notes(data: bytes) -> list[tuple[int, int, int, float, float, int, int]]:
    """(track, channel, program, onset, release, pitch, velocity) with times in seconds."""
    if data[:4] != b"MThd":
        raise ValueError("no MIDI header")
    size, _, count, division = struct.unpack(">IHHH", data[4:14])
    if division & 0x8000 or not division:
        raise ValueError("only ticks per quarter note are supported")
    at, chunks = 8 + size, []
    while len(chunks) < count and at + 8 <= len(data):
        kind, n = data[at : at + 4], struct.unpack(">I", data[at + 4 : at + 8])[0]
        if kind == b"MTrk":
            chunks.append(list(_events(data[at + 8 : at + 8 + n])))
        at += 8 + n
    changes = sorted((t, int.from_bytes(p[1:4], "big")) for chunk in chunks for t, s, p in chunk if s == 0xFF and p[:1] == b"\x51")
    tempo, marks = 500_000, [(0, 0.0, 500_000)]
    for tick, new in changes:
        last, seconds, tempo = marks[-1]
        marks.append((tick, seconds + (tick - last) * tempo / division / 1e6, new))

    ticks = [m[0] for m in marks]

    def seconds(tick: int) -> float:
        start, base, tempo = marks[bisect.bisect_right(ticks, tick) - 1]
        return base + (tick - start) * tempo / division / 1e6

    out = []
    for number, chunk in enumerate(chunks):
        program, sounding = [0] * 16, {}
        for tick, status, payload in chunk:
            kind, channel = status >> 4, status & 15
            if kind == 0xC:
                program[channel] = payload[0]
            elif kind == 0x9 and payload[1]:
                sounding.setdefault((channel, payload[0]), []).append((tick, payload[1]))
            elif kind in (0x8, 0x9):
                # An end closes all that began before it, under the program of now.  What began on its own tick is a note struck
                # again and goes on, if there was one to close; else it has no length and is none.
                open_ = sounding.pop((channel, payload[0]), [])
                ended = [note for note in open_ if note[0] < tick]
                out += [(number, channel, program[channel], seconds(start), seconds(tick), payload[0], velocity) for start, velocity in ended]
                if ended and len(ended) < len(open_):
                    sounding[channel, payload[0]] = open_[len(ended) :]
    return out


def file_rows(path: str, data: bytes) -> list[tuple]:
    """Rows of a file; one without a pitch if it can't be read."""
    track, name = path.rsplit("/", 2)[-2:]
    try:
        notes = parse_notes(data)
    except (ValueError, IndexError, struct.error):
        notes = [(0, 0, 0, None, None, None, None)]
    return [(track, k, hash_name(name), f"{n[0]}:{n[1]}:{n[2]}", n[2], n[1] == 9, *n[3:]) for k, n in enumerate(notes)]


def hash_name(name: str) -> int:
    """A file's number inside its track: a hash of its name, the same wherever it is read."""
    return zlib.crc32(name.encode()) & 0x7FFFFFFF


def _variable(value: int) -> bytes:
    out = bytes([value & 127])
    while value := value >> 7:
        out = bytes([value & 127 | 128]) + out
    return out


def midi_bytes(notes: list[tuple[float, float, int, int, bool, int]], division: int = 480, tempo: int = 500_000) -> bytes:
    """A file of one track.  notes: onset, release, pitch, velocity, is_drum, program.  Drums are channel 9; each
    program has one of the other channels for as long as there are any, then shares them by program changes."""
    tick = lambda seconds: round(seconds * 1e6 * division / tempo)
    voices = {p: [c for c in range(16) if c != 9][i % 15] for i, p in enumerate(sorted({n[5] for n in notes if not n[4]}))}
    events = []
    for onset, release, pitch, velocity, drum, program in notes:
        channel = 9 if drum else voices[program]
        events.append((tick(onset), 1, bytes([0xC0 | channel, program & 127, 0x90 | channel, pitch, velocity])))
        events.append((tick(release), 0, bytes([0x80 | channel, pitch, 0])))
    body, at = _variable(0) + b"\xff\x51\x03" + tempo.to_bytes(3, "big"), 0
    for when, is_on, data in sorted(events):
        for part in (data[:2], data[2:]) if is_on else (data,):
            body += _variable(when - at) + part
            at = when
    body += _variable(0) + b"\xff\x2f\x00"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, division) + b"MTrk" + struct.pack(">I", len(body)) + body


def _opened(path: str):
    """pyarrow's filesystem for a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    """Paths that one task reads."""

    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


def packed(files: list[tuple[str, int]], most: int, each: int) -> list[list[str]]:
    """Files in order, in groups of up to `most` bytes, where opening a file counts as `each` bytes; a larger file is a group of its own."""
    groups, size = [], 0
    for path, n in sorted(files):
        if not groups or size + n + each > most:
            groups, size = [*groups, []], 0
        groups[-1].append(path)
        size += n + each
    return groups


class MidiReader(DataSourceReader):
    """Options: maxPartitionBytes (128 MiB) and openCostInBytes (4 MiB / 1024, as MIDI files are small)."""

    def __init__(self, options):
        self.path = options["path"]
        self.most, self.each = int(options.get("maxpartitionbytes", 128 << 20)), int(options.get("opencostinbytes", 4 << 10))
        self.tracks: set[str] | None = None

    def pushFilters(self, filters):
        for one in filters:
            wanted = {one.value} if isinstance(one, EqualTo) else set(one.value) if isinstance(one, In) else None
            if wanted is None or one.attribute != ("track_id",):
                yield one
            else:
                self.tracks = wanted if self.tracks is None else self.tracks & wanted

    def partitions(self):
        from pyarrow import fs

        system, root = _opened(self.path)
        root = root.rstrip("/")
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        midi = [(f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(".mid")]
        if self.tracks is not None:
            midi = [(path, n) for path, n in midi if path.rsplit("/", 2)[-2] in self.tracks]
        return [Files(paths) for paths in packed(midi, self.most, self.each)]

    def read(self, partition):
        system, _ = _opened(self.path)
        for path in partition.paths if partition is not None else ():
            with system.open_input_file(path) as file:
                yield from file_rows(path, file.read())


class MidiWriter(DataSourceWriter):
    """Files path/track_id/file_no.mid from rows that lie together by track_id and file_no (write_midi deals them so).  A task that is
    repeated writes the same files again."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator):
        system, root = _opened(self.path)
        for (track, number), rows in itertools.groupby(iterator, lambda r: (r["track_id"], r["file_no"])):
            notes = [(r["onset"], r["release"], r["pitch"], r["velocity"], r["is_drum"], r["program"] or 0) for r in rows if r["pitch"] is not None]
            system.create_dir(f"{root.rstrip('/')}/{track}")
            with system.open_output_stream(f"{root.rstrip('/')}/{track}/{number}.mid") as file:
                file.write(midi_bytes(notes))
        return WriterCommitMessage()


class MidiSource(DataSource):
    """Format "midi": notes of the *.mid files below a folder."""

    @classmethod
    def name(cls):
        return "midi"

    def schema(self):
        return NOTES

    def reader(self, schema):
        return MidiReader(self.options)

    def writer(self, schema, overwrite):
        return MidiWriter(self.options, overwrite)


def register_midi(spark: SparkSession) -> None:
    """Makes format "midi" known to a session, and lets it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MidiSource)


def write_midi(notes: DataFrame, folder: str) -> None:
    """A file for each track_id and file_no of notes (columns of NOTES; program may be missing)."""
    register_midi(notes.sparkSession)
    program = F.col("program") if "program" in notes.columns else F.lit(0)
    rows = notes.select(F.col("track_id").cast("string").alias("track_id"), "note_seq", "file_no", "instrument", program.cast("int").alias("program"), "is_drum", "onset", "release", "pitch", "velocity")
    rows.repartition("track_id", "file_no").sortWithinPartitions("track_id", "file_no").write.format("midi").mode("append").save(folder)


def read_midi(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of all *.mid files below folder; a track is the folder a file lies in.  An unreadable file gives one
    row without a pitch, so that it still counts among its track's files."""
    scheme = folder.split(":", 1)[0] if "://" in folder else "file"
    if scheme in ("file", "hdfs", "s3", "gs", "gcs"):
        register_midi(spark)
        return spark.read.format("midi").load(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                frame = pd.DataFrame(file_rows(path, data), columns=_COLUMNS)
                yield frame.astype({"pitch": "Int32", "velocity": "Int32", "onset": "float64", "release": "float64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.mid").load(folder)
    return files.select("path", "content").mapInPandas(run, NOTES)
