"""Scans that part large files: frames of detection JSON by ranges of bytes, odometry rows by blocks of their files; and files made of rows."""

from __future__ import annotations

import codecs
import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from trackloom.sources.formats import boxes_of

#: A frame's key and the start of its list. Frames begin with their number; no other key does.
_FRAME = re.compile(r'"(\s*\d[^"]*)"\s*:\s*(?=\[)')
#: What is read at once beyond a range, for the frame that its end cuts.
_MORE = 1 << 16
#: Tasks that a scan is parted into, about, and bytes of one that has more to read than a range.
TASKS, BUNDLE = 256, 1 << 25
_POSE = "timestamp_ns bigint, x double, y double, z double, qx double, qy double, qz double, qw double"


def file_system(path: str):
    """The store that a path names, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def sequence_of(path: str) -> str:
    """A sequence is named by its file, or by the folder seq_name=... that it is in."""
    folder = re.search(r"(?:^|/)seq_name=([^/]+)/", path)
    return folder[1] if folder else path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


@dataclass
class Range:
    """The frames of a file whose keys begin from start on and before end."""

    path: str
    seq_name: str
    start: int
    end: int


@dataclass
class Ranges(InputPartition):
    """What a task reads, one after the other."""

    ranges: list[Range]


class FrameReader(DataSourceReader):
    def __init__(self, path: str, suffix: str, split_bytes: int):
        self.path, self.suffix, self.split_bytes, self.names = path, suffix, split_bytes, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality with names of sequences chooses files; it stays a filter, too."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("seq_name",):
                self.names = {f.value} if self.names is None else self.names & {f.value}
            elif isinstance(f, In) and f.attribute == ("seq_name",):
                self.names = set(f.value) if self.names is None else self.names & set(f.value)
            yield f

    def ranges(self) -> list[Range]:
        from pyarrow import fs

        store, path = file_system(self.path)
        info = store.get_file_info(path)
        files = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        shown = [f for f in files if f.is_file and f.path.endswith(self.suffix) and not f.base_name.startswith((".", "_"))]
        chosen = [f for f in shown if self.names is None or sequence_of(f.path) in self.names]
        return [Range(f.path, sequence_of(f.path), at, min(at + self.split_bytes, f.size)) for f in chosen for at in range(0, f.size, self.split_bytes)]

    def partitions(self) -> Sequence[Ranges]:
        """Ranges in bundles: about TASKS of them, none of more than BUNDLE bytes, if a range itself is not; many small files don't make as many tasks."""
        ranges = self.ranges()
        most = min(BUNDLE, sum(r.end - r.start for r in ranges) // TASKS)
        bundles, size = [], most + 1
        for r in ranges:
            if size + r.end - r.start > most:
                bundles.append(Ranges([]))
                size = 0
            bundles[-1].ranges.append(r)
            size += r.end - r.start
        return bundles

    def read(self, partition: Ranges) -> Iterator[tuple[str, str, str]]:
        for r in partition.ranges:
            yield from self.frames_of(r)

    def frames_of(self, partition: Range) -> Iterator[tuple[str, str, str]]:
        store, _ = file_system(self.path)
        decoder, parse = codecs.getincrementaldecoder("utf-8")("ignore"), json.JSONDecoder()
        with store.open_input_file(partition.path) as f:
            f.seek(partition.start)
            text = decoder.decode(f.read(partition.end - partition.start))
            limit, at = len(text), 0
            text += decoder.decode(f.read(_MORE))
            while (key := _FRAME.search(text, at)) and key.start() < limit:
                while True:
                    try:
                        _, at = parse.raw_decode(text, key.end())
                        break
                    except json.JSONDecodeError:
                        # the list goes on behind what is read so far, or is broken
                        more = f.read(max(_MORE, len(text) - key.end()))
                        if not more:
                            raise ValueError(f"{partition.path}: frame {key[1]!r} is no list") from None
                        text += decoder.decode(more)
                yield partition.seq_name, key[1], text[key.end() : at]


class FrameSource(DataSource):
    """Format `frames`: (seq_name, frame_id, value), the list of each frame as JSON text. A file is read in ranges of splitBytes (32 MB), one after the other
    within a task, so nobody holds more than a range and one frame. Options: suffix of files (.json), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "seq_name string, frame_id string, value string"

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options["path"], self.options.get("suffix", ".json"), int(self.options.get("splitBytes", 1 << 25)))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    """Rows (name, body) as files. Tasks write beside the place, under names of their own; the commit moves what successful tasks wrote, so a task that ran twice or
    a run that failed leaves nothing there."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> Written:
        store, path = file_system(self.path)
        done, name, out = [], None, None
        for row in rows:
            if row["name"] != name:
                if out is not None:
                    out.close()
                beside, name = f"{path}/_writing/{uuid.uuid4().hex}", row["name"]
                store.create_dir(f"{path}/_writing", recursive=True)
                out = store.open_output_stream(beside)
                done.append((beside, f"{path}/{name}"))
            out.write(bytes(row["body"]))
        if out is not None:
            out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = file_system(self.path)
        store.create_dir(path, recursive=True)
        for beside, place in (f for m in messages if m for f in m.files):
            store.create_dir(place.rsplit("/", 1)[0], recursive=True)
            store.move(beside, place)
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, path = file_system(self.path)
        if store.get_file_info(f"{path}/_writing").type != fs.FileType.NotFound:
            store.delete_dir(f"{path}/_writing")


class FileSink(DataSource):
    """Format `whole_files`: writes (name string, body binary), a file for each name; rows of a name that follow each other in a task are its parts, in order."""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "name string, body binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


def read_frames(spark: SparkSession, path: str, mode: str = "unknown", suffix: str = ".json", split_bytes: int = 1 << 25) -> DataFrame:
    """Boxes as formats.read_boxes() has them, files read in ranges by several tasks each.

    All frames of a file are read, in whatever container they are; a file with several containers needs read_boxes(), which chooses one. A frame without boxes is a
    row without a box. An empty file or folder has no rows; a frame that is no list is an error. Filters by sequence choose files: the session's setting for that is switched on.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)
    frames = spark.read.format("frames").option("suffix", suffix).option("splitBytes", split_bytes).load(path)
    return boxes_of(frames, mode)


def read_odometry(spark: SparkSession, path: str, suffix: str = ".csv") -> DataFrame:
    """Poses of all files under path; a pose's frame is the number of its row in its file, below one header.

    Files are parted in blocks as Spark's scan does it. A row's number is its place in its block and the rows of the blocks before it, so the blocks of a
    file are counted apart. Blank lines don't count; a field that is no number is null.
    """
    lines = spark.read.text(path, pathGlobFilter=f"*{suffix}", recursiveFileLookup=True)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = lines.filter(F.trim("value") != "")
    counts = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("k"))
    before = counts.select("file", "block", (F.sum("k").over(W.partitionBy("file").orderBy("block")) - F.col("k")).alias("before"))
    inside = F.row_number().over(W.partitionBy("file", "block").orderBy("at"))
    rows = lines.withColumn("inside", inside).join(before, ["file", "block"]).withColumn("frame_idx", (F.col("before") + F.col("inside") - 2).cast("int"))
    name = F.coalesce(F.nullif(F.regexp_extract("file", r"/seq_name=([^/]+)/", 1), F.lit("")), F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1))
    rows = rows.filter("frame_idx >= 0").select(name.alias("seq_name"), "frame_idx", F.from_csv(F.trim("value"), _POSE).alias("p"))
    return rows.select("seq_name", "frame_idx", "p.*")
